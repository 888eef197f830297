"""Importance resampling against a plain computation; the selection against sorting."""

import collections
import hashlib
import math
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from tankline.llm import resample
from tankline.llm.common import LOWER, UPPER, WORD


def runs(text, n):
    w = re.findall(WORD, (text or "").translate(str.maketrans(UPPER, LOWER)))
    return w, [" ".join(w[i : i + k]) for k in range(1, n + 1) for i in range(len(w) - k + 1)]


def plain(docs, target, n=1, buckets=10_000, seed=2024, percent=10, min_words=20):
    def count(texts):
        return collections.Counter(zlib.crc32(f.encode()) % buckets for t in texts for f in runs(t, n)[1])

    s, t = count(x for _, x in docs), count(target)
    a, b = sum(s.values()) + buckets, sum(t.values()) + buckets
    rows = []
    for k, (i, text) in enumerate(docs):
        w, f = runs(text, n)
        weight = sum(math.floor(1000 * math.log(((t[x] + 1) * a) / ((s[x] + 1) * b))) for x in (zlib.crc32(y.encode()) % buckets for y in f))
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, len(w), len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, k])
    pool = sorted((r for r in rows if r[1] >= min_words), key=lambda r: (-r[4], r[0] is None, r[0] or 0, r[6]))
    for place, r in enumerate(pool[: percent * len(pool) // 100]):
        r[5] = place + 1
    return rows


@pytest.mark.parametrize("n,buckets,finish", [(1, 10_000, 4096), (2, 500, 3)])
def test_equals_plain(spark, prose_of, n, buckets, finish, monkeypatch):
    rng = random.Random(3)
    docs = [(i, prose_of(rng, rng.randint(0, 60))) for i in range(300)] + [(300, None), (301, "É ÀB x " * 10), (302, "")]
    target = [prose_of(rng, 30) for _ in range(20)] + [None]
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(7)
    t = spark.createDataFrame([(i, x) for i, x in enumerate(target)], "item_id long, text string")
    model = resample.fit(d, t, max_run=n, buckets=buckets)
    got = resample.draw(resample.weigh(d, model), finish=finish)
    want = plain(docs, target, n, buckets)
    assert sorted(tuple(r[c] for c in ("id", "n_words", "n_features", "weight", "score", "rank")) for r in got.collect()) == sorted(
        (tuple(r[:6]) for r in want), key=lambda r: r[0])
    assert sum(r[5] is not None for r in want) > 20


def test_cutoff_equals_sorting(spark):
    rng = random.Random(4)
    keys = [(rng.randrange(40), rng.randrange(3), i) for i in range(3000)]
    d = spark.createDataFrame(keys, "a long, b long, c long")
    skewed = d.repartitionByRange(6, "a").cache()  # partitions of different sizes and ranges
    want = sorted(keys)
    for k in (1, 2, 1500, 2999, 3000):
        assert resample.cutoff(skewed, k, finish=20) == want[k - 1]
    assert resample.cutoff(skewed, 0) is None
    with pytest.raises(ValueError):
        resample.cutoff(skewed, 3001)


def test_odd_tables(spark, odd_docs, no_docs):
    t = spark.createDataFrame([(1, "word and more")], "item_id long, text string")
    got = resample.resample(odd_docs, t, percent=50, carry=True)
    rows = got.collect()
    assert len(rows) == odd_docs.count() and set(rows[0]["row"].asDict()) == set(odd_docs.columns)
    assert all(r["weight"] == r["n_features"] == 0 and r["rank"] is None for r in rows if not r["row"]["text"])
    drawn = sorted(r["rank"] for r in rows if r["rank"])
    assert drawn == list(range(1, sum(r["n_words"] >= 20 for r in rows) // 2 + 1)) and drawn
    same = spark.createDataFrame([(5, "the same words " * 10)] * 30, "doc_id long, text string")  # all keys tie but for the row
    assert resample.resample(same, t).where("rank is not null").count() == 3
    assert resample.resample(no_docs, t).count() == 0
    assert resample.resample(odd_docs, no_docs).where(F.col("weight").isNull()).count() == 0
