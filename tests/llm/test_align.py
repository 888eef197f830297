"""Alignment of two tokenizers against all pairs of byte ranges; merge path against a two-pointer merge."""

import collections
import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tankline.llm import align, queries, vocab

A, B = vocab.ByteBpe(f"{queries.TOKENIZERS}/byte_bpe_50k.json"), vocab.Pieces(f"{queries.TOKENIZERS}/piece_bpe_32k.model")
ODD = [None, "", " ", "a", "x <|endoftext|> y", "　漢字 Ⅷ½ \U0001f600​ é", "  two  spaces\n\n\ttab ", "ﷺ ① ª", "\x00 nul", "a" * 300,
       "<0x41></s><s><unk>", "▁ x", "It's we'll 12,345.", "ſ ı İ ǅ", "नमस्ते กขค"]


def brute(text):
    """(n_a, n_b, groups, links as a counter of id pairs) from all pairs of byte ranges."""
    if not text:
        return 0, 0, [], collections.Counter()
    x, y = vocab._byte_bpe(A.path)[1].encode(" " + text, add_special_tokens=False).ids, B.encode([text])[0]
    want = (" " + text).encode()
    if b"".join(A.bytes[i] for i in x) != want or b"".join(B.bytes[i] for i in y) != want:
        return 0, 0, [], collections.Counter()
    ea, eb = np.cumsum([len(A.bytes[i]) for i in x]), np.cumsum([len(B.bytes[i]) for i in y])
    sa, sb = ea - [len(A.bytes[i]) for i in x], eb - [len(B.bytes[i]) for i in y]
    links = collections.Counter((x[i], y[j]) for i in range(len(x)) for j in np.flatnonzero((sb < ea[i]) & (sa[i] < eb)))
    groups, last = [], 0
    for e in sorted(set(ea) & set(eb)):
        groups.append(([x[i] for i in range(len(x)) if last < ea[i] <= e], [y[j] for j in range(len(y)) if last < eb[j] <= e]))
        last = e
    return len(x), len(y), groups, links


def written(groups):
    return ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)


def test_merge_path_equals_two_pointers():
    rng = np.random.default_rng(1)
    for n, m, piece in [(1, 1, 1), (5, 90, 7), (200, 180, 16), (300, 3, 64), (64, 64, 1000)]:
        top = 4 * max(n, m)
        a, b = (np.sort(np.append(rng.choice(top, k - 1, replace=False) + 1, top + 1)) for k in (n, m))
        want, i, j, g = [], 0, 0, 0
        while i < n:
            want.append((i, j, g))
            if a[i] == b[j]:
                i, j, g = i + 1, j + 1, g + 1
            elif a[i] < b[j]:
                i += 1
            else:
                j += 1
        assert [tuple(int(v) for v in r) for r in zip(*align.merge(a, b, piece))] == want
        d = np.arange(0, n + m, piece)
        order = np.argsort(np.concatenate([a, b]), kind="stable")  # equal ends: a first
        assert align.cut(a, b, piece).tolist() == [int((order[:k] < n).sum()) for k in d]
    assert [len(x) for x in align.merge(np.zeros(0, int), np.zeros(0, int))] == [0, 0, 0]


def test_both_engines_give_the_files_ids():
    slow = vocab._byte_bpe(A.path)[1]
    texts = [t for t in ODD if t] + ["Naïve café, l'été — déjà-vu; 3.14 don't\n\n  x", "\t\r\n \x0b\x0c a"]
    assert A.encode(texts) == [slow.encode(t, add_special_tokens=False).ids for t in texts]
    assert [x.tolist() for x in A.arrays(texts)] == A.encode(texts)
    assert vocab._byte_bpe(A.path)[2] is not None


@pytest.mark.parametrize("piece", [3, 64])
def test_alignment(spark, prose_of, piece):
    import random
    rng = random.Random(2)
    texts = [*ODD, *[prose_of(rng, rng.randint(1, 60)) for _ in range(30)]]
    texts += texts[-3:]
    d = spark.createDataFrame([(i, t, "kept") for i, t in enumerate(texts)], "doc_id long, text string, pair string").repartition(3)
    got = {r["doc_id"]: r for r in align.with_counts(align.align(d, A, B, piece=piece)).collect()}
    want = {i: brute(t) for i, t in enumerate(texts)}
    count = collections.Counter(p for _, _, _, links in want.values() for p in links)
    top = collections.Counter()
    for (a, _), n in count.items():
        top[a] = max(top[a], n)
    assert len(got) == len(texts)
    for i, (n_a, n_b, groups, links) in want.items():
        r = got[i]
        assert r["pair"] == "kept" and (r["n_a"], r["n_b"], r["n_groups"], r["n_links"]) == (n_a, n_b, len(groups), sum(links.values())), texts[i]
        assert r["groups"] == written(groups)
        assert {(p >> 20, p & 0xFFFFF): n for p, n in zip(r["pairs"], r["times"])} == dict(links)
        assert r["count_sum"] == sum(n * count[p] for p, n in links.items())
        assert r["n_best"] == sum(n for p, n in links.items() if count[p] == top[p[0]])


def test_odd_tables(spark, odd_docs, no_docs):
    docs = odd_docs.drop("n_words")
    whole = align.with_counts(align.align(docs, A, B))
    assert whole.count() == odd_docs.count()
    empty = whole.where(F.coalesce(F.length("text"), F.lit(0)) == 0).collect()
    assert empty and all(r["n_a"] == r["n_links"] == r["count_sum"] == 0 and r["groups"] == "" for r in empty)
    few = align.with_counts(align.align(docs.select("doc_id", "text"), A, B), max_rows=1)  # the shuffled way
    assert sorted(few.select("doc_id", "n_best", "count_sum").collect(), key=str) == sorted(whole.select("doc_id", "n_best", "count_sum").collect(), key=str)
    assert align.with_counts(align.align(no_docs, A, B)).count() == 0
    with pytest.raises(ValueError):
        align.align(odd_docs.withColumn("pairs", F.lit(1)), A, B)


def test_query_digest(spark):
    got = queries.op11_align(spark, "/root/testdata/sf0.001").orderBy("doc_id").limit(12).collect()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()}
    for r in got:
        s = written(brute(texts[r["doc_id"]])[2])
        assert r["groups_sha256"] == (hashlib.sha256(s.encode()).hexdigest() if s else "")
