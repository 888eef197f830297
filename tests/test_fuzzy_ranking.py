"""Exact similarity join against all pairs; representative rule; distributed ranks."""

import random

import pandas as pd

from tankline.operators import fuzzy as FZ
from tankline.operators.ranking import cumulative_by_key, dense_rank_keys, rank_within_group


def _lev(a, b):
    prev = list(range(len(b) + 1))
    for i, ca in enumerate(a, 1):
        cur = [i]
        for j, cb in enumerate(b, 1):
            cur.append(min(prev[j] + 1, cur[j - 1] + 1, prev[j - 1] + (ca != cb)))
        prev = cur
    return prev[-1]


def test_similar_pairs_exact(spark):
    rnd = random.Random(1)
    base = ["".join(rnd.choice("abcde ") for _ in range(rnd.randrange(3, 25))).strip() or "a" for _ in range(60)]
    words = set(base)
    for w in base[:30]:  # near copies
        i = rnd.randrange(len(w))
        words.add(w[:i] + rnd.choice("xyz") + w[i + 1:])
        words.add(w + "s")
    words = sorted(words)
    for t in (80.0, 90.0):
        got = {(r.a, r.b) for r in FZ.similar_pairs(spark.createDataFrame([(w,) for w in words], "norm string"),
                                                   "norm", t).collect()}
        want = {(a, b) for i, a in enumerate(words) for b in words[i + 1:]
                if 100 * _lev(a, b) <= (100 - t) * max(len(a), len(b))}
        assert got == want


def test_consolidation_last_writer_one_hop(spark):
    # edge_names: chain A~B~C with A not ~ C; case-only variant; null
    rows = [(1, "abcdefghij"), (2, "abcdefghiX"), (3, "abcdefghXX"), (4, "ABCDEFGHIJ"), (5, None)]
    df = spark.createDataFrame(rows, "id int, name string")
    got = {r.name: r.representative for r in FZ.consolidate_names(df, "name", "id", threshold=90.0).collect()}
    # A (1) ~ B (2) and case variant (4); B ~ A, C; C ~ B only. Latest first-seen wins, one hop.
    assert got["abcdefghij"] == "ABCDEFGHIJ"
    assert got["ABCDEFGHIJ"] == "ABCDEFGHIJ"
    assert got["abcdefghiX"] == "ABCDEFGHIJ"
    assert got["abcdefghXX"] == "abcdefghXX"
    assert None not in got
    strict = {r.name: r.representative for r in
              FZ.consolidate_names(df, "name", "id", threshold=90.0, strict_reference=True).collect()}
    assert strict["abcdefghij"] == "abcdefghiX"  # the case variant scores 100 and is not merged


def test_rank_within_group_skewed(spark):
    rnd = random.Random(2)
    rows = [(i, "hot" if rnd.random() < 0.7 else rnd.choice("abc"), rnd.random()) for i in range(3000)]
    df = spark.createDataFrame(rows, "id int, g string, o double").repartition(7)
    got = {r.id: r.rank for r in rank_within_group(df, "g", "o").collect()}
    pdf = pd.DataFrame(rows, columns=["id", "g", "o"])
    pdf["rk"] = pdf.groupby("g")["o"].rank(method="first").astype(int)
    assert all(got[i] == rk for i, rk in zip(pdf.id, pdf.rk))


def test_cumulative_and_dense_rank(spark):
    rows = [(float(i % 37), 1, i % 2) for i in range(500)]
    df = spark.createDataFrame(rows, "s double, one long, pos long").groupBy("s").sum("one", "pos") \
        .withColumnRenamed("sum(one)", "n").withColumnRenamed("sum(pos)", "p")
    got = {r.s: (r.cum_n, r.cum_p) for r in cumulative_by_key(df, "s", ["n", "p"], descending=True).collect()}
    pdf = df.toPandas().sort_values("s", ascending=False)
    for s, cn, cp in zip(pdf.s, pdf.n.cumsum(), pdf.p.cumsum()):
        assert got[s] == (cn, cp)
    ranks = {r.k: r.rank for r in dense_rank_keys(spark.createDataFrame([(x,) for x in [5, 3, 3, 9, None, 1]],
                                                                         "k int"), "k").collect()}
    assert ranks == {1: 1, 3: 2, 5: 3, 9: 4}


def test_names_that_share_a_frequent_word(spark):
    import random

    from tankline.operators.fuzzy import similar_pairs

    rng = random.Random(12)
    names = {"service station " + "".join(rng.choice("abcdefgh") for _ in range(rng.randint(5, 14))) for _ in range(250)}
    for n in rng.sample(sorted(names), 60):  # one or two edits
        for _ in range(rng.randint(1, 2)):
            i = rng.randrange(len(n))
            n = rng.choice([n[:i] + n[i + 1 :], n[:i] + "x" + n[i:], n[:i] + "y" + n[i + 1 :]])
        names.add(n)
    names |= {"a", "b", "ab", "ba", "abc", "abd", "xbcd", "", "service station"}
    names = sorted(names)

    def lev(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    for threshold in (95.0, 88.0, 50.0):
        use = names if threshold > 80 else sorted({n for n in names if len(n) < 5} | set(names[:15]))
        want = {(a, b) for i, a in enumerate(use) for b in use[i + 1 :]
                if a and b and 100 * lev(a, b) <= (100 - threshold) * max(len(a), len(b))}
        d = spark.createDataFrame([(n,) for n in use], "norm string")
        assert {(r.a, r.b) for r in similar_pairs(d, threshold=threshold).collect()} == want
