"""Linear-chain CRF against enumeration; line quality and word languages."""

import itertools
import random

import numpy as np
from pyspark.sql import functions as F

from tankline.llm import crf, langid, quality_crf


def test_marginals_match_enumeration():
    rng = np.random.default_rng(1)
    k, lengths = 3, np.array([1, 4, 0, 5, 2])
    e, t, s = rng.normal(size=(12, k)), rng.normal(size=(k, k)), rng.normal(size=k)
    got, xi, log_z = crf.marginals(e, t, s, lengths, edges=True)
    want, pairs, total, at = np.zeros_like(e), np.zeros((k, k)), 0.0, 0
    for n in lengths:
        z, g, p = 0.0, np.zeros((n, k)), np.zeros((k, k))
        for path in itertools.product(range(k), repeat=int(n)) if n else ():
            w = np.exp(s[path[0]] + sum(e[at + i, y] for i, y in enumerate(path)) + sum(t[a, b] for a, b in zip(path, path[1:])))
            z += w
            for i, y in enumerate(path):
                g[i, y] += w
            for a, b in zip(path, path[1:]):
                p[a, b] += w
        if n:
            want[at : at + n], pairs, total, at = g / z, pairs + p / z, total + np.log(z), at + n
    assert np.allclose(got, want) and np.allclose(xi, pairs) and np.isclose(log_z, total)
    long = rng.normal(size=(5000, k)) * 30  # far from 0: no overflow, rows sum to 1
    assert np.allclose(crf.marginals(long, t * 20, s, np.array([4000, 1000])).sum(axis=1), 1)


def test_blocks_do_not_matter():
    rng = np.random.default_rng(2)
    e, t, s = rng.normal(size=(700, 2)), rng.normal(size=(2, 2)), rng.normal(size=2)
    whole = crf.marginals(e, t, s, np.array([300, 400]))
    assert np.allclose(whole, np.vstack([crf.marginals(e[:300], t, s, np.array([300])), crf.marginals(e[300:], t, s, np.array([400]))]))


def test_fit_learns_transitions():
    rng = np.random.default_rng(3)
    y = [0]
    for _ in range(1999):
        y.append(y[-1] if rng.random() < 0.9 else 1 - y[-1])
    y = np.array(y)
    x = (y + rng.normal(size=2000) * 1.5)[:, None]
    em = lambda th: np.hstack([np.zeros((2000, 1)), x * th[0] + th[1]])
    th, t, s = crf.fit(em, lambda d: np.array([(x[:, 0] * d[:, 1]).sum(), d[:, 1].sum()]), np.zeros(2), 2, y, np.array([2000]))
    assert t[0, 0] > t[0, 1] + 1 and t[1, 1] > t[1, 0] + 1
    alone = ((x[:, 0] * th[0] + th[1] > 0) == y).mean()
    assert (crf.marginals(em(th), t, s, np.array([2000])).argmax(axis=1) == y).mean() > alone + 0.05


def junk(rng, prose_of):
    w = prose_of(rng, 30).split()
    return rng.choice([" | ".join(w), "!! ".join(x.upper() for x in w), " ".join(x + rng.choice(["###", "***", "%%%"]) for x in w),
                       " ".join(x for x in w[:6] for _ in range(6))])


def test_quality(spark, odd_docs, no_docs, prose_of):
    rng, rows = random.Random(6), []
    for i in range(400):
        lines, bad = [prose_of(rng, rng.randint(5, 25)) for _ in range(rng.randint(1, 8))], i % 3 == 0
        if bad:
            lines[rng.randrange(len(lines)) :] = [junk(rng, prose_of) for _ in range(rng.randint(2, 6))]
        rows.append((i, "\n".join(lines), int(not bad)))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, q, 0) for i, _, q in rows] + [(1, 0, 0), (None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    learn = ~quality_crf.held_out(F.col("_id"), 3, 1)
    model = quality_crf.fit(docs, labels, learn=learn)
    got = quality_crf.score(docs, model).withColumn("held", quality_crf.held_out(F.col("doc_id"), 3, 1)).collect()
    right = [(r["score"] >= 0.5) == bool(rows[r["doc_id"]][2]) for r in got if r["held"]]
    assert len(right) > 80 and np.mean(right) > 0.95
    # lines of a mixed text are told apart
    x, size = quality_crf.text_features("\n".join([prose_of(rng, 15), prose_of(rng, 15), junk(rng, prose_of), junk(rng, prose_of)]))
    p = model.line_marginals(x, np.array([4]))
    assert min(p[:2]) > 0.5 > max(p[2:])
    odd = quality_crf.score(odd_docs, model, out="s")
    assert odd.columns == [*odd_docs.columns, "s"]
    for r in odd.collect():
        assert 0 <= r["s"] <= 1 and ((r["text"] or "").strip() or r["s"] == 0)
    assert quality_crf.score(no_docs, model, out="s").count() == 0
    assert len({tuple(r) for r in quality_crf.score(docs, quality_crf.fit(docs, labels, learn=learn)).collect()} ^ {tuple(r)[:3] for r in got}) == 0
    none = quality_crf.fit(no_docs, labels.limit(0))
    assert {r["s"] for r in quality_crf.score(docs, none, out="s").collect()} == {0.5}


def test_quality_sample_is_of_the_given_documents_and_both_labels(spark, prose_of):
    rng = random.Random(9)
    labels = spark.createDataFrame([(i, int(i % 50 > 0), 0) for i in range(2000)], "doc_id long, quality int, toxic int")
    # an earlier stage left every tenth document; 40 of these 200 are bad
    docs = spark.createDataFrame([(i, prose_of(rng, 8)) for i in range(0, 2000, 10)] + [(10, "a copy")], "doc_id long, text string")
    sample = quality_crf.training_sample(docs, labels, "doc_id", "text", "quality", 60, None).collect()
    assert sorted(r["y"] for r in sample) == [0] * 30 + [1] * 30
    few = quality_crf.training_sample(docs, labels, "doc_id", "text", "quality", 1000, None).collect()
    assert sorted(r["y"] for r in few) == [0] * 40 + [1] * 160
    one = quality_crf.fit(docs, labels.where("quality = 1"))
    assert not one.learned
    lines = spark.createDataFrame([(i, "\n".join(prose_of(rng, 5) for _ in range(30))) for i in range(2)], "doc_id long, text string")
    assert quality_crf.fit(lines, labels, max_lines=3).learned


SYL = {"xx": "ka to mi nu ra se ho ki", "yy": "bol dren gast vurk plin stof", "zz": "eau oui tre ille ance ment"}


def sentence(rng, lang, n):
    return " ".join("".join(rng.choice(SYL[lang].split()) for _ in range(rng.randint(1, 3))) for _ in range(n))


def test_languages(spark, odd_docs, no_docs):
    rng = random.Random(8)
    rows = [(i, sentence(rng, lang, rng.randint(3, 60)), lang) for i in range(300) for lang in [rng.choice(sorted(SYL))]]
    docs = spark.createDataFrame([*rows, (999, "ka to mi", None)], "doc_id long, text string, lang string")
    held = quality_crf.held_out(F.col("doc_id"), 5, 0)
    model = langid.fit(docs.where(~held))
    assert model.langs == sorted(SYL)
    got = langid.predict(docs.where(held).where("lang is not null"), model, out="p").collect()
    assert len(got) > 30 and np.mean([r["p"]["lang"] == r["lang"] for r in got]) > 0.95
    # code-switched text: every word gets its own language
    spans = [(lang, sentence(rng, lang, rng.randint(5, 15)).split()) for _ in range(40) for lang in [rng.choice(sorted(SYL))]]
    mixed = spark.createDataFrame([(1, " ".join(w for _, ws in spans for w in ws))], "doc_id long, text string")
    labelled = langid.label_words(mixed, model).first()["words"]
    gold = [lang for lang, ws in spans for _ in ws]
    assert [x["word"] for x in labelled] == [w for _, ws in spans for w in ws]
    assert np.mean([x["lang"] == g for x, g in zip(labelled, gold)]) > 0.9
    odd = langid.predict(odd_docs.drop("lang"), model, out="p").collect()
    for r in odd:
        assert (r["p"]["lang"] == "und") == (not any(c.isalpha() for c in r["text"] or "")) and 0 <= r["p"]["score"] <= 1
    assert langid.predict(no_docs, model, out="p").count() == 0
    assert langid.predict(odd_docs, langid.fit(no_docs), out="p").where("p.lang <> 'und'").count() == 0


def test_cell_counts_cover_every_document(spark):
    rows = [(i, "ab cd" if i % 2 else "ab", "l%d" % (i % 2)) for i in range(50)]
    c = langid.count_cells(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(7), "text", "lang")
    lex = langid.word_cells("ab")[0][0]
    assert {r["lang"]: r["n"] for r in c.where(F.col("cell") == lex).collect()} == {"l0": 25, "l1": 25}


def test_numerals_are_no_letters_and_long_runs_count_whole():
    assert langid.words_of("½ ² Ⅷ ③ 12 _") == [] and langid.words_of("a½b Ⅷé") == ["a", "b", "é"]
    long = "ab" * 200
    assert len(langid.word_cells(long)[2]) == 399 + 398  # all pairs and triples, the middle too
    words = ["a", "ab", "été", long, "漢字"]
    together = langid.cells_of(words)
    for g in range(3):
        for i, w in enumerate(words):  # no matter what is hashed beside it
            assert together[g][0][together[g][1] == i].tolist() == list(langid.word_cells(w)[g])
    assert langid.word_cells("abc")[0] != langid.word_cells("acb")[0]


def test_language_sample_has_rare_languages_and_no_copies(spark):
    rows = [("aa", f"text {i}") for i in range(300)] + [("aa", "same")] * 50 + [("bb", f"rare {i}") for i in range(4)] + [("aa", None)]
    d = spark.createDataFrame(rows, "lang string, text string").repartition(5)
    got = langid.sample_keys(d, "text", "lang", 20).collect()
    assert len(got) == len({r["h"] for r in got}) == 20 and sum(r["lang"] == "bb" for r in got) == 4


def test_rescaling_doesnt_change_marginals():
    rng = np.random.default_rng(4)
    e, t, s = rng.normal(size=(400, 4)) * 20, rng.normal(size=(4, 4)) * 8, rng.normal(size=4)
    assert np.allclose(crf.marginals(e, t, s, np.array([150, 250])), crf.marginals(e, t, s, np.array([150, 250]), edges=True)[0])
