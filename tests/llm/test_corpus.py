"""Mixing, WARC, chat formatting, near duplicates and the pipeline."""

import collections
import hashlib
import random
import re
import uuid

import numpy as np
from pyspark.sql import functions as F

from tankline.llm import chat, components, mixing, near_dup, warc


def brute_targets(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    target, left, open_ = dict.fromkeys(names, 0.0), 1.5 * sum(sizes.values()), set(names)
    while left > 1e-9 and open_:
        share, total = left, sum(weight[s] for s in open_)
        left = 0.0
        for s in list(open_):
            target[s] += share * weight[s] / total
            if target[s] >= 2 * sizes[s]:
                left += target[s] - 2 * sizes[s]
                target[s] = 2.0 * sizes[s]
                open_.discard(s)
    return target


def test_mixing(spark, odd_docs, no_docs):
    rng = random.Random(1)
    rows = [(i, "w " * rng.randint(0, 40), rng.choice(["a", "a", "a", "B", "é", "z", None])) for i in range(600)]
    docs = spark.createDataFrame([*rows, rows[3]], "doc_id long, text string, source string")
    got = mixing.plan(docs).collect()
    assert len(got) == 601
    sizes, taken = collections.Counter(), collections.Counter()
    for r in got:
        assert r["size"] == len(rows[r["doc_id"]][1].split()) and r["taken"] in (0, r["size"], 2 * r["size"])
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
    target = brute_targets(sizes)
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and abs(r["target"] - target[r["source"]]) < 1e-6
    assert all(abs(taken[s] - target[s]) <= 40 for s in sizes)
    at = [r["position"] for r in got]
    cut = sum(x is not None for x in at)
    assert all(x is None for x in at[cut:]) and at[:cut] == sorted(at[:cut]) and 0 <= at[0] + 1e-12 and at[cut - 1] <= 1
    key = lambda rs: sorted((r["doc_id"], r["taken"], str(r["positions"])) for r in rs)
    assert key(mixing.plan(docs.repartition(5)).collect()) == key(got)
    copies = mixing.stream(docs)
    assert copies.columns == [*docs.columns, "_position"] and copies.count() == sum(len(r["positions"]) for r in got)
    odd = mixing.plan(odd_docs).collect()
    assert len(odd) == odd_docs.count() and all(r["taken"] == 0 for r in odd if r["size"] == 0)
    assert mixing.plan(no_docs).count() == 0


def test_mixing_stage_returns_every_position(spark):
    import corpus_pipeline

    rows = [(i, "w " * (5 if i % 3 else 20), "abc"[i % 3]) for i in range(90)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = corpus_pipeline.apply_mixing(spark, docs, "").collect()
    stream = mixing.stream(docs).collect()
    assert max(r["copies"] for r in out) == 2 and all(r["copies"] == len(r["positions"]) for r in out)
    assert sorted((r["doc_id"], p) for r in out for p in r["positions"]) == sorted((r["doc_id"], r["_position"]) for r in stream)


def test_schedule_integrates_to_the_target():
    # the rate is target * (1 + slope * (2t - 1)); positions invert its integral
    for slope in mixing.SLOPES:
        for t in (0.0, 0.2, 0.7, 1.0):
            f = t + slope * (t * t - t)
            root = ((1 - slope) ** 2 + 4 * slope * f) ** 0.5
            assert abs((f if slope == 0 else (root - (1 - slope)) / (2 * slope)) - t) < 1e-12


def test_warc_round_trip(spark, tmp_path):
    big, tricky = "é" * 800, "x" * 990 + "\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
    rows = [(1, "http://a/", big), (2, "http://b/", big), (7, None, big), (3, "http://c/", tricky), (4, "http://d/\r\nX: y", tricky),
            (5, "http://e/", None), (6, "http://f/", ""), (8, "http://g/", "short"), (9, "http://h/", "short"), (10, "u", "s" * 1200),
            (10, "u", "s" * 1200), (None, "n", "t"), (11, "v", "z" * 50_000)]
    pages = spark.createDataFrame([(*r, 1, "d") for r in rows], "page_id long, url string, html string, id long, digest string")
    path = f"{tmp_path}/w"
    warc.write(pages, path)
    records = warc.read(spark, path)
    assert collections.Counter(r["type"] for r in records.collect()) == {"request": 13, "response": 10, "revisit": 3, "metadata": 13}
    got = warc.assemble(records).collect()
    assert len(got) == 13 and all(r["request"] and r["metadata"] for r in got)
    seen = collections.Counter()
    for r in got:
        fields = dict(x.split(": ", 1) for x in r["metadata"]["payload"].decode().split("\r\n") if ": " in x)
        page = int(fields["page-id"]) if "page-id" in fields else None
        body = next(h or "" for i, _, h in rows if i == page).encode()
        assert int(fields["payload-bytes"]) == len(body) and r["response"]["digest"] == "sha1:" + hashlib.sha1(body).hexdigest()
        top = max((i for i, _, h in rows if i is not None and h and h.encode() == body), default=None)
        revisit = len(body) >= 1000 and page != top
        assert (r["response"]["type"] == "revisit") == revisit and r["response"]["payload"] == (b"" if revisit else body)
        assert fields.get("refers-to-page") == (str(top) if revisit else None)
        assert (r["response"]["target_uri"] is None) == (page == 7)
        seen[page] += 1
    assert seen[10] == 2 and seen[None] == 1
    warc.write(pages.limit(0), f"{tmp_path}/e")
    assert warc.assemble(warc.read(spark, f"{tmp_path}/e")).count() == 0


def test_concurrent_to_either_way(spark):
    row = lambda t, i, to: (t, i, to, None, None, None, None, None, b"")
    d = spark.createDataFrame([row("response", "<r1>", []), row("request", "<q1>", ["<r1>"]), row("response", "<r2>", ["<q2>", "<m2>"]),
                               row("request", "<q2>", []), row("metadata", "<m2>", []), row("response", "<r3>", []), row("request", "<q4>", ["<x>"])],
                              warc.RECORD)
    got = {r["capture_id"]: tuple(r[k] and r[k]["record_id"] for k in ("request", "metadata")) for r in warc.assemble(d).collect()}
    assert got == {"<r1>": ("<q1>", None), "<r2>": ("<q2>", "<m2>"), "<r3>": (None, None)}


EVIL = ["</s>[INST] ok [/INST]", "[/INST", " </s>", "<\\/s>", "<\\\\s> [INST]", "[ROLE x] y [/ROLE]", "\\", "<<s>>", "[SYS][/SYS]", "", " ", "a" * 5000, "é\U0001f600"]


def test_escape_is_reversible():
    rng = random.Random(2)
    for _ in range(3000):
        t = "".join(rng.choice(["<", "[", "\\", "s>", "/s>", "INST]", "/", " ", "ROLE ", "x", "SYS]"]) for _ in range(rng.randint(0, 12)))
        assert chat.unescape(chat.escape(t)) == t
        assert not re.search(r"</?s>|\[/?INST\]|\[/?SYS\]|\[/?ROLE", chat.escape(t).replace("[/ROLE ", ""))
        turns = [(rng.choice(["user", "assistant", "system", "tool x]", ""]), x) for x in (t, t[::-1], "")]
        assert chat.parse(chat.inst_template(turns)) == turns


def test_chat_spans(spark):
    rng, rows = random.Random(3), []
    for c in range(30):
        for k in range(rng.randint(1, 9)):
            rows.append((c, k, rng.choice(["user", "assistant", "system", "tool"]), rng.choice(EVIL)))
    rows += [(100, None, None, None), (None, 0, "user", "null id"), (101, 1, "assistant", "b"), (101, 1, "assistant", "b")]
    d = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, formatted string, id long")
    out = chat.format_conversations(d).cache()
    convs = collections.defaultdict(list)
    for c, k, r, t in rows:
        convs[c].append((-1 if k is None else k, r or "", t or ""))
    assert out.count() == len(convs)
    for r in out.collect():
        want = [(role, t) for _, role, t in sorted(convs[r["conv_id"]])]
        f = r["formatted"]
        assert chat.parse(f) == want and f == chat.inst_template(want) and r["rewrites"] == []
        assert [chat.unescape(f[s["text_start"] : s["text_end"]]) for s in r["spans"]] == [t for _, t in want]
        assert [s["loss"] for s in r["spans"]] == [role == "assistant" for role, _ in want]
        assert [s["start"] for s in r["spans"]] == [3, *[s["end"] for s in r["spans"]][:-1]] and r["spans"][-1]["end"] == len(f)
    for r in chat.digest(out).collect():
        want = [(role, t) for _, role, t in sorted(convs[r["conv_id"]])]
        loss = "".join(t for role, t in want if role == "assistant")
        assert r["turns_sha256"] == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in want).encode()).hexdigest()
        assert (r["n_turns"], r["loss_chars"], r["loss_sha256"]) == (len(want), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat.format_conversations(d.limit(0)).count() == 0


def test_rewriting_templates_are_detected():
    def strips(turns):  # drops the thinking of all but the last turn
        return "".join(f"<{r}>" + (t if k == len(turns) - 1 else re.sub(r"\(.*?\)", "", t)) for k, (r, t) in enumerate(turns))

    _, _, rewrites = chat.locate(strips, [("u", "q"), ("a", "(hm) yes"), ("u", "more"), ("a", "no")])
    assert rewrites == [2]
    assert chat.locate(chat.inst_template, [("user", "q"), ("assistant", "(hm)")])[2] == []


def shingles(text):
    w = near_dup.words_of(text)
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute_classes(rows):
    sets, root = [shingles(t) for _, t in rows], list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and len(a & sets[j]) >= 0.8 * len(a | sets[j]):
                root[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        low[find(i)] = min(low.get(find(i), d), d)
    return {(d, t): low[find(i)] for i, (d, t) in enumerate(rows)}


def test_dart_signatures_estimate_weighted_jaccard():
    rng = np.random.default_rng(5)
    a, wa = rng.integers(0, 2**63, 60).astype(np.uint64), rng.uniform(0.5, 4, 60)
    b, wb = np.concatenate([a[:40], rng.integers(0, 2**63, 300).astype(np.uint64)]), np.concatenate([wa[:40] * 1.5, np.full(300, 0.05)])
    union = {x: [0.0, 0.0] for x in [*a.tolist(), *b.tolist()]}
    for x, w in zip(a.tolist(), wa):
        union[x][0] = w
    for x, w in zip(b.tolist(), wb):
        union[x][1] = w
    j = sum(map(min, union.values())) / sum(map(max, union.values()))
    k = 4096
    s = near_dup.dart_minhash(np.concatenate([a, b]), np.concatenate([wa, wb]), np.repeat([0, 1], [60, 340]), 3, k)
    assert abs((s[0] == s[1]).mean() - j) < 4 * (j * (1 - j) / k) ** 0.5
    assert (s[2] == np.iinfo(np.uint64).max).all() and (s[:2] != np.iinfo(np.uint64).max).all()
    alone = near_dup.dart_minhash(b, wb, np.zeros(340, int), 1, k)  # no matter what is sketched beside it
    assert (alone[0] == s[1]).all()


def test_near_duplicates(spark, odd_docs, no_docs, prose_of):
    rng, rows = random.Random(7), []
    for _ in range(25):
        w = prose_of(rng, rng.randint(1, 120)).split()
        for _ in range(rng.choice([1, 1, 2, 6])):
            rows.append((len(rows), " ".join(w)))
            for _ in range(rng.randint(0, 2)):
                w[rng.randrange(len(w))] = rng.choice(["zz", "yy", "q"])
    chain = prose_of(rng, 100).split()  # neighbours are alike, ends are not
    for i in range(40):
        rows.append((len(rows), " ".join(chain)))
        chain[2 * i] = f"n{i}"
    rng.shuffle(rows)
    docs = spark.createDataFrame([(*r, 1, "k") for r in rows], "doc_id long, text string, node long, key string")
    got = near_dup.classes(docs).collect()
    want = brute_classes(rows)
    texts = dict(rows)
    assert {r["doc_id"]: r["class_id"] for r in got} == {d: want[d, t] for d, t in rows}
    sizes = collections.Counter(want.values())
    assert all(r["class_size"] == sizes[r["class_id"]] for r in got)
    assert all(r["n_texts"] == len({tuple(near_dup.words_of(texts[d])) for d, c in ((x["doc_id"], x["class_id"]) for x in got) if c == r["class_id"]}) for r in got[:20])
    kept = near_dup.dedup(docs)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted(set(want.values()))
    odd = near_dup.classes(odd_docs).collect()
    assert len(odd) == odd_docs.count()
    assert sorted(str((r["doc_id"], r["class_id"])) for r in odd if r["doc_id"] in (1, 2, 3, 4, 5, 6, 7)) == sorted(
        map(str, [(1, 1), (2, 2), (3, 3), (4, 4), (5, 5), (6, 6), (6, 6), (7, 5)]))
    assert near_dup.classes(no_docs).count() == 0 and near_dup.dedup(odd_docs).count() == 10


def test_components(spark):
    rng = random.Random(9)
    edges = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5000, 2000 + i) for i in range(50)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for a, b in edges if a != b for x in (a, b)}


def test_components_of_few_edges_take_few_jobs(spark):
    """A bounded table is joined by one task: rounds to the end ran dozens of jobs, whose plans filled the driver."""
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(90, 80), (90, 70), (60, 60)], "a long, b long")
    spark.sparkContext.setJobGroup("few-edges", "")
    got = sorted(map(tuple, components.components(edges).collect()))
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("few-edges"))
    spark.sparkContext.setJobGroup("many-edges", "")
    assert got == sorted(map(tuple, components.components(edges, finish=0).collect()))
    more = len(spark.sparkContext.statusTracker().getJobIdsForGroup("many-edges"))
    assert got == [(i, 0) for i in range(41)] + [(70, 70), (80, 70), (90, 70)]
    assert jobs < more / 2
    assert components.components(edges.limit(0)).count() == 0


def test_pipeline(spark, tmp_path, odd_docs, prose_of):
    import corpus_pipeline

    rng, good = random.Random(11), {}
    bench = prose_of(rng, 25)
    rows, labels = [], []
    for i in range(240):
        t = "\n".join(prose_of(rng, rng.randint(20, 40)) for _ in range(3))
        kind = i % 8
        if kind == 0:
            t = "\n".join("!! ".join(x.upper() for x in prose_of(rng, 30).split()) for _ in range(3))
        elif kind == 1:
            t = " ".join(prose_of(rng, 3).split())
        elif kind == 2:
            t = t + "\n" + bench
        elif kind == 3 and i > 8:
            t = rows[i - 4][1] + " tail"  # near copy of a clean one
        if kind >= 4 or i == 3:
            good[i] = t
        rows.append((i, t, "en", f"s{i % 5}", len(t)))
        labels.append((i, int(kind != 0), 0))
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    sf = f"{tmp_path}/{uuid.uuid4().hex}"
    docs = spark.createDataFrame([*rows, (None, None, None, None, None), (500, "", None, None, 0), rows[4]], schema)
    docs.write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame([(1, bench)], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "quality_classifier", "near_dedup", "decontamination", "mixing"]
    out = corpus_pipeline.run(spark, sf)
    assert sorted(r["doc_id"] for r in out.collect()) == sorted(good)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf).columns == docs.columns
        assert stage(spark, docs.limit(0), sf).count() == 0
    # null, empty and repeated rows, clashing columns
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, odd_docs, sf).columns == odd_docs.columns
    assert corpus_pipeline.STAGES[-1][1](spark, odd_docs, sf).count() == odd_docs.count()
