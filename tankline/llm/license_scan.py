"""Licence scan: exact set-similarity join of text blocks against licence templates.

A template ``T`` is found in a block ``B`` when ``|T & B| >= threshold * |T|`` (sets
of lower-cased words). Blocks are windows of ``block`` words that start every
``block / 2`` words, so every passage of up to ``block / 2`` words lies whole in one.
Template words are ordered by their frequency over all documents, rarest first:

* prefix filter: a qualifying block holds one of the template's first
  ``|T| - need + 1`` words, so only those words are looked up;
* length filter: the block holds at least ``need`` template-vocabulary words;
* positional filter: the ranks of the common word leave room for ``need`` words.

Survivors are verified exactly. The phrases of ``PHRASES`` (consecutive words) are
counted at every place. No document text is shuffled: candidates are verified where
the words are, and only found labels go on.

Defined cases: a null or empty text has no words, no labels and score 0; repeated
rows are scanned one by one; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tankline.llm.common import WORD, indices, with_row_id, words

#: Phrases of the contract and their labels.
PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
#: Short licence notices.
TEMPLATES = (
    ("apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted"),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0."),
    ("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0."),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("mit", "Released under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"),
    ("mpl-2.0", "Subject to the terms of the Mozilla Public License, v. 2.0."),
)
THRESHOLD = 0.8
BLOCK = 64


def template_sets(templates) -> list[tuple[int, str, list[str]]]:
    return [(i, label, sorted(set(re.findall(WORD, text.lower())))) for i, (label, text) in enumerate(templates)]


def prefix_index(sets, freq: dict[str, int], threshold: float) -> list[tuple]:
    """Rows (token, template, label, tokens in global order, rank, size, need) for the
    prefix of every template."""
    rows = []
    for i, label, toks in sets:
        order = sorted(toks, key=lambda w: (freq.get(w, 0), w))
        need = max(1, math.ceil(threshold * len(order) - 1e-9))
        rows += [(w, i, label, order, rank, len(order), need) for rank, w in enumerate(order[: len(order) - need + 1])]
    return rows


def _phrase_at(w: Column, i: Column, phrase: str) -> Column:
    cond = F.lit(True)
    for k, part in enumerate(phrase.split()):
        cond = cond & F.coalesce(F.get(w, i + k) == part, F.lit(False))
    return cond


def _places(phrase: str, label: str) -> Column:
    """(i, label) wherever the phrase stands; ``at`` holds the places of first words."""
    return F.transform(F.filter("at", lambda i: _phrase_at(F.col("w"), i, phrase)),
                       lambda i: F.struct(i.cast("long").alias("i"), F.lit(label).alias("label")))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates=TEMPLATES, phrases=PHRASES,
         threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """One row per input row: id, n_words, n_base, first_word, last_word, base_labels and
    labels (sorted arrays), templates (array of (label, block_start, containment), the best
    block of each template), score."""
    spark = docs.sparkSession
    step = block // 2
    if step < 1 or any(len(t) > step for _, _, t in template_sets(templates)):
        raise ValueError("a template has more words than half a block")
    sets = template_sets(templates)
    vocab = sorted({w for _, _, t in sets for w in t})
    base = docs.select(F.col(id_col).alias("id"), words(F.col(text_col)).alias("w"))
    # how often each template word occurs in all documents; one row per template word
    freq = {r["t"]: r["n"] for r in base.select(F.explode(F.filter("w", lambda x: x.isin(vocab))).alias("t"))
            .groupBy("t").agg(F.count(F.lit(1)).alias("n")).collect()}
    rows = prefix_index(sets, freq, threshold)
    order = sorted(vocab, key=lambda w: (freq.get(w, 0), w))  # rarest first
    index = spark.createDataFrame(
        [(*r, order.index(r[0])) for r in rows],
        "token string, tid int, label string, tokens array<string>, i int, size int, need int, rk int")
    heads = sorted({p.split()[0] for p, _ in phrases})
    look = sorted({r[0] for r in rows} | set(heads))
    d = with_row_id(base).select("_rid", "id", "w", F.size("w").cast("long").alias("n_words"))
    d = d.withColumn("at", F.filter(indices(F.size("w")), lambda i: F.get("w", i).isin(look)))
    places = F.concat(*[_places(p, label) for p, label in phrases])
    # candidates: (token, block) of the prefix words, plus one row that keeps every document
    cand = F.flatten(F.transform(
        F.filter("at", lambda i: F.get("w", i).isin([r[0] for r in rows])),
        lambda i: F.transform(
            F.filter(F.array(F.floor(i / step) - 1, F.floor(i / step)), lambda b: b >= 0),
            lambda b: F.struct(F.get("w", i).alias("token"), b.cast("int").alias("b")))))
    none = F.array(F.struct(F.lit(None).cast("string").alias("token"), F.lit(-1).alias("b")))
    d = d.select("_rid", "id", "n_words", "w", places.alias("places"),
                 F.explode(F.concat(none, F.array_distinct(cand))).alias("c"))
    d = d.withColumn("places", F.when(F.col("c.b") < 0, F.col("places")))
    d = d.join(F.broadcast(index), F.col("c.token") == F.col("token"), "left")  # one row per prefix word
    in_block = F.array_distinct(F.filter(F.slice("w", F.col("c.b") * step + 1, block), lambda x: x.isin(vocab)))
    d = d.withColumn("bv", F.when(F.col("tid").isNotNull(), in_block))
    long_enough = F.size("bv") >= F.col("need")
    # words of the block from the common word on, in the global order: room for ``need`` matches
    room = F.size(F.filter("bv", lambda x: F.array_position(F.array(*map(F.lit, order)), x) > F.col("rk")))
    ok = long_enough & (F.col("size") - F.col("i") >= F.col("need")) & (room >= F.col("need"))
    common = F.size(F.array_intersect("tokens", "bv"))
    found = F.when(F.col("tid").isNotNull() & ok & (common >= F.col("need")),
                   F.struct((common / F.col("size")).alias("containment"), (-F.col("c.b") * step).alias("at"), "label"))
    d = d.select("_rid", "id", "n_words", "places", "tid", found.alias("found"))
    d = d.where(F.col("places").isNotNull() | F.col("found").isNotNull())
    per = (d.groupBy("_rid", "tid").agg(F.max("found").alias("found"), F.max("places").alias("places"),
                                        F.first("id").alias("id"), F.first("n_words").alias("n_words"))
           .groupBy("_rid").agg(F.max("places").alias("places"), F.first("id").alias("id"),
                                F.first("n_words").alias("n_words"), F.collect_list("found").alias("found")))
    at = F.transform("places", lambda x: x["i"])
    base_labels = F.array_sort(F.array_distinct(F.transform("places", lambda x: x["label"])))
    labels = F.array_sort(F.array_union(base_labels, F.transform("found", lambda x: x["label"])))
    best = F.coalesce(F.array_max(F.transform("found", lambda x: x["containment"])), F.lit(0.0))
    return per.select(
        F.col("id").alias(id_col), "n_words", F.size("places").cast("long").alias("n_base"),
        F.array_min(at).alias("first_word"), F.array_max(at).alias("last_word"),
        base_labels.alias("base_labels"), labels.alias("labels"),
        F.array_sort(F.transform("found", lambda x: F.struct(
            x["label"].alias("label"), (-x["at"]).alias("block_start"), x["containment"].alias("containment")))).alias("templates"),
        F.when(F.size("places") > 0, F.lit(1.0)).otherwise(best).alias("score"))
