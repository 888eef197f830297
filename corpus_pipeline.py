"""The corpus pipeline: documents in, a mixing plan out.

Every stage takes (spark, docs, sf_dir), works on all rows its predecessor kept, and is
written as Parquet in the shared folder before the next one reads it. The first four
return the columns of documents, the last one row per remaining document with all its
places in the training stream: ``copies`` of them in the array ``positions``, none for a
document that the mix leaves out. Rows are in the order of the first; exploding
``positions`` gives the stream.

Documents are known by doc_id. Nulls, empty texts, repeated rows, empty tables and
further columns are treated as each operator's docstring says: quality rules reject
texts of fewer than 20 words (null and empty ones among them), the classifier sees
the rest, near-dedup keeps one row per class and one of rows that repeat an id and
its text, decontamination drops every row with a contaminated id.
"""

from __future__ import annotations

import uuid
import warnings

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tankline.llm import decontam, mixing, near_dup, quality_crf, quality_rules
from tankline.llm.common import read
from tankline.session import ensure_checkpoint_dir


def apply_quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = quality_rules.fit_llr(quality_rules.trusted_flag(docs, read(spark, sf_dir, "labels")), "_trusted")
    return quality_rules.kept_rows(quality_rules.judge(docs, model))


def apply_quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns from the labelled rows of the source table, as the rules have left hardly a bad one,
    and judges the remaining documents. Without labels of both kinds there is nothing to
    learn: every text with a line scores 0.5 and is kept, with a warning."""
    source = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality_crf.fit(source, read(spark, sf_dir, "labels"), learn=~quality_crf.held_out(F.col("_id"), 3, 1))
    if not model.learned:
        warnings.warn("quality_classifier: no labels of both kinds in the documents table; every text with a line is kept")
    out = "_score" + uuid.uuid4().hex
    return quality_crf.score(docs, model, out=out).where(F.col(out) >= 0.5).drop(out)


def apply_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dup.dedup(docs)


def apply_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.clean(docs, read(spark, sf_dir, "benchmark"))


def apply_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.plan(docs)


STAGES = [
    ("quality_rules", apply_quality_rules),
    ("quality_classifier", apply_quality_classifier),
    ("near_dedup", apply_near_dedup),
    ("decontamination", apply_decontamination),
    ("mixing", apply_mixing),
]
#: Hashed n-grams, a learned classifier and signatures are not SQL; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = f"{ensure_checkpoint_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs = read(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{root}/{i}-{name}")
        docs = spark.read.parquet(f"{root}/{i}-{name}")
    return docs
