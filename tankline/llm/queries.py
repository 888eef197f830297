"""Registered queries of the training-data operators and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tankline.llm import (align, chat, decontam, langid, license_scan, lm, mixing, near_dup, quality_crf, quality_rules,
                          resample, url_filter, vocab, warc)
from tankline.llm import queries_sql as SQL
from tankline.llm.common import read
from tankline.session import ensure_checkpoint_dir


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = license_scan.scan(read(spark, sf_dir, "documents"))
    return d.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base_labels", ",").alias("base_labels"),
                    F.array_join("labels", ",").alias("labels"), "score")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality_rules.fit_llr(quality_rules.trusted_flag(docs, read(spark, sf_dir, "labels")), "_trusted")
    return quality_rules.judge(docs, model).drop("row")


def op3_quality_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality_crf.fit(docs, read(spark, sf_dir, "labels"), learn=~quality_crf.held_out(F.col("_id"), 3, 1))
    d = quality_crf.score(docs, model)
    return d.select("doc_id", quality_crf.held_out(F.col("doc_id"), 3, 1).alias("held_out"), "score",
                    (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    text = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", text), (-1, 1, "assistant", text)], "conv_id long, turn long, role string, text string")
    return chat.digest(chat.format_conversations(rows.unionByName(extra)))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = url_filter.judge(read(spark, sf_dir, "pages"))
    return d.select("page_id", "host", "path", "rule", "verdict")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = mixing.plan(read(spark, sf_dir, "documents"))
    return d.select("doc_id", "size", "source_size", "target", "taken", "position")


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = warc.scratch(spark, ensure_checkpoint_dir(spark))
    warc.write(read(spark, sf_dir, "pages"), path)
    records = warc.read(spark, path)
    # payloads become their length and digest before the join, metadata (a few lines) stay
    side = F.when(F.col("type") == "metadata", F.col("payload").cast("string"))
    d = warc.assemble(records.withColumn("bytes", F.octet_length("payload").cast("long"))
                      .withColumn("sha1", F.sha1("payload")).withColumn("fields", side).drop("payload"))

    def field(name: str):
        return F.nullif(F.regexp_extract("metadata.fields", rf"(?m)^{name}: (-?\d+)\r?$", 1), F.lit("")).cast("long")

    whole = F.col("response.type") == "response"
    return d.select(field("page-id").alias("page_id"),
                    F.when(whole, F.col("response.bytes")).otherwise(field("payload-bytes")).alias("payload_bytes"),
                    F.when(whole, F.col("response.sha1")).otherwise(F.substring_index("response.digest", ":", -1)).alias("payload_digest"),
                    F.col("response.type").alias("record_type"), field("refers-to-page").alias("refers_to"))


def op8_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = quality_crf.held_out(F.col("doc_id"), 5, 0)
    model = langid.fit(docs.where(~held))
    d = langid.predict(docs.select("doc_id", "text"), model)
    return d.select("doc_id", held.alias("held_out"), F.col("lang.lang").alias("lang_pred"), F.col("lang.score").alias("score"))


def op9_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.classes(read(spark, sf_dir, "documents"))


def op10_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = decontam.find(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return d.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                    F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


#: Where every worker finds the tokenizer files.
TOKENIZERS = "/opt/tokenizers"


def op11_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = vocab.ByteBpe(f"{TOKENIZERS}/byte_bpe_50k.json"), vocab.Pieces(f"{TOKENIZERS}/piece_bpe_32k.model")
    d = align.align(read(spark, sf_dir, "documents").select("doc_id", "text"), a, b)
    digest = F.when(F.col("groups") == "", F.lit("")).otherwise(F.sha2("groups", 256)).alias("groups_sha256")
    d = align.with_counts(d.select("doc_id", "n_a", "n_b", "n_groups", "n_links", digest, "pairs", "times"))
    return d.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def op12_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = resample.resample(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return d.select(F.col("id").alias("doc_id"), "n_features", "weight", "score", "rank")


def op13_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = lm.score_texts(read(spark, sf_dir, "documents"), vocab.ByteBpe(f"{TOKENIZERS}/byte_bpe_50k.json"),
                       quality_crf.held_out(F.col("id"), 7, 2))
    return d.withColumnRenamed("id", "doc_id")


QUERIES = {f.__name__: f for f in (
    op1_license_scan, op2_quality_rules, op3_quality_crf, op4_chat_format, op5_url_filter, op6_mixing, op7_warc, op8_langid,
    op9_near_dup, op10_decontam, op11_align, op12_resample, op13_lm_score)}
ORACLE = {"op1_license_scan": SQL.OP1, "op4_chat_format": SQL.OP4, "op5_url_filter": SQL.OP5, "op6_mixing": SQL.OP6, "op7_warc": SQL.OP7, "op10_decontam": SQL.OP10, "op12_resample": SQL.OP12}
