"""Parquet scans of the shared tables.

Scans are lazy; callers select columns and filter so Catalyst prunes the
``ReadSchema`` and pushes predicates into the parquet reader.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name not in TABLES:
        raise ValueError(f"unknown table {name!r}")
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def register_all(spark: SparkSession, sf_dir: str) -> None:
    """Register every shared table as a temp view (for ``spark.sql`` users)."""
    for name in TABLES:
        table(spark, sf_dir, name).createOrReplaceTempView(name)
