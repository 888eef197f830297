"""File sources and sinks (SRC-1..SRC-3, SNK-1, SNK-3, SNK-4).

Readers take an explicit schema (no inference pass over the data); the price
sheet reader reshapes a products-as-rows / dates-as-columns sheet with
``unpivot`` + ``groupBy().pivot()`` -- the sheet is one row per product and
one column per date, so it is small by construction.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

# Product labels of the price sheet and the names they get.
PRICE_PRODUCTS = {
    "95 LRP (c/l)": "Petrol",
    "Diesel 0.05% (c/l) ": "Diesel",
    "95 ULP (c/l) *": "Petrol Inland",
    "Diesel 0.05% (c/l) **": "Diesel Inland",
}


def read_csv(spark: SparkSession, path: str, schema: StructType | str, sep: str = ",",
             timestamp_format: str | None = None) -> DataFrame:
    """SRC-1 / SRC-2: delimited text with a header row and a declared schema."""
    r = spark.read.schema(schema).option("header", True).option("sep", sep).option("mode", "PERMISSIVE")
    if timestamp_format:
        r = r.option("timestampFormat", timestamp_format).option("timestampNTZFormat", timestamp_format)
    return r.csv(path)


def read_price_sheet(spark: SparkSession, path: str, products: dict | None = None, label_col: str = "label",
                     date_label: str = "Date", date_format: str = "yyyy-MM-dd", scale: float = 100.0,
                     sep: str = ";") -> DataFrame:
    """SRC-3 / RS-2: a sheet whose first column names the rows ('Date' and one row per
    product) and whose other columns are effective dates. Values use a decimal comma,
    may be padded, and are in cents (divided by ``scale``). Output: one row per
    date with one double column per product."""
    products = products or PRICE_PRODUCTS
    raw = spark.read.option("header", False).option("sep", sep).csv(path)  # all strings
    first, cols = raw.columns[0], raw.columns[1:]
    # labels are matched after trimming: padded labels are common in such sheets
    long = (raw.withColumn(label_col, F.trim(F.col(first))).drop(first)
            .unpivot([label_col], cols, "col", "val"))
    keys = {k.strip(): v for k, v in products.items()}
    wide = long.groupBy("col").pivot(label_col, [date_label, *keys]).agg(F.first("val"))
    out = wide.select(F.to_date(F.trim(F.col(f"`{date_label}`")), date_format).alias("effective_date"),
                      *[(F.regexp_replace(F.trim(F.col(f"`{k}`")), ",", ".").cast("double") / F.lit(scale)).alias(v)
                        for k, v in keys.items()])
    return out.where(F.col("effective_date").isNotNull())


def write_price_sheet(df: DataFrame, path: str, date_col: str, value_cols: dict, date_format: str = "yyyy-MM-dd",
                      sep: str = ";") -> None:
    """Inverse of ``read_price_sheet`` (used to exchange sheets and in tests):
    products as rows, one column per date, decimal comma."""
    cols = {c: label for c, label in value_cols.items()}
    long = df.select(F.date_format(date_col, date_format).alias("d"),
                     *[F.regexp_replace(F.col(c).cast("string"), r"\.", ",").alias(lab) for c, lab in cols.items()])
    dates = sorted(r[0] for r in long.select("d").collect())  # one per sheet column: bounded
    rows = long.unpivot(["d"], [F.col(f"`{v}`") for v in cols.values()], "label", "v")
    wide = rows.groupBy("label").pivot("d", dates).agg(F.first("v"))
    header = long.sparkSession.createDataFrame([("Date", *dates)], ["label", *dates])
    header.unionByName(wide.select("label", *dates)).coalesce(1).write.mode("overwrite") \
        .option("header", False).option("sep", sep).option("ignoreTrailingWhiteSpace", False).csv(path)


def write_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by: Sequence[str] = ()) -> None:
    """SNK-1: table sink (overwrite), optionally partitioned."""
    w = df.write.mode("overwrite").format(fmt)
    if fmt == "csv":
        w = w.option("header", True)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.save(path)


def write_report(df: DataFrame, path: str) -> None:
    """SNK-3: a small report table as one CSV file with a header."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def write_map_extract(df: DataFrame, path: str, cols: Sequence[str]) -> None:
    """SNK-4: id and coordinates only. One row per vehicle, so as many files as partitions."""
    df.select(*cols).write.mode("overwrite").option("header", True).csv(path)
