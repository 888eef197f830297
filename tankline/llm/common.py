"""Column helpers shared by the text operators: word splitting, let-binding, row ids."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
#: Words of the licence, near-duplicate and decontamination operators (after A-Z became a-z).
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The same rule for the bytes of a UTF-8 text: A-Z to a-z, any other ASCII but letters and digits to a blank.
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
#: Words of the quality and mixing operators: runs of anything but ASCII white space.
TOKEN = r"[^\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def ascii_lower(c: Column) -> Column:
    """A-Z to a-z and nothing else. Pure ASCII text takes the fast built-in."""
    return (F.when(F.octet_length(c) == F.char_length(c), F.lower(c))
            .otherwise(F.translate(c, UPPER, LOWER)))


def words(c: Column) -> Column:
    """Lower-cased words of a text; null has none."""
    return F.regexp_extract_all(ascii_lower(F.coalesce(c, F.lit(""))), F.lit(WORD), F.lit(0))


def tokens(c: Column) -> Column:
    """White-space separated words of a text; null has none."""
    return F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(TOKEN), F.lit(0))


def let(expr: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``expr`` once per row and use it, under a name, in ``body``."""
    return F.element_at(F.transform(F.array(expr), body), 1)


def indices(n: Column) -> Column:
    """0 .. n-1; empty for n <= 0."""
    return F.when(n > 0, F.sequence(F.lit(0), n.cast("int") - 1)).otherwise(
        F.array().cast("array<int>"))


def with_row_id(df: DataFrame, name: str = "_rid") -> DataFrame:
    """An id per input row, so that repeated rows stay apart. Only ever used inside one
    plan that scans its input once; never joined with ids from another scan."""
    return df.withColumn(name, F.monotonically_increasing_id())


def packed(df: DataFrame, **keys: str) -> DataFrame:
    """The whole row as the struct ``row`` beside the named columns, so that no column of the
    input can clash with those an operator adds."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"),
                     *[F.col(f"`{c}`").alias(name) for name, c in keys.items()])


def hot_join(big: DataFrame, small: DataFrame, key: str, weight: str, parts: int = 1000) -> DataFrame:
    """Left join with a table of unique keys that says in ``weight`` how many rows of ``big`` have each.
    Keys of a ``parts``-th of those rows or more, of which there are at most ``parts``, are
    broadcast, so no task gets all rows of a hot key; the others are shuffled."""
    total = small.agg(F.sum(weight)).first()[0] or 0
    is_hot = F.col(weight) >= F.lit(max(2.0, total / parts))
    hot = F.broadcast(small.where(is_hot))
    rest = big.join(hot.select(key), key, "left_anti").join(small.where(~is_hot), key, "left")
    return big.join(hot, key).unionByName(rest)
