"""Rule-based anomaly flags (HF-1..HF-7).

amount flag     amount > multiplier x mean amount of (category, district, month name)
frequency flag  whole days since the vehicle's previous transaction < days_threshold
                and amount > that group mean
price flag      |reference price - unit price| > price_threshold; the diesel reference
                is the coastal diesel price plus a fixed uplift
flag count      0-3

Unknown operands give False (V1). The group mean is an aggregate joined back
with a size check -- never a window over the group keys, so one large
(category, district, month) group is never sent to a single task.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tankline.functions import expr as X
from tankline.operators.joins import attach
from tankline.operators.temporal import with_gap_days
from tankline.schema import DEFAULT, TxnCols

# Fixed values (must equal the reference's): three quoted diesel prices and the
# gazetted price, in rand per litre; the uplift is their mean minus the gazetted price.
DIESEL_QUOTES = [22.75, 23.34, 23.43]
DIESEL_GAZETTED = 20.64
DIESEL_UPLIFT = sum(DIESEL_QUOTES) / 3 - DIESEL_GAZETTED

# Default thresholds: multiplier 1.5, 2 days, R1.00.
DEFAULT_MULTIPLIER = 1.5
DEFAULT_DAYS = 2
DEFAULT_PRICE_DIFF = 1.0

MONTH_KEY = "month_name"


def group_keys(c: TxnCols = DEFAULT) -> list[str]:
    return [c.category, c.district, MONTH_KEY]


def with_month_name(df: DataFrame, c: TxnCols = DEFAULT) -> DataFrame:
    return df if MONTH_KEY in df.columns else df.withColumn(MONTH_KEY, X.month_name(c.ts))


def group_mean(df: DataFrame, keys: Sequence[str], amount: str, out: str = "avg_category_amount") -> DataFrame:
    """Exact mean per group as sum / count (integer sums stay exact); rows with a
    null key form no group, as in pandas (V5)."""
    return (df.groupBy(*keys)
            .agg((F.sum(amount).cast("double") / F.count(amount)).alias(out))
            .where(reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])))


def with_amount_flag(df: DataFrame, c: TxnCols = DEFAULT, multiplier: float = DEFAULT_MULTIPLIER,
                     keys: Sequence[str] | None = None, of: DataFrame | None = None) -> DataFrame:
    """HF-1 (+ WN-2): ``avg_category_amount`` and ``amount_flag``. The mean is that of ``of``
    (default: the rows themselves): a caller that has shuffled the rows passes what they
    were read from, so the aggregate reads a pruned scan."""
    df = with_month_name(df, c)
    keys = list(keys or group_keys(c))
    avg = group_mean(with_month_name(df if of is None else of, c), keys, c.amount)
    out = attach(df, avg, keys, "left")
    return out.withColumn("amount_flag", X.flag(F.col(c.amount) > F.col("avg_category_amount") * F.lit(multiplier)))


def with_frequency_flag(df: DataFrame, c: TxnCols = DEFAULT, days_threshold: int = DEFAULT_DAYS,
                        bucket: str = "day") -> DataFrame:
    """HF-2 (+ WN-1): ``gap_days`` and ``frequency_flag``; needs ``avg_category_amount``."""
    if "gap_days" not in df.columns:
        df = with_gap_days(df, c, bucket=bucket)
    cond = (F.col("gap_days") < F.lit(days_threshold)) & (F.col(c.amount) > F.col("avg_category_amount"))
    return df.withColumn("frequency_flag", X.flag(cond))


def price_difference(c: TxnCols = DEFAULT, money_scale: float = 100.0):
    """|reference - unit price| by fuel type; NaN (0/0 unit price) becomes null."""
    adj = F.col(c.coastal_diesel) + F.lit(DIESEL_UPLIFT * money_scale)
    ref = F.when(F.col(c.fuel) == "Diesel", adj).otherwise(F.col(c.coastal_petrol))
    return X.null_if_nan(F.abs(ref - F.col(c.unit_price)))


def with_price_flag(df: DataFrame, c: TxnCols = DEFAULT, price_threshold: float = DEFAULT_PRICE_DIFF,
                    money_scale: float = 100.0) -> DataFrame:
    """HF-3: ``coastal_diesel_adjusted``, ``price_difference`` and ``price_flag``.
    Prices and unit price are in 1/money_scale currency units (cents by default)."""
    return (df.withColumn("coastal_diesel_adjusted", F.col(c.coastal_diesel) + F.lit(DIESEL_UPLIFT * money_scale))
            .withColumn("price_difference", price_difference(c, money_scale))
            .withColumn("price_flag", X.flag(F.col("price_difference") > F.lit(price_threshold * money_scale))))


def with_flag_count(df: DataFrame) -> DataFrame:
    """HF-4: ``number_of_flags`` 0-3."""
    n = sum(F.col(f).cast("int") for f in ("amount_flag", "frequency_flag", "price_flag"))
    return df.withColumn("number_of_flags", n)


def apply_flags(df: DataFrame, c: TxnCols = DEFAULT, multiplier: float = DEFAULT_MULTIPLIER,
                days_threshold: int = DEFAULT_DAYS, price_threshold: float = DEFAULT_PRICE_DIFF,
                money_scale: float = 100.0, bucket: str = "day") -> DataFrame:
    """HF-5 / HF-6: all three flags and their count on priced transactions
    (output of ``temporal.enrich_prices``)."""
    # the gap first, then the mean of the incoming rows: neither reads the other's exchange
    d = df if "gap_days" in df.columns else with_gap_days(df, c, bucket=bucket)
    d = with_amount_flag(d, c, multiplier, of=df)
    d = with_frequency_flag(d, c, days_threshold, bucket)
    d = with_price_flag(d, c, price_threshold, money_scale)
    return with_flag_count(d)


def save_flagged(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """HF-6 sink: write the flagged table (overwrite)."""
    df.write.mode("overwrite").format(fmt).save(path)


def flag_distribution(flagged: DataFrame) -> DataFrame:
    """HF-4 / AG-3: rows and share per flag count."""
    return (flagged.groupBy("number_of_flags").agg(F.count(F.lit(1)).alias("n"))
            .selectExpr("number_of_flags", "n", "n / sum(n) OVER () AS share"))


def with_low_efficiency(eff: DataFrame, kmpl: str = "kmpl", limit: float = 5.0) -> DataFrame:
    """HF-7: vehicle flag KMPL < limit."""
    return eff.withColumn("low_efficiency", X.flag(F.col(kmpl) < F.lit(limit)))
