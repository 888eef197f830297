"""Column-expression helpers. Every function maps Columns to a Column and stays
inside whole-stage codegen (no Python in the plan)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

INF = float("inf")


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def null_if_nan(x) -> Column:
    """NaN -> null, so that aggregates skip it and comparisons are unknown (V1, V6)."""
    x = col(x)
    return F.when(F.isnan(x), F.lit(None)).otherwise(x)


def flag(cond: Column) -> Column:
    """Comparison with an unknown operand is False (pandas semantics, V1)."""
    return F.coalesce(cond, F.lit(False))


def unit_price(amount, quantity) -> Column:
    """amount / quantity with float-division semantics (V2): x/0 is +-inf, 0/0 is NaN,
    null stays null. Spark's ANSI mode would raise on /0, so zero is handled explicitly."""
    a, q = col(amount).cast("double"), col(quantity).cast("double")
    return (F.when(q.isNull() | a.isNull(), F.lit(None).cast("double"))
            .when(q == 0, F.when(a > 0, F.lit(INF)).when(a < 0, F.lit(-INF)).otherwise(F.lit(float("nan"))))
            .otherwise(a / q))


def finite_or_null(x) -> Column:
    """+-inf and NaN -> null (FLT-9)."""
    x = col(x)
    return F.when(F.isnan(x) | (F.abs(x) == F.lit(INF)), F.lit(None)).otherwise(x)


def title_case(x) -> Column:
    """Python ``str.title``: a letter is upper-cased when it follows a non-letter,
    lower-cased otherwise ("o'brien" -> "O'Brien", "n2-city" -> "N2-City"). ASCII letters (V9)."""
    parts = F.split(F.lower(col(x)), r"(?<=[^a-z])(?=[a-z])")
    return F.array_join(F.transform(parts, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1 << 20))), "")


def truncate(x, n: int, keep_room: bool = False) -> Column:
    """Cut text longer than n and add '...'. keep_room=True cuts to n-3 so the
    result is n long (the EDA variant); otherwise the first n characters are kept."""
    x = col(x)
    cut = n - 3 if keep_room else n
    return F.when(F.length(x) > n, F.concat(F.substring(x, 1, cut), F.lit("..."))).otherwise(x)


def right_closed_band(x, edges: Sequence[float], labels: Sequence[str]) -> Column:
    """``pd.cut(x, edges, labels)``: bands (e_i, e_i+1], values at or below the first
    edge or above the last are null (V7)."""
    if len(labels) != len(edges) - 1:
        raise ValueError("need one label per band")
    x = col(x)
    out = None
    for lo, hi, lab in zip(edges[:-1], edges[1:], labels):
        cond = (x > F.lit(lo)) & (x <= F.lit(hi))
        out = F.when(cond, F.lit(lab)) if out is None else out.when(cond, F.lit(lab))
    return out


def equal_width_bin(x, lo, hi, n_bins: int) -> Column:
    """Histogram bin 0..n-1 of numpy's equal-width rule; the last bin is closed."""
    x, lo, hi = col(x), col(lo), col(hi)
    width = (hi - lo) / F.lit(n_bins)
    raw = F.when(width == 0, F.lit(0)).otherwise(F.floor((x - lo) / width).cast("int"))
    return F.least(raw, F.lit(n_bins - 1))


def similarity_ratio(a, b) -> Column:
    """0-100 similarity from edit distance on the given strings:
    100 * (1 - levenshtein / greatest(length)). Both empty -> 100."""
    a, b = col(a), col(b)
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, F.lit(100.0)).otherwise(
        F.lit(100.0) * (F.lit(1.0) - F.levenshtein(a, b) / longest))


def normalise_text(x) -> Column:
    """Lower case, punctuation to space, collapsed and trimmed whitespace."""
    y = F.regexp_replace(F.lower(col(x)), r"[^a-z0-9]+", " ")
    return F.trim(F.regexp_replace(y, r"\s+", " "))


def month_name(ts) -> Column:
    return F.date_format(col(ts), "MMMM")


def weekday_name(ts) -> Column:
    return F.date_format(col(ts), "EEEE")


def month_start(ts) -> Column:
    return F.date_trunc("month", col(ts)).cast("date")


def whole_days_between(earlier, later) -> Column:
    """Whole 24-hour periods from earlier to later (timedelta ``.days``, V3), not
    calendar days: 23:00 -> 01:00 next day is 0. Gaps are non-negative here."""
    return F.timestamp_diff("DAY", col(earlier), col(later))


def prefix_rules(x, rules: Sequence[tuple[str, str]]) -> Column:
    """Ordered 'starts with p -> v' rules; later rules see the output of earlier ones (FN-6)."""
    out = col(x)
    for prefix, value in rules:
        out = F.when(out.startswith(prefix), F.lit(value)).otherwise(out)
    return out


def money(x, symbol: str = "R") -> Column:
    """R1,234 style label of an amount (FN-8)."""
    return F.concat(F.lit(symbol), F.format_number(col(x), 0))


def signed_pct(x) -> Column:
    """'+1.23%' style label (FN-8)."""
    return F.format_string("%+.2f%%", col(x))
