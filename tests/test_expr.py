"""Edge fixtures for the column helpers (V2, V7, V9, FN-7, FN-9)."""

import math

from pyspark.sql import functions as F

from tankline.functions import expr as X
from tankline.operators.temporal import GAP_BANDS


def test_unit_price_inf_nan(spark):
    # edge_unit_price: litres 0 with amount > 0, < 0, = 0; null litres
    df = spark.createDataFrame([(1, 100, 0), (2, -5, 0), (3, 0, 0), (4, 10, None), (5, 10, 4)], "id int, a long, q long")
    got = {r.id: r.u for r in df.select("id", X.unit_price("a", "q").alias("u")).collect()}
    assert got[1] == math.inf and got[2] == -math.inf and math.isnan(got[3])
    assert got[4] is None and got[5] == 2.5


def test_title_case_matches_python(spark):
    # edge_titles: apostrophe, hyphen, digit-letter, empty, null
    words = ["o'brien", "n2-city", "3rd street", "", "ALL CAPS", "mIxEd_case", "port elizabeth"]
    df = spark.createDataFrame([(w,) for w in words] + [(None,)], "w string")
    got = [r.t for r in df.select(X.title_case("w").alias("t")).collect()]
    assert got[:-1] == [w.title() for w in words]
    assert got[-1] is None


def test_right_closed_bands(spark):
    # edge_bands: gaps 0, 1, 2, 3, 5, 10, 20, 30, 31, null
    vals = [0, 1, 2, 3, 5, 10, 20, 30, 31, None]
    df = spark.createDataFrame([(v,) for v in vals], "g int")
    got = [r.b for r in df.select(X.right_closed_band("g", *GAP_BANDS).alias("b")).collect()]
    assert got == [None, "< 2 days", "< 2 days", "2-5 days", "2-5 days", "5-10 days", "10-20 days",
                   "20-30 days", "> 30 days", None]


def test_truncate_variants(spark):
    df = spark.createDataFrame([("abcdefghij",), ("abc",)], "s string")
    r = df.select(X.truncate("s", 5).alias("a"), X.truncate("s", 5, keep_room=True).alias("b")).collect()
    assert (r[0].a, r[0].b) == ("abcde...", "ab...")
    assert (r[1].a, r[1].b) == ("abc", "abc")


def test_similarity_ratio(spark):
    df = spark.createDataFrame([("kitten", "sitting"), ("", ""), ("abc", "abc")], "a string, b string")
    got = [r.s for r in df.select(X.similarity_ratio("a", "b").alias("s")).collect()]
    assert abs(got[0] - 100 * (1 - 3 / 7)) < 1e-12 and got[1] == 100.0 and got[2] == 100.0


def test_whole_days_not_calendar_days(spark):
    df = spark.createDataFrame([("2021-01-01 23:00:00", "2021-01-02 01:00:00")], "a string, b string")
    d = df.select(X.whole_days_between(F.to_timestamp("a"), F.to_timestamp("b")).alias("d")).first().d
    assert d == 0


def test_title_case_property(spark):
    """Random ASCII text: the Spark expression equals Python's str.title."""
    from hypothesis import given, settings, strategies as st

    alphabet = st.sampled_from(list("abcXYZ019 '-_.,/&"))
    samples = []

    @settings(max_examples=200, deadline=None)
    @given(st.text(alphabet=alphabet, max_size=20))
    def collect(s):
        samples.append(s)

    collect()
    df = spark.createDataFrame([(i, s) for i, s in enumerate(samples)], "i int, s string")
    got = {r.i: r.t for r in df.select("i", X.title_case("s").alias("t")).collect()}
    assert all(got[i] == s.title() for i, s in enumerate(samples))
