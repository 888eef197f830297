"""Flags edge cases and the compressed sweep / validation against direct per-setting
computation (V1, V2, V5, V20, HF-8, HF-12)."""

import datetime as dt
import random

from pyspark.sql import functions as F

from tankline.operators import flags as FL
from tankline.operators import sweep as SW


COLS = ("txn_id long, entity_id long, ts timestamp, amount_cents long, litres long, category string, "
        "district string, site string, department string, fuel_type string, coastal_petrol_cents double, "
        "coastal_diesel_cents double, unit_price double")


def _priced(spark, rows):
    return spark.createDataFrame(rows, COLS)


def test_flag_edges(spark):
    t = dt.datetime(2021, 3, 1)
    up = FL.DIESEL_UPLIFT * 100
    rows = [
        # same group: amounts 100, 300 -> mean 200; 300 == 1.5 * 200 is not > (boundary)
        (1, 1, t, 100, 1, "A", "D", "s", "x", "Petrol", 100.0, 100.0, 100.0),
        (2, 2, t, 300, 1, "A", "D", "s", "x", "Petrol", 100.0, 100.0, 200.0),
        # null category -> no group mean -> amount and frequency flags False (V5)
        (3, 3, t, 999999, 1, None, "D", "s", "x", "Petrol", 100.0, 100.0, 100.0),
        # litres 0, amount > 0 -> unit price inf -> price flag True (V2)
        (4, 4, t, 50, 0, "B", "D", "s", "x", "Diesel", 100.0, 100.0, float("inf")),
        # 0/0 -> NaN -> price flag False
        (5, 5, t, 0, 0, "B", "D", "s", "x", "Diesel", 100.0, 100.0, float("nan")),
        # diesel reference = coastal diesel + uplift; difference exactly 100 cents is not > threshold
        (6, 6, t, 50, 1, "B", "D", "s", "x", "Diesel", 0.0, 100.0, 100.0 + up + 100.0),
        # no price row -> price flag False
        (7, 7, t, 50, 1, "B", "D", "s", "x", "Diesel", None, None, 5.0),
    ]
    got = {r.txn_id: r for r in FL.apply_flags(_priced(spark, rows)).collect()}
    assert got[1].amount_flag is False and got[2].amount_flag is False
    assert got[3].avg_category_amount is None and got[3].amount_flag is False and got[3].frequency_flag is False
    assert got[4].price_flag is True
    assert got[5].price_flag is False and got[5].price_difference is None
    assert got[6].price_flag is False
    assert got[7].price_flag is False
    assert all(r.number_of_flags == int(r.amount_flag) + int(r.frequency_flag) + int(r.price_flag) for r in got.values())


def _random_priced(spark, n=600, seed=7, months=4):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        ts = dt.datetime(2021, 1, 1) + dt.timedelta(hours=rnd.randrange(24 * 30 * months))
        amt = rnd.choice([rnd.randrange(100, 5000), rnd.randrange(-50, 50)])
        litres = rnd.choice([0, 1, 5, 10, 40, None])
        up = None if litres is None else (float("inf") if litres == 0 and amt > 0 else
                                          (float("-inf") if litres == 0 and amt < 0 else
                                           (float("nan") if litres == 0 else amt / litres)))
        rows.append((i, rnd.randrange(12), ts, amt, litres, rnd.choice(["A", "B", None]), rnd.choice(["D1", "D2"]),
                     "s", rnd.choice(["x", "y", None]), rnd.choice(["Petrol", "Diesel"]),
                     rnd.choice([50.0, 120.0, None]), rnd.choice([60.0, 90.0]), up))
    return _priced(spark, rows)


def test_sweep_equals_direct(spark):
    df = _random_priced(spark)
    mults, days, prices = [1.3, 1.5], [1, 3], [0.8, 1.2]
    base = FL.apply_flags(df).cache()
    sw = {(r.multiplier, r.days_threshold, r.price_diff): r
          for r in SW.threshold_sweep(base, mults=mults, days=days, prices=prices).collect()}
    for m in mults:
        for d in days:
            for p in prices:
                f = FL.apply_flags(df, multiplier=m, days_threshold=d, price_threshold=p)
                multi = f.where(F.col("number_of_flags") >= 2)
                n, n2 = f.count(), multi.count()
                tot = multi.agg(F.sum("amount_cents")).first()[0] or 0
                r = sw[(m, d, p)]
                assert r.num_multi_flags == n2 and r.total_flagged_amount == tot
                assert abs(r.pct_multi_flags - n2 * 100.0 / n) < 1e-9
                dept = (f.where(F.col("department").isNotNull()).groupBy("department")
                        .agg(F.avg("number_of_flags").alias("r")).orderBy(F.desc("r"), "department").first())
                assert r.highest_dept_flags == dept.department


def test_validation_blend_rules_and_month_count(spark):
    df = _random_priced(spark, n=500, months=3)
    v = SW.temporal_validation(df, mults=[1.5], days=[2], prices=[1.0]).collect()
    assert len(v) == 1  # three months -> one triple
    two = _random_priced(spark, n=200, months=2).where(F.month("ts") <= 2)
    assert SW.temporal_validation(two, mults=[1.5], days=[2], prices=[1.0]).count() == 0
    r = v[0]
    assert 0.0 <= r.consistency_score <= 100.0 and 0.0 <= r.vehicle_overlap <= 100.0
