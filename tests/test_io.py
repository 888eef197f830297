"""File sources, stage tables and incremental ingestion (SRC-1..3, SNK-1, SNK-3)."""

import datetime as dt
import os
import tempfile

from pyspark.sql import functions as F

from tankline.sources import files as FI


def _tmp():
    return tempfile.mkdtemp(prefix="tankline-io-", dir="/tmp")


def test_price_sheet_padded_decimal_comma(spark):
    # edge_prices: unsorted sheet, decimal comma, padded text, padded labels
    d = _tmp()
    with open(os.path.join(d, "sheet.csv"), "w") as f:
        f.write("Date;2021-05-05;2021-04-07\n")
        f.write("95 LRP (c/l);  1 234,5 ;1200,25\n".replace("1 234,5", "1234,5"))
        f.write("Diesel 0.05% (c/l) ;1100;1090,5\n")
        f.write(" 95 ULP (c/l) * ;1300,5;1290\n")
        f.write("Diesel 0.05% (c/l) **;1150;1140\n")
    got = {r.effective_date: r for r in FI.read_price_sheet(spark, os.path.join(d, "sheet.csv")).collect()}
    a = got[dt.date(2021, 4, 7)]
    assert (a.Petrol, a.Diesel, a["Petrol Inland"], a["Diesel Inland"]) == (12.0025, 10.905, 12.9, 11.4)
    b = got[dt.date(2021, 5, 5)]
    assert b.Petrol == 12.345 and b.Diesel == 11.0


def test_csv_roundtrip_with_schema(spark):
    d = _tmp()
    df = spark.createDataFrame([(1, dt.datetime(2021, 1, 2, 3, 4, 5), 10.5, None), (2, None, -1.0, "x;y")],
                               "id long, ts timestamp_ntz, v double, s string")
    FI.write_table(df, os.path.join(d, "t"), "csv")
    back = FI.read_csv(spark, os.path.join(d, "t"), "id long, ts timestamp_ntz, v double, s string")
    assert sorted(back.collect()) == sorted(df.collect())
    FI.write_report(df, os.path.join(d, "r"))
    assert len([f for f in os.listdir(os.path.join(d, "r")) if f.endswith(".csv")]) == 1


def test_incremental_flags_equals_batch(spark):
    from tankline.operators.flags import apply_flags
    from tankline.streaming import incremental_flags
    d = _tmp()
    t = dt.datetime(2021, 3, 1)
    rows = [(i, i % 3, t + dt.timedelta(hours=7 * i), 100 + 37 * i, 10, "A", "D", "s", "x", "Diesel", 100.0, 100.0,
             float(10 + i)) for i in range(40)]
    schema = ("txn_id long, entity_id long, ts timestamp, amount_cents long, litres long, category string, "
              "district string, site string, department string, fuel_type string, coastal_petrol_cents double, "
              "coastal_diesel_cents double, unit_price double")
    df = spark.createDataFrame(rows, schema)
    df.where(F.col("txn_id") < 20).write.parquet(os.path.join(d, "src", "a"))
    df.where(F.col("txn_id") >= 20).write.parquet(os.path.join(d, "src", "b"))
    out = incremental_flags(spark, os.path.join(d, "src", "*"), df.schema, os.path.join(d, "table"),
                            os.path.join(d, "flagged"), os.path.join(d, "ckpt"))
    cols = ["txn_id", "amount_flag", "frequency_flag", "price_flag", "number_of_flags"]
    assert sorted(out.select(*cols).collect()) == sorted(apply_flags(df).select(*cols).collect())
