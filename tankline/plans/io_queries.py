"""Queries of the file sources and sinks: each writes a table derived from the shared
tables in the reference's file layout and reads it back with our reader."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tankline.operators.clean import attach_coordinates
from tankline.plans.flag_queries import FLAG_COLS
from tankline.plans.registry import REGISTRY, query
from tankline.plans.table_queries import COORDS_SQL, place_coordinates
from tankline.session import ensure_checkpoint_dir
from tankline.sources import fixtures as FX
from tankline.sources import files as FI
from tankline.sources import stages as SG


def _path(spark, sf, name):
    """A folder of this run's own, so that sessions on the same input don't overwrite each other."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/files/{SG._key(spark, sf)}/{SG._NAMESPACE[0]}/{uuid.uuid4().hex[:12]}/{name}"


PRODUCT_COLS = {"coastal_petrol_cents": "95 LRP (c/l)", "coastal_diesel_cents": "Diesel 0.05% (c/l) ",
                "inland_petrol_cents": "95 ULP (c/l) *", "inland_diesel_cents": "Diesel 0.05% (c/l) **"}


@query("price_sheet", covers=("SRC-3", "RS-2", "FN-4", "FN-10"), sql=FX.with_views("""
SELECT effective_date, coastal_petrol_cents / 100.0 AS "Petrol", coastal_diesel_cents / 100.0 AS "Diesel",
       inland_petrol_cents / 100.0 AS "Petrol Inland", inland_diesel_cents / 100.0 AS "Diesel Inland" FROM price""",
                                                                  "price"))
def price_sheet(spark, sf):
    p = _path(spark, sf, "price_sheet")
    FI.write_price_sheet(SG.stage(spark, sf, "price"), p, "effective_date", PRODUCT_COLS)
    return FI.read_price_sheet(spark, p)


TXN_SCHEMA = ("txn_id bigint, entity_id bigint, ts timestamp_ntz, amount_cents bigint, litres bigint, "
              "category string, district string, site string, department string, fuel_type string")


@query("csv_roundtrip", covers=("SRC-1", "SNK-1"), sql=FX.with_views("SELECT * FROM txn", "txn"))
def csv_roundtrip(spark, sf):
    p = _path(spark, sf, "txn_csv")
    FI.write_table(SG.stage(spark, sf, "txn"), p, "csv")
    return FI.read_csv(spark, p, TXN_SCHEMA)


@query("register_semicolon", covers=("SRC-2", "SNK-3"), sql=FX.with_views("SELECT * FROM register", "register"))
def register_semicolon(spark, sf):
    p = _path(spark, sf, "register_csv")
    SG.stage(spark, sf, "register").write.mode("overwrite").option("header", True).option("sep", ";").csv(p)
    return FI.read_csv(spark, p, "reg_no bigint, old_reg bigint, site string, district string, source string", sep=";")


@query("map_extract", covers=("SNK-4", "SRC-4", "JN-11"), sql=FX.with_views("""
SELECT DISTINCT t.entity_id, c.lat, c.lon FROM txn t LEFT JOIN coords c ON c.address = t.site || ', ' || t.district""", "txn", ctes=[COORDS_SQL]))
def map_extract(spark, sf):
    """Id and coordinates of every vehicle's places, through the CSV file."""
    p = _path(spark, sf, "map_extract")
    places = SG.stage(spark, sf, "txn").select("entity_id", "site", "district").distinct()
    d = attach_coordinates(places, "site", place_coordinates(spark, sf), region="district").select("entity_id", "lat", "lon").distinct()
    FI.write_map_extract(d, p, ["entity_id", "lat", "lon"])
    return FI.read_csv(spark, p, "entity_id bigint, lat double, lon double")


@query("streaming_flags", covers=("HF-5", "streaming"), sql=REGISTRY["flags_all"].sql)
def streaming_flags(spark, sf):
    """The priced stage streamed as files through incremental ingestion; the flagged
    table equals the batch flags of all rows."""
    from tankline.streaming import incremental_flags
    priced = SG.stage(spark, sf, "priced")
    run = uuid.uuid4().hex[:8]
    src = _path(spark, sf, f"stream/{run}/src")
    priced.write.mode("overwrite").parquet(src)
    out = incremental_flags(spark, src, priced.schema, _path(spark, sf, f"stream/{run}/table"),
                            _path(spark, sf, f"stream/{run}/flagged"), _path(spark, sf, f"stream/{run}/ckpt"))
    return out.select(*FLAG_COLS, F.least("number_of_flags", F.lit(2)).alias("flag_class"))
