"""Canonical views of the fleet data model over the shared TPC-H-like tables.

Each view has a DataFrame builder (the Spark side) and an SQL text (``SQL``)
that DuckDB runs as a CTE in the oracle queries. Both must give equal rows;
money is integer cents and ``txn_id`` is the tie-breaker everywhere.

txn       enriched transactions: one per order
price     monthly price sheet (four products, cents per unit)
meter     cumulative odometer log per entity and day
register  fleet register with old and new plates (fans out a left join)
names     merchant / site names with plural and upper-case variants
scored    labels with a rule-made prediction and score
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tankline.sources.tables import table

# ---------------------------------------------------------------- Spark side


def _geo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """nation x region: 25 rows by the TPC-H definition, so broadcasting is bounded."""
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    r = table(spark, sf_dir, "region").select("r_regionkey", "r_name")
    return n.join(F.broadcast(r), n.n_regionkey == r.r_regionkey).select("n_nationkey", "n_name", "r_name")


def txn(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderdate", "o_totalprice", "o_orderpriority")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    geo = _geo(spark, sf_dir)
    cust = c.join(F.broadcast(geo), c.c_nationkey == geo.n_nationkey).select(
        "c_custkey", "c_mktsegment", "n_name", "r_name")
    qty = (table(spark, sf_dir, "lineitem").groupBy("l_orderkey")
           .agg(F.sum("l_quantity").cast("bigint").alias("litres")))
    j = (o.join(cust, o.o_custkey == cust.c_custkey)
         .join(qty, o.o_orderkey == qty.l_orderkey, "left"))
    return j.select(
        F.col("o_orderkey").alias("txn_id"),
        F.col("o_custkey").alias("entity_id"),
        F.col("o_orderdate").alias("ts"),
        F.round(F.col("o_totalprice") * 100).cast("bigint").alias("amount_cents"),
        F.col("litres"),
        F.col("c_mktsegment").alias("category"),
        F.col("r_name").alias("district"),
        F.col("n_name").alias("site"),
        F.col("o_orderpriority").alias("department"),
        F.when(F.col("o_orderkey") % 4 == 0, F.lit("Petrol")).otherwise(F.lit("Diesel")).alias("fuel_type"),
    )


def price(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    cents = F.round(F.col("l_extendedprice") * 100)

    def unit(cond):
        return F.sum(F.when(cond, cents)) / F.sum(F.when(cond, F.col("l_quantity")))

    return (li.groupBy(F.date_trunc("month", "l_shipdate").cast("date").alias("effective_date"))
            .agg(unit(F.col("l_linestatus") == "O").alias("coastal_petrol_cents"),
                 unit(F.col("l_linestatus") == "F").alias("coastal_diesel_cents"),
                 unit(F.col("l_returnflag") == "R").alias("inland_petrol_cents"),
                 unit(F.col("l_returnflag") == "A").alias("inland_diesel_cents")))


def meter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cumulative odometer per entity and day. The running total is salted by month:
    a running sum inside each (entity, month) plus the totals of the entity's
    earlier months (one row per entity-month), so no entity's whole history is
    windowed in one task."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_shipdate", "l_quantity")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    daily = (li.join(o, li.l_orderkey == o.o_orderkey)
             .groupBy(F.col("o_custkey").alias("entity_id"), F.col("l_shipdate").alias("ts"))
             .agg(F.sum("l_quantity").alias("q"))
             .withColumn("_m", F.date_trunc("month", "ts")))
    w_in = Window.partitionBy("entity_id", "_m").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    months = daily.groupBy("entity_id", "_m").agg(F.sum("q").alias("_mq"))
    w_m = Window.partitionBy("entity_id").orderBy("_m").rowsBetween(Window.unboundedPreceding, -1)
    months = months.select("entity_id", "_m", F.coalesce(F.sum("_mq").over(w_m), F.lit(0.0)).alias("_before"))
    run = daily.withColumn("_run", F.sum("q").over(w_in)).join(months, ["entity_id", "_m"])
    return run.select("entity_id", "ts", (F.col("_before") + F.col("_run")).cast("bigint").alias("odo"))


def register(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    geo = _geo(spark, sf_dir)
    k = F.col("c_custkey")
    return (c.where(k % 5 != 4)
            .join(F.broadcast(geo), c.c_nationkey == geo.n_nationkey)
            .select(k.alias("reg_no"),
                    F.when(k % 10 == 0, k + 1).alias("old_reg"),
                    F.col("n_name").alias("site"),
                    F.col("r_name").alias("district"),
                    F.when(k % 2 == 0, F.lit("white")).otherwise(F.lit("ems")).alias("source")))


def names(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    return p.select(k.alias("name_id"),
                    F.when(k % 5 == 0, F.concat("p_name", F.lit("s")))
                    .when(k % 7 == 0, F.upper("p_name"))
                    .otherwise(F.col("p_name")).alias("name"))


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    lab = table(spark, sf_dir, "labels").select("doc_id", "quality")
    d = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    return lab.join(d, "doc_id").select(
        "doc_id", F.col("quality").alias("y_true"),
        F.when(F.col("n_chars") % 3 == 0, 1).otherwise(0).alias("y_pred"),
        ((F.col("n_chars") % 1000) / F.lit(1000.0)).alias("score"))


BUILDERS = {"txn": txn, "price": price, "meter": meter, "register": register,
            "names": names, "scored": scored}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return BUILDERS[name](spark, sf_dir)


# ---------------------------------------------------------------- oracle side

SQL = {
    "txn": """
SELECT o.o_orderkey AS txn_id, o.o_custkey AS entity_id, o.o_orderdate AS ts,
       CAST(ROUND(o.o_totalprice * 100) AS BIGINT) AS amount_cents, q.litres,
       c.c_mktsegment AS category, r.r_name AS district, n.n_name AS site,
       o.o_orderpriority AS department,
       CASE WHEN o.o_orderkey % 4 = 0 THEN 'Petrol' ELSE 'Diesel' END AS fuel_type
FROM orders o
JOIN customer c ON c.c_custkey = o.o_custkey
JOIN nation n ON n.n_nationkey = c.c_nationkey
JOIN region r ON r.r_regionkey = n.n_regionkey
LEFT JOIN (SELECT l_orderkey, CAST(SUM(l_quantity) AS BIGINT) AS litres FROM lineitem GROUP BY l_orderkey) q
  ON q.l_orderkey = o.o_orderkey""",
    "price": """
SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS effective_date,
       SUM(CASE WHEN l_linestatus = 'O' THEN ROUND(l_extendedprice * 100) END) / SUM(CASE WHEN l_linestatus = 'O' THEN l_quantity END) AS coastal_petrol_cents,
       SUM(CASE WHEN l_linestatus = 'F' THEN ROUND(l_extendedprice * 100) END) / SUM(CASE WHEN l_linestatus = 'F' THEN l_quantity END) AS coastal_diesel_cents,
       SUM(CASE WHEN l_returnflag = 'R' THEN ROUND(l_extendedprice * 100) END) / SUM(CASE WHEN l_returnflag = 'R' THEN l_quantity END) AS inland_petrol_cents,
       SUM(CASE WHEN l_returnflag = 'A' THEN ROUND(l_extendedprice * 100) END) / SUM(CASE WHEN l_returnflag = 'A' THEN l_quantity END) AS inland_diesel_cents
FROM lineitem
GROUP BY CAST(date_trunc('month', l_shipdate) AS DATE)""",
    "meter": """
SELECT entity_id, ts, CAST(SUM(q) OVER (PARTITION BY entity_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS odo
FROM (SELECT o.o_custkey AS entity_id, l.l_shipdate AS ts, SUM(l.l_quantity) AS q
      FROM lineitem l JOIN orders o ON o.o_orderkey = l.l_orderkey GROUP BY o.o_custkey, l.l_shipdate) d""",
    "register": """
SELECT c.c_custkey AS reg_no, CASE WHEN c.c_custkey % 10 = 0 THEN c.c_custkey + 1 END AS old_reg,
       n.n_name AS site, r.r_name AS district,
       CASE WHEN c.c_custkey % 2 = 0 THEN 'white' ELSE 'ems' END AS source
FROM customer c JOIN nation n ON n.n_nationkey = c.c_nationkey JOIN region r ON r.r_regionkey = n.n_regionkey
WHERE c.c_custkey % 5 <> 4""",
    "names": """
SELECT p_partkey AS name_id, CASE WHEN p_partkey % 5 = 0 THEN concat(p_name, 's') WHEN p_partkey % 7 = 0 THEN upper(p_name) ELSE p_name END AS name
FROM part""",
    "scored": """
SELECT l.doc_id, l.quality AS y_true, CASE WHEN d.n_chars % 3 = 0 THEN 1 ELSE 0 END AS y_pred, (d.n_chars % 1000) / CAST(1000 AS DOUBLE) AS score
FROM labels l JOIN documents d ON d.doc_id = l.doc_id""",
}


def with_views(body: str, *names: str, ctes: tuple[str, ...] | list[str] = (), recursive: bool = False) -> str:
    """Oracle query text: the CTEs of the views it reads, then extra ``name AS (...)``
    CTEs in order, then the final SELECT."""
    parts = [f"{n} AS ({SQL[n].strip()})" for n in names] + [c.strip() for c in ctes]
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join(parts) + "\n" + body.strip()
