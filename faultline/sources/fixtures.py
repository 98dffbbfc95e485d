"""Canonical inspection tables derived from the driver's star-schema parquet files.

``inspections``       one row per line item: machine = supplier nation bucket, batch = part brand,
                      shift = order priority digit, defect type = part type, defects from returned lines.
``event_inspections`` one row per event: daily / shift trends and the streaming jobs.

Each view exists twice: as a DataFrame plan (what the library runs) and as SQL text
(the CTE that the DuckDB oracles start from).  They must stay the same relation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.session import materialize

CANONICAL = ["inspection_id", "timestamp", "machine_id", "batch_id", "shift", "defect_type",
             "defect_count", "units_inspected", "temperature", "pressure", "speed", "vibration",
             "humidity"]
PARAMS = ["temperature", "pressure", "speed", "vibration", "humidity"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_STORED: dict[tuple, DataFrame] = {}


def inspections(spark: SparkSession, sf_dir: str, no_defect_label: bool = False,
                with_part_lot: bool = False) -> DataFrame:
    """The canonical table, joined and stored once per application and read by all queries."""
    key = (spark.sparkContext.applicationId, sf_dir, no_defect_label, with_part_lot)
    if key not in _STORED:
        _STORED[key] = materialize(join_inspections(spark, sf_dir, no_defect_label, with_part_lot), "inspections")
    return _STORED[key]


def join_inspections(spark: SparkSession, sf_dir: str, no_defect_label: bool = False,
                     with_part_lot: bool = False) -> DataFrame:
    """The canonical inspection table over lineitem ⋈ orders ⋈ customer ⋈ supplier ⋈ part.

    Only the columns used are read (the projection reaches the parquet scans) and texts are cut to
    what is kept of them before any shuffle.  Customers meet the orders first, so line items are
    shuffled for orders and for parts, not for customers too; join strategies are left to AQE, which
    broadcasts a side only when its measured size is under ``spark.sql.autoBroadcastJoinThreshold``.
    """
    li = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
        "l_extendedprice", "l_discount", "l_tax", (F.col("l_returnflag") == "R").alias("returned"), "l_shipdate")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.substring("o_orderpriority", 1, 1).alias("shift"))
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    p = table(spark, sf_dir, "part").select("p_partkey", F.substring("p_brand", 7, 1 << 20).alias("brand"), "p_type", "p_size")
    placed = o.join(c, o.o_custkey == c.c_custkey).select("o_orderkey", "shift", "c_acctbal")
    j = (li.join(s, li.l_suppkey == s.s_suppkey).drop("l_suppkey", "s_suppkey")
           .join(placed, li.l_orderkey == placed.o_orderkey).drop("o_orderkey")
           .join(p, li.l_partkey == p.p_partkey))
    defects = F.when(F.col("returned"),
                     F.ceil(F.col("l_quantity") * F.col("l_discount")).cast("bigint")
                     ).otherwise(F.lit(0).cast("bigint"))
    dtype = F.col("p_type")
    if no_defect_label:
        dtype = F.when(defects == 0, F.lit("No Defect")).otherwise(F.col("p_type"))
    cols = [
        F.concat(F.lit("INS-"), F.col("l_orderkey").cast("string"), F.lit("-"),
                 F.col("l_linenumber").cast("string")).alias("inspection_id"),
        F.col("l_shipdate").alias("timestamp"),
        F.concat(F.lit("M"), F.lpad((F.col("s_nationkey") % 5 + 1).cast("string"), 2, "0")).alias("machine_id"),
        F.concat(F.lit("B"), F.col("brand")).alias("batch_id"),
        F.col("shift"),
        dtype.alias("defect_type"),
        defects.alias("defect_count"),
        F.col("l_quantity").cast("bigint").alias("units_inspected"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("temperature"),
        F.col("l_tax").alias("pressure"),
        F.col("l_discount").alias("speed"),
        F.col("p_size").cast("double").alias("vibration"),
        F.col("c_acctbal").alias("humidity"),
    ]
    if with_part_lot:
        cols.append(F.col("l_partkey").cast("string").alias("part_lot"))
    return j.select(*cols)


def inspections_sql(no_defect_label: bool = False) -> str:
    dtype = ("CASE WHEN l_returnflag = 'R' AND CAST(ceil(l_quantity * l_discount) AS BIGINT) <> 0 "
             "THEN p_type ELSE 'No Defect' END") if no_defect_label else "p_type"
    return f"""
SELECT concat('INS-', CAST(l_orderkey AS VARCHAR), '-', CAST(l_linenumber AS VARCHAR)) AS inspection_id,
       l_shipdate AS "timestamp",
       concat('M', lpad(CAST(s_nationkey % 5 + 1 AS VARCHAR), 2, '0')) AS machine_id,
       concat('B', substr(p_brand, 7)) AS batch_id,
       substr(o_orderpriority, 1, 1) AS shift,
       {dtype} AS defect_type,
       CASE WHEN l_returnflag = 'R' THEN CAST(ceil(l_quantity * l_discount) AS BIGINT) ELSE CAST(0 AS BIGINT) END AS defect_count,
       CAST(l_quantity AS BIGINT) AS units_inspected,
       l_extendedprice / l_quantity AS temperature,
       l_tax AS pressure,
       l_discount AS speed,
       CAST(p_size AS DOUBLE) AS vibration,
       c_acctbal AS humidity,
       CAST(l_partkey AS VARCHAR) AS part_lot
FROM lineitem
JOIN orders   ON l_orderkey = o_orderkey
JOIN customer ON o_custkey = c_custkey
JOIN supplier ON l_suppkey = s_suppkey
JOIN part     ON l_partkey = p_partkey"""


def event_inspections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_view(table(spark, sf_dir, "events"))


def event_view(ev: DataFrame) -> DataFrame:
    """Canonical columns over an events frame (batch or streaming)."""
    ev = ev.select("event_id", "ts", "user_id", "event_type", "value")
    h = F.hour("ts")
    return ev.select(
        F.concat(F.lit("EV-"), F.col("event_id").cast("string")).alias("inspection_id"),
        F.col("ts").alias("timestamp"),
        F.concat(F.lit("M"), F.lpad((F.col("user_id") % 5 + 1).cast("string"), 2, "0")).alias("machine_id"),
        F.concat(F.lit("B"), F.lpad((F.col("user_id") % 40 + 1).cast("string"), 2, "0")).alias("batch_id"),
        F.when(h < 8, "A").when(h < 16, "B").otherwise("C").alias("shift"),
        F.col("event_type").alias("defect_type"),
        F.when(F.col("event_type") == "error", F.lit(1)).otherwise(F.lit(0)).cast("bigint").alias("defect_count"),
        F.lit(1).cast("bigint").alias("units_inspected"),
        F.col("value").alias("temperature"),
    )


EVENT_INSPECTIONS_SQL = """
SELECT concat('EV-', CAST(event_id AS VARCHAR)) AS inspection_id,
       ts AS "timestamp",
       concat('M', lpad(CAST(user_id % 5 + 1 AS VARCHAR), 2, '0')) AS machine_id,
       concat('B', lpad(CAST(user_id % 40 + 1 AS VARCHAR), 2, '0')) AS batch_id,
       CASE WHEN hour(ts) < 8 THEN 'A' WHEN hour(ts) < 16 THEN 'B' ELSE 'C' END AS shift,
       event_type AS defect_type,
       CASE WHEN event_type = 'error' THEN CAST(1 AS BIGINT) ELSE CAST(0 AS BIGINT) END AS defect_count,
       CAST(1 AS BIGINT) AS units_inspected,
       value AS temperature
FROM events"""


def with_views(body: str, no_defect_label: bool = False, events: bool = False) -> str:
    """Prefix an oracle query with the fixture CTE(s) it reads."""
    ctes = [f"inspections AS ({inspections_sql(no_defect_label)})"]
    if events:
        ctes.append(f"event_inspections AS ({EVENT_INSPECTIONS_SQL})")
    body = body.strip()
    if body.upper().startswith("WITH "):
        return "WITH " + ",\n".join(ctes) + ",\n" + body[5:]
    return "WITH " + ",\n".join(ctes) + "\n" + body
