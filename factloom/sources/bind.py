"""The driver's tables as notes, facts (entity-attribute-value), phase events and dictionaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _values(rows: DataFrame, keys: list, pairs: dict) -> DataFrame:
    """One row for each variable, from one scan of rows: keys and values are made before rows are multiplied, and those not asked for not at all."""
    made = rows.select(*keys, *[v.cast("string").alias(f"value_{i}") for i, v in enumerate(pairs.values())])
    each = made.select("*", F.explode(F.array(*[F.lit(k) for k in pairs])).alias("core_variable"))
    value = F.coalesce(*[F.when(F.col("core_variable") == k, F.col(f"value_{i}")) for i, k in enumerate(pairs)])
    return each.withColumn("value", value).drop(*[f"value_{i}" for i in range(len(pairs))])


def facts(spark: SparkSession, sf_dir: str, day_texts: bool = False) -> DataFrame:
    """patient_id, original_source, record_id, seq, date_ref, core_variable, value of orders, lines and customers.

    Order.status is blank for every seventh order and Line.returnflag for every fifth part, so that data are missing. With day_texts
    date_ref is text, which is made once for all variables of a row.
    """
    kind = "string" if day_texts else "date"
    o, li, c = (table(spark, sf_dir, n) for n in ("orders", "lineitem", "customer"))
    day = F.to_date("o_orderdate")
    orders = _values(
        o,
        [F.col("o_custkey").alias("patient_id"), F.concat(F.lit("src"), F.col("o_orderkey") % 3).alias("original_source"), F.concat(F.lit("O"), F.col("o_orderkey")).alias("record_id"), F.col("o_orderkey").alias("seq"), day.cast(kind).alias("date_ref")],
        {"Order.status": F.when(F.col("o_orderkey") % 7 != 0, F.col("o_orderstatus")), "Order.priority": F.col("o_orderpriority"), "Order.totalprice": F.round("o_totalprice").cast("long"), "Order.date": day},
    )
    ship = F.to_date("l_shipdate")
    lines = li.join(o.select("o_orderkey", "o_custkey"), li["l_orderkey"] == F.col("o_orderkey"))
    lines = _values(
        lines,
        [F.col("o_custkey").alias("patient_id"), F.concat(F.lit("src"), F.col("l_suppkey") % 3).alias("original_source"), F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", ship.cast("string")).alias("record_id"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("seq"), ship.cast(kind).alias("date_ref")],
        {"Line.returnflag": F.when(F.col("l_partkey") % 5 != 0, F.col("l_returnflag")), "Line.linestatus": F.col("l_linestatus"), "Line.quantity": F.col("l_quantity").cast("long")},
    )
    customers = _values(
        c,
        [F.col("c_custkey").alias("patient_id"), F.lit("src0").alias("original_source"), F.concat(F.lit("C"), F.col("c_custkey")).alias("record_id"), F.col("c_custkey").alias("seq"), F.lit(None).cast(kind).alias("date_ref")],
        {"Customer.segment": F.col("c_mktsegment"), "Customer.balance": F.round("c_acctbal").cast("long"), "Customer.nation": F.col("c_nationkey")},
    )
    return orders.unionByName(lines).unionByName(customers)


#: The same facts for the SQL twins.
FACTS = """
o AS (SELECT o_custkey AS patient_id, 'src' || (o_orderkey % 3) AS original_source, 'O' || o_orderkey AS record_id, o_orderkey AS seq, CAST(o_orderdate AS DATE) AS date_ref, * FROM orders),
l AS (SELECT o_custkey AS patient_id, 'src' || (l_suppkey % 3) AS original_source, concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(CAST(l_shipdate AS DATE) AS VARCHAR)) AS record_id, l_orderkey * 8 + l_linenumber AS seq, CAST(l_shipdate AS DATE) AS date_ref, lineitem.* FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
c AS (SELECT c_custkey AS patient_id, 'src0' AS original_source, 'C' || c_custkey AS record_id, c_custkey AS seq, CAST(NULL AS DATE) AS date_ref, * FROM customer),
facts AS (
SELECT patient_id, original_source, record_id, seq, date_ref, 'Order.status' AS core_variable, CASE WHEN o_orderkey % 7 != 0 THEN o_orderstatus END AS value FROM o
UNION ALL SELECT patient_id, original_source, record_id, seq, date_ref, 'Order.priority', o_orderpriority FROM o
UNION ALL SELECT patient_id, original_source, record_id, seq, date_ref, 'Order.totalprice', CAST(CAST(round(o_totalprice) AS BIGINT) AS VARCHAR) FROM o
UNION ALL SELECT patient_id, original_source, record_id, seq, date_ref, 'Order.date', CAST(date_ref AS VARCHAR) FROM o
UNION ALL SELECT patient_id, original_source, record_id, seq, date_ref, 'Line.returnflag', CASE WHEN l_partkey % 5 != 0 THEN l_returnflag END FROM l
UNION ALL SELECT patient_id, original_source, record_id, seq, date_ref, 'Line.linestatus', l_linestatus FROM l
UNION ALL SELECT patient_id, original_source, record_id, seq, date_ref, 'Line.quantity', CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) FROM l
UNION ALL SELECT patient_id, original_source, record_id, seq, date_ref, 'Customer.segment', c_mktsegment FROM c
UNION ALL SELECT patient_id, original_source, record_id, seq, date_ref, 'Customer.balance', CAST(CAST(round(c_acctbal) AS BIGINT) AS VARCHAR) FROM c
UNION ALL SELECT patient_id, original_source, record_id, seq, date_ref, 'Customer.nation', CAST(c_nationkey AS VARCHAR) FROM c)
"""


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """note_id, p_id, report_type, center, text."""
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("note_id"), (F.col("doc_id") % 50).alias("p_id"), F.col("source").alias("report_type"), F.col("lang").alias("center"), "text")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, patient_id, ts, event_type, value."""
    return table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("patient_id"), F.col("ts").cast("timestamp_ntz").alias("ts"), "event_type", "value")
