"""Further queries: row rules on notes and annotations, exports, per-patient reports, orders and sets."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from factloom.functions import text as tx
from factloom.operators import facts as fx
from factloom.plans.core import CHECKS, IMPORTANCE_SQL, PHASE_SQL, _phases, checks, counts, j2_asof_phase, with_importance
from factloom.plans.texts import ANN, PLACEHOLDER_SQL, annotations
from factloom.sources import bind, exports
from factloom.sources.bind import FACTS, table
from factloom.sources.shared import shared_dir

QUERIES, SQL = {}, {}


def query(sql: str, facts: bool = False):
    def add(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = counts(f"WITH {FACTS}, {sql}" if facts else sql)
        return f

    return add


@query("SELECT coalesce(CAST(doc_id AS VARCHAR), 'row') AS note_id, p_id, length(text) AS n FROM (SELECT *, doc_id % 50 AS p_id FROM documents) WHERE NOT (text IS NULL AND doc_id IS NULL)")
def p4_p9_note_rows(spark, sf_dir):
    n = bind.notes(spark, sf_dir).where("NOT (text IS NULL AND note_id IS NULL)")
    return n.select(F.coalesce(F.col("note_id").cast("string"), F.lit("row")).alias("note_id"), "p_id", F.length("text").cast("long").alias("n"))


ABSENT_SQL = "CASE WHEN value IS NULL THEN 'missing' WHEN regexp_matches(lower(value), '(not specified|unknown)') THEN 'not specified' WHEN value = 'N' THEN 'not applicable' END"


@query(f"WITH t AS (SELECT o_orderkey AS order_id, 'Status [status] on [date]' || CASE WHEN o_orderkey % 3 = 0 THEN ' by [name], [date]' ELSE '' END AS template FROM orders) SELECT order_id, {PLACEHOLDER_SQL} AS placeholders FROM t")
def p17_placeholders(spark, sf_dir):
    extra = F.when(F.col("o_orderkey") % 3 == 0, " by [name], [date]").otherwise("")
    t = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("order_id"), F.concat(F.lit("Status [status] on [date]"), extra).alias("template"))
    return t.select("order_id", F.array_join(F.array_sort(F.array_distinct(F.regexp_extract_all("template", F.lit(tx.PLACEHOLDER), F.lit(0)))), ",").alias("placeholders"))


@query("WITH d AS (SELECT upper(trim(p_brand)) AS code, min(p_partkey) AS entry FROM part GROUP BY 1) SELECT p_partkey, d.entry FROM part JOIN d ON d.code = upper(trim(p_brand))")
def j12_code_to_entry(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", F.upper(F.trim("p_brand")).alias("code"))
    return p.join(p.groupBy("code").agg(F.min("p_partkey").alias("entry")), "code").select("p_partkey", "entry")


@query("SELECT c_custkey, coalesce(n_name, CAST(c_nationkey AS VARCHAR)) AS label FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_nationkey % 4 != 0) ON n_nationkey = c_nationkey")
def j18_label_or_own_text(spark, sf_dir):
    c, n = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation").where("n_nationkey % 4 != 0")
    return c.join(n, c["c_nationkey"] == n["n_nationkey"], "left").select("c_custkey", F.coalesce("n_name", F.col("c_nationkey").cast("string")).alias("label"))


@query("WITH m AS (SELECT max(o_orderkey) AS m FROM orders) SELECT o_orderkey AS record_id, 'structured' AS source FROM orders UNION ALL SELECT event_id + m, 'notes' FROM events, m")
def j20_u1_offset_append(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    top = o.agg(F.max("o_orderkey").alias("m"))  # one row
    e = table(spark, sf_dir, "events").join(F.broadcast(top))
    return o.select(F.col("o_orderkey").alias("record_id"), F.lit("structured").alias("source")).unionByName(e.select((F.col("event_id") + F.col("m")).alias("record_id"), F.lit("notes").alias("source")))


@query("d AS (SELECT patient_id, min(seq) AS seq FROM facts WHERE core_variable IN ('Order.status', 'Order.priority') GROUP BY 1) SELECT patient_id, core_variable, value, seq FROM facts WHERE core_variable = 'Order.totalprice' UNION ALL SELECT patient_id, 'Diagnosis.code', 'D' || (patient_id % 10), seq FROM d", facts=True)
def j21_replace_by_one_row(spark, sf_dir):
    f = bind.facts(spark, sf_dir).where(fx.entity(F.col("core_variable")) == "Order").where("core_variable != 'Order.date'")
    parts = f.where(F.col("core_variable").isin("Order.status", "Order.priority")).groupBy("patient_id").agg(F.min("seq").alias("seq"))
    code = parts.select("patient_id", F.lit("Diagnosis.code").alias("core_variable"), F.concat(F.lit("D"), F.col("patient_id") % 10).alias("value"), "seq")
    return f.where("core_variable = 'Order.totalprice'").select("patient_id", "core_variable", "value", "seq").unionByName(code)


@query("WITH r AS (SELECT o_orderkey + 5000 * (o_orderkey % 2) AS k FROM orders WHERE o_orderkey % 10 = 1) SELECT count_if(o_orderkey IS NOT NULL) AS deleted, count_if(o_orderkey IS NULL) AS not_found FROM r LEFT JOIN orders ON o_orderkey = k")
def j22_delete_counts(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    r = o.where("o_orderkey % 10 = 1").select((F.col("o_orderkey") + 5000 * (F.col("o_orderkey") % 2)).alias("k"))
    hit = r.join(o, F.col("k") == F.col("o_orderkey"), "left")
    return hit.agg(F.count("o_orderkey").alias("deleted"), F.count_if(F.col("o_orderkey").isNull()).alias("not_found"))


@query(f"WITH {PHASE_SQL}, j AS (SELECT ev.*, coalesce((SELECT max(struct_pack(at := ph.tm, e := ph.event_id, p := phase)).p FROM ph WHERE ph.k = ev.k AND ph.tm <= ev.tm), 'Diagnosis') AS phase FROM ev) SELECT k AS patient_id, phase, count(*) AS n, count_if(value IS NULL) AS missing, bool_and(value IS NOT NULL) AS complete FROM j GROUP BY 1, 2")
def a27_a29_patient_phase(spark, sf_dir):
    e = bind.events(spark, sf_dir).join(j2_asof_phase(spark, sf_dir), "event_id")
    return e.groupBy("patient_id", "phase").agg(F.count("*").alias("n"), F.count_if(F.col("value").isNull()).alias("missing"), F.bool_and(F.col("value").isNotNull()).alias("complete"))


@query(f"{CHECKS}, {IMPORTANCE_SQL} SELECT patient_id, coalesce(importance, 'Unknown') AS importance, count(*) AS checks, count_if(failed) AS n_failed FROM ck LEFT JOIN im USING (core_variable) GROUP BY 1, 2", facts=True)
def a28_patient_importance(spark, sf_dir):
    return with_importance(spark, checks(spark, sf_dir)).groupBy("patient_id", "importance").agg(F.count("*").alias("checks"), F.count_if("failed").alias("n_failed"))


@query("SELECT event_type, CAST(sum(event_id) AS BIGINT) AS total, CAST(min(event_id) AS BIGINT) AS least, CAST(max(event_id) AS BIGINT) AS most, round(avg(event_id), 4) AS mean FROM events GROUP BY 1")
def a48_a49_roll_up(spark, sf_dir):
    v = F.col("event_id")
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.sum(v).alias("total"), F.min(v).alias("least"), F.max(v).alias("most"), F.round(F.avg(v), 4).alias("mean"))


@query("SELECT o_custkey AS patient_id, arg_max(o_orderstatus, struct_pack(a := o_orderdate, b := o_orderkey)) AS last_status FROM orders GROUP BY 1")
def w8_last_value(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("patient_id")).agg(F.max_by("o_orderstatus", F.struct("o_orderdate", "o_orderkey")).alias("last_status"))


@query("WITH m AS (SELECT max(o_orderkey) AS m FROM orders), k AS (SELECT DISTINCT event_type FROM events) SELECT event_type, m + row_number() OVER (ORDER BY event_type) AS next_id FROM k, m")
def w7_next_ids(spark, sf_dir):
    kinds = table(spark, sf_dir, "events").select("event_type").distinct()
    top = table(spark, sf_dir, "orders").agg(F.max("o_orderkey").alias("m"))
    return kinds.join(F.broadcast(top)).select("event_type", (F.col("m") + F.row_number().over(Window.orderBy("event_type"))).alias("next_id"))


@query("SELECT o_orderkey, o_orderpriority FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 10")
def k5_k6_latest(spark, sf_dir):
    return table(spark, sf_dir, "orders").orderBy(F.desc("o_orderdate"), "o_orderkey").select("o_orderkey", "o_orderpriority").limit(10)


@query("x AS (SELECT 1) SELECT DISTINCT core_variable FROM facts WHERE core_variable NOT IN ('Order.status', 'Order.totalprice', 'Order.date', 'Line.returnflag', 'Line.quantity', 'Customer.segment')", facts=True)
def u6_never_checked(spark, sf_dir):
    # Distinct before the difference, which deals rows out by variable.
    f = bind.facts(spark, sf_dir).select("core_variable").distinct()
    return f.subtract(checks(spark, sf_dir).select("core_variable").distinct())


@query("SELECT conv_id, CAST(turn AS BIGINT) AS turn, role, text FROM conversations WHERE text IS NOT NULL")
def s15_backup_and_restore(spark, sf_dir):
    path = f"{shared_dir(spark)}/backup-{uuid.uuid4().hex}"
    exports.back_up(table(spark, sf_dir, "conversations"), path)
    return exports.restore(spark, path, "conv_id long, turn long, role string, text string", ["conv_id", "text"])


@query("""WITH m AS (SELECT n_name AS value, 'N' || n_nationkey AS code FROM nation WHERE n_nationkey % 3 != 0) SELECT n_nationkey, coalesce(m.code, 'UNRESOLVED::' || n_name) AS code, count(*) AS customers FROM customer JOIN nation ON n_nationkey = c_nationkey LEFT JOIN m ON m.value = n_name GROUP BY 1, 2""")
def j17_value_to_code(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    m = n.where("n_nationkey % 3 != 0").select(F.col("n_name").alias("value"), F.concat(F.lit("N"), "n_nationkey").alias("code"))
    coded = n.join(m, n["n_name"] == m["value"], "left").select("n_nationkey", F.coalesce("code", F.concat(F.lit("UNRESOLVED::"), "n_name")).alias("code"))
    return table(spark, sf_dir, "customer").join(coded, F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_nationkey", "code").agg(F.count("*").alias("customers"))


@query("""WITH f AS (SELECT source || CASE WHEN doc_id % 2 = 0 THEN '-a' ELSE '-b' END AS key, count(*) AS n FROM documents GROUP BY 1), w AS (SELECT DISTINCT source || CASE WHEN doc_id % 3 = 0 THEN '-c' ELSE '-a' END AS key FROM documents), b AS (SELECT regexp_replace(key, '-[a-z]$', '') AS base, min(key) AS any_key FROM f GROUP BY 1)
SELECT w.key, coalesce(f.key, b.any_key) AS found FROM w LEFT JOIN f ON f.key = w.key LEFT JOIN b ON b.base = regexp_replace(w.key, '-[a-z]$', '')""")
def j24_key_fallback(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    have = d.select(F.concat("source", F.when(F.col("doc_id") % 2 == 0, "-a").otherwise("-b")).alias("have")).distinct()
    want = d.select(F.concat("source", F.when(F.col("doc_id") % 3 == 0, "-c").otherwise("-a")).alias("key")).distinct().withColumn("base", F.regexp_replace("key", "-[a-z]$", ""))
    base = have.groupBy(F.regexp_replace("have", "-[a-z]$", "").alias("base")).agg(F.min("have").alias("any_key"))
    return want.join(have, want["key"] == have["have"], "left").join(base, "base", "left").select("key", F.coalesce("have", "any_key").alias("found"))


@query("""WITH r AS (SELECT o_orderkey, o_custkey, CASE WHEN o_custkey % 2 = 0 THEN CAST(o_orderdate AS DATE) END AS d FROM orders), k AS (SELECT o_custkey, d, min(o_orderkey) AS first FROM r GROUP BY 1, 2), n AS (SELECT *, dense_rank() OVER (PARTITION BY o_custkey ORDER BY first) AS record_id FROM k) SELECT o_orderkey, record_id FROM r JOIN n ON n.o_custkey = r.o_custkey AND n.d IS NOT DISTINCT FROM r.d""")
def w2_record_ids_by_cardinality(spark, sf_dir):
    day = F.when(F.col("o_custkey") % 2 == 0, F.to_date("o_orderdate"))
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.coalesce(day.cast("string"), F.lit("")).alias("d"))
    keys = o.groupBy("o_custkey", "d").agg(F.min("o_orderkey").alias("first"))
    keys = keys.withColumn("record_id", F.dense_rank().over(Window.partitionBy("o_custkey").orderBy("first")).cast("long"))
    return o.join(keys, ["o_custkey", "d"]).select("o_orderkey", "record_id")


@query("WITH k(entity, cardinality) AS (VALUES ('Order', 0), ('Customer', 1)) SELECT core_variable, coalesce(cardinality, 1) = 0 AS repeatable FROM (SELECT DISTINCT core_variable FROM facts) v LEFT JOIN k ON entity = split_part(core_variable, '.', 1)".replace("WITH k", "k", 1), facts=True)
def p20_repeatable(spark, sf_dir):
    v = bind.facts(spark, sf_dir).select("core_variable").distinct().withColumn("entity", fx.entity(F.col("core_variable")))
    k = spark.createDataFrame([("Order", 0), ("Customer", 1)], "entity string, cardinality int")
    return v.join(F.broadcast(k), "entity", "left").select("core_variable", (F.coalesce("cardinality", F.lit(1)) == 0).alias("repeatable"))
