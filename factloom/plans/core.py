"""Queries over facts, records and events, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from factloom.operators import facts as fx
from factloom.operators import links, quality
from factloom.sources import bind
from factloom.sources.bind import FACTS, table

QUERIES, SQL = {}, {}


def counts(sql: str) -> str:
    """count_if(x) as a BIGINT, which it is not in the other engine."""
    while (at := sql.find("count_if(")) >= 0:
        depth, end = 0, at + len("count_if")
        while True:
            depth += {"(": 1, ")": -1}.get(sql[end], 0)
            end += 1
            if not depth:
                break
        sql = f"{sql[:at]}count(CASE WHEN {sql[at + 9 : end - 1]} THEN 1 END){sql[end:]}"
    return sql


def query(sql: str | None = None, facts: bool = False):
    """Registers a query under its name, with SQL over the driver's tables (after the facts, if wanted)."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = counts((f"WITH {FACTS}, " if facts else "WITH ") + sql.strip().removeprefix("WITH "))
        return f

    return add


@query("""WITH p AS (SELECT o_custkey AS k, CAST(o_orderdate AS TIMESTAMP) AS at, o_orderkey AS id FROM orders),
c AS (SELECT event_id, user_id AS k, CAST(ts AS TIMESTAMP) AS at FROM events)
SELECT event_id, (SELECT max(struct_pack(at := p.at, r := -id, id := id)).id FROM p WHERE p.k = c.k AND p.at <= c.at) AS linked_to FROM c""")
def j1_asof_link(spark, sf_dir):
    child = table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("k"), F.col("ts").cast("timestamp").alias("at"))
    parent = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderdate").cast("timestamp").alias("at"), F.col("o_orderkey").alias("id"), (-F.col("o_orderkey")).alias("r"))
    return links.asof(child, parent, "k", "at", ["id"], [F.col("r")]).select("event_id", F.col("found.id").alias("linked_to"))


PHASES = {"error": "Progression", "purchase": "Recurrence", "signup": "Diagnosis"}
PHASE_SQL = "ph AS (SELECT event_id, user_id AS k, CAST(ts AS TIMESTAMP) AS tm, CASE event_type WHEN 'error' THEN 'Progression' WHEN 'purchase' THEN 'Recurrence' ELSE 'Diagnosis' END AS phase FROM events WHERE event_type IN ('error', 'purchase', 'signup')), ev AS (SELECT event_id, user_id AS k, CAST(ts AS TIMESTAMP) AS tm, event_type, value FROM events WHERE event_type IN ('view', 'click'))"


def _phases(spark, sf_dir):
    e = bind.events(spark, sf_dir).select("event_id", F.col("patient_id").alias("k"), F.col("ts").cast("timestamp").alias("at"), "event_type", "value")
    phase = F.when(F.col("event_type") == "error", "Progression").when(F.col("event_type") == "purchase", "Recurrence").otherwise("Diagnosis")
    return e.where(F.col("event_type").isin("error", "purchase", "signup")).withColumn("phase", phase), e.where(F.col("event_type").isin("view", "click"))


@query(f"""WITH {PHASE_SQL} SELECT event_id, coalesce((SELECT max(struct_pack(tm := ph.tm, e := ph.event_id, p := phase)).p FROM ph WHERE ph.k = ev.k AND ph.tm <= ev.tm), 'Diagnosis') AS phase FROM ev""")
def j2_asof_phase(spark, sf_dir):
    phases, rows = _phases(spark, sf_dir)
    found = links.asof(rows, phases.withColumnRenamed("event_id", "e"), "k", "at", ["phase"], [F.col("e")])
    return found.select("event_id", F.coalesce("found.phase", F.lit("Diagnosis")).alias("phase"))


@query(f"""WITH {PHASE_SQL}, j AS (SELECT event_id, coalesce((SELECT max(struct_pack(tm := ph.tm, e := ph.event_id, p := phase)).p FROM ph WHERE ph.k = ev.k AND ph.tm <= ev.tm), 'Diagnosis') AS phase FROM ev)
SELECT event_type, phase, count(*) AS n FROM ev LEFT JOIN j USING (event_id) GROUP BY ALL""")
def j3_phase_back_to_facts(spark, sf_dir):
    return bind.events(spark, sf_dir).join(j2_asof_phase(spark, sf_dir), "event_id").groupBy("event_type", "phase").agg(F.count("*").alias("n"))


@query(f"""WITH {PHASE_SQL}, p AS (SELECT k, tm, event_id AS id, CAST(tm AS DATE) AS d FROM ph WHERE phase = 'Recurrence')
SELECT event_id, (SELECT min(struct_pack(g := abs(date_diff('day', p.d, CAST(ev.tm AS DATE))), id := p.id)).id FROM p WHERE p.k = ev.k AND abs(date_diff('day', p.d, CAST(ev.tm AS DATE))) <= 14) AS found FROM ev""")
def j4_nearest_within_14_days(spark, sf_dir):
    phases, rows = _phases(spark, sf_dir)
    episodes = phases.where("phase = 'Recurrence'").select("k", "at", F.col("event_id").alias("id"))
    return links.nearest(rows.select("event_id", "k", "at"), episodes, "k", "at", 14, "id").select("event_id", "found")


@query(f"""WITH {PHASE_SQL}, p AS (SELECT k, tm, event_id AS id FROM ph WHERE phase = 'Recurrence'),
j AS (SELECT event_id, ev.tm, (SELECT max(struct_pack(tm := p.tm, id := p.id)) FROM p WHERE p.k = ev.k AND p.tm <= ev.tm) AS m FROM ev)
SELECT event_id, CASE WHEN date_diff('day', CAST(m.tm AS DATE), CAST(tm AS DATE)) <= 14 THEN m.id END AS found FROM j""")
def j5_recent_episode(spark, sf_dir):
    phases, rows = _phases(spark, sf_dir)
    episodes = phases.where("phase = 'Recurrence'").select("k", "at", F.col("event_id").alias("id"))
    found = links.asof(rows.select("event_id", "k", "at"), episodes, "k", "at", ["id"], [F.col("id")])
    return found.select("event_id", F.when(F.datediff("at", "found.at") <= 14, F.col("found.id")).alias("found"))


@query(f"""WITH {PHASE_SQL}, p AS (SELECT k, tm, event_id AS id FROM ph WHERE phase = 'Recurrence'), w AS (SELECT k, max(struct_pack(tm := tm, id := id)).id AS id FROM p GROUP BY k)
SELECT event_id, coalesce((SELECT max(struct_pack(tm := p.tm, id := p.id)).id FROM p WHERE p.k = ev.k AND p.tm <= ev.tm), w.id) AS found FROM ev LEFT JOIN w ON w.k = ev.k""")
def j6_episode_with_fallback(spark, sf_dir):
    phases, rows = _phases(spark, sf_dir)
    episodes = phases.where("phase = 'Recurrence'").select("k", "at", F.col("event_id").alias("id"))
    latest = episodes.groupBy("k").agg(F.max_by("id", F.struct("at", "id")).alias("latest"))
    found = links.asof(rows.select("event_id", "k", "at"), episodes, "k", "at", ["id"], [F.col("id")])
    return found.join(latest, "k", "left").select("event_id", F.coalesce("found.id", "latest").alias("found"))


@query(f"""WITH {PHASE_SQL}, e AS (SELECT event_id, k, tm FROM ph WHERE phase = 'Recurrence' AND event_id % 4 != 0)
SELECT event_id, (SELECT max(struct_pack(tm := e2.tm, id := e2.event_id)).id FROM e AS e2 WHERE e2.k = e.k AND e2.tm < e.tm) AS prior FROM e""")
def j7_prior_episode(spark, sf_dir):
    phases, _ = _phases(spark, sf_dir)
    # Links that exist (here every fourth id) are left out first.
    e = phases.where("phase = 'Recurrence' AND event_id % 4 != 0").select("event_id", "k", "at")
    w = Window.partitionBy("k").orderBy("at").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    best = e.groupBy("k", "at").agg(F.max("event_id").alias("id"))
    prior = best.withColumn("prior", F.lag("id").over(Window.partitionBy("k").orderBy("at"))).select("k", "at", "prior")
    return e.join(prior, ["k", "at"], "left").select("event_id", "prior")


@query("""WITH r AS (SELECT event_id, user_id, event_type, CAST(ts AS DATE) AS d FROM events), s AS (SELECT DISTINCT user_id, event_type, d FROM r WHERE event_id % 3 = 0)
SELECT min(event_id) AS event_id, user_id, event_type, CAST(d AS VARCHAR) AS day FROM r WHERE event_id % 3 != 0 AND NOT EXISTS (SELECT 1 FROM s WHERE s.user_id = r.user_id AND s.event_type = r.event_type AND s.d = r.d) GROUP BY user_id, event_type, d""")
def j8_new_rows_only(spark, sf_dir):
    r = bind.events(spark, sf_dir).select("event_id", F.col("patient_id").alias("user_id"), "event_type", F.to_date("ts").alias("day"))
    return links.new_rows(r.where("event_id % 3 != 0"), r.where("event_id % 3 = 0"), ["user_id", "event_type", "day"], "event_id").withColumn("day", F.col("day").cast("string"))


@query("SELECT split_part(core_variable, '.', 1) AS entity, count(*) AS n, count(value) AS present FROM facts GROUP BY 1".replace("SELECT", "x AS (SELECT 1) SELECT", 1), facts=True)
def p1_entity(spark, sf_dir):
    return bind.facts(spark, sf_dir).groupBy(fx.entity(F.col("core_variable")).alias("entity")).agg(F.count("*").alias("n"), F.count("value").alias("present"))


@query("""t(v, g) AS (VALUES ('Order.status', 'a'), ('quantity', 'b'), ('segment', 'a')) SELECT core_variable, count(*) AS n FROM facts LEFT JOIN t f ON f.v = core_variable LEFT JOIN t s ON s.v = split_part(core_variable, '.', 2) WHERE coalesce(f.g, s.g, 'both') IN ('a', 'both') GROUP BY 1""", facts=True)
def p2_group_filter(spark, sf_dir):
    tags = spark.createDataFrame([("Order.status", "a"), ("quantity", "b"), ("segment", "a")], "v string, g string")
    f = bind.facts(spark, sf_dir).withColumn("short", fx.field(F.col("core_variable")))
    out = f.join(F.broadcast(tags.toDF("core_variable", "full_tag")), "core_variable", "left").join(F.broadcast(tags.toDF("short", "short_tag")), "short", "left")
    return out.where(F.coalesce("full_tag", "short_tag", F.lit("both")).isin("a", "both")).groupBy("core_variable").agg(F.count("*").alias("n"))


@query("""x AS (SELECT core_variable, value, CASE WHEN core_variable LIKE '%date%' THEN 'date' WHEN core_variable LIKE '%price%' OR core_variable LIKE '%balance%' THEN 'float' WHEN core_variable LIKE '%quantity%' OR core_variable LIKE '%nation%' THEN 'Integer' ELSE 'string' END AS type FROM facts)
SELECT core_variable, type, CAST(sum(CASE WHEN type IN ('float', 'Integer') THEN try_cast(value AS DOUBLE) END) AS DOUBLE) AS total, CAST(min(CASE WHEN type = 'date' THEN try_cast(value AS DATE) END) AS VARCHAR) AS first_day FROM x GROUP BY 1, 2""", facts=True)
def p11_p13_typed_values(spark, sf_dir):
    return fx.typed(bind.facts(spark, sf_dir)).groupBy("core_variable", "type").agg(F.sum("number").alias("total"), F.min("day").cast("string").alias("first_day"))


ORDER_VARS = ["Order.status", "Order.priority", "Order.totalprice", "Order.date"]


@query("""SELECT patient_id, record_id, min(value) FILTER (core_variable = 'Order.status') AS status, min(value) FILTER (core_variable = 'Order.priority') AS priority, min(value) FILTER (core_variable = 'Order.totalprice') AS totalprice, min(value) FILTER (core_variable = 'Order.date') AS date FROM facts WHERE core_variable LIKE 'Order.%' GROUP BY 1, 2""".replace("SELECT", "x AS (SELECT 1) SELECT", 1), facts=True)
def a1_pivot_first(spark, sf_dir):
    return fx.pivot(bind.facts(spark, sf_dir), ["patient_id", "record_id"], ORDER_VARS)


@query("""SELECT patient_id, arg_max(value, seq) FILTER (core_variable = 'Order.status' AND value IS NOT NULL) AS status, arg_max(value, seq) FILTER (core_variable = 'Order.priority') AS priority, arg_max(value, seq) FILTER (core_variable = 'Order.totalprice') AS totalprice FROM facts WHERE core_variable IN ('Order.status', 'Order.priority', 'Order.totalprice') GROUP BY 1""".replace("SELECT", "x AS (SELECT 1) SELECT", 1), facts=True)
def a2_pivot_last(spark, sf_dir):
    return fx.pivot(bind.facts(spark, sf_dir), ["patient_id"], ORDER_VARS[:3], last=True)


RULES = [
    ("Order.status", "not_null", "Completeness", None, None, None, None), ("Order.status", "in_set", "Conformance", ["F", "O"], None, None, None),
    ("Order.totalprice", "of_type", "Conformance", None, None, None, "number"), ("Order.totalprice", "between", "Plausibility", None, 1000.0, 200000.0, None),
    ("Order.date", "not_future", "Plausibility", None, None, None, None), ("Line.returnflag", "not_null", "Completeness", None, None, None, None),
    ("Line.quantity", "between", "Plausibility", None, 1.0, 45.0, None), ("Customer.segment", "in_set", "Conformance", ["BUILDING", "MACHINERY"], None, None, None),
    ("Customer.segment", "of_type", "Conformance", None, None, None, "number"),
]
AS_OF = "1997-06-01"


def rules(spark):
    return spark.createDataFrame(RULES, "core_variable string, rule string, dimension string, allowed array<string>, lo double, hi double, kind string")


def checks(spark, sf_dir):
    return quality.checked(bind.facts(spark, sf_dir), rules(spark), AS_OF)


CHECKS = """r(core_variable, rule, dimension) AS (VALUES """ + ", ".join(f"('{a}', '{b}', '{c}')" for a, b, c, *_ in RULES) + """),
ck AS (SELECT f.*, rule, dimension, CASE rule WHEN 'not_null' THEN trim(coalesce(value, '')) = ''
WHEN 'in_set' THEN value IS NOT NULL AND value NOT IN (SELECT unnest(CASE f.core_variable WHEN 'Order.status' THEN ['F', 'O'] ELSE ['BUILDING', 'MACHINERY'] END))
WHEN 'of_type' THEN value IS NOT NULL AND try_cast(value AS DOUBLE) IS NULL
WHEN 'between' THEN coalesce(NOT try_cast(value AS DOUBLE) BETWEEN CASE f.core_variable WHEN 'Line.quantity' THEN 1 ELSE 1000 END AND CASE f.core_variable WHEN 'Line.quantity' THEN 45 ELSE 200000 END, false)
ELSE coalesce(try_cast(value AS DATE) > DATE '1997-06-01', false) END AS failed FROM facts f JOIN r ON r.core_variable = f.core_variable)"""
CHECKS = CHECKS.replace("value NOT IN (SELECT unnest(CASE f.core_variable WHEN 'Order.status' THEN ['F', 'O'] ELSE ['BUILDING', 'MACHINERY'] END))", "NOT list_contains(CASE f.core_variable WHEN 'Order.status' THEN ['F', 'O'] ELSE ['BUILDING', 'MACHINERY'] END, value)")
OUTCOME = "count(*) AS checks, count_if(failed) AS n_failed, round((count(*) - count_if(failed)) * 100.0 / count(*), 4) AS percent_passed"


@query(f"{CHECKS} SELECT core_variable, rule, {OUTCOME} FROM ck GROUP BY 1, 2", facts=True)
def a3_a9_rule_outcomes(spark, sf_dir):
    return quality.outcome(checks(spark, sf_dir), "core_variable", "rule")


@query("""WITH x AS (SELECT o_orderstatus AS a, CASE WHEN o_orderkey % 11 != 0 THEN o_orderpriority END AS b FROM orders) SELECT count(*) AS checks, count_if(a = 'F' AND b IS NOT NULL) AS n_failed FROM x""")
def a8_null_if(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("a"), F.when(F.col("o_orderkey") % 11 != 0, F.col("o_orderpriority")).alias("b"))
    return o.agg(F.count("*").alias("checks"), F.count_if((F.col("a") == "F") & F.col("b").isNotNull()).alias("n_failed"))


@query(f"{CHECKS} SELECT patient_id, record_id, core_variable, value, rule, CASE rule WHEN 'not_null' THEN 'value is missing' WHEN 'in_set' THEN 'value is not allowed' WHEN 'of_type' THEN 'value has another type' WHEN 'between' THEN 'value is out of range' ELSE 'date is in the future' END AS reason FROM ck WHERE failed", facts=True)
def a10_violations(spark, sf_dir):
    reason = F.when(F.col("rule") == "not_null", "value is missing").when(F.col("rule") == "in_set", "value is not allowed").when(F.col("rule") == "of_type", "value has another type").when(F.col("rule") == "between", "value is out of range").otherwise("date is in the future")
    return checks(spark, sf_dir).where("failed").select("patient_id", "record_id", "core_variable", "value", "rule", reason.alias("reason"))


@query(f"{CHECKS} SELECT core_variable, count(*) AS elements, count_if(failed) AS failures FROM ck WHERE rule = 'not_null' GROUP BY 1", facts=True)
def a11_not_null_counts(spark, sf_dir):
    return checks(spark, sf_dir).where("rule = 'not_null'").groupBy("core_variable").agg(F.count("*").alias("elements"), F.count_if("failed").alias("failures"))


@query(f"{CHECKS}, e AS (SELECT original_source, patient_id, count_if(NOT failed) / count(*) AS share FROM ck GROUP BY 1, 2) SELECT original_source, count(*) AS patients, count_if(share >= 0.8) AS passing FROM e GROUP BY 1", facts=True)
def a14_patients_passing(spark, sf_dir):
    return quality.patients_passing(checks(spark, sf_dir), "original_source")


@query(f"{CHECKS}, e AS (SELECT original_source, patient_id, count_if(NOT failed) / count(*) AS share FROM ck GROUP BY 1, 2), p AS (SELECT original_source, count(*) AS patients, count_if(share >= 0.8) AS passing FROM e GROUP BY 1), v AS (SELECT original_source, count(DISTINCT core_variable) AS variables, {OUTCOME} FROM ck GROUP BY 1) SELECT * FROM v JOIN p USING (original_source)", facts=True)
def a15_source_report(spark, sf_dir):
    rows = checks(spark, sf_dir)
    variables = rows.groupBy("original_source").agg(F.count_distinct("core_variable").alias("variables"))
    return variables.join(quality.outcome(rows, "original_source"), "original_source").join(quality.patients_passing(rows, "original_source"), "original_source")


@query(f"{CHECKS} SELECT core_variable, {OUTCOME}, list_aggregate(list_sort(list(DISTINCT dimension)), 'string_agg', ',') AS dimensions FROM ck GROUP BY 1", facts=True)
def a16_variable_summary(spark, sf_dir):
    rows = checks(spark, sf_dir)
    return quality.outcome(rows, "core_variable").join(rows.groupBy("core_variable").agg(F.array_join(F.array_sort(F.collect_set("dimension")), ",").alias("dimensions")), "core_variable")


@query("""SELECT core_variable, count_if(trim(coalesce(value, '')) = '') AS blanks, count(DISTINCT CASE WHEN trim(coalesce(value, '')) = '' THEN patient_id END) AS patients FROM facts GROUP BY 1""".replace("SELECT", "x AS (SELECT 1) SELECT", 1), facts=True)
def a18_blanks(spark, sf_dir):
    return bind.facts(spark, sf_dir).groupBy("core_variable").agg(F.count_if(quality.blank()).alias("blanks"), F.count_distinct(F.when(quality.blank(), F.col("patient_id"))).alias("patients"))


#: The report on coded variables for the SQL twins, by any columns.
_ALLOWED = "CASE core_variable WHEN 'Order.status' THEN ['F', 'O'] ELSE ['BUILDING', 'MACHINERY'] END"
IN_SET = "s AS (SELECT *, trim(value) AS v, {0} AS allowed FROM ck WHERE rule = 'in_set'), i AS (SELECT {1}, count(*) AS checks, count_if(failed) AS n_failed, any_value(allowed) AS a, list_sort(coalesce(list(DISTINCT v) FILTER (v NOT IN ('', 'nan', 'None', 'NaT')), [])) AS o, count(DISTINCT patient_id) FILTER (failed AND v NOT IN ('', 'nan', 'None', 'NaT')) AS patients FROM s GROUP BY {1}), it AS (SELECT {1}, checks, n_failed, array_to_string(list_sort(a), ',') AS expected, array_to_string(o, ',') AS observed, array_to_string(list_filter(o, lambda x: NOT list_contains(a, x)), ',') AS unexpected, patients FROM i)"


def in_set(spark, sf_dir, *by):
    out = quality.in_set(checks(spark, sf_dir).where("rule = 'in_set'"), *by)
    return out.withColumns({c: F.array_join(c, ",") for c in ("expected", "observed", "unexpected")})


@query(f"{CHECKS}, {IN_SET.format(_ALLOWED, 'core_variable, record_id')} SELECT * FROM it", facts=True)
def a20_in_set_by_record(spark, sf_dir):
    """Expected, observed and unexpected values of every coded variable in each record, and the patients concerned."""
    return in_set(spark, sf_dir, "core_variable", "record_id")


IMPORTANCE = {"Order.status": "High", "Order.totalprice": "High", "Line.quantity": "Medium", "Line.returnflag": "Low"}
IMPORTANCE_SQL = "im(core_variable, importance) AS (VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in IMPORTANCE.items()) + ")"


def with_importance(spark, rows):
    return rows.join(F.broadcast(spark.createDataFrame(list(IMPORTANCE.items()), "core_variable string, importance string")), "core_variable", "left").fillna("Unknown", ["importance"])


@query("""SELECT patient_id, record_id, CAST(min(CASE WHEN lower(core_variable) LIKE '%date%' THEN try_cast(value AS DATE) END) AS VARCHAR) AS record_date FROM facts GROUP BY 1, 2""".replace("SELECT", "x AS (SELECT 1) SELECT", 1), facts=True)
def a24_record_dates(spark, sf_dir):
    return bind.facts(spark, sf_dir).groupBy("patient_id", "record_id").agg(F.min(F.when(F.lower("core_variable").contains("date"), F.expr("try_cast(value AS DATE)"))).cast("string").alias("record_date"))


@query(f"WITH {PHASE_SQL}, j AS (SELECT *, coalesce((SELECT max(struct_pack(tm := ph.tm, e := ph.event_id, p := phase)).p FROM ph WHERE ph.k = ev.k AND ph.tm <= ev.tm), 'Diagnosis') AS phase FROM ev), s(phase) AS (VALUES ('Diagnosis'), ('Progression'), ('Recurrence')) SELECT s.phase, count(j.k) AS n, count(DISTINCT j.k) AS patients, count_if(j.k IS NOT NULL AND value IS NULL) AS missing FROM s LEFT JOIN j USING (phase) GROUP BY 1")
def a25_phase_missingness(spark, sf_dir):
    e = bind.events(spark, sf_dir).join(j2_asof_phase(spark, sf_dir), "event_id")
    spine = spark.createDataFrame([("Diagnosis",), ("Progression",), ("Recurrence",)], "phase string")
    got = e.groupBy("phase").agg(F.count("*").alias("n"), F.count_distinct("patient_id").alias("patients"), F.count_if(F.col("value").isNull()).alias("missing"))
    return spine.join(got, "phase", "left").fillna(0)


@query("""SELECT patient_id, split_part(core_variable, '.', 1) AS entity, count(DISTINCT coalesce(record_id, '')) AS instances FROM facts GROUP BY 1, 2""".replace("SELECT", "x AS (SELECT 1) SELECT", 1), facts=True)
def a30_instances(spark, sf_dir):
    return bind.facts(spark, sf_dir).groupBy("patient_id", fx.entity(F.col("core_variable")).alias("entity")).agg(F.count_distinct(F.coalesce("record_id", F.lit(""))).alias("instances"))


MATRIX_VARS = ["Order.status", "Order.priority", "Line.returnflag", "Customer.segment"]
MATRIX = "v(core_variable) AS (VALUES " + ", ".join(f"('{v}')" for v in MATRIX_VARS) + """), n AS (SELECT patient_id, core_variable, count(*) AS n, count_if(trim(coalesce(value, '')) != '') AS filled FROM facts GROUP BY 1, 2),
mx AS (SELECT p.patient_id, v.core_variable, CASE WHEN n IS NULL THEN 'Not present' WHEN filled = 0 THEN 'Missing' WHEN filled < n THEN 'Sometimes' ELSE '' END AS state FROM (SELECT DISTINCT patient_id FROM facts) p CROSS JOIN v LEFT JOIN n ON n.patient_id = p.patient_id AND n.core_variable = v.core_variable)"""


@query(f"{MATRIX} SELECT patient_id, count_if(state != '') AS not_complete, round(count_if(state != '') * 100.0 / count(*), 4) AS percent FROM mx GROUP BY 1", facts=True)
def a32_matrix_by_patient(spark, sf_dir):
    m = quality.missing_matrix(bind.facts(spark, sf_dir), MATRIX_VARS)
    bad = F.count_if(F.col("state") != "")
    return m.groupBy("patient_id").agg(bad.alias("not_complete"), F.round(bad * 100.0 / F.count("*"), 4).alias("percent"))


@query("""y AS (SELECT *, CASE WHEN core_variable LIKE 'Customer.%' THEN NULL ELSE date_ref END AS on_date FROM facts WHERE value IS NOT NULL) SELECT patient_id, core_variable, CAST(on_date AS VARCHAR) AS on_date, count(DISTINCT value) AS n_values, min(value) AS low, max(value) AS high, array_to_string(list_sort(list(DISTINCT original_source)), ',') AS sources FROM y GROUP BY patient_id, core_variable, y.on_date HAVING count(DISTINCT value) > 1""", facts=True)
def a46_export_conflicts(spark, sf_dir):
    return quality.conflicts(bind.facts(spark, sf_dir), ["Customer"]).withColumn("on_date", F.col("on_date").cast("string"))


@query("""WITH k AS (SELECT o_custkey, CAST(o_orderdate AS DATE) AS d, min(o_orderkey) AS first FROM orders GROUP BY 1, 2), r AS (SELECT *, dense_rank() OVER (PARTITION BY o_custkey ORDER BY first) AS record_id FROM k) SELECT o_orderkey, record_id FROM orders JOIN r ON r.o_custkey = orders.o_custkey AND r.d = CAST(o_orderdate AS DATE)""")
def w1_record_ids(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.to_date("o_orderdate").alias("d"))
    keys = o.groupBy("o_custkey", "d").agg(F.min("o_orderkey").alias("first"))
    keys = keys.withColumn("record_id", F.dense_rank().over(Window.partitionBy("o_custkey").orderBy("first")).cast("long"))
    return o.join(keys, ["o_custkey", "d"]).select("o_orderkey", "record_id")


@query("""WITH n AS (SELECT doc_id, 'n' || (doc_id % 700) AS note_id FROM documents) SELECT doc_id, CASE WHEN count(*) OVER (PARTITION BY note_id) > 1 THEN note_id || '_' || doc_id ELSE note_id END AS note_id FROM n""")
def w3_unique_note_ids(spark, sf_dir):
    n = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("n"), F.col("doc_id") % 700).alias("note_id"))
    twice = n.groupBy("note_id").count().where("count > 1").select("note_id", F.lit(True).alias("twice"))
    return n.join(twice, "note_id", "left").select("doc_id", F.when(F.col("twice"), F.concat_ws("_", "note_id", "doc_id")).otherwise(F.col("note_id")).alias("note_id"))


@query(r"""WITH n AS (SELECT doc_id, CASE WHEN doc_id % 41 != 0 THEN lower(trim(regexp_replace(text, '[ \t\n\r]+', ' ', 'g'))) END AS t FROM documents) SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS kept FROM n""")
def w4_duplicate_texts(spark, sf_dir):
    """The first id of each text, spaces and case aside; rows without a text are one group. Digests only bring likely equals together:
    the texts themselves are compared, and only those of digests that several rows have are shuffled."""
    folded = F.lower(F.trim(F.regexp_replace("text", "[ \t\n\r]+", " ")))
    d = table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 41 != 0, folded).alias("t")).withColumn("digest", F.xxhash64("t"))
    often = d.groupBy("digest").agg(F.count("*").alias("n")).where("n > 1").select("digest")
    many = d.join(often, "digest", "left_semi")
    first = many.groupBy("digest", "t").agg(F.min("doc_id").alias("kept"))
    found = many.join(first, (many["digest"] == first["digest"]) & many["t"].eqNullSafe(first["t"])).select("doc_id", "kept")
    return d.join(often, "digest", "left_anti").select("doc_id", F.col("doc_id").alias("kept")).unionByName(found)


@query("""WITH x AS (SELECT 1) SELECT o_custkey AS patient_id, min(struct_pack(d := o_orderdate, k := o_orderkey)).k AS first_order FROM orders GROUP BY 1""")
def w5_first_by_date(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("patient_id")).agg(F.min_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("first_order"))


@query("""x AS (SELECT core_variable, count(value) AS n FROM facts GROUP BY 1) SELECT * FROM x ORDER BY n DESC, core_variable LIMIT 5""", facts=True)
def k4_top_variables(spark, sf_dir):
    return bind.facts(spark, sf_dir).groupBy("core_variable").agg(F.count("value").alias("n")).orderBy(F.desc("n"), "core_variable").limit(5)


@query("""WITH m AS (SELECT DISTINCT p_brand AS v FROM part), d AS (SELECT DISTINCT p_brand AS v FROM part WHERE p_size > 25), c AS (SELECT DISTINCT p_type AS v FROM part WHERE p_size > 45) SELECT v FROM (SELECT v FROM m INTERSECT SELECT v FROM d) UNION SELECT v FROM c""")
def u2_model_and_checked(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return p.select(F.col("p_brand").alias("v")).intersect(p.where("p_size > 25").select("p_brand")).union(p.where("p_size > 45").select("p_type")).distinct()


@query("""WITH x AS (SELECT 1) SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)""")
def u3_without_entities(spark, sf_dir):
    return table(spark, sf_dir, "customer").join(table(spark, sf_dir, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")
