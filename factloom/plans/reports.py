"""Row rules of exports and quality reports in full, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from factloom.operators import facts as fx
from factloom.operators import quality
from factloom.operators.extract import invalid
from factloom.plans.core import _ALLOWED, CHECKS, IMPORTANCE, IN_SET, MATRIX, MATRIX_VARS, ORDER_VARS, PHASE_SQL, RULES, checks, counts, in_set, j2_asof_phase
from factloom.plans.review import a43_diagnosis_resolution
from factloom.plans.review import SQL as REVIEW
from factloom.sources import bind
from factloom.sources.bind import FACTS, table

QUERIES, SQL = {}, {}


def query(sql: str | None = None, facts: bool = False):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = counts(f"WITH {FACTS}, {sql}" if facts else sql.strip())
        return f

    return add


#: Values of an export, some of which say that there is none.
VALUE = "CASE o_orderkey % 9 WHEN 0 THEN 'Grade not specified here' WHEN 1 THEN 'Unknown site' WHEN 2 THEN ' none. ' WHEN 3 THEN '[select value]' WHEN 4 THEN '  ' WHEN 5 THEN 'no data' WHEN 6 THEN 'an unknown one' ELSE o_orderpriority END"
ABSENT_SQL = " ".join(f"WHEN regexp_matches(v, '{p}') THEN regexp_extract(v, '{p}')" for p in fx.ABSENCES)


@query(f"WITH a AS (SELECT o_orderkey AS id, {VALUE} AS raw, trim({VALUE}) AS v FROM orders), b AS (SELECT id, v, CASE WHEN v = '' THEN 'Empty value' ELSE 'Absence indicator detected: \"' || trim(CASE {ABSENT_SQL} END) || '\"' END AS reason FROM a) SELECT id, v AS value, coalesce(reason, '') AS reason, reason IS NULL AS kept FROM b")
def p5_absences(spark, sf_dir):
    """Rows to keep and to leave out of an export, with the reason."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.expr(VALUE).alias("v"))
    reason = fx.absence(F.col("v"))
    return o.select("id", F.trim("v").alias("value"), F.coalesce(reason, F.lit("")).alias("reason"), reason.isNull().alias("kept"))


@query(f"WITH a AS (SELECT o_custkey AS patient, trim({VALUE}) AS v FROM orders), b AS (SELECT patient, CASE WHEN v = '' THEN 'Empty value' ELSE CASE {ABSENT_SQL} END END AS reason FROM a), n AS (SELECT patient, count(reason) AS excluded FROM b GROUP BY 1) SELECT n.patient, excluded, coalesce(d.reasons, '') AS review_reasons FROM n LEFT JOIN (SELECT * FROM ({REVIEW['a43_diagnosis_resolution']}) WHERE status = 'needs_review') d ON d.patient = n.patient")
def a52_export_metadata(spark, sf_dir):
    """Rows left out of each patient and, for patients to be reviewed, why."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("patient"), fx.absence(F.expr(VALUE)).alias("reason"))
    review = a43_diagnosis_resolution(spark, sf_dir).where("status = 'needs_review'").select("patient", "reasons")
    return o.groupBy("patient").agg(F.count("reason").alias("excluded")).join(review, "patient", "left").select("patient", "excluded", F.coalesce("reasons", F.lit("")).alias("review_reasons"))


@query("x AS (SELECT *, lower(trim(coalesce(value, ''))) AS v, contains(lower(core_variable), 'date') AS d FROM facts) SELECT core_variable, count_if(v IN ('n/a', 'na', 'none', 'null', 'unknown', 'unk', '-', '--', '') OR regexp_full_match(v, '\\[[^\\]]+\\]') OR (d AND NOT regexp_matches(v, '\\d{1,2}/\\d{1,2}/\\d{4}|\\d{4}-\\d{2}-\\d{2}'))) AS invalid FROM x GROUP BY 1", facts=True)
def p6_invalid_values(spark, sf_dir):
    """Placeholders, and values of date variables without a date."""
    kind = F.when(F.lower("core_variable").contains("date"), "DATE").otherwise("TEXT")
    return bind.facts(spark, sf_dir).groupBy("core_variable").agg(F.count_if(invalid(kind, F.col("value"))).alias("invalid"))


#: Names that a field may have, and texts to clean by the type of the name.
FIELDS = ["dateOfX", "lastContact", "ageAtDx", "numberOfCycles", "bmi", "tumorSize", "rupture", "treatmentCompleted", "rtCompletedAsPlanned", "patient", "episodeEvent", "episodeKind", "hospital", "grade"]
CLEANABLE = "'seen ' || CAST(CAST(o_orderdate AS DATE) AS STRING) || ' at 5/6/2020 with ' || CAST(o_custkey AS STRING) || CASE WHEN o_orderkey % 2 = 0 THEN '.25 cm' ELSE ' units' END"
_TYPE = "CASE WHEN regexp_matches(f, 'date|lastcontact') THEN 'date' WHEN regexp_matches(f, 'age|count|number|cycles') THEN 'Integer' WHEN regexp_matches(f, 'bmi|diameter|dose|fractions|size') THEN 'float' WHEN regexp_matches(f, 'rupture|hyperthermia') OR (contains(f, 'completed') AND NOT contains(f, 'asplanned')) THEN 'boolean' WHEN f IN ('patient', 'cancerepisode', 'episodeevent', 'systemictreatment') THEN 'reference' WHEN regexp_matches(f, 'hospital|location|doneby|definedat') THEN 'String' ELSE 'CodeableConcept' END"


@query(f"WITH a AS (SELECT o_orderkey AS id, {FIELDS}[o_orderkey % {len(FIELDS)} + 1] AS field, {CLEANABLE} AS v FROM orders), b AS (SELECT *, lower(field) AS f FROM a), c AS (SELECT *, {_TYPE} AS type FROM b) SELECT id, field, type, CASE type WHEN 'date' THEN '5/6/2020' WHEN 'Integer' THEN regexp_extract(v, '\\b(\\d+)\\b', 1) WHEN 'float' THEN regexp_extract(v, '\\b(\\d+(?:\\.\\d+)?)\\b', 1) ELSE v END AS value FROM c")
def p11_p12_cleaned_by_type(spark, sf_dir):
    """The type that a field's name implies, and the date, integer or number that a text of that type holds."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.element_at(F.array(*[F.lit(f) for f in FIELDS]), (F.col("o_orderkey") % len(FIELDS) + 1).cast("int")).alias("field"), F.expr(CLEANABLE).alias("v"))
    kind = fx.export_type(F.col("field"))
    return o.select("id", "field", kind.alias("type"), fx.cleaned_by_type(F.col("v"), kind).alias("value"))


@query("x AS (SELECT core_variable, patient_id, value, CASE WHEN core_variable = 'Order.status' THEN 'Integer' WHEN core_variable IN ('Line.quantity', 'Customer.nation') THEN 'Integer' ELSE 'float' END AS type FROM facts WHERE core_variable IN ('Order.status', 'Line.quantity', 'Customer.nation', 'Order.totalprice', 'Customer.segment')), cc AS (SELECT *, try_cast(value AS DOUBLE) AS n FROM x) SELECT core_variable, type, count(n) AS numbers, count_if(value IS NOT NULL AND trim(value) != '' AND n IS NULL) AS lost, count(DISTINCT CASE WHEN value IS NOT NULL AND trim(value) != '' AND n IS NULL THEN patient_id END) AS patients FROM cc GROUP BY 1, 2", facts=True)
def p13_coercion_losses(spark, sf_dir):
    """What numeric coercion loses, with the patients that it fails for."""
    names = ["Order.status", "Line.quantity", "Customer.nation", "Order.totalprice", "Customer.segment"]
    f = bind.facts(spark, sf_dir).where(F.col("core_variable").isin(names))
    kind = F.when(F.col("core_variable").isin(names[:3]), "Integer").otherwise("float")
    n = F.expr("try_cast(value AS DOUBLE)")
    lost = F.col("value").isNotNull() & (F.trim("value") != "") & n.isNull()
    return f.groupBy("core_variable", kind.alias("type")).agg(F.count(n).alias("numbers"), F.count_if(lost).alias("lost"), F.count_distinct(F.when(lost, F.col("patient_id"))).alias("patients"))


#: Importance by keys of letters and digits: full names, or fields only.
IMPORTANT = {"Order_status": "M", "total-Price": "R", "Line_quantity": "M", "return_flag": "O"}
GRADES = {"M": "High", "R": "Medium", "O": "Low"}
MODEL = ["Order.status", "Order.totalprice", "Line.quantity", "Line.returnflag", "Customer.segment", "Order.neverseen"]
_IM = "im(k, g) AS (VALUES " + ", ".join(f"('{''.join(c.lower() for c in k if c.isalnum())}', '{GRADES[v]}')" for k, v in IMPORTANT.items()) + f"), md(core_variable) AS (VALUES {', '.join(f'({m!r})' for m in MODEL)})"
_GRADE = "coalesce((SELECT g FROM im WHERE k = regexp_replace(lower(core_variable), '[^a-z0-9]', '', 'g')), (SELECT g FROM im WHERE k = regexp_replace(lower(split_part(core_variable, '.', 2)), '[^a-z0-9]', '', 'g')), 'Unknown')"


def importance(variable: Column) -> Column:
    table_ = F.create_map(*[F.lit(x) for k, v in IMPORTANT.items() for x in ("".join(c.lower() for c in k if c.isalnum()), GRADES[v])])
    key = lambda c: F.regexp_replace(F.lower(c), "[^a-z0-9]", "")
    return F.coalesce(F.try_element_at(table_, key(variable)), F.try_element_at(table_, key(fx.field(variable))), F.lit("Unknown"))


@query(f"{CHECKS}, {_IM}, g AS (SELECT ck.*, {_GRADE} AS importance FROM ck), p AS (SELECT importance, patient_id, count_if(NOT failed) / count(*) AS share FROM g GROUP BY 1, 2), pp AS (SELECT importance, count(*) AS patients, count_if(share >= 0.8) AS passing FROM p GROUP BY 1), m AS (SELECT {_GRADE} AS importance, count(*) AS model_variables, count_if(core_variable NOT IN (SELECT core_variable FROM ck)) AS never_checked FROM md GROUP BY 1), s AS (SELECT importance, count(DISTINCT core_variable) AS variables, count(*) AS checks, count_if(failed) AS n_failed FROM g GROUP BY 1) SELECT importance, variables, patients, passing, checks, n_failed, coalesce(model_variables, 0) AS model_variables, coalesce(never_checked, 0) AS never_checked FROM s JOIN pp USING (importance) LEFT JOIN m USING (importance)", facts=True)
def a21_p15_importance_summary(spark, sf_dir):
    """Variables, patients by the 80 % rule and checks of each importance, against the whole data model. One pass: checks are summed by
    variable and patient first."""
    by = checks(spark, sf_dir).groupBy(importance(F.col("core_variable")).alias("importance"), "patient_id", "core_variable").agg(F.count("*").alias("n"), F.count_if("failed").alias("bad"))
    by_patient = by.groupBy("importance", "patient_id").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"), F.collect_set("core_variable").alias("v"))
    share = (F.col("n") - F.col("bad")) / F.col("n")
    out = by_patient.groupBy("importance").agg(F.array_distinct(F.flatten(F.collect_set("v"))).alias("v"), F.count("*").alias("patients"), F.count_if(share >= quality.PATIENT_PASS).alias("passing"), F.sum("n").alias("checks"), F.sum("bad").alias("n_failed"))
    checked = {r[0] for r in RULES}
    model = spark.createDataFrame([(m, m not in checked) for m in MODEL], "core_variable string, never boolean").groupBy(importance(F.col("core_variable")).alias("importance")).agg(F.count("*").alias("model_variables"), F.count_if("never").alias("never_checked"))
    out = out.join(F.broadcast(model), "importance", "left")
    return out.select("importance", F.size("v").cast("long").alias("variables"), "patients", "passing", "checks", "n_failed", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("model_variables", "never_checked")])


#: Expected annotations as the notes column holds them, and the prompts that ask for them.
KEYED = "CASE o_orderkey % 4 WHEN 0 THEN 'Tumor grade: high | Site: leg: left' WHEN 1 THEN 'grade: low|stage: two' WHEN 2 THEN 'x | no keys' ELSE 'Age (years) of stage: 4' END"
ASKED = "CASE o_custkey % 3 WHEN 0 THEN 'grade' WHEN 1 THEN 'tumor site' ELSE 'stage' END"


@query(f"""WITH a AS (SELECT o_orderkey AS id, {KEYED} AS t, {ASKED} AS q FROM orders), p AS (SELECT *, list_filter(list_transform(string_split(t, '|'), lambda x: trim(x)), lambda x: contains(x, ':')) AS l FROM a),
k AS (SELECT *, list_filter(l, lambda x: contains(lower(trim(split_part(x, ':', 1))), q) OR contains(q, lower(trim(split_part(x, ':', 1)))))[1] AS hit FROM p) SELECT id, q AS prompt, coalesce(trim(substr(hit, instr(hit, ':') + 1)), nullif(trim(regexp_extract(t, '(?is)' || q || '\\s*:\\s*([^|]+)', 1)), '')) AS expected FROM k""")
def p16_expected_annotations(spark, sf_dir):
    """The first part whose key is within the prompt's name or holds it, else what a pattern finds."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.expr(KEYED).alias("t"), F.expr(ASKED).alias("prompt"))
    return o.select("id", "prompt", fx.expected_part(F.col("t"), F.col("prompt")).alias("expected"))


RESULT = "CASE conv_id % 4 WHEN 0 THEN 'ERROR: x' WHEN 1 THEN '' ELSE left(text, 9) END"
REASON = "CASE turn % 5 WHEN 0 THEN repeat('r', 1997) || '...' WHEN 1 THEN 'It is Not mentioned here' WHEN 2 THEN 'a reason' WHEN 3 THEN '' ELSE 'cannot be determined' END"
_NONE = "|".join(fx.NO_INFORMATION)


@query(f"WITH a AS (SELECT conv_id, CAST(turn AS BIGINT) AS turn, {RESULT} AS t, {REASON} AS r FROM conversations) SELECT conv_id, turn, CASE WHEN starts_with(t, 'ERROR:') THEN 'error' WHEN right(r, 3) = '...' AND length(r) >= 1997 THEN 'incomplete' WHEN trim(coalesce(t, '')) = '' THEN CASE WHEN regexp_matches(lower(r), '{_NONE}') THEN 'success' ELSE 'error' END ELSE 'success' END AS status FROM a")
def p18_result_status(spark, sf_dir):
    """Errors, results whose reasoning was cut, and empty ones that are right where the reasoning says that nothing is known."""
    c = table(spark, sf_dir, "conversations").withColumn("turn", F.col("turn").cast("long"))
    return c.select("conv_id", "turn", fx.result_status(F.expr(RESULT), F.expr(REASON)).alias("status"))


#: Variables of an entity that its pivot has whether or not the data have them.
CONFIGURED = ["Line.never"]


@query("SELECT patient_id, record_id, min(value) FILTER (core_variable = 'Line.linestatus') AS linestatus, min(value) FILTER (core_variable = 'Line.quantity') AS quantity, min(value) FILTER (core_variable = 'Line.returnflag') AS returnflag, NULL::VARCHAR AS never FROM facts WHERE core_variable LIKE 'Line.%' GROUP BY 1, 2".replace("SELECT", "x AS (SELECT 1) SELECT", 1), facts=True)
def a1_pivot_of_found_variables(spark, sf_dir):
    """An entity that is not configured: its variables are those of the data (a small distinct list), and configured extras that never appear."""
    f = bind.facts(spark, sf_dir).where(fx.entity(F.col("core_variable")) == "Line")
    found = sorted(r.core_variable for r in f.select("core_variable").distinct().collect())  # the names of one entity's fields
    # A record has one place in the order, so of equal variables the least value counts. By record first, as records are read nearly in that order.
    rows = fx.pivot(f, ["record_id", "patient_id"], found, order=())
    never = [v for v in CONFIGURED if v not in found]
    return rows.select("patient_id", "record_id", *[v.split(".")[1] for v in found], *[F.lit(None).cast("string").alias(v.split(".")[1]) for v in never])


@query("SELECT patient_id, arg_max(value, seq) FILTER (core_variable = 'Order.status' AND value IS NOT NULL) AS status, arg_max(value, seq) FILTER (core_variable = 'Order.priority') AS priority, arg_max(value, seq) FILTER (core_variable = 'Order.totalprice') AS totalprice, arg_min(original_source, seq) AS original_source FROM facts WHERE core_variable IN ('Order.status', 'Order.priority', 'Order.totalprice') GROUP BY 1".replace("SELECT", "x AS (SELECT 1) SELECT", 1), facts=True)
def a2_pivot_last_with_source(spark, sf_dir):
    """The last value of each variable and the first source of a patient."""
    f = bind.facts(spark, sf_dir).where(F.col("core_variable").isin(ORDER_VARS[:3]))
    source = f.groupBy("patient_id").agg(F.min_by("original_source", "seq").alias("original_source"))
    return fx.pivot(f, ["patient_id"], ORDER_VARS[:3], last=True).join(source, "patient_id")


@query("v AS (SELECT core_variable, min(struct_pack(s := seq, o := original_source)).o AS first_source, count(DISTINCT original_source) AS n FROM facts WHERE core_variable NOT LIKE 'Line.%' GROUP BY 1), d AS (SELECT CASE WHEN count(DISTINCT original_source) = 1 THEN min(original_source) END AS fallback FROM facts WHERE core_variable LIKE 'Customer.%') SELECT m.core_variable, coalesce(first_source, fallback, 'UNKNOWN_SOURCE') AS canonical, coalesce(n, 0) > 1 AS mixed FROM (VALUES ('Order.status'), ('Customer.segment'), ('Line.quantity'), ('Order.neverseen')) m(core_variable) LEFT JOIN v USING (core_variable), d", facts=True)
def a12_canonical_source(spark, sf_dir):
    """The first source of each variable, whether it has several, and for variables without facts the only source of the structured data."""
    f = bind.facts(spark, sf_dir)
    v = f.where("core_variable NOT LIKE 'Line.%'").groupBy("core_variable").agg(F.min_by("original_source", F.struct("seq", "original_source")).alias("first_source"), F.count_distinct("original_source").alias("n"))
    only = f.where("core_variable LIKE 'Customer.%'").agg(F.when(F.count_distinct("original_source") == 1, F.min("original_source")).alias("fallback"))
    model = spark.createDataFrame([("Order.status",), ("Customer.segment",), ("Line.quantity",), ("Order.neverseen",)], "core_variable string")
    return model.join(v, "core_variable", "left").join(F.broadcast(only)).select("core_variable", F.coalesce("first_source", "fallback", F.lit("UNKNOWN_SOURCE")).alias("canonical"), (F.coalesce("n", F.lit(0)) > 1).alias("mixed"))


@query(f"{CHECKS}, b AS (SELECT original_source, core_variable, rule, dimension, count(*) AS n, count_if(failed) AS bad, count(value) AS present FROM ck GROUP BY 1, 2, 3, 4), z AS (SELECT original_source, dimension, CASE WHEN present = 0 AND bad > 0 THEN 1 ELSE n END AS n, CASE WHEN present = 0 AND bad > 0 THEN 1 ELSE bad END AS bad FROM b) SELECT original_source, coalesce(dimension, 'Total') AS dimension, CAST(sum(n) - sum(bad) AS BIGINT) AS passed, CAST(sum(bad) AS BIGINT) AS n_failed, CAST(sum(n) AS BIGINT) AS total, round((sum(n) - sum(bad)) * 100.0 / sum(n), 1) AS percent_passed FROM z GROUP BY GROUPING SETS ((original_source, dimension), (original_source))", facts=True)
def a13_source_dimensions(spark, sf_dir):
    """Checks by source and quality dimension; a check that failed without any element counts as one."""
    b = checks(spark, sf_dir).groupBy("original_source", "core_variable", "rule", "dimension").agg(F.count("*").alias("n"), F.count_if("failed").alias("bad"), F.count("value").alias("present"))
    empty = (F.col("present") == 0) & (F.col("bad") > 0)
    z = b.select("original_source", F.explode(F.array("dimension", F.lit("Total"))).alias("dimension"), F.when(empty, 1).otherwise(F.col("n")).alias("n"), F.when(empty, 1).otherwise(F.col("bad")).alias("bad"))
    n, bad = F.sum("n"), F.sum("bad")
    return z.groupBy("original_source", "dimension").agg((n - bad).alias("passed"), bad.alias("n_failed"), n.alias("total"), F.round((n - bad) * 100.0 / n, 1).alias("percent_passed"))


@query(f"{CHECKS}, t AS (SELECT core_variable, original_source, patient_id, value, failed FROM ck WHERE rule = 'of_type') SELECT core_variable, 'number' AS expected, CASE WHEN count(CASE WHEN trim(coalesce(value, '')) != '' THEN 1 END) = 0 THEN 'Missing' WHEN count_if(failed) > 0 THEN 'string' ELSE 'number' END AS current_type, round((count(value) - count_if(failed)) * 100.0 / nullif(count(value), 0), 2) AS percent, array_to_string(list_sort(list(DISTINCT original_source)), ',') AS sources, count(DISTINCT CASE WHEN failed THEN patient_id END) AS patients FROM t GROUP BY 1", facts=True)
def a17_datatypes(spark, sf_dir):
    """Expected and current type of each variable, the percent that fits, sources and failing patients."""
    t = checks(spark, sf_dir).where("rule = 'of_type'")
    bad = F.count_if("failed")
    kind = F.when(F.count_if(~quality.blank()) == 0, "Missing").when(bad > 0, "string").otherwise("number")
    return t.groupBy("core_variable").agg(F.lit("number").alias("expected"), kind.alias("current_type"), F.round(F.try_divide((F.count("value") - bad) * 100.0, F.count("value")), 2).alias("percent"), F.array_join(F.array_sort(F.collect_set("original_source")), ",").alias("sources"), F.count_distinct(F.when(F.col("failed"), F.col("patient_id"))).alias("patients"))


@query(f"{CHECKS}, {IN_SET.format(_ALLOWED, 'core_variable')} SELECT core_variable, checks, n_failed, expected, observed, unexpected, patients, unexpected = '' AS succeeded FROM it", facts=True)
def a19_in_set_report(spark, sf_dir):
    """Expected, observed and unexpected values of every coded variable, and the patients concerned."""
    return in_set(spark, sf_dir, "core_variable").withColumn("succeeded", F.col("unexpected") == "")


@query(f"{CHECKS}, s AS (SELECT DISTINCT core_variable, coalesce(CAST(patient_id AS VARCHAR), '') || ':' || coalesce(record_id, '') AS record, trim(value) AS v FROM ck WHERE rule = 'in_set' AND failed AND trim(value) NOT IN ('', 'nan', 'None', 'NaT')) SELECT core_variable, record, string_agg(v, ',' ORDER BY v) AS values FROM s GROUP BY 1, 2", facts=True)
def a19_in_set_records(spark, sf_dir):
    """Every record of every coded variable that has a value outside its set, a row each."""
    return quality.failing_records(checks(spark, sf_dir).where("rule = 'in_set'"))


@query(f"{CHECKS}, {_IM}, s AS (SELECT rule, count(*) AS checks, count_if(failed) AS n_failed, count(DISTINCT core_variable) AS variables, count(DISTINCT patient_id) AS patients FROM ck GROUP BY 1), t AS (SELECT CAST(count(*) AS BIGINT) AS model FROM md) SELECT rule, checks, n_failed, variables, patients, model AS model_variables, model - variables AS never_checked, round((checks - n_failed) * 100.0 / (checks + model - variables), 4) AS percent_of_model FROM s, t", facts=True)
def a22_rule_summary(spark, sf_dir):
    """Checks, variables and patients of each rule, and against the data model, in which variables that are never checked failed once."""
    c = checks(spark, sf_dir).groupBy("rule").agg(F.count("*").alias("checks"), F.count_if("failed").alias("n_failed"), F.count_distinct("core_variable").alias("variables"), F.count_distinct("patient_id").alias("patients"))
    model = F.lit(len(MODEL)).cast("long")
    return c.select("*", model.alias("model_variables"), (model - F.col("variables")).alias("never_checked"), F.round((F.col("checks") - F.col("n_failed")) * 100.0 / (F.col("checks") + model - F.col("variables")), 4).alias("percent_of_model"))


#: Episodes: a status of each record, a date of some, and diagnosis dates of patients.
STATUS = "st AS (SELECT o_custkey AS p, o_orderkey AS r, CASE o_orderkey % 3 WHEN 0 THEN '32949' WHEN 1 THEN '2000100002' ELSE 'x' END AS code, CASE WHEN o_orderkey % 5 != 0 THEN CAST(o_orderdate AS DATE) END AS d FROM orders), dg AS (SELECT o_custkey AS p, min(CAST(o_orderdate AS DATE)) AS d FROM orders WHERE o_custkey % 4 != 0 AND o_orderkey % 7 = 0 GROUP BY 1)"


@query(f"WITH {STATUS}, e AS (SELECT st.p, CASE code WHEN '32949' THEN 'Progression' WHEN '2000100002' THEN 'Recurrence' ELSE 'Diagnosis' END AS phase, coalesce(st.d, dg.d) AS d FROM st LEFT JOIN dg USING (p) UNION ALL SELECT p, 'Diagnosis', d FROM dg) SELECT p AS patient_id, phase, CAST(min(d) AS VARCHAR) AS first_day FROM e WHERE d IS NOT NULL GROUP BY 1, 2")
def a23_phase_events(spark, sf_dir):
    """The first day of each phase of a patient: by status, dated by its record's episode, else by the patient's first diagnosis."""
    o = table(spark, sf_dir, "orders")
    key = F.col("o_orderkey")
    phase = F.when(key % 3 == 0, "Progression").when(key % 3 == 1, "Recurrence").otherwise("Diagnosis")
    st = o.select(F.col("o_custkey").alias("patient_id"), phase.alias("phase"), F.when(key % 5 != 0, F.to_date("o_orderdate")).alias("d"))
    dg = o.where("o_custkey % 4 != 0 AND o_orderkey % 7 = 0").groupBy(F.col("o_custkey").alias("patient_id")).agg(F.min(F.to_date("o_orderdate")).alias("dx"))
    events = st.join(dg, "patient_id", "left").select("patient_id", "phase", F.coalesce("d", "dx").alias("d")).unionByName(dg.select("patient_id", F.lit("Diagnosis").alias("phase"), F.col("dx").alias("d")))
    return events.where("d IS NOT NULL").groupBy("patient_id", "phase").agg(F.min("d").cast("string").alias("first_day"))


_J = f"{PHASE_SQL}, j AS (SELECT ev.*, coalesce((SELECT max(struct_pack(tm := ph.tm, e := ph.event_id, p := phase)).p FROM ph WHERE ph.k = ev.k AND ph.tm <= ev.tm), 'Diagnosis') AS phase FROM ev)"


@query(f"WITH {_J} SELECT k AS patient_id, event_type AS instance, phase, count(*) AS total, count(value) AS present, coalesce(array_to_string(list_sort(list(event_id) FILTER (value IS NULL)), ','), '') AS missing, bool_and(value IS NOT NULL) AS complete FROM j GROUP BY 1, 2, 3")
def a27_patient_instance_phase(spark, sf_dir):
    """Total, present and missing values of each patient's entity instance in each phase, with the list of what is missing."""
    e = bind.events(spark, sf_dir).join(j2_asof_phase(spark, sf_dir), "event_id")
    missing = F.array_join(F.array_sort(F.collect_list(F.when(F.col("value").isNull(), F.col("event_id")))), ",")
    return e.groupBy("patient_id", F.col("event_type").alias("instance"), "phase").agg(F.count("*").alias("total"), F.count("value").alias("present"), missing.alias("missing"), F.bool_and(F.col("value").isNotNull()).alias("complete"))


@query(f"{MATRIX}, pc AS (SELECT core_variable, round(count_if(state != '') * 100.0 / count(*), 4) AS percent_missing FROM mx GROUP BY 1) SELECT mx.*, percent_missing FROM mx JOIN pc USING (core_variable)", facts=True)
def a31_missing_matrix(spark, sf_dir):
    """Each variable of each patient, and the percent of patients that the variable is not complete for."""
    m = quality.missing_matrix(bind.facts(spark, sf_dir), MATRIX_VARS)
    percent = m.groupBy("core_variable").agg(F.round(F.count_if(F.col("state") != "") * 100.0 / F.count("*"), 4).alias("percent_missing"))
    return m.join(F.broadcast(percent), "core_variable")  # a row for each variable


_MATRIX_GRADES = ", ".join(f"('{v}', '{IMPORTANCE.get(v, 'Unknown')}')" for v in MATRIX_VARS)


@query(f"{MATRIX}, im2(core_variable, importance) AS (VALUES {_MATRIX_GRADES}), dp AS (SELECT DISTINCT patient_id, CASE WHEN date_ref < DATE '1997-01-01' THEN 'early' ELSE 'late' END AS phase FROM facts WHERE date_ref IS NOT NULL), sp AS (SELECT unnest(['early', 'late']) AS phase) SELECT mx.patient_id, importance, sp.phase, CAST(sum(CASE WHEN dp.patient_id IS NOT NULL AND state IN ('Missing', 'Sometimes') THEN 1 ELSE 0 END) AS BIGINT) AS missing FROM mx JOIN im2 USING (core_variable), sp LEFT JOIN dp ON dp.patient_id = mx.patient_id AND dp.phase = sp.phase GROUP BY 1, 2, 3", facts=True)
def a32_importance_phase_totals(spark, sf_dir):
    """Missing or sometimes missing variables of each patient by importance, in each phase that the patient has (else 0)."""
    f = bind.facts(spark, sf_dir)
    m = quality.missing_matrix(f, MATRIX_VARS)
    grade = F.create_map(*[F.lit(x) for v in MATRIX_VARS for x in (v, IMPORTANCE.get(v, "Unknown"))])
    by = m.groupBy("patient_id", F.element_at(grade, F.col("core_variable")).alias("importance")).agg(F.count_if(F.col("state").isin("Missing", "Sometimes")).alias("n"))
    phases = f.where("date_ref IS NOT NULL").groupBy("patient_id").agg(F.collect_set(F.when(F.col("date_ref") < F.lit("1997-01-01").cast("date"), "early").otherwise("late")).alias("has"))
    each = by.join(phases, "patient_id", "left").withColumn("phase", F.explode(F.array(F.lit("early"), F.lit("late"))))
    return each.select("patient_id", "importance", "phase", F.when(F.coalesce(F.array_contains("has", F.col("phase")), F.lit(False)), F.col("n")).otherwise(0).alias("missing"))


@query(f"WITH {_J}, r AS (SELECT event_type AS entity, phase, min(CASE WHEN event_id % 3 != 0 THEN tm END) AS d, min(CASE phase WHEN 'Diagnosis' THEN 0 WHEN 'Progression' THEN 1 ELSE 2 END) AS o FROM j GROUP BY 1, 2), l AS (SELECT event_type AS entity, arg_max(phase, struct_pack(t := tm, e := event_id)) AS last_phase FROM j GROUP BY 1), f AS (SELECT entity, arg_min(phase, struct_pack(n := d IS NULL, d := coalesce(d, TIMESTAMP '2100-01-01'), o := o)) AS first_phase FROM r GROUP BY 1) SELECT entity, first_phase, last_phase FROM f JOIN l USING (entity)")
def a33_first_and_last_phase(spark, sf_dir):
    """The first phase of each entity by its earliest dated record, without dates by the order of phases; and its last phase."""
    e = bind.events(spark, sf_dir).join(j2_asof_phase(spark, sf_dir), "event_id").withColumn("at", F.col("ts").cast("timestamp"))
    dated = F.when(F.col("event_id") % 3 != 0, F.col("at"))
    rank = F.when(F.col("phase") == "Diagnosis", 0).when(F.col("phase") == "Progression", 1).otherwise(2)
    order = F.struct(dated.isNull(), F.coalesce(dated, F.lit("2100-01-01").cast("timestamp")), rank)
    return e.groupBy(F.col("event_type").alias("entity")).agg(F.min_by("phase", order).alias("first_phase"), F.max_by("phase", F.struct("at", "event_id")).alias("last_phase"))


@query("x AS (SELECT *, trim(coalesce(value, '')) = '' AS blank FROM facts), t AS (SELECT CAST(count(DISTINCT patient_id) AS DOUBLE) AS patients FROM facts) SELECT core_variable, count(*) AS n, count_if(blank) AS missing, round((count(*) - count_if(blank)) * 100.0 / count(*), 2) AS score, CAST(min(year(date_ref)) AS BIGINT) || '-' || CAST(max(year(date_ref)) AS BIGINT) AS years, count_if(date_ref < DATE '1997-01-01' AND NOT blank) > 0 AS early, count_if(date_ref >= DATE '1997-01-01' AND NOT blank) > 0 AS late FROM x GROUP BY 1", facts=True)
def a35_catalogue(spark, sf_dir):
    """All variables of the catalogue in one aggregate: counts, score, years and availability in each phase."""
    f = bind.facts(spark, sf_dir)
    blank, early = quality.blank(), F.col("date_ref") < F.lit("1997-01-01").cast("date")
    n = F.count("*")
    years = F.concat(F.min(F.year("date_ref")), F.lit("-"), F.max(F.year("date_ref")))
    return f.groupBy("core_variable").agg(n.alias("n"), F.count_if(blank).alias("missing"), F.round((n - F.count_if(blank)) * 100.0 / n, 2).alias("score"), years.alias("years"), (F.count_if(early & ~blank) > 0).alias("early"), (F.count_if(~early & ~blank) > 0).alias("late"))


@query("WITH n AS (SELECT doc_id % 1500 AS o, doc_id FROM documents), e AS (SELECT doc_id, source, lang, coalesce(f.c, 0) AS entities, length(text) AS chars FROM documents LEFT JOIN (SELECT l_orderkey, count(*) AS c FROM lineitem WHERE l_linenumber > 3 GROUP BY 1) f ON l_orderkey = doc_id) SELECT source, count(*) AS notes, CAST(sum(entities) AS BIGINT) AS entities, round(avg(entities), 4) AS mean, min(entities) AS least, max(entities) AS most, CAST(quantile_cont(entities, 0.5) AS DOUBLE) AS median, round(count_if(entities > 0) * 100.0 / count(*), 4) AS coverage, round(count_if(chars IS NULL) * 100.0 / count(*), 4) AS error_rate FROM e GROUP BY 1")
def a40_run_statistics(spark, sf_dir):
    """Entities per note, coverage and errors by report type; the median is of counts that few values take, so it is exact and small."""
    n = table(spark, sf_dir, "lineitem").where("l_linenumber > 3").groupBy(F.col("l_orderkey").alias("doc_id")).agg(F.count("*").alias("c"))
    e = table(spark, sf_dir, "documents").join(n, "doc_id", "left").select("source", F.coalesce("c", F.lit(0)).alias("entities"), F.col("text").isNull().alias("error"))
    # Equal counts go together first, so the percentile sees a row for each count.
    h = e.groupBy("source", "entities").agg(F.count("*").alias("k"), F.count_if("error").alias("bad"))
    notes = F.sum("k")
    return h.groupBy("source").agg(
        notes.alias("notes"), F.sum(F.col("entities") * F.col("k")).alias("entities"), F.round(F.sum(F.col("entities") * F.col("k")) / notes, 4).alias("mean"), F.min("entities").alias("least"), F.max("entities").alias("most"),
        F.percentile("entities", F.lit(0.5), F.col("k")).alias("median"), F.round(F.sum(F.when(F.col("entities") > 0, F.col("k")).otherwise(0)) * 100.0 / notes, 4).alias("coverage"), F.round(F.sum("bad") * 100.0 / notes, 4).alias("error_rate"),
    )


CENTERS = ["INT-SARC", "INT", "VGR"]
PROMPTS = "CASE doc_id % 5 WHEN 0 THEN 'site-int-sarc' WHEN 1 THEN 'grade-int' WHEN 2 THEN 'age-vgr' WHEN 3 THEN 'stage-int-sarc' ELSE 'other' END"


@query(f"WITH p AS (SELECT source, {PROMPTS} AS p FROM documents WHERE source != 'src0' OR doc_id % 5 = 4), v AS (SELECT source, CASE WHEN ends_with(p, '-int-sarc') THEN 'INT-SARC' WHEN ends_with(p, '-int') THEN 'INT' WHEN ends_with(p, '-vgr') THEN 'VGR' END AS c FROM p), n AS (SELECT source, c, count(*) AS n FROM v WHERE c IS NOT NULL GROUP BY 1, 2) SELECT s.source, arg_max(c, struct_pack(n := n, c := c)) AS center FROM (SELECT DISTINCT source FROM p) s LEFT JOIN n USING (source) GROUP BY 1")
def a47_center_by_vote(spark, sf_dir):
    """The center that most prompts of a set end with, the longest name first; none where no prompt has a known one."""
    p = table(spark, sf_dir, "documents").where("source != 'src0' OR doc_id % 5 = 4").select("source", F.expr(PROMPTS).alias("p"))
    c = F.lit(None).cast("string")
    for name in sorted(CENTERS, key=len):
        c = F.when(F.col("p").endswith(f"-{name.lower()}"), name).otherwise(c)
    votes = p.withColumn("c", c).groupBy("source", "c").agg(F.count("*").alias("n"))
    return votes.groupBy("source").agg(F.max_by("c", F.when(F.col("c").isNotNull(), F.struct("n", "c"))).alias("center"))


@query("WITH v AS (SELECT conv_id, role, count(DISTINCT left(text, 3)) AS without_split, count(DISTINCT left(text, 3)) + count(DISTINCT CASE WHEN length(text) > 200 THEN left(text, 4) END) AS with_split FROM conversations GROUP BY 1, 2) SELECT role, CAST(sum(without_split) AS BIGINT) AS without_split, CAST(sum(with_split) AS BIGINT) AS with_split, count_if(with_split > without_split) AS more, count_if(with_split = without_split) AS same, count(*) AS cases FROM v GROUP BY 1")
def a48_splitting_totals(spark, sf_dir):
    """Values found with and without splitting, and the cases in which splitting finds more."""
    a = F.count_distinct(F.left("text", F.lit(3)))
    v = table(spark, sf_dir, "conversations").groupBy("conv_id", "role").agg(a.alias("w"), (a + F.count_distinct(F.when(F.length("text") > 200, F.left("text", F.lit(4))))).alias("s"))
    return v.groupBy("role").agg(F.sum("w").alias("without_split"), F.sum("s").alias("with_split"), F.count_if(F.col("s") > F.col("w")).alias("more"), F.count_if(F.col("s") == F.col("w")).alias("same"), F.count("*").alias("cases"))


@query("SELECT morphology AS part, 'topographies' AS kind, array_to_string(list_sort(list(DISTINCT topography))[1:5], ',') AS valid FROM (SELECT p_brand AS morphology, 'T' || p_size AS topography FROM part) GROUP BY 1 UNION ALL SELECT topography, 'morphologies', array_to_string(list_sort(list(DISTINCT morphology))[1:5], ',') FROM (SELECT p_brand AS morphology, 'T' || p_size AS topography FROM part) GROUP BY 1")
def j27_valid_parts(spark, sf_dir):
    """The first five topographies of each morphology, and the reverse."""
    p = table(spark, sf_dir, "part").select(F.col("p_brand").alias("m"), F.concat(F.lit("T"), "p_size").alias("t")).distinct()
    one = lambda key, other, kind: p.groupBy(F.col(key).alias("part")).agg(F.lit(kind).alias("kind"), F.array_join(F.slice(F.array_sort(F.collect_list(other)), 1, 5), ",").alias("valid"))
    return one("m", "t", "topographies").unionByName(one("t", "m", "morphologies"))


@query("WITH m(source, prompt) AS (VALUES ('src0', 'p0'), ('src0', 'p1'), ('src1', 'p2')), a AS (SELECT doc_id, source, 'p' || doc_id % 4 AS prompt FROM documents) SELECT doc_id, prompt FROM a WHERE prompt != 'p3' AND (EXISTS (SELECT 1 FROM m WHERE m.source = a.source AND m.prompt = a.prompt) OR (doc_id % 10 = 2 AND prompt = 'p2') OR source NOT IN (SELECT source FROM m))")
def j30_allowed_annotations(spark, sf_dir):
    """Annotations that stay after a prompt type was removed and the mapping of report types changed: mapped ones, a note's own
    overrides, and all of report types without a mapping."""
    mapping = spark.createDataFrame([("src0", ["p0", "p1"]), ("src1", ["p2"])], "source string, allowed array<string>")
    a = table(spark, sf_dir, "documents").select("doc_id", "source", F.concat(F.lit("p"), F.col("doc_id") % 4).alias("prompt"))
    own = F.when(F.col("doc_id") % 10 == 2, F.array(F.lit("p2"))).otherwise(F.array().cast("array<string>"))
    a = a.join(F.broadcast(mapping), "source", "left").where("prompt != 'p3'")
    return a.where(F.col("allowed").isNull() | F.array_contains(F.array_union("allowed", own), F.col("prompt"))).select("doc_id", "prompt")


@query("WITH h AS (SELECT conv_id, count(*) AS turns, max(CAST(turn AS BIGINT)) AS updated FROM conversations GROUP BY 1) SELECT conv_id, turns, updated FROM h ORDER BY updated DESC, conv_id LIMIT 15")
def k6_sessions_by_update(spark, sf_dir):
    """The sessions that were updated last: a top-k of one aggregate."""
    h = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").alias("turns"), F.max(F.col("turn").cast("long")).alias("updated"))
    return h.orderBy(F.desc("updated"), "conv_id").limit(15)


OUTPUT = "CASE vec_id % 6 WHEN 0 THEN 'Grade [select grade]' WHEN 1 THEN 'It is unclear' WHEN 2 THEN '' WHEN 3 THEN 'Not stated at all' ELSE 'Grade high' END"
LIMITS = {0: -0.02, 1: -0.05}
_CONFIDENCE = f"s AS (SELECT vec_id, label, {OUTPUT} AS out, list_transform(list_filter(embedding, lambda x: x < 0.4), lambda x: CAST(x AS DOUBLE) - 0.1) AS e FROM embeddings), c AS (SELECT vec_id, label, out, list_avg(e) AS mean, list_min(e) AS least, e[1] AS first FROM s), d AS (SELECT *, CASE label WHEN 0 THEN -0.02 WHEN 1 THEN -0.05 ELSE -0.1 END AS t, out = '' OR regexp_matches(lower(out), '\\[[^\\]]+\\]|unknown|not applicable|no information|not mentioned|not stated|unclear') AS odd FROM c)"


def _confidence(spark, sf_dir):
    """Token scores of each output (null ones left out) with their mean, least and first, the prompt's threshold and whether it is rejected."""
    e = F.transform(F.filter("embedding", lambda x: x < 0.4), lambda x: x.cast("double") - 0.1)
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.expr(OUTPUT).alias("out"), e.alias("e"))
    mean = F.try_divide(F.aggregate("e", F.lit(0.0), lambda s, x: s + x), F.size("e"))
    limit = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in LIMITS.items() for x in kv]), F.col("label")), F.lit(-0.1))
    odd = (F.col("out") == "") | F.lower("out").rlike(r"\[[^\]]+\]|unknown|not applicable|no information|not mentioned|not stated|unclear")
    rows = rows.select("vec_id", "label", mean.alias("mean"), F.array_min("e").alias("least"), F.get("e", F.lit(0)).alias("first"), limit.alias("limit"), odd.alias("odd"))
    return rows.withColumn("rejected", (F.col("mean") < F.col("limit")) & F.col("odd"))


@query(f"WITH {_CONFIDENCE} SELECT vec_id, round(mean, 6) AS mean, round(least, 6) AS least, round(first, 6) AS first, round((greatest(-10, least(0, mean)) + 10) / 10, 6) AS normal, mean < t AND odd AS rejected FROM d")
def t19_confidence(spark, sf_dir):
    """Scores of outputs, the mean also on a scale from 0 to 1; rejected ones are under the prompt's threshold and look like placeholders."""
    c = _confidence(spark, sf_dir)
    normal = (F.greatest(F.lit(-10.0), F.least(F.lit(0.0), F.col("mean"))) + 10) / 10
    return c.select("vec_id", *[F.round(x, 6).alias(x) for x in ("mean", "least", "first")], F.round(normal, 6).alias("normal"), "rejected")


@query(f"WITH {_CONFIDENCE} SELECT label, count(*) AS n, round(avg(mean), 6) AS mean, round(min(mean), 6) AS least, round(max(mean), 6) AS most, count_if(mean < t AND odd) AS rejected, round(count_if(mean < t AND odd) / count(*), 6) AS rejection_rate FROM d GROUP BY 1")
def a38_confidence_statistics(spark, sf_dir):
    """Statistics of the scores by prompt and the share of rejected outputs."""
    c = _confidence(spark, sf_dir)
    bad = F.count_if("rejected")
    return c.groupBy("label").agg(F.count("*").alias("n"), F.round(F.avg("mean"), 6).alias("mean"), F.round(F.min("mean"), 6).alias("least"), F.round(F.max("mean"), 6).alias("most"), bad.alias("rejected"), F.round(bad / F.count("*"), 6).alias("rejection_rate"))


@query(f"{_IM}, y AS (SELECT count(DISTINCT patient_id) AS t FROM facts), v AS (SELECT core_variable, CASE WHEN min(date_ref) IS NULL THEN '' WHEN min(date_ref) < DATE '1997-01-01' THEN 'early' ELSE 'late' END AS first_phase, count(DISTINCT CASE WHEN trim(coalesce(value, '')) != '' THEN patient_id END) AS n FROM facts GROUP BY 1) SELECT core_variable AS variable, {_GRADE} AS importance, first_phase, round((1 - n / t) * 100, 2) AS percent_missing FROM v, y", facts=True)
def a34_reduced_matrix(spark, sf_dir):
    """The four columns for outside users: variable, importance, first phase and the percent of patients without a value."""
    f = bind.facts(spark, sf_dir)
    total = f.agg(F.count_distinct("patient_id").alias("t"))
    day = F.min("date_ref")
    phase = F.when(day.isNull(), "").when(day < F.lit("1997-01-01").cast("date"), "early").otherwise("late")
    v = f.groupBy("core_variable").agg(phase.alias("first_phase"), F.count_distinct(F.when(~quality.blank(), F.col("patient_id"))).alias("n"))
    return v.join(F.broadcast(total)).select(F.col("core_variable").alias("variable"), importance(F.col("core_variable")).alias("importance"), "first_phase", F.round((1 - F.col("n") / F.col("t")) * 100, 2).alias("percent_missing"))


@query(f"{CHECKS}, sel AS (SELECT ck.*, split_part(core_variable, '.', 1) AS entity FROM ck WHERE core_variable NOT IN ('Order.date') AND NOT (rule = 'not_null' AND core_variable LIKE 'Customer.%')) SELECT CASE WHEN entity = 'Customer' THEN 'patients' ELSE entity END AS frame, rule, count(DISTINCT CASE WHEN entity = 'Customer' THEN CAST(patient_id AS VARCHAR) ELSE patient_id || '/' || record_id END) AS rows_checked, count_if(failed) AS n_failed FROM sel GROUP BY 1, 2", facts=True)
def a9_routed_rules(spark, sf_dir):
    """Rules by the frame that they go to: the patients' for entities of one instance, else the entity's; variables of another group
    are left out, and not-null rules of optional entities of one instance."""
    c = checks(spark, sf_dir).withColumn("entity", fx.entity(F.col("core_variable")))
    c = c.where("core_variable != 'Order.date' AND NOT (rule = 'not_null' AND entity = 'Customer')")
    single = F.col("entity") == "Customer"
    row = F.when(single, F.col("patient_id").cast("string")).otherwise(F.concat_ws("/", "patient_id", "record_id"))
    return c.groupBy(F.when(single, "patients").otherwise(F.col("entity")).alias("frame"), "rule").agg(F.count_distinct(row).alias("rows_checked"), F.count_if("failed").alias("n_failed"))
