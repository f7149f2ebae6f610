"""Queries over notes, annotations, dictionaries and vectors, each with its SQL twin."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from factloom.functions import history as hx
from factloom.functions import prompts
from factloom.functions import text as tx
from factloom.operators import evaluate as ev
from factloom.plans.core import counts
from factloom.sources import bind
from factloom.sources.bind import table
from factloom.sources.shared import new_path, shared_dir
from factloom.streaming import incremental

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = counts(sql.strip())
        return f

    return add


def annotations(spark, sf_dir):
    """order_id, prompt, annotation: template sentences built from orders."""
    o = table(spark, sf_dir, "orders")
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    text = F.concat(F.lit("Order status: "), "o_orderstatus", F.lit("; priority: "), "o_orderpriority", F.lit("; dated "), day, F.lit(", "), F.date_format("o_orderdate", "dd/MM/yyyy"), F.lit("; code 8140/3-C"), F.lpad((F.col("o_orderkey") % 90 + 10).cast("string"), 2, "0"), F.lit("."), (F.col("o_orderkey") % 10).cast("string"))
    return o.select(F.col("o_orderkey").alias("order_id"), F.col("o_custkey").alias("patient_id"), text.alias("annotation"))


ANN = "ann AS (SELECT o_orderkey AS order_id, o_custkey AS patient_id, 'Order status: ' || o_orderstatus || '; priority: ' || o_orderpriority || '; dated ' || strftime(o_orderdate, '%Y-%m-%d') || ', ' || strftime(o_orderdate, '%d/%m/%Y') || '; code 8140/3-C' || (o_orderkey % 90 + 10) || '.' || (o_orderkey % 10) AS annotation FROM orders)"


PLACEHOLDER_SQL = "array_to_string(list_sort(list_distinct(regexp_extract_all(template, '\\[[^\\]]*\\]'))), ',')"


#: White space of any kind, for an engine whose own is that of ASCII.
WHITE = r"[\s\p{Z}\x0b\x85]"
#: A model's two texts of a note, whole: the second repeats itself in every third note.
FIELDS = {"reasoning": "text", "raw_output": "CASE WHEN doc_id % 3 = 0 THEN repeat('The same finding again and again! ', doc_id % 7) || text ELSE 'Short. ' || lang END"}
_PARTS = " UNION ALL ".join(f"SELECT doc_id, '{f}' AS field, {t} AS t FROM documents" for f, t in FIELDS.items())


@query(rf"""WITH f AS ({_PARTS}), s AS (SELECT doc_id, field, list_filter(list_transform(string_split_regex(t, '[.!?]{WHITE}+|\n'), lambda x: regexp_replace(x, '^{WHITE}+|{WHITE}+$', '', 'g')), lambda x: length(x) > 20) AS s FROM f WHERE length(t) >= 50),
r AS (SELECT doc_id, field, len(s) AS n, len(list_distinct(s)) AS d, 1 - len(list_distinct(s)) / len(s) AS r FROM s WHERE len(s) >= 3)
SELECT doc_id, 'repetition_loop' AS type, field, CASE WHEN r > 0.8 THEN 'high' ELSE 'medium' END AS severity, round(r, 2) AS duplicate_ratio, 'Repetitive output detected: ' || d || '/' || n || ' unique sentences' AS message FROM r WHERE r >= 0.5""")
def t6_repetition(spark, sf_dir):
    """A flag for each field of a note whose sentences repeat, over whole texts."""
    d = table(spark, sf_dir, "documents")
    flags = tx.repetition_flags({f: F.expr(t) for f, t in FIELDS.items()})
    return d.select("doc_id", F.explode(flags).alias("f")).select("doc_id", "f.*")


#: Template sentences of all forms, and some of none.
TEMPLATE = """CASE o_orderkey % 11 WHEN 0 THEN 'Biopsy grading (FNCLCC): ' || o_custkey % 4 || '.' WHEN 1 THEN 'Patient''s gender ' || CASE WHEN o_custkey % 2 = 0 THEN 'male.' ELSE 'FEMALE' END WHEN 2 THEN ' Histological type: Undifferentiated sarcoma (8805/' || o_custkey % 4 || ')..'
WHEN 3 THEN 'tumor site (Trunk wall): ' || o_orderpriority || '. ' WHEN 4 THEN 'Age at diagnosis:' || o_custkey % 90 WHEN 5 THEN 'Margins after surgery: R' || o_custkey % 3 || chr(10) || 'second line.' WHEN 6 THEN 'Status: ' || o_orderstatus || ': more.'
WHEN 7 THEN 'Annotation: none. ' WHEN 8 THEN ': ' || o_orderstatus WHEN 9 THEN 'no form at all...' END"""
_FORMS = "coalesce(" + ", ".join(f"CASE WHEN regexp_matches(t, {x}) THEN regexp_replace(regexp_extract(t, {x}, 1), '^{WHITE}+|{WHITE}+$', '', 'g') END" for x in ("'(?is)" + p.replace("'", "''") + "'" for p in tx.TEMPLATES)) + ")"


@query(rf"""WITH a AS (SELECT o_orderkey AS order_id, regexp_replace(coalesce({TEMPLATE}, ''), '^{WHITE}+|{WHITE}+$', '', 'g') AS t FROM orders), v AS (SELECT *, {_FORMS} AS v FROM a)
SELECT order_id, coalesce(CASE WHEN ends_with(v, '.') THEN regexp_replace(left(v, length(v) - 1), '^{WHITE}+|{WHITE}+$', '', 'g') ELSE v END, regexp_replace(t, '\.+$', '')) AS value FROM v""")
def t14_template_values(spark, sf_dir):
    """The value of a template sentence, by the first form that it has."""
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("order_id"), tx.template_value(F.expr(TEMPLATE)).alias("value"))


#: Annotations of all prompts, some of several, in words that both engines take.
ANNOTATION = """CASE o_orderkey % 16 WHEN 0 THEN 'Biopsy grading (FNCLCC): ' || o_custkey % 4 WHEN 1 THEN ' Patient''s gender male. ' WHEN 2 THEN 'Tumor site: trunk; biopsy has been performed' WHEN 3 THEN 'Pre-operative Chemotherapy was started on 2020-01-01 and chemotherapy ended on 2020-02-01'
WHEN 4 THEN 'Post-operative radiotherapy in total of ' || o_custkey % 60 || ' Gy' WHEN 5 THEN 'Type of recurrence/progression: local' WHEN 6 THEN 'Unknown surgical specimen mitotic count' WHEN 7 THEN 'Surgical specimen grading (FNCLCC): 3; necrosis in surgical specimen' WHEN 8 THEN 'ICD-O-3 8805/3'
WHEN 9 THEN 'Re-excision or radicalization' WHEN 10 THEN 'There was a PROGRESSION at last follow-up' WHEN 11 THEN 'Response to ' || CASE WHEN o_custkey % 2 = 0 THEN 'radiotherapy' ELSE 'chemotherapy' END WHEN 12 THEN 'The stage is an unknown stage' WHEN 13 THEN 'no previous cancer and no previous or concurrent cancers' WHEN 14 THEN o_orderpriority END"""
_RULES = ", ".join(f"({i}, '{k}', '{p.replace(chr(92) + chr(39), chr(39)).replace(chr(39), chr(39) * 2)}')" for i, (k, ps) in enumerate(prompts.PROMPT_PATTERNS.items()) for p in ps)


@query(f"WITH a AS (SELECT o_orderkey AS order_id, trim(lower({ANNOTATION})) AS t FROM orders), r(pos, prompt, pattern) AS (VALUES {_RULES}), m AS (SELECT DISTINCT order_id, pos, prompt FROM a JOIN r ON regexp_matches(t, pattern)) SELECT order_id, arg_min(prompt, pos) AS prompt, string_agg(prompt, ',' ORDER BY pos) AS prompts FROM m GROUP BY 1")
def j9_w9_first_matching_rule(spark, sf_dir):
    """The first prompt by position of whose patterns an annotation has one, and all such prompts."""
    found = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("order_id"), prompts.prompts_of(F.expr(ANNOTATION)).alias("p"))
    return found.where(F.size("p") > 0).select("order_id", F.get("p", F.lit(0)).alias("prompt"), F.array_join("p", ",").alias("prompts"))


COMB = "c AS (SELECT p_brand AS morphology, p_size AS topography, 'K' || min(p_partkey) AS code FROM part GROUP BY 1, 2), q AS (SELECT p_partkey AS id, p_brand AS morphology, (p_size + 1) % 50 AS topography FROM part)"


def combinations(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    c = p.groupBy(F.col("p_brand").alias("morphology"), F.col("p_size").alias("topography")).agg(F.concat(F.lit("K"), F.min("p_partkey")).alias("code"))
    return c, p.select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("morphology"), ((F.col("p_size") + 1) % 50).alias("topography"))


@query(f"WITH {COMB} SELECT id, c.code IS NOT NULL AS valid, EXISTS (SELECT 1 FROM c m WHERE m.morphology = q.morphology) AS morphology_known, EXISTS (SELECT 1 FROM c t WHERE t.topography = q.topography) AS topography_known FROM q LEFT JOIN c ON c.morphology = q.morphology AND c.topography = q.topography")
def j16_valid_combinations(spark, sf_dir):
    c, q = combinations(spark, sf_dir)
    out = q.join(c, ["morphology", "topography"], "left")
    out = out.join(c.select("morphology", F.lit(True).alias("m")).distinct(), "morphology", "left").join(c.select("topography", F.lit(True).alias("t")).distinct(), "topography", "left")
    return out.select("id", F.col("code").isNotNull().alias("valid"), F.coalesce("m", F.lit(False)).alias("morphology_known"), F.coalesce("t", F.lit(False)).alias("topography_known"))


@query("SELECT conv_id, count(*) AS turns, max(CAST(turn AS BIGINT)) AS last_turn FROM conversations GROUP BY 1")
def a50_sessions(spark, sf_dir):
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").alias("turns"), F.max(F.col("turn").cast("long")).alias("last_turn"))


@query("SELECT lang AS center, array_to_string(list_sort(list(DISTINCT source)), ',') AS report_types, bool_or(length(text) > 5000) AS has_long FROM documents GROUP BY 1")
def a51_report_types(spark, sf_dir):
    return bind.notes(spark, sf_dir).groupBy("center").agg(F.array_join(F.array_sort(F.collect_set("report_type")), ",").alias("report_types"), F.bool_or(F.length("text") > 5000).alias("has_long"))


@query("""WITH m(source, allowed) AS (VALUES ('src0', ['p1', 'p2']), ('src1', ['p3'])), n AS (SELECT doc_id, source, list_filter(['p1', 'p2', 'p3', 'p4'], lambda x: allowed IS NULL OR list_contains(allowed, x) OR (doc_id % 10 = 0 AND x = 'p4')) AS l FROM documents LEFT JOIN m USING (source))
SELECT doc_id, unnest(list_filter(l, lambda x: NOT (doc_id % 7 = 0 AND x = 'p1'))) AS prompt FROM n""")
def p3_j10_applicable_prompts(spark, sf_dir):
    mapping = spark.createDataFrame([("src0", ["p1", "p2"]), ("src1", ["p3"])], "report_type string, allowed array<string>")
    every = F.array(*[F.lit(f"p{i}") for i in range(1, 5)])
    n = bind.notes(spark, sf_dir).drop("text").join(F.broadcast(mapping), "report_type", "left")
    extra = F.when(F.col("note_id") % 10 == 0, F.array(F.lit("p4"))).otherwise(F.array().cast("array<string>"))
    less = F.when(F.col("note_id") % 7 == 0, F.array(F.lit("p1"))).otherwise(F.array().cast("array<string>"))
    allowed = F.array_except(F.array_union(F.coalesce("allowed", every), extra), less)
    return n.select(F.col("note_id").alias("doc_id"), F.explode(F.array_intersect(every, allowed)).alias("prompt"))


@query("""WITH m(source, allowed) AS (VALUES ('src0', ['p1', 'p2']), ('src1', ['p3'])), n AS (SELECT doc_id, list_filter(coalesce(allowed, []), lambda x: NOT (doc_id % 7 = 0 AND x IN ('p1', 'p3'))) AS k, CASE WHEN doc_id % 5 = 0 THEN ['p4', 'p1', 'p4'] ELSE [] END AS o FROM documents LEFT JOIN m USING (source)),
s AS (SELECT doc_id, list_concat(k, list_filter(CASE WHEN len(o) > 0 THEN ['p4', 'p1'] ELSE [] END, lambda x: NOT list_contains(k, x))) AS l FROM n)
SELECT doc_id, CAST(i - 1 AS BIGINT) AS place, l[i] AS prompt FROM (SELECT *, unnest(range(1, len(l) + 1)) AS i FROM s)""")
def p3c_shown_prompts(spark, sf_dir):
    """The prompts of each note with exclusions first, then overrides."""
    mapping = spark.createDataFrame([("src0", ["p1", "p2"]), ("src1", ["p3"])], "report_type string, allowed array<string>")
    n = bind.notes(spark, sf_dir).drop("text").join(F.broadcast(mapping), "report_type", "left")
    array = lambda *p: F.array(*[F.lit(x) for x in p]).cast("array<string>")
    less = F.when(F.col("note_id") % 7 == 0, array("p1", "p3")).otherwise(array())
    more = F.when(F.col("note_id") % 5 == 0, array("p4", "p1", "p4")).otherwise(array())
    out = n.select(F.col("note_id").alias("doc_id"), F.posexplode(prompts.shown_prompts(F.col("allowed"), less, more)).alias("place", "prompt"))
    return out.withColumn("place", F.col("place").cast("long"))


@query("SELECT doc_id, CASE WHEN text IS NULL THEN 'error: no text' WHEN doc_id % 17 = 0 THEN 'error: not readable' ELSE 'done' END AS status, CASE WHEN text IS NOT NULL AND doc_id % 17 != 0 THEN length(text) END AS n_chars FROM documents")
def i1_incremental_notes(spark, sf_dir):
    """Notes as they come, once each; a note that cannot be worked on has its error in its status and stops no other."""
    base = f"{shared_dir(spark)}/incremental-{uuid.uuid4().hex}"
    problem = F.when(F.col("text").isNull(), "no text").when(F.col("doc_id") % 17 == 0, "not readable")
    work = lambda rows: incremental.isolated(rows, F.length("text").cast("long"), problem).select("doc_id", "status", F.col("value").alias("n_chars"))
    incremental.process_new(spark, f"{sf_dir}/documents.parquet*", f"{base}/target", f"{base}/checkpoint", work, "doc_id")
    return spark.read.parquet(f"{base}/target").drop("batch")


@query("""WITH f AS (SELECT *, 0 AS run FROM documents WHERE doc_id % 2 = 0 UNION ALL SELECT *, 1 FROM documents WHERE doc_id % 3 != 2), p(run, prompt) AS (VALUES (0, 'site'), (1, 'site'), (1, 'stage')),
g AS (SELECT f.doc_id, f.run, prompt, length(text) AS n, CASE WHEN text IS NULL THEN 'no text' WHEN doc_id % 17 = 0 THEN 'not readable' END AS problem FROM f JOIN p ON p.run = f.run WHERE NOT (prompt = 'stage' AND doc_id % 5 = 0))
SELECT doc_id, prompt, CAST(run AS BIGINT) AS batch, coalesce('error: ' || problem, 'done') AS status, CASE WHEN problem IS NULL THEN n END AS n_chars FROM g QUALIFY problem IS NOT NULL OR row_number() OVER (PARTITION BY doc_id, prompt ORDER BY run) = 1""")
def i1_notes_by_prompt(spark, sf_dir):
    """Notes and prompts once each: a second file brings some notes again, and a prompt that is new to all."""
    base = new_path(spark, "by-prompt")
    d = table(spark, sf_dir, "documents")
    problem = F.when(F.col("text").isNull(), "no text").when(F.col("doc_id") % 17 == 0, "not readable")
    work = lambda rows: incremental.isolated(rows, F.length("text").cast("long"), F.col("problem")).select("doc_id", "prompt", "status", F.col("value").alias("n_chars"))
    stage = F.when(F.col("doc_id") % 5 != 0, "stage")
    for some, applicable in (("doc_id % 2 = 0", F.array(F.lit("site"))), ("doc_id % 3 != 2", F.array(F.lit("site"), stage))):
        d.where(some).write.mode("append").parquet(f"{base}/notes")
        incremental.process_prompts(spark, f"{base}/notes", f"{base}/target", f"{base}/checkpoint", "doc_id", applicable, problem, work)
    return spark.read.parquet(f"{base}/target").withColumn("batch", F.col("batch").cast("long"))


#: A note's text with events of a history in it, in words that both engines take.
HISTORY = "text || CASE doc_id % 5 WHEN 0 THEN ' status post surgery 01/02/2019, s/p chemotherapy 03.2020, condition after (2018), 2020-01-05' WHEN 1 THEN ' operata in data 06-2019, recidiva 12/05/2020; seguiva radioterapia, istologico' WHEN 2 THEN ' 01/02/2019 03/04/2019 05.06.2020 07/08/2021 09/10/2022 resection and imrt' WHEN 3 THEN ' behandlad med x' ELSE '' END"
HISTORY_TYPE = "CASE WHEN doc_id % 11 = 0 THEN 'Anamnesis ' || source ELSE source END"
#: The boundaries of words of any script in the other engine: letters beyond ASCII as one of ASCII for dates, the character that follows for words.
_PLAIN = r"regexp_replace(t, '[^\x00-\x7F\P{L}]|[^\x00-\x7F\P{N}]', 'q', 'g')"
_ENDS = r"(?:$|[^\p{L}\p{N}_])"
_FAMILIES = ", ".join(f"CASE WHEN regexp_matches(t, '(?i){p.replace(chr(92) + 'b', _ENDS)}') THEN '{name}' END" for name, p in hx.TREATMENTS.items())


@query(rf"""WITH n AS (SELECT doc_id, lower({HISTORY_TYPE}) AS r, coalesce({HISTORY}, '') AS t FROM documents),
c AS (SELECT doc_id, len(list_distinct(regexp_extract_all({_PLAIN}, '{hx.DATES}'))) AS dates, len(list_distinct(regexp_extract_all({_PLAIN}, '{hx.YEARS}'))) AS years, len(regexp_extract_all(t, '(?i){hx.EVENTS.replace(chr(92) + "b", _ENDS)}')) AS markers, list_filter([{_FAMILIES}], lambda x: x IS NOT NULL) AS f, coalesce(regexp_matches(r, '{"|".join(hx.REPORT_TYPES)}'), FALSE) AS by_type FROM n)
SELECT doc_id, by_type OR (dates >= 3 AND markers >= 3) OR (markers >= 3 AND len(f) >= 2) OR (dates >= 5 AND len(f) >= 2) AS history,
round(CAST(least(1.0, CASE WHEN by_type THEN 0.4 ELSE 0 END + CASE WHEN dates >= 3 THEN least(0.3, 0.1 * dates) ELSE 0 END + CASE WHEN markers >= 3 THEN least(0.4, 0.1 * markers) ELSE 0 END + CASE WHEN len(f) >= 2 THEN 0.2 ELSE 0 END) AS DOUBLE), 4) AS confidence,
CAST(greatest(dates, markers, len(f)) AS BIGINT) AS events, concat_ws(',', CASE WHEN by_type THEN 'report_type' END, CASE WHEN dates >= 3 THEN 'date_count' END, CASE WHEN markers >= 3 THEN 'event_markers' END, CASE WHEN len(f) >= 2 THEN 'diverse_treatments' END) AS methods,
CAST(dates AS BIGINT) AS dates, CAST(years AS BIGINT) AS years, CAST(markers AS BIGINT) AS markers, coalesce(array_to_string(f, ','), '') AS families FROM c""")
def t1_history_notes(spark, sf_dir):
    """Notes that tell a history: by report type, distinct dates, event markers and families of treatments, over whole texts."""
    h = table(spark, sf_dir, "documents").select("doc_id", hx.history(F.expr(HISTORY), F.expr(HISTORY_TYPE)).alias("h")).select("doc_id", "h.*")
    return h.withColumns({"methods": F.array_join("methods", ","), "families": F.array_join("families", ",")})


@query("SELECT doc_id, confidence, events FROM (" + SQL["t1_history_notes"] + ") WHERE history ORDER BY confidence DESC, events DESC, doc_id LIMIT 20")
def k6_history_notes(spark, sf_dir):
    """The twenty notes that are histories with the greatest confidence."""
    # Through inline, as a filter on a projected column would search every text twice.
    h = table(spark, sf_dir, "documents").select("doc_id", F.inline(F.array(hx.history(F.expr(HISTORY), F.expr(HISTORY_TYPE))))).where("history")
    return h.select("doc_id", "confidence", "events").orderBy(F.desc("confidence"), F.desc("events"), "doc_id").limit(20)


#: Answers with several values in several forms.
VALUES = """CASE o_orderkey % 9 WHEN 0 THEN '["a", " b ", "", "c"]' WHEN 1 THEN 'x; y;; z' WHEN 2 THEN 'one, two , three' WHEN 3 THEN '- first
* second
3) third' WHEN 4 THEN 'p | q|' WHEN 5 THEN 'single ' || o_orderstatus WHEN 6 THEN 'short, ' || repeat('long ', 30) || 'part' WHEN 7 THEN 'ERROR: a; b' ELSE '[broken; list]' END"""


@query(rf"""WITH a AS (SELECT o_orderkey AS order_id, {VALUES} AS raw, trim({VALUES}) AS t FROM orders),
p AS (SELECT *, list_filter(list_transform(string_split(t, ';'), lambda x: trim(x)), lambda x: x != '') AS s, list_filter(list_transform(string_split(t, ','), lambda x: trim(x)), lambda x: x != '') AS c, list_filter(list_transform(string_split(t, chr(10)), lambda x: regexp_replace(regexp_replace(trim(x), '^[-*•]\s+', ''), '^\d+[.)]\s+', '')), lambda x: x != '') AS l, list_filter(list_transform(string_split(t, '|'), lambda x: trim(x)), lambda x: x != '') AS b FROM a),
v AS (SELECT order_id, CASE WHEN starts_with(raw, 'ERROR:') THEN [raw] WHEN starts_with(t, '[') AND right(t, 1) = ']' AND json_valid(t) THEN list_filter(list_transform(CAST(json(t) AS VARCHAR[]), lambda x: trim(x)), lambda x: x != '') WHEN len(s) > 1 THEN s WHEN len(c) > 1 AND len(list_filter(c, lambda x: length(x) >= 100)) = 0 THEN c WHEN len(l) > 1 THEN l WHEN len(b) > 1 THEN b ELSE [t] END AS v FROM p)
SELECT order_id, CAST(i - 1 AS BIGINT) AS pos, v[i] AS value FROM (SELECT *, unnest(range(1, len(v) + 1)) AS i FROM v)""")
def t11_split_values(spark, sf_dir):
    """A JSON array, else parts by semicolons, short ones by commas, lines without bullets and numbers, or bars."""
    parts = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("order_id"), F.posexplode(tx.split_values(F.expr(VALUES))).alias("pos", "value"))
    return parts.select("order_id", F.col("pos").cast("long").alias("pos"), "value")


DATED = "'on ' || CAST(CAST(o_orderdate AS DATE) AS STRING) || ', ' || CASE o_orderkey % 3 WHEN 0 THEN '1/2/2020 and 01/02/2020' WHEN 1 THEN '12/3/2021' ELSE 'none' END"


@query(f"WITH a AS (SELECT o_orderkey AS order_id, {DATED} AS t FROM orders) SELECT order_id, array_to_string(list_sort(list_distinct(list_concat(list_concat(regexp_extract_all(t, '\\d{{2}}/\\d{{2}}/\\d{{4}}'), regexp_extract_all(t, '\\d{{4}}-\\d{{2}}-\\d{{2}}')), regexp_extract_all(t, '\\d{{1,2}}/\\d{{1,2}}/\\d{{4}}')))), ',') AS dates FROM a")
def t12_u5_dates(spark, sf_dir):
    """Dates by three patterns, each once."""
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("order_id"), F.array_join(ev.dates(F.expr(DATED)), ",").alias("dates"))


@query("""WITH q AS (SELECT vec_id AS q_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings WHERE vec_id % 100 = 0), e AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
s AS (SELECT q_id, vec_id, round(list_cosine_similarity(q.v, e.v), 6) AS score FROM q JOIN e USING (label) WHERE q_id != vec_id) SELECT q_id, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY score DESC, vec_id) AS r FROM s) WHERE r <= 3""")
def j23_vector_top_k(spark, sf_dir):
    """The three nearest of each query's prompt. Labels are few, so the examples are dealt out by a salt and meet the queries in
    each; the best of a salt are kept as a bounded list while they are summed up, so no ranking sees all."""
    e = table(spark, sf_dir, "embeddings")
    salts = 16
    q = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("q_id"), "label", F.col("embedding").alias("v")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    s = e.withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.lit(salts)).cast("int")).join(q, ["label", "salt"]).where("q_id != vec_id")
    s = s.select("q_id", "salt", "vec_id", F.round(tx.cosine(F.col("v"), F.col("embedding")), 6).alias("score"))
    order = Window.partitionBy("q_id", "salt").orderBy(F.desc("score"), "vec_id")
    best = s.withColumn("r", F.row_number().over(order)).where("r <= 3")
    return best.withColumn("r", F.row_number().over(Window.partitionBy("q_id").orderBy(F.desc("score"), "vec_id"))).where("r <= 3").select("q_id", "vec_id", "score")
