"""Queries on resolution, review decisions, reports and orders, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from factloom.functions import text as tx
from factloom.operators import facts as fx
from factloom.operators import quality, resolve
from factloom.plans.core import AS_OF, CHECKS, OUTCOME, PHASE_SQL, RULES, checks, counts, j2_asof_phase
from factloom.sources import bind
from factloom.sources.bind import FACTS, table
from factloom.streaming import incremental

QUERIES, SQL = {}, {}


def query(sql: str | None = None, facts: bool = False):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = counts(f"WITH {FACTS}, {sql}" if facts else sql.strip())
        return f

    return add


NORMAL = "trim(regexp_replace(regexp_replace(regexp_replace(trim(lower({0})), '[(\\[]\\d{{4}}/\\d[)\\]]', '', 'g'), '[.;,]+$', ''), '\\s+', ' ', 'g'))"
#: Texts to look up: names as they are, shortened, extended, or in part.
LOOKED_UP = "CASE p_partkey % 6 WHEN 0 THEN upper(p_name) || ' (8140/3).' WHEN 1 THEN p_name || ' extra' WHEN 2 THEN left(p_name, length(p_name) - 2) WHEN 3 THEN split_part(p_name, ' ', 2) || ' ' || split_part(p_name, ' ', 1) WHEN 4 THEN 'none of it' ELSE split_part(p_name, ' ', 1) || ' very big one' END"


@query(f"""WITH q AS (SELECT DISTINCT {NORMAL.format(LOOKED_UP)} AS query FROM part), e AS (SELECT {NORMAL.format('p_name')} AS entry, min(p_partkey) AS seq FROM part GROUP BY 1),
s AS (SELECT query, entry, seq, CASE WHEN query = entry THEN 1.0 WHEN contains(query, entry) OR contains(entry, query) THEN 0.7 + 0.3 * (least(length(query), length(entry)) / greatest(length(query), length(entry)))
  ELSE len(list_intersect(list_distinct(string_split(query, ' ')), list_distinct(string_split(entry, ' ')))) / greatest(len(list_distinct(string_split(query, ' '))), len(list_distinct(string_split(entry, ' ')))) END AS score FROM q, e)
SELECT query, arg_max(entry, struct_pack(s := round(score, 9), q := -seq)) AS entry, round(max(score), 6) AS score FROM s WHERE score >= 0.6 GROUP BY 1""")
def j11_fuzzy_dictionary(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    found = resolve.fuzzy(p.select(F.expr(LOOKED_UP).alias("text")), p.select(F.col("p_name").alias("text"), F.col("p_partkey").alias("seq")))
    return found.withColumn("score", F.round("score", 6))


@query()
def j13_label_tiers(spark, sf_dir):
    """Values to codes of their category, the dictionary being every name; a tier needs a similarity that SQL has not."""
    p = table(spark, sf_dir, "part")
    d = p.select(F.col("p_type").alias("category"), F.col("p_name").alias("label"), F.concat(F.lit("K"), "p_partkey").alias("code"), F.col("p_partkey").alias("seq"))
    return resolve.by_tier(p.select(F.col("p_type").alias("category"), F.expr(LOOKED_UP).alias("value")), d)


#: Combinations, and queries by code, by both parts, by one, by text or by nothing known.
COMBINATION = "c AS (SELECT 'M' || p_brand || '-T' || p_size AS code, 'M' || p_brand AS morphology, 'T' || p_size AS topography, min(p_name) AS name, min(p_partkey) AS seq FROM part GROUP BY 1, 2, 3)"
ASKED = "q AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 5 = 0 THEN 'M' || p_brand || '-T' || p_size END AS query, CASE WHEN p_partkey % 5 IN (1, 2) THEN 'M' || p_brand WHEN p_partkey % 5 = 4 THEN 'Mx' END AS morphology, CASE p_partkey % 5 WHEN 1 THEN 'T' || p_size WHEN 2 THEN 'T' || (p_size + 1) % 50 WHEN 4 THEN CASE WHEN p_partkey % 2 = 0 THEN 'T' || p_size ELSE 'Tx' END END AS topography, CASE WHEN p_partkey % 5 = 3 THEN upper(p_name) WHEN p_partkey % 10 = 2 THEN 'zzz' END AS ht, CASE WHEN p_partkey % 10 = 3 THEN split_part(p_name, ' ', 2) END AS tt FROM part)"


def combinations(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    m, t = F.concat(F.lit("M"), "p_brand"), F.concat(F.lit("T"), "p_size")
    c = p.groupBy(F.concat(m, F.lit("-"), t).alias("code"), m.alias("morphology"), t.alias("topography")).agg(F.min("p_name").alias("name"), F.min("p_partkey").alias("seq"))
    k = F.col("p_partkey")
    next_t = F.concat(F.lit("T"), (F.col("p_size") + 1) % 50)
    q = p.select(
        k.alias("id"), F.when(k % 5 == 0, F.concat(m, F.lit("-"), t)).alias("query"), F.when((k % 5).isin(1, 2), m).when(k % 5 == 4, "Mx").alias("morphology"),
        F.when(k % 5 == 1, t).when(k % 5 == 2, next_t).when(k % 5 == 4, F.when(k % 2 == 0, t).otherwise("Tx")).alias("topography"),
        F.when(k % 5 == 3, F.upper("p_name")).when(k % 10 == 2, "zzz").alias("histology_text"), F.when(k % 10 == 3, F.split_part("p_name", F.lit(" "), F.lit(2))).alias("topography_text"),
    )
    return c, q


@query(f"""WITH {COMBINATION}, {ASKED}, cm AS (SELECT morphology, arg_min(code, seq) AS m FROM c GROUP BY 1), ct AS (SELECT topography, arg_min(code, seq) AS t FROM c GROUP BY 1),
tx AS (SELECT x, arg_min(code, seq) AS found FROM (SELECT DISTINCT x FROM (SELECT lower(ht) AS x FROM q UNION ALL SELECT lower(tt) FROM q) WHERE x != '') JOIN c ON contains(lower(name), x) OR contains(x, lower(name)) GROUP BY 1)
SELECT id, CASE WHEN e.code IS NOT NULL THEN e.code WHEN b.code IS NOT NULL THEN b.code ELSE coalesce(h.found, t.found, cm.m, ct.t) END AS code,
CAST(CASE WHEN e.code IS NOT NULL THEN 1.0 WHEN b.code IS NOT NULL THEN 0.9 WHEN coalesce(h.found, t.found) IS NOT NULL THEN 0.5 WHEN coalesce(cm.m, ct.t) IS NOT NULL THEN 0.3 ELSE 0 END AS DOUBLE) AS score,
CASE WHEN e.code IS NOT NULL THEN 'exact' WHEN b.code IS NOT NULL THEN 'combined' WHEN coalesce(h.found, t.found) IS NOT NULL THEN 'text' WHEN cm.m IS NOT NULL THEN 'partial_morphology' WHEN ct.t IS NOT NULL THEN 'partial_topography' ELSE 'no_match' END AS method
FROM q LEFT JOIN c e ON e.code = q.query LEFT JOIN c b ON b.morphology = q.morphology AND b.topography = q.topography LEFT JOIN tx h ON h.x = lower(q.ht) LEFT JOIN tx t ON t.x = lower(q.tt) LEFT JOIN cm ON cm.morphology = q.morphology LEFT JOIN ct ON ct.topography = q.topography""")
def j14_best_combination(spark, sf_dir):
    c, q = combinations(spark, sf_dir)
    return resolve.best_match(q, c)


@query()
def j15_w6_top_candidates(spark, sf_dir):
    """The five best candidates of each query; text tiers need a similarity that SQL has not."""
    c, q = combinations(spark, sf_dir)
    return resolve.top_candidates(q, c, 5).drop("seq")


@query(f"""WITH {COMBINATION}, s AS (SELECT *, CASE WHEN lower(code) = 'ring' THEN 1.0 WHEN contains(lower(code), 'ring') THEN 0.85 WHEN lower(name) = 'ring' THEN 0.9 WHEN starts_with(lower(name), 'ring') THEN 0.75 WHEN contains(lower(name), 'ring') THEN 0.5 + 0.2 * 4 / length(name) ELSE 0 END AS score FROM c WHERE starts_with(morphology, 'MBrand#1'))
SELECT code, name, CAST(score AS DOUBLE) AS score FROM s WHERE score > 0 ORDER BY score DESC, seq LIMIT 20""")
def k3_scored_search(spark, sf_dir):
    return resolve.searched(combinations(spark, sf_dir)[0], " Ring ", 20, morphology="MBrand#1").select("code", "name", "score")


@query(f"""WITH {COMBINATION}, d AS (SELECT o_orderkey AS patient, trim(CASE WHEN o_orderkey % 3 = 0 THEN ' MBrand#' || o_custkey % 25 || '-T' || o_orderkey % 50 || ' ' ELSE 'nothing' END) AS query FROM orders) SELECT patient, code IS NOT NULL AS accepted, code, name, CASE WHEN code IS NOT NULL THEN 'user_override' END AS source FROM d LEFT JOIN c ON c.code = d.query""")
def a44_manual_resolution(spark, sf_dir):
    """Reviewers' codes: those of the list resolve a patient, others are rejected."""
    c, _ = combinations(spark, sf_dir)
    d = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("patient"), F.trim(F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit(" MBrand#"), F.col("o_custkey") % 25, F.lit("-T"), F.col("o_orderkey") % 50, F.lit(" "))).otherwise("nothing")).alias("query"))
    out = d.join(c, d["query"] == c["code"], "left")
    return out.select("patient", F.col("code").isNotNull().alias("accepted"), "code", "name", F.when(F.col("code").isNotNull(), "user_override").alias("source"))


#: Code annotations of patients' notes, one an order: histology, site, or neither; some flagged as repetitive.
DIAGNOSES = "dn AS (SELECT o_custkey AS patient, o_orderkey AS note, CASE o_orderkey % 4 WHEN 0 THEN 'histology' WHEN 1 THEN 'topography' END AS kind, CASE o_orderkey % 4 WHEN 0 THEN 'MBrand#' || o_custkey % 25 || CASE WHEN o_custkey % 7 = 0 THEN 'x' || o_orderkey % 3 ELSE '' END WHEN 1 THEN CASE WHEN o_custkey % 5 != 0 THEN 'T' || o_custkey % 50 END END AS code, o_orderkey % 8 = 4 AND o_custkey % 7 = 0 AS high FROM orders)"


@query(f"""WITH {COMBINATION}, {DIAGNOSES}, g AS (SELECT patient, list_sort(list(DISTINCT code) FILTER (kind = 'histology' AND NOT high)) AS h, list_sort(list(DISTINCT code) FILTER (kind = 'topography' AND NOT high)) AS t FROM dn GROUP BY 1),
h AS (SELECT patient, coalesce(list_filter(h, lambda x: x IS NOT NULL), []) AS h, coalesce(list_filter(t, lambda x: x IS NOT NULL), []) AS t FROM g), m AS (SELECT patient, code AS manual FROM (SELECT DISTINCT patient, 'MBrand#' || patient % 25 || '-T' || patient % 50 AS query FROM h WHERE patient % 11 = 0) JOIN c ON code = query),
r AS (SELECT h.*, manual, concat_ws('; ', CASE WHEN len(h) > 0 AND len(t) = 0 THEN 'Missing topography/tumor site code' WHEN len(t) > 0 AND len(h) = 0 THEN 'Missing histology code' END, CASE WHEN len(h) > 1 THEN 'Multiple conflicting histology codes: ' || array_to_string(h, ', ') END, CASE WHEN len(t) > 1 THEN 'Multiple conflicting topography codes: ' || array_to_string(t, ', ') END) AS why, c.code FROM h LEFT JOIN m USING (patient) LEFT JOIN c ON len(h) = 1 AND len(t) = 1 AND c.morphology = h[1] AND c.topography = t[1])
SELECT patient, CASE WHEN manual IS NOT NULL THEN 'manually_resolved' WHEN len(h) = 0 AND len(t) = 0 THEN 'skipped' WHEN why != '' OR code IS NULL THEN 'needs_review' ELSE 'auto_resolved' END AS status,
CASE WHEN manual IS NOT NULL OR (len(h) = 0 AND len(t) = 0) THEN '' WHEN why != '' THEN why WHEN code IS NULL THEN 'Combination ' || h[1] || '-' || t[1] || ' not found in diagnosis codes' ELSE '' END AS reasons, coalesce(manual, CASE WHEN why = '' THEN code END) AS resolved FROM r""")
def a43_diagnosis_resolution(spark, sf_dir):
    """Distinct histology and site codes of each patient (annotations flagged as highly repetitive do not count), decided:
    skipped, needs_review with reasons, auto_resolved where the one combination is in the list; manual results stay."""
    c, _ = combinations(spark, sf_dir)
    cust, key = F.col("o_custkey"), F.col("o_orderkey")
    kind = F.when(key % 4 == 0, "histology").when(key % 4 == 1, "topography")
    hist = F.concat(F.lit("MBrand#"), cust % 25, F.when(cust % 7 == 0, F.concat(F.lit("x"), key % 3)).otherwise(""))
    code = F.when(key % 4 == 0, hist).when((key % 4 == 1) & (cust % 5 != 0), F.concat(F.lit("T"), cust % 50))
    dn = table(spark, sf_dir, "orders").select(cust.alias("patient"), kind.alias("kind"), code.alias("code"), ((key % 8 == 4) & (cust % 7 == 0)).alias("high"))
    manual = dn.where("patient % 11 = 0").select("patient").distinct().withColumn("query", F.concat(F.lit("MBrand#"), F.col("patient") % 25, F.lit("-T"), F.col("patient") % 50)).join(c.select(F.col("code").alias("query")), "query").select("patient", F.col("query").alias("manual"))
    # Codes of a patient: distinct ones first, so a list holds what one patient can have of a code list.
    some = dn.where("NOT high AND code IS NOT NULL AND kind IS NOT NULL").select("patient", "kind", "code").distinct()
    lists = some.groupBy("patient").agg(*[F.array_sort(F.collect_list(F.when(F.col("kind") == k, F.col("code")))).alias(k[0]) for k in ("histology", "topography")])
    g = dn.select("patient").distinct().join(lists, "patient", "left").select("patient", *[F.coalesce(x, F.array().cast("array<string>")).alias(x) for x in "ht"]).join(manual, "patient", "left")
    h, t = F.size("h"), F.size("t")
    many = lambda n, name, c: F.when(n > 1, F.concat(F.lit(f"Multiple conflicting {name} codes: "), F.array_join(c, ", ")))
    why = F.concat_ws("; ", F.when((h > 0) & (t == 0), "Missing topography/tumor site code").when((t > 0) & (h == 0), "Missing histology code"), many(h, "histology", "h"), many(t, "topography", "t"))
    one = (h == 1) & (t == 1)
    r = g.withColumns({"why": why, "m": F.when(one, F.get("h", F.lit(0))), "p": F.when(one, F.get("t", F.lit(0)))}).join(c.select(F.col("morphology").alias("m"), F.col("topography").alias("p"), "code"), ["m", "p"], "left")
    none, by_hand = (h == 0) & (t == 0), F.col("manual").isNotNull()
    unknown = F.concat(F.lit("Combination "), "m", F.lit("-"), "p", F.lit(" not found in diagnosis codes"))
    status = F.when(by_hand, "manually_resolved").when(none, "skipped").when((F.col("why") != "") | F.col("code").isNull(), "needs_review").otherwise("auto_resolved")
    reasons = F.when(by_hand | none, "").when(F.col("why") != "", F.col("why")).when(F.col("code").isNull(), unknown).otherwise("")
    return r.select("patient", status.alias("status"), reasons.alias("reasons"), F.coalesce("manual", F.when(F.col("why") == "", F.col("code"))).alias("resolved"))


@query(SQL["a43_diagnosis_resolution"].replace("SELECT patient, CASE WHEN manual", "SELECT status, count(*) AS patients FROM (SELECT patient, CASE WHEN manual", 1) + ") GROUP BY 1")
def a45_status_counts(spark, sf_dir):
    return a43_diagnosis_resolution(spark, sf_dir).groupBy("status").agg(F.count("*").alias("patients"))


#: Annotations with codes in several forms, one an order.
CODED = "CASE o_orderkey % 6 WHEN 0 THEN 'Type 8140/3 - C5' || o_custkey % 10 || '.1 seen' WHEN 1 THEN 'Type 88' || (10 + o_custkey % 80) || '/3.' WHEN 2 THEN 'Site C' || (10 + o_custkey % 80) || '.9' WHEN 3 THEN 'C10.1 then 8000/1' WHEN 4 THEN '[select ICD-O-3 code]' ELSE 'no code' END"


@query(f"""WITH a AS (SELECT o_orderkey AS order_id, {CODED} AS t FROM orders), b AS (SELECT *, regexp_extract(t, '(\\d{{4}}/\\d)\\s*-\\s*(C\\d{{2}}\\.\\d)', 1) AS m1, regexp_extract(t, '(\\d{{4}}/\\d)\\s*-\\s*(C\\d{{2}}\\.\\d)', 2) AS t1, regexp_extract(t, '\\d{{4}}/\\d') AS m2, regexp_extract(t, 'C\\d{{2}}\\.\\d') AS t2 FROM a)
SELECT order_id, CASE WHEN m1 != '' THEN m1 || '-' || t1 WHEN m2 != '' THEN m2 WHEN t2 != '' THEN t2 END AS code, CASE WHEN m1 != '' THEN m1 WHEN m2 != '' THEN m2 END AS morphology, CASE WHEN m1 != '' THEN t1 WHEN m2 = '' AND t2 != '' THEN t2 END AS topography, CAST(CASE WHEN m1 != '' OR m2 != '' THEN 1.0 WHEN t2 != '' THEN 0.8 END AS DOUBLE) AS confidence FROM b""")
def t25_codes(spark, sf_dir):
    """A joint code, else a morphology, else a topography."""
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("order_id"), tx.existing_code(F.expr(CODED)).alias("c")).select("order_id", "c.*")


#: Replies of a model with terms and codes.
TERMS = """CASE o_orderkey % 5 WHEN 0 THEN 'So: {"histology_text": " Sarcoma ", "morphology_code": "8800/3", "topography_text": null, "topography_code": "C4' || o_custkey % 10 || '.1"} end' WHEN 1 THEN '{"histology_text": "", "query_code": "8000/3-C10.1"}' WHEN 2 THEN 'text 8140/3-C34.' || o_custkey % 10 || ' text' WHEN 3 THEN '{broken "histology_text": } 8001/1 and C50.2' ELSE 'nothing' END"""


@query(rf"""WITH a AS (SELECT o_orderkey AS order_id, {TERMS} AS t FROM orders), b AS (SELECT *, coalesce(nullif(regexp_extract(t, '(?s)\{{[^{{}}]*"histology_text"[^{{}}]*\}}'), ''), regexp_extract(t, '(?s)\{{.*\}}')) AS j FROM a), c AS (SELECT *, j != '' AND json_valid(j) AS ok FROM b),
d AS (SELECT order_id, CASE WHEN ok THEN nullif(trim(coalesce(json_extract_string(j, '$.histology_text'), '')), '') END AS histology_text, CASE WHEN ok THEN nullif(trim(coalesce(json_extract_string(j, '$.topography_text'), '')), '') END AS topography_text, CASE WHEN ok THEN nullif(trim(json_extract_string(j, '$.morphology_code')), '') ELSE nullif(regexp_extract(t, '\d{{4}}/\d'), '') END AS morphology, CASE WHEN ok THEN nullif(trim(json_extract_string(j, '$.topography_code')), '') ELSE nullif(regexp_extract(t, 'C\d{{2}}\.\d'), '') END AS topography, CASE WHEN ok THEN nullif(trim(json_extract_string(j, '$.query_code')), '') END AS q FROM c)
SELECT order_id, histology_text, topography_text, morphology, topography, coalesce(q, morphology || '-' || topography) AS query_code FROM d""")
def t27_terms(spark, sf_dir):
    """Codes and texts of a model's reply: its JSON, else codes by their patterns."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("order_id"), F.expr(TERMS).alias("t"))
    one, any_ = F.regexp_extract("t", r'(?s)\{[^{}]*"histology_text"[^{}]*\}', 0), F.regexp_extract("t", r"(?s)\{.*\}", 0)
    o = o.withColumn("j", F.when(one != "", one).otherwise(any_)).withColumn("ok", F.coalesce((F.col("j") != "") & F.try_parse_json("j").isNotNull(), F.lit(False)))
    get = lambda k: F.nullif(F.trim(F.get_json_object("j", f"$.{k}")), F.lit(""))
    by = lambda p: F.nullif(F.regexp_extract("t", p, 0), F.lit(""))
    o = o.withColumns({"histology_text": F.when(F.col("ok"), get("histology_text")), "topography_text": F.when(F.col("ok"), get("topography_text")), "morphology": F.when(F.col("ok"), get("morphology_code")).otherwise(by(r"\d{4}/\d")), "topography": F.when(F.col("ok"), get("topography_code")).otherwise(by(r"C\d{2}\.\d")), "q": F.when(F.col("ok"), get("query_code"))})
    return o.select("order_id", "histology_text", "topography_text", "morphology", "topography", F.coalesce("q", F.concat("morphology", F.lit("-"), "topography")).alias("query_code"))


@query()
def t26_code_resolution(spark, sf_dir):
    """Annotations to codes with candidates: an explicit code, else the dictionary of the prompt's kind, then ranked candidates, with the
    annotation's own code kept; confidence under 0.7 is marked. Tested by hand, as its candidates need J15's similarity."""
    c, _ = combinations(spark, sf_dir)
    p = table(spark, sf_dir, "part")
    kind = F.when(F.col("p_partkey") % 2 == 0, "histology").otherwise("site")
    text = F.expr("CASE p_partkey % 4 WHEN 0 THEN 'Type M' || p_brand || '-T' || p_size WHEN 1 THEN 'Site: ' || p_name WHEN 2 THEN 'Histology: ' || p_name || ' .' ELSE 'unknown' END")
    rows = p.select(F.col("p_partkey").alias("id"), kind.alias("kind"), text.alias("text"))
    return resolve.coded(rows, c, p.select(F.col("p_name").alias("text"), F.concat(F.lit("M"), "p_brand").alias("morphology"), F.concat(F.lit("T"), "p_size").alias("topography"), F.col("p_partkey").alias("seq")), r"M(Brand#\d+)-(T\d+)", 5)


@query("SELECT rule, CASE WHEN regexp_full_match(raw, '-?[0-9]+') THEN raw WHEN rule = 'column' THEN regexp_replace(raw, '_', '.') ELSE replace(raw, '_', '.') END AS arg, regexp_full_match(raw, '-?[0-9]+') AS is_number, count(*) AS n FROM (SELECT CASE p_partkey % 3 WHEN 0 THEN 'column' WHEN 1 THEN 'other' ELSE 'value' END AS rule, CASE p_partkey % 3 WHEN 2 THEN CAST(p_size AS VARCHAR) ELSE replace(p_name, ' ', '_') || '_' || p_type END AS raw FROM part) GROUP BY 1, 2, 3")
def p14_rule_arguments(spark, sf_dir):
    """Entity_field as Entity.field (the first underscore), other names with points throughout, digits as numbers."""
    k = F.col("p_partkey") % 3
    rows = table(spark, sf_dir, "part").select(F.when(k == 0, "column").when(k == 1, "other").otherwise("value").alias("rule"), F.when(k == 2, F.col("p_size").cast("string")).otherwise(F.concat(F.replace("p_name", F.lit(" "), F.lit("_")), F.lit("_"), "p_type")).alias("raw"))
    number = F.col("raw").rlike("^-?[0-9]+$")
    arg = F.when(number, F.col("raw")).when(F.col("rule") == "column", F.regexp_replace("raw", "^([^_]*)_", "$1.")).otherwise(F.replace("raw", F.lit("_"), F.lit(".")))
    return rows.groupBy("rule", arg.alias("arg"), number.alias("is_number")).agg(F.count("*").alias("n"))


@query("SELECT CAST(patient_id AS VARCHAR) AS patient_id, core_variable, coalesce(value, '') AS value, '' AS linked_to, '' AS quality FROM facts WHERE core_variable LIKE 'Customer.%' UNION ALL SELECT CAST(patient_id AS VARCHAR), core_variable, coalesce(value, ''), 'x', '' FROM facts WHERE core_variable = 'Order.status'".replace("SELECT", "x AS (SELECT 1) SELECT", 1), facts=True)
def p10_aligned_columns(spark, sf_dir):
    """Tables of other columns as one schema, what is missing as empty text."""
    f = bind.facts(spark, sf_dir)
    a = f.where("core_variable LIKE 'Customer.%'").select("patient_id", "core_variable", "value")
    b = f.where("core_variable = 'Order.status'").select("core_variable", "value", "patient_id", F.lit("x").alias("linked_to"))
    return fx.aligned([a, b], ["patient_id", "core_variable", "value", "linked_to", "quality"])


@query("SELECT p_partkey, p_name AS annotation FROM part WHERE p_partkey % 9 != 0 AND p_partkey % 7 != 0 AND starts_with(p_name, 'small')")
def p21_example_rows(spark, sf_dir):
    """Complete rows whose annotation begins with a prefix."""
    p = table(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_partkey") % 9 != 0, F.col("p_name")).alias("annotation"), F.when(F.col("p_partkey") % 7 != 0, F.col("p_type")).alias("note"))
    return p.dropna(subset=["annotation", "note"]).where(F.col("annotation").startswith("small")).select("p_partkey", "annotation")


NOTE_OF = "CASE o_orderkey % 4 WHEN 0 THEN CAST(o_orderkey AS STRING) WHEN 1 THEN 'note-' || CAST(o_custkey AS STRING) || '-x' WHEN 2 THEN left(CAST(o_orderkey AS STRING), 3) ELSE 'zz' END"


@query(f"""WITH a AS (SELECT o_orderkey AS id, {NOTE_OF} AS wanted FROM orders), n AS (SELECT CAST(c_custkey AS VARCHAR) AS note, c_custkey AS seq FROM customer), e AS (SELECT id, wanted, note FROM a LEFT JOIN n ON note = wanted)
SELECT id, coalesce(note, (SELECT arg_min(note, seq) FROM n WHERE contains(n.note, e.wanted) OR contains(e.wanted, n.note))) AS note FROM e""")
def j19_note_of_annotation(spark, sf_dir):
    """By the same id, else by an id that is within the other, the first by order: equality joins on parts of ids."""
    a = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.expr(NOTE_OF).alias("wanted"))
    n = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("note"), F.col("c_custkey").alias("seq"))
    n = n.hint("merge")  # as many as customers, whatever their file's size says
    wanted = a.select("wanted").distinct()
    same = wanted.join(n, F.col("wanted") == F.col("note")).select("wanted", "note")
    rest = wanted.join(same, "wanted", "left_anti")
    inside = resolve.containments(n.select(F.col("note").alias("short")), rest.select(F.col("wanted").alias("long"))).select(F.col("long").alias("wanted"), F.col("short").alias("note"))
    around = resolve.containments(rest.select(F.col("wanted").alias("short")), n.select(F.col("note").alias("long"))).select(F.col("short").alias("wanted"), F.col("long").alias("note"))
    first = inside.unionByName(around).join(n, "note").groupBy("wanted").agg(F.min_by("note", "seq").alias("note"))
    return a.join(same.unionByName(first).hint("merge"), "wanted", "left").select("id", "note")


@query("SELECT o_orderkey AS id, coalesce(CASE WHEN o_orderkey % 3 = 0 THEN o_orderstatus END, 'v' || o_custkey % 9) AS value, coalesce(CASE WHEN o_orderkey % 4 = 0 THEN '01/02/2020' END, strftime(o_orderdate, '%Y-%m-%d')) AS date FROM orders")
def j28_derived_values(spark, sf_dir):
    """A derived field value before the annotation's text, an extracted date before the note's."""
    o = table(spark, sf_dir, "orders")
    derived = F.when(F.col("o_orderkey") % 3 == 0, F.create_map(F.lit("status"), F.col("o_orderstatus")))
    found = F.when(F.col("o_orderkey") % 4 == 0, "01/02/2020")
    return o.select(F.col("o_orderkey").alias("id"), F.coalesce(F.try_element_at(derived, F.lit("status")), F.concat(F.lit("v"), F.col("o_custkey") % 9)).alias("value"), F.coalesce(found, F.date_format("o_orderdate", "yyyy-MM-dd")).alias("date"))


@query("WITH m AS (SELECT p_type || p_size AS prompt, CASE WHEN p_partkey % 3 = 0 THEN '' ELSE 'E' || p_brand END AS entity, CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE 'f' || p_partkey % 5 END AS field, p_partkey AS pos FROM part), f AS (SELECT prompt, arg_min(entity || '.' || field, pos) AS v FROM m WHERE entity != '' AND field != '' GROUP BY 1), k(prompt, v) AS (VALUES ('ECONOMY1', 'Patient.sex'), ('SMALL2', 'Diagnosis.age')) SELECT p.prompt, coalesce(f.v, k.v) AS core_variable FROM (SELECT DISTINCT prompt FROM m) p LEFT JOIN f USING (prompt) LEFT JOIN k USING (prompt)")
def j29_variable_of_prompt(spark, sf_dir):
    """The first field mapping with entity and field, else a fixed table."""
    k = F.col("p_partkey")
    m = table(spark, sf_dir, "part").select(F.concat("p_type", "p_size").alias("prompt"), F.when(k % 3 == 0, "").otherwise(F.concat(F.lit("E"), "p_brand")).alias("entity"), F.when(k % 4 != 0, F.concat(F.lit("f"), k % 5)).alias("field"), k.alias("pos"))
    first = m.groupBy("prompt").agg(F.min_by(F.when((F.col("entity") != "") & (F.col("field") != ""), F.concat("entity", F.lit("."), "field")), F.when((F.col("entity") != "") & (F.col("field") != ""), F.col("pos"))).alias("v"))
    fixed = spark.createDataFrame([("ECONOMY1", "Patient.sex"), ("SMALL2", "Diagnosis.age")], "prompt string, fallback string")
    return first.join(F.broadcast(fixed), "prompt", "left").select("prompt", F.coalesce("v", "fallback").alias("core_variable"))


@query("SELECT p_partkey AS id, CASE WHEN p_partkey % 4 > p_partkey % 3 THEN 'out of range' WHEN p_partkey % 5 = 0 THEN 'unchanged' ELSE 'selected' END AS decision, CASE WHEN p_partkey % 5 != 0 AND p_partkey % 4 <= p_partkey % 3 THEN p_brand || '-' || p_partkey % 4 ELSE p_brand || '-0' END AS code FROM part WHERE NOT (p_partkey % 5 = 0 AND p_partkey % 4 > p_partkey % 3) UNION ALL SELECT p_partkey, 'unchanged', p_brand || '-0' FROM part WHERE p_partkey % 5 = 0 AND p_partkey % 4 > p_partkey % 3")
def j31_chosen_candidates(spark, sf_dir):
    """Reviewers' choices by index into each row's candidates; indexes that no candidate has are told and change nothing."""
    p = table(spark, sf_dir, "part")
    candidates = F.transform(F.sequence(F.lit(0), (F.col("p_partkey") % 3).cast("int")), lambda i: F.concat("p_brand", F.lit("-"), i))
    rows = p.select(F.col("p_partkey").alias("id"), candidates.alias("candidates"))
    decisions = p.where("p_partkey % 5 != 0").select(F.col("p_partkey").alias("id"), (F.col("p_partkey") % 4).cast("int").alias("chosen"))
    out = rows.join(decisions, "id", "left").withColumn("c", F.get("candidates", "chosen"))
    decision = F.when(F.col("chosen").isNull(), "unchanged").when(F.col("c").isNull(), "out of range").otherwise("selected")
    return out.select("id", decision.alias("decision"), F.coalesce("c", F.get("candidates", F.lit(0))).alias("code"))


@query("SELECT o_orderkey AS id, CASE WHEN o_orderkey % 2 = 0 THEN 'new ' || o_orderstatus ELSE 'old' END AS annotation, CASE WHEN o_orderkey % 2 = 1 AND o_orderkey % 3 != 0 THEN o_orderpriority END AS derived FROM orders WHERE o_orderkey % 3 != 0 OR o_orderkey % 2 = 0")
def j32_updated_annotations(spark, sf_dir):
    """An update replaces all: rows that it leaves out go, edited ones lose what was derived from them."""
    o = table(spark, sf_dir, "orders")
    old = o.select(F.col("o_orderkey").alias("id"), F.lit("old").alias("annotation"), F.col("o_orderpriority").alias("derived"))
    new = o.where("o_orderkey % 3 != 0 OR o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("new "), "o_orderstatus")).otherwise("old").alias("annotation"))
    joined = new.alias("n").join(old.alias("o"), "id", "left")
    return joined.select("id", "n.annotation", F.when(F.col("n.annotation") == F.col("o.annotation"), F.col("o.derived")).alias("derived"))


@query(f"WITH {PHASE_SQL}, j AS (SELECT ev.*, coalesce((SELECT max(struct_pack(tm := ph.tm, e := ph.event_id, p := phase)).p FROM ph WHERE ph.k = ev.k AND ph.tm <= ev.tm), 'Diagnosis') AS phase FROM ev) SELECT event_type || '_' || k AS instance, phase, count(value) AS present, count(*) AS total FROM j GROUP BY 1, 2")
def a26_instance_phase(spark, sf_dir):
    """Present values of each entity instance in each phase."""
    e = bind.events(spark, sf_dir).join(j2_asof_phase(spark, sf_dir), "event_id")
    return e.groupBy(F.concat_ws("_", "event_type", "patient_id").alias("instance"), "phase").agg(F.count("value").alias("present"), F.count("*").alias("total"))


@query("""WITH f AS (SELECT l_orderkey AS note, list_sort(list({'v': 'Line.quantity', 'x': CAST(l_quantity AS BIGINT), 'n': CAST(l_linenumber AS BIGINT)})) AS l, count(*) AS n FROM lineitem GROUP BY 1) SELECT o_orderkey AS note, o_orderpriority AS input, coalesce(n, 0) AS entities, coalesce('[' || array_to_string(list_transform(l, lambda s: '{"core_variable":"' || s.v || '","value":' || s.x || ',"record":' || s.n || '}'), ',') || ']', '[]') AS output FROM orders LEFT JOIN f ON note = o_orderkey""")
def a41_input_and_output(spark, sf_dir):
    """Each note with its entities as JSON."""
    li = table(spark, sf_dir, "lineitem")
    one = F.struct(F.lit("Line.quantity").alias("core_variable"), F.col("l_quantity").cast("long").alias("value"), F.col("l_linenumber").cast("long").alias("record"))
    found = li.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.to_json(F.array_sort(F.collect_list(one))).alias("output"), F.count("*").alias("entities"))
    o = table(spark, sf_dir, "orders").join(found, "o_orderkey", "left")
    return o.select(F.col("o_orderkey").alias("note"), F.col("o_orderpriority").alias("input"), F.coalesce("entities", F.lit(0)).alias("entities"), F.coalesce("output", F.lit("[]")).alias("output"))


BLOCKS = {"Customer": 1, "Order": 2, "Line": 3}
PLACES = {"Order.date": 1, "Order.status": 2, "Line.quantity": 1}


@query("b(entity, block) AS (VALUES ('Customer', 1), ('Order', 2), ('Line', 3)), p(core_variable, place) AS (VALUES ('Order.date', 1), ('Order.status', 2), ('Line.quantity', 1)), v AS (SELECT core_variable, count(*) AS n FROM facts GROUP BY 1) SELECT core_variable, n, row_number() OVER (ORDER BY coalesce(block, 99), coalesce(place, 999), core_variable) AS position FROM v LEFT JOIN b ON entity = split_part(core_variable, '.', 1) LEFT JOIN p USING (core_variable)", facts=True)
def k1_k2_report_order(spark, sf_dir):
    """Variables in the order of their entity's block, their place in the configuration, their name; the place is a row a variable."""
    v = bind.facts(spark, sf_dir).groupBy("core_variable").agg(F.count("*").alias("n"))
    rank = lambda key, table, most: F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key), F.lit(most))
    order = Window.orderBy(rank(fx.entity(F.col("core_variable")), BLOCKS, 99), rank(F.col("core_variable"), PLACES, 999), "core_variable")
    return v.select("core_variable", "n", F.row_number().over(order).cast("long").alias("position"))


@query(f"{CHECKS}, s AS (SELECT 'row' AS kind, core_variable AS name, {OUTCOME} FROM ck GROUP BY 2 UNION ALL SELECT 'summary', 'All', {OUTCOME} FROM ck UNION ALL SELECT 'summary', importance, {OUTCOME} FROM (SELECT CASE WHEN rule = 'not_null' THEN 'High' ELSE 'Low' END AS importance, ck.* FROM ck) GROUP BY 2) SELECT name, checks, n_failed, row_number() OVER (ORDER BY CASE WHEN kind = 'summary' THEN CASE name WHEN 'All' THEN 1 WHEN 'High' THEN 2 ELSE 3 END ELSE 9 END, name) AS position FROM s", facts=True)
def k2_summary_first(spark, sf_dir):
    """Summary rows in a fixed order, then variables, from one pass over the checks."""
    c = checks(spark, sf_dir).withColumn("importance", F.when(F.col("rule") == "not_null", "High").otherwise("Low"))
    each = F.explode(F.array(F.struct(F.lit(9).alias("o"), F.col("core_variable").alias("name")), F.struct(F.lit(1).alias("o"), F.lit("All").alias("name")), F.struct(F.when(F.col("importance") == "High", 2).otherwise(3).alias("o"), F.col("importance").alias("name"))))
    out = quality.outcome(c.select("failed", each.alias("g")).select("failed", "g.*"), "o", "name")
    return out.select("name", "checks", "n_failed", F.row_number().over(Window.orderBy("o", "name")).cast("long").alias("position"))


@query("SELECT status, count(*) AS n, CAST(min(chars) AS BIGINT) AS least, CAST(max(chars) AS BIGINT) AS most, round(avg(chars), 4) AS mean FROM (SELECT CASE WHEN doc_id % 13 = 0 THEN 'error' WHEN doc_id % 5 = 0 THEN 'skipped' ELSE 'processed' END AS status, length(text) AS chars FROM documents) GROUP BY 1")
def i2_progress(spark, sf_dir):
    status = F.expr("CASE WHEN doc_id % 13 = 0 THEN 'error' WHEN doc_id % 5 = 0 THEN 'skipped' ELSE 'processed' END")
    return incremental.summary(table(spark, sf_dir, "documents").select(status.alias("status"), F.length("text").cast("long").alias("cost"))).withColumnsRenamed({"min": "least", "max": "most"})


@query(f"{CHECKS} SELECT core_variable, rule, {OUTCOME} FROM ck GROUP BY 1, 2 UNION ALL SELECT core_variable, 'even_length', count(*), count_if(length(value) % 2 = 1), round((count(*) - count_if(length(value) % 2 = 1)) * 100.0 / count(*), 4) FROM facts WHERE core_variable = 'Order.priority' GROUP BY 1", facts=True)
def f3_added_rule(spark, sf_dir):
    """A kind of rule that a user registers, beside the built-in ones."""
    quality.register("even_length", F.coalesce(F.length("value") % 2 == 1, F.lit(False)))
    try:
        rules = spark.createDataFrame([*RULES, ("Order.priority", "even_length", "Conformance", None, None, None, None)], "core_variable string, rule string, dimension string, allowed array<string>, lo double, hi double, kind string")
        return quality.outcome(quality.checked(bind.facts(spark, sf_dir), rules, AS_OF), "core_variable", "rule")
    finally:
        quality.unregister("even_length")
