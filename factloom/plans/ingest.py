"""Queries that write the given tables in other forms and read them back, each with its SQL twin."""

from __future__ import annotations

import unicodedata
import uuid

from pyspark.sql import functions as F

from factloom.functions import text as tx
from factloom.operators import facts as fx
from factloom.operators.groups import numbered
from factloom.plans.clinical import TEXT
from factloom.plans.core import counts
from factloom.sources import bind, delimited, documents, exports
from factloom.sources.bind import FACTS, table
from factloom.sources.shared import new_path

QUERIES, SQL = {}, {}


def query(sql: str | None = None, facts: bool = False):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = counts(f"WITH {FACTS}, {sql}" if facts else sql.strip())
        return f

    return add


def _strings(df):
    return df.select(*[F.col(c).cast("string").alias(c) for c in df.columns])


@query("SELECT CAST(p_partkey AS VARCHAR) AS p_partkey, p_name || CASE p_partkey % 3 WHEN 0 THEN ', \"x\"' WHEN 1 THEN '; y' ELSE '' END AS p_name, p_brand FROM part")
def s1_s2_delimiters(spark, sf_dir):
    """Files of commas, semicolons and bars, with delimiters and quotes within fields."""
    p = table(spark, sf_dir, "part").select("p_partkey", F.expr("p_name || CASE p_partkey % 3 WHEN 0 THEN ', \"x\"' WHEN 1 THEN '; y' ELSE '' END").alias("p_name"), "p_brand")
    out = None
    for i, sep in enumerate((",", ";", "|")):
        path = new_path(spark, "delimited")
        _strings(p.where(F.col("p_partkey") % 3 == i)).coalesce(1).write.options(sep=sep, header=True, escape='"').csv(path)
        read = delimited.read_table(spark, path)
        out = read if out is None else out.unionByName(read)
    return out


@query("SELECT CAST(o_orderkey AS VARCHAR) AS id, o_orderstatus AS status, CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority END AS priority, CASE WHEN o_orderkey % 2 = 1 THEN CAST(o_custkey AS VARCHAR) END AS patient FROM orders")
def s3_cohort(spark, sf_dir):
    """Files of different headers as one table, without one that is not there and one that is empty."""
    o = table(spark, sf_dir, "orders")
    even, odd, empty = (new_path(spark, "cohort") for _ in range(3))
    _strings(o.where("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"))).write.options(header=True).csv(even)
    _strings(o.where("o_orderkey % 2 = 1").select(F.col("o_custkey").alias("patient"), F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"))).write.options(header=True, sep=";").csv(odd)
    spark.createDataFrame([], "value string").write.text(empty)
    return delimited.read_cohort(spark, [even, f"{even}-absent", empty, odd]).select("id", "status", "priority", "patient")


#: A note on one line without quotes; every third ends with a delimiter and more.
LINE = "trim(replace(replace(replace(text, chr(10), ' '), chr(13), ' '), '\"', ' ')) || CASE WHEN doc_id % 3 = 0 THEN '; more; ' || lang ELSE '' END"
NOTES = ["text", "date", "p_id", "note_id", "report_type"]


@query(f"SELECT trim({LINE}) AS text, CASE WHEN doc_id % 5 = 0 THEN '' ELSE '01/02/2024' END AS date, CAST(doc_id % 50 AS VARCHAR) AS p_id, CAST(doc_id AS VARCHAR) AS note_id, source AS report_type FROM documents WHERE text IS NOT NULL AND trim(text) != ''")
def s4_s6_s7_notes_file(spark, sf_dir):
    """A notes file with a byte order mark, quoted names and unquoted delimiters in the first column."""
    d = table(spark, sf_dir, "documents").where("text IS NOT NULL AND trim(text) != ''")
    line = F.concat_ws(";", F.expr(LINE), F.expr("CASE WHEN doc_id % 5 = 0 THEN '' ELSE '01/02/2024' END"), F.concat(F.lit('"'), F.col("doc_id") % 50, F.lit('" ')), "doc_id", "source")
    path = new_path(spark, "notes")
    header = spark.createDataFrame([('﻿"text"; date ;p_id;note_id;report_type',)], "value string")
    header.unionByName(d.select(line.alias("value"))).write.text(path)  # a file for each task, the header in the first
    return delimited.read_notes(spark, path, NOTES)


@query("""WITH q AS (SELECT doc_id, trim(replace(text, chr(13), '')) AS t FROM documents WHERE text IS NOT NULL AND trim(replace(text, chr(13), '')) != '')
SELECT CAST(doc_id AS VARCHAR) AS note_id, CASE WHEN doc_id % 4 = 0 THEN '"' ELSE '' END || 'Note ' || doc_id || chr(10) || chr(10) || t || chr(10) || '; end' AS text, 'p' || doc_id % 50 AS p_id FROM q UNION ALL SELECT 'note_id', 'text', 'p_id'""")
def s1_s4_quoted_line_breaks(spark, sf_dir):
    """A notes file whose quoted texts hold line breaks, blank lines, delimiters and quotes, with a row that is like the header."""
    t = F.trim(F.replace(F.col("text"), F.lit("\r"), F.lit("")))
    d = table(spark, sf_dir, "documents").where(t.isNotNull() & (t != ""))
    text = F.concat(F.when(F.col("doc_id") % 4 == 0, '"').otherwise(""), F.lit("Note "), "doc_id", F.lit("\n\n"), t, F.lit("\n; end"))
    rows = d.select(F.col("doc_id").cast("string").alias("note_id"), text.alias("text"), F.concat(F.lit("p"), F.col("doc_id") % 50).alias("p_id"))
    quoted = F.concat(F.lit('"'), F.replace(F.col("text"), F.lit('"'), F.lit('""')), F.lit('"'))
    lines = rows.select(F.concat_ws(";", "note_id", quoted, "p_id").alias("value"))
    path = new_path(spark, "quoted-notes")
    header = spark.createDataFrame([("note_id;text;p_id",)] * 2, "value string").coalesce(1)
    header.unionByName(lines).write.text(path)  # a file for each task, the header in the first
    return delimited.read_notes(spark, path, ["note_id", "text", "p_id"])


@query(r"SELECT CAST(doc_id AS VARCHAR) AS note_id, trim(regexp_replace(text, '[^\x20-\xff]+', ' ', 'g')) AS text, lang FROM documents WHERE text IS NOT NULL")
def s5_encodings(spark, sf_dir):
    """Files in UTF-16 and Latin-1, told apart by their bytes."""
    d = table(spark, sf_dir, "documents").where("text IS NOT NULL").select(F.col("doc_id").cast("string").alias("note_id"), F.trim(F.regexp_replace("text", r"[^\x20-\xff]+", " ")).alias("text"), "lang")
    out = None
    for i, name in enumerate(("UTF-16", "ISO-8859-1")):
        path = new_path(spark, "encoded")
        d.where(F.expr(f"note_id % 2 = {i}")).write.options(sep=";", header=True, encoding=name, escape='"', quoteAll=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)
        read = delimited.read_notes(spark, path, ["note_id", "text"])
        out = read if out is None else out.unionByName(read)
    return out


#: Patients with notes and annotations, as JSON; the note's text has controls that cleaning removes.
PATIENT_NOTE = "struct(CAST(o_orderkey AS STRING) AS note_id, concat('Line ', o_orderpriority, chr(10), chr(9), ' of ', o_orderkey, chr(1), '!') AS text, CAST(CAST(o_orderdate AS DATE) AS STRING) AS date, CAST(o_custkey AS STRING) AS p_id, o_orderstatus AS report_type, array({0}, 'Status ' || o_orderstatus) AS annotations, array(struct({0} AS template_text, CASE WHEN o_orderkey % 3 = 0 THEN array(struct(' span one ' AS text), struct('' AS text), struct(o_orderpriority AS text)) ELSE array() END AS supporting_text_spans)) AS annotations_with_spans)".format(TEXT)
PATTERNS = {"weight": ["^Annotation: Weight", "height: 1[.]"], "stage": ["(?i)^stage at", "metasta"], "status": ["^Status F$"]}


def patients(spark, sf_dir):
    path = new_path(spark, "patients")
    o = table(spark, sf_dir, "orders")
    o.groupBy(F.col("o_custkey").cast("string").alias("patient_id")).agg(F.collect_list(F.expr(PATIENT_NOTE)).alias("notes")).write.json(path)
    return documents.read_patients(spark, path)


PN = f"n AS (SELECT *, CAST(o_orderkey AS VARCHAR) AS note_id, {TEXT} AS a1, 'Status ' || o_orderstatus AS a2 FROM orders)"
PM = ", ".join(f"('{k}', '{'|'.join(v)}')" for k, v in PATTERNS.items())


@query(f"WITH {PN} SELECT 'Line ' || o_orderpriority || ' of ' || o_orderkey || ' !' AS text, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS date, CAST(o_custkey AS VARCHAR) AS p_id, note_id, o_orderstatus AS report_type FROM n")
def s8_patient_notes(spark, sf_dir):
    return documents.note_rows(patients(spark, sf_dir))


@query(f"WITH {PN}, p(prompt_type, pattern) AS (VALUES {PM}) SELECT note_id, prompt_type, array_to_string(list_filter([trim(a1), a2], lambda a: regexp_matches(a, pattern)), ' | ') AS matching_annotation, trim(a1) || ' | ' || a2 AS all_annotations FROM n, p")
def s9_note_prompts(spark, sf_dir):
    return documents.prompt_rows(patients(spark, sf_dir), PATTERNS).select("note_id", "prompt_type", "matching_annotation", "all_annotations")


@query(f"WITH {PN}, h AS (SELECT *, list_filter([a1, a2], lambda a: regexp_matches(a, '{'|'.join(PATTERNS['weight'] + PATTERNS['status'])}'))[1] AS a FROM n) SELECT DISTINCT CASE WHEN a = a1 AND o_orderkey % 3 = 0 THEN 'span one ... ' || o_orderpriority ELSE 'Line ' || o_orderpriority || chr(10) || chr(9) || ' of ' || o_orderkey || chr(1) || '!' END AS note_original_text, a AS annotation FROM h WHERE a IS NOT NULL")
def t24_p19_examples(spark, sf_dir):
    return documents.examples(patients(spark, sf_dir), PATTERNS["weight"] + PATTERNS["status"])


@query(f"WITH {PN} SELECT p_id, count(*) AS notes FROM (SELECT o_custkey AS p_id, dense_rank() OVER (ORDER BY o_custkey) AS pos FROM n) WHERE pos IN (1, 3, 5) OR pos % 10 = 0 GROUP BY 1")
def p19_patients_by_position(spark, sf_dir):
    """The notes of patients at given places of the order of ids: the places are counted on ids alone, before the notes are read."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("p_id"))
    ids = o.distinct()
    start = spark.range(1).select(F.lit(0).alias("top"))
    places = numbered(ids.withColumnRenamed("p_id", "made"), start)
    chosen = places.where("record_id IN (1, 3, 5) OR record_id % 10 = 0").select(F.col("made").alias("p_id"))
    return o.join(chosen, "p_id", "left_semi").groupBy("p_id").agg(F.count("*").alias("notes"))


WITH_DATA = """html || '<script type="x">var data = {"id": ' || CAST(page_id AS STRING) || ', "in": {"y": 1}}; window.meta = {"k": "v"}; let bad = {oops};</script>'"""


@query(rf"""WITH h AS (SELECT page_id, {WITH_DATA} AS html FROM pages), o AS (SELECT page_id, flatten(list_transform(regexp_extract_all(html, '(?is)<script[^>]*>(.*?)</script>', 1), lambda s: regexp_extract_all(s, '{documents.OBJECT}'))) AS l, regexp_extract(html, '(?s)\bvar\s+data\s*=\s*(\{{.*?\}})\s*;', 1) AS v, regexp_extract(html, '(?s)window\.meta\s*=\s*(\{{.*?\}})\s*;', 1) AS w FROM h)
SELECT page_id, array_to_string(list_filter(l, lambda x: json_valid(x)), chr(10)) AS objects, CASE WHEN json_valid(v) THEN v END AS data, CASE WHEN json_valid(w) THEN w END AS meta FROM o""")
def s10_script_objects(spark, sf_dir):
    """All JSON objects in the scripts of pages, and those assigned to two names."""
    p = table(spark, sf_dir, "pages").select("page_id", F.expr(WITH_DATA).alias("html"))
    h = F.col("html")
    return p.select("page_id", F.array_join(documents.script_objects(h), "\n").alias("objects"), documents.script_variable(h, "data").alias("data"), documents.script_variable(h, "meta").alias("meta"))


FLAT = "SELECT CAST(patient_id AS VARCHAR) AS patient_id, original_source, core_variable, CAST(date_ref AS VARCHAR) AS date_ref, {} AS value, record_id, CAST(NULL AS VARCHAR) AS linked_to, CAST(NULL AS VARCHAR) AS quality FROM facts"


@query("x AS (SELECT 1) " + FLAT.format("nullif(value, '')"), facts=True)
def s11_label_export(spark, sf_dir):
    """All facts with the eight fixed columns, semicolon separated, read back."""
    path = new_path(spark, "labels")
    exports.write_labels(bind.facts(spark, sf_dir, day_texts=True), path)
    return exports.read_labels(spark, path)


#: Codes of the values of coded variables.
CODES = {"Order.status": {"F": "S1", "O": "S2"}, "Customer.segment": {"BUILDING": "C1"}}


@query("m(core_variable, value, code) AS (VALUES ('Order.status', 'F', 'S1'), ('Order.status', 'O', 'S2'), ('Customer.segment', 'BUILDING', 'C1')), t AS (SELECT facts.* REPLACE (CASE WHEN facts.core_variable IN ('Order.status', 'Customer.segment') AND value IS NOT NULL THEN coalesce(m.code, 'UNRESOLVED::' || value) WHEN facts.core_variable IN ('Line.quantity', 'Customer.nation') THEN nullif(regexp_extract(value, '-?[0-9]+'), '') ELSE value END AS value) FROM facts LEFT JOIN m USING (core_variable, value)) " + FLAT.format("value").replace("FROM facts", "FROM t"), facts=True)
def s12_j17_coded_export(spark, sf_dir):
    """The export with codes: a map of values of coded variables, UNRESOLVED:: for others; integers cleaned; the rest as it is."""
    f = bind.facts(spark, sf_dir, day_texts=True)
    name, value = F.col("core_variable"), F.col("value")
    # Within the scan of each table: a join would put its rows together first.
    out = F.when(name.isin("Line.quantity", "Customer.nation"), fx.first_integer(value))
    for variable, codes in CODES.items():
        out = out.when(name == variable, fx.code_or_text(value, codes))
    path = new_path(spark, "coded")
    exports.write_labels(f.withColumn("value", out.otherwise(value)), path)
    return exports.read_labels(spark, path)


@query("""SELECT CAST(p_partkey AS VARCHAR) AS id, '{"brand":"' || p_brand || '","sizes":[' || p_size || ']}' AS nested, '1995-01-0' || (p_partkey % 9 + 1) AS day FROM part""")
def s13_s14_step_tables(spark, sf_dir):
    """A stage's output as a table that is replaced, nested values as JSON and dates as text; then read back as CSV."""
    p = table(spark, sf_dir, "part")
    out = p.select("p_partkey", F.struct(F.col("p_brand").alias("brand"), F.array("p_size").alias("sizes")).alias("nested"), F.to_date(F.concat(F.lit("1995-01-0"), F.col("p_partkey") % 9 + 1)).alias("day"))
    name = f"step_{uuid.uuid4().hex}"
    for part in (out.limit(0), out):
        exports.store_step(part.withColumnRenamed("p_partkey", "id"), name, new_path(spark, "step"))
    back = exports.step_as_csv(spark, name, new_path(spark, "step-csv"))
    spark.sql(f"DROP TABLE {name}")
    return back


@query("SELECT regexp_replace(prompt_key, '-[A-Z]+$', '') AS prompt_type, note_text, annotation, n FROM (SELECT p_type || '-' || CASE WHEN p_size % 2 = 0 THEN 'AA' ELSE 'BB' END AS prompt_key, p_name AS note_text, p_brand AS annotation, count(*) OVER (PARTITION BY p_type, p_size % 2) AS n, p_size FROM part WHERE p_partkey % 7 != 0) WHERE p_size % 2 = 1")
def s16_example_store(spark, sf_dir):
    """Examples uploaded for two centers (incomplete rows dropped), one center's deleted, the other's downloaded and counted."""
    path = new_path(spark, "examples")
    p = table(spark, sf_dir, "part")
    rows = p.select(F.col("p_type").alias("prompt_type"), F.col("p_name").alias("note_text"), F.when(F.col("p_partkey") % 7 != 0, F.col("p_brand")).alias("annotation"), "p_size")
    exports.add_examples(rows.where("p_size % 2 = 0").drop("p_size"), path, "AA")
    exports.add_examples(rows.where("p_size % 2 = 1").drop("p_size"), path, "BB")
    exports.delete_examples(spark, path, "AA")
    left = exports.read_examples(spark, path, "BB")
    return left.join(left.groupBy("prompt_type").agg(F.count("*").alias("n")), "prompt_type")


@query("SELECT r_name AS center, n_name AS prompt_type, 'Do ' || n_name || ' {fewshots} Note: {note}' AS template, CASE WHEN n_nationkey % 2 = 0 THEN '{\"entity\":\"E' || n_nationkey || '\"}' END AS entity_mapping FROM nation JOIN region ON r_regionkey = n_regionkey")
def s17_prompts(spark, sf_dir):
    """Prompts by center as JSON, some as plain templates and some as objects, flattened."""
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    text = F.concat(F.lit(" Do "), "n_name", F.lit(" {few_shot_examples} {static_samples}Note: {{note_original_text}}{{annotation}}"))
    entity = F.concat(F.lit("E"), F.col("n_nationkey"))
    prompt = F.when(F.col("n_nationkey") % 2 == 0, F.to_json(F.struct(text.alias("template"), F.struct(entity.alias("entity")).alias("entity_mapping")))).otherwise(F.to_json(F.struct(text.alias("template"))))
    rows = n.join(r, n["n_regionkey"] == r["r_regionkey"]).select("r_name", "n_name", F.when(F.col("n_nationkey") % 3 == 0, prompt).otherwise(F.when(F.col("n_nationkey") % 2 == 0, prompt).otherwise(F.to_json(F.array(text)))).alias("j"))
    one = F.concat(F.to_json(F.array("n_name")).substr(F.lit(2), F.length("n_name") + 2), F.lit(":"), F.when(F.col("j").startswith("["), F.col("j").substr(F.lit(2), F.length("j") - 2)).otherwise(F.col("j")))
    centers = rows.withColumn("one", one).groupBy("r_name").agg(F.concat(F.lit('"'), F.col("r_name"), F.lit('":{'), F.array_join(F.collect_list("one"), ","), F.lit("}")).alias("c"))
    path = new_path(spark, "prompts")
    centers.agg(F.concat(F.lit("{"), F.array_join(F.collect_list("c"), ","), F.lit("}")).alias("value")).coalesce(1).write.text(path)
    return documents.read_prompts(spark, path)


@query("SELECT lang AS center, source AS report_type, CASE WHEN lang = 'de' THEN 'new' ELSE 'p' || min(doc_id % 4) END AS prompts FROM documents WHERE lang != 'de' OR doc_id % 2 = 0 GROUP BY 1, 2 UNION SELECT 'de', source, 'p' || min(doc_id % 4) FROM documents WHERE lang = 'de' GROUP BY source HAVING count(CASE WHEN doc_id % 2 = 0 THEN 1 END) = 0")
def s18_mapping_upsert(spark, sf_dir):
    """A center's mapping of report types: given ones replaced, others kept."""
    d = table(spark, sf_dir, "documents")
    old = d.groupBy(F.col("lang").alias("center"), F.col("source").alias("report_type")).agg(F.concat(F.lit("p"), F.min(F.col("doc_id") % 4)).alias("prompts"))
    new = d.where("lang = 'de' AND doc_id % 2 = 0").select(F.col("lang").alias("center"), F.col("source").alias("report_type"), F.lit("new").alias("prompts")).distinct()
    return exports.upserted(old, new, ["center", "report_type"])


@query("SELECT lower(p_type) AS category, lower(p_name || ' - x') AS label, arg_max('C' || p_partkey, lpad(CAST(p_partkey AS VARCHAR), 9, '0')) AS code_id FROM part GROUP BY 1, 2")
def s19_code_dictionary(spark, sf_dir):
    """{code: "Category - Label"}: only the first " - " splits, spaces and case are normalised, the last of equal ones wins."""
    p = table(spark, sf_dir, "part")
    entry = F.struct(F.lpad(F.col("p_partkey").cast("string"), 9, "0").alias("o"), F.concat(F.lit('"C'), F.col("p_partkey"), F.lit('":"'), F.col("p_type"), F.lit(" - "), F.replace("p_name", F.lit(" "), F.lit("  ")), F.lit(' - x"')).alias("e"))
    path = new_path(spark, "codes")
    p.agg(F.concat(F.lit("{"), F.array_join(F.transform(F.array_sort(F.collect_list(entry)), lambda x: x["e"]), ","), F.lit("}")).alias("value")).write.text(path)
    return documents.read_codes(spark, path)


@query("WITH c AS (SELECT 'Q' || p_partkey AS query, p_brand AS morphology, 'C' || p_size AS topography, p_name AS name FROM part), l AS (SELECT 'query' AS kind, upper(query) AS key FROM c UNION ALL SELECT 'morphology', upper(morphology) FROM c UNION ALL SELECT 'topography', upper(topography) FROM c UNION ALL SELECT 'name', lower(name) FROM c) SELECT kind, key, count(*) AS n FROM l GROUP BY 1, 2")
def s20_combination_lookups(spark, sf_dir):
    """The combination list as a file and its four lookups, in one scan."""
    p = table(spark, sf_dir, "part")
    path = new_path(spark, "combinations")
    _strings(p.select(F.concat(F.lit("Q"), "p_partkey").alias("Query"), F.col("p_brand").alias("Morphology"), F.concat(F.lit("C"), "p_size").alias("Topography"), F.col("p_name").alias("NAME"), F.col("p_partkey").alias("ID"))).write.options(header=True).csv(path)
    c = delimited.read_table(spark, path)
    keys = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), v.alias("key")) for k, v in (("query", F.upper("Query")), ("morphology", F.upper("Morphology")), ("topography", F.upper("Topography")), ("name", F.lower("NAME")))]))
    return c.select(keys.alias("k")).select("k.*").groupBy("kind", "key").agg(F.count("*").alias("n"))


@query("WITH u AS (SELECT p_name AS label, p_type AS grp, 'C' || p_size AS code FROM part WHERE p_partkey % 2 = 0 AND p_size % 9 != 0 UNION ALL SELECT p_name, p_type, 'C' || p_size FROM part WHERE p_partkey % 2 = 1 AND p_size % 4 != 0), k AS (SELECT lower(label) AS key, code FROM u UNION SELECT lower(grp), code FROM u) SELECT key, count(*) AS codes, min(code) AS least FROM k GROUP BY 1")
def s21_condition_files(spark, sf_dir):
    """Two files of other headers as one dimension: rows without a code or not in use go, labels and groups are keys."""
    p = table(spark, sf_dir, "part")
    one, two = new_path(spark, "conditions"), new_path(spark, "conditions")
    code = F.concat(F.lit("C"), "p_size")
    p.where("p_partkey % 2 = 0").select(F.col("p_name").alias("Subsite"), F.when(F.col("p_size") % 9 != 0, code).alias("ICD-O-3"), F.col("p_type").alias("Group")).write.options(header=True).csv(one)
    p.where("p_partkey % 2 = 1").select(F.col("p_type").alias("SITE"), F.col("p_name").alias("Sub-site"), code.alias("icdo3_code"), F.when(F.col("p_size") % 4 != 0, "Yes").otherwise("no").alias("In use")).write.options(header=True).csv(two)
    a, b = delimited.read_table(spark, one), delimited.read_table(spark, two)
    both = a.select(F.col("Subsite").alias("label"), F.col("Group").alias("grp"), F.col("ICD-O-3").alias("code")).unionByName(b.where("lower(`In use`) != 'no'").select(F.col("Sub-site").alias("label"), F.col("SITE").alias("grp"), F.col("icdo3_code").alias("code")))
    keys = both.where("code != ''").select(F.explode(F.array(F.lower("label"), F.lower("grp"))).alias("key"), "code").distinct()
    return keys.groupBy("key").agg(F.count("*").alias("codes"), F.min("code").alias("least"))


@query("WITH u AS (SELECT 'C' || p_size AS code, p_name AS label, p_partkey % 3 AS file, p_partkey FROM part) SELECT code, arg_min(label, struct_pack(f := file, p := p_partkey)) AS label FROM u GROUP BY 1")
def s22_label_maps(spark, sf_dir):
    """Labels of codes out of three files, the first file that has one wins."""
    p = table(spark, sf_dir, "part").select(F.concat(F.lit("C"), "p_size").alias("code"), F.col("p_name").alias("label"), (F.col("p_partkey") % 3).alias("file"), "p_partkey")
    return p.groupBy("code").agg(F.min_by("label", F.struct("file", "p_partkey")).alias("label"))


KINDS = ["liposarcoma", "leiomyosarcoma", "fibrosarcoma", "no tumour"]


@query(f"SELECT doc_id AS note_id, CAST(2000 + doc_id % 25 AS BIGINT) AS year, {KINDS}[doc_id % 4 + 1] AS label, 'Histology of ' || (2000 + doc_id % 25) || ': ' || {KINDS}[doc_id % 4 + 1] || '.' AS text FROM documents")
def s23_synthetic_notes(spark, sf_dir):
    """A labelled note for each document's id, the same at each run."""
    label = F.element_at(F.array(*[F.lit(k) for k in KINDS]), (F.col("doc_id") % 4 + 1).cast("int"))
    year = (2000 + F.col("doc_id") % 25).cast("long")
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("note_id"), year.alias("year"), label.alias("label"), F.concat(F.lit("Histology of "), year, F.lit(": "), label, F.lit(".")).alias("text"))


@query("t AS (SELECT 'csv' AS form UNION ALL SELECT 'json'), r AS (SELECT core_variable AS key, 'variables' AS report, count(*) AS n FROM facts GROUP BY 1 UNION ALL SELECT original_source, 'sources', count(*) FROM facts GROUP BY 1) SELECT report, key, n, form FROM r, t", facts=True)
def s24_reports(spark, sf_dir):
    """Each report in both forms, read back: one pass over the facts a report."""
    f = bind.facts(spark, sf_dir)
    reports = {"variables": f.groupBy(F.col("core_variable").alias("key")).agg(F.count("*").alias("n")), "sources": f.groupBy(F.col("original_source").alias("key")).agg(F.count("*").alias("n"))}
    base = new_path(spark, "reports")
    exports.write_reports(reports, base)
    out = None
    for name in reports:
        for form in ("csv", "json"):
            r = exports.read_report(spark, base, name, form, "key string, n long").withColumns({"report": F.lit(name), "form": F.lit(form)})
            out = r if out is None else out.unionByName(r)
    return out.select("report", "key", "n", "form")


@query("SELECT CAST(conv_id AS VARCHAR) AS note_id, role AS prompt_type, left(text, 5) AS expected_annotation, CAST(turn AS VARCHAR) AS extra FROM (SELECT *, regexp_replace(text, '[^A-Za-z]', '', 'g') AS text0 FROM conversations) WHERE text IS NOT NULL AND regexp_full_match(left(text, 5), '[A-Za-z ]+') AND left(text, 5) = trim(left(text, 5))")
def s25_evaluation_files(spark, sf_dir):
    """Evaluation rows with the fixed columns first, then others by name."""
    c = table(spark, sf_dir, "conversations").select(F.col("turn").cast("string").alias("extra"), F.left("text", F.lit(5)).alias("expected_annotation"), F.col("role").alias("prompt_type"), F.col("conv_id").cast("string").alias("note_id"))
    c = c.where(F.col("expected_annotation").rlike("^[A-Za-z ]+$") & (F.col("expected_annotation") == F.trim("expected_annotation")))
    path = new_path(spark, "evaluation")
    ordered = exports.ordered_columns(c.columns, ["note_id", "prompt_type", "expected_annotation", "predicted_annotation"])
    assert ordered == ["note_id", "prompt_type", "expected_annotation", "extra"]
    c.select(*ordered).write.options(header=True).csv(path)
    return delimited.read_table(spark, path)


def _ranges(letters) -> str:
    """Letters in ascending order as what stands in the brackets of a pattern."""
    at = sorted(map(ord, letters))
    ends = [(a, b) for a, b in zip(at, at[1:]) if b > a + 1]
    return "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in zip([at[0]] + [b for _, b in ends], [a for a, _ in ends] + [at[-1]]))


def _letters() -> tuple[str, dict[str, str]]:
    """Letters that do not print, without controls and surrogates; compatibility letters with what stands for them."""
    every = [(c, unicodedata.category(c)) for c in map(chr, range(0x110000))]
    plain = {c: k for c, g in every if g not in ("Cn", "Co", "Cs") and unicodedata.decomposition(c) and (k := unicodedata.normalize("NFKD", c)) != unicodedata.normalize("NFD", c)}
    return "".join(c for c, g in every if g in ("Cf", "Cn", "Co")), plain


HIDDEN, PLAIN = _letters()
PLAIN_MAP = "MAP {" + ", ".join(f"chr({ord(c)}): '{k.replace(chr(39), chr(39) * 2)}'" for c, k in PLAIN.items()) + "}"


# U+11A7 joins nothing; nfc_normalize drops it after some syllables, so texts are normalised between them.
@query(rf"""WITH d AS (SELECT doc_id, text || chr(8230) || chr(1) || chr(64257) || chr(160) || chr(65296) AS t FROM documents), p AS (SELECT doc_id, regexp_replace(regexp_replace(t, '[\p{{Z}}\p{{Cc}}]+', ' ', 'g'), '[{_ranges(HIDDEN)}]+', '', 'g') AS t FROM d),
k AS (SELECT doc_id, list_reduce(list_distinct(regexp_extract_all(t, '[{_ranges(PLAIN)}]')), lambda a, c: replace(a, c, {PLAIN_MAP}[c]), t) AS t FROM p)
SELECT doc_id, trim(regexp_replace(array_to_string(list_transform(string_split(t, chr(4519)), lambda s: nfc_normalize(s)), chr(4519)), ' +', ' ', 'g')) AS text FROM k""")
def t30_clean_text(spark, sf_dir):
    """Newlines, controls and runs of spaces become a space, compatibility letters plain ones. Some of each are added to every text."""
    # Through explode, as every text would be made anew for each use of it.
    d = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.array(F.expr("text || '…' || chr(1) || 'ﬁ' || '\u00a0' || '０'"))).alias("text"))
    return d.select("doc_id", tx.clean_text(F.col("text")).alias("text"))
