"""Annotations to facts and the row handlers, each with its SQL twin."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from factloom.operators import annotate, extract, groups, links
from factloom.operators.extract import Parameter, Sentence
from factloom.plans.core import counts
from factloom.sources.bind import table
from factloom.sources.shared import new_path, written

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = counts(sql.strip())
        return f

    return add


#: A sentence dictionary of our own.
SENTENCES = [
    Sentence("61", "", r"weight: ([0-9.]+) kg, height: ([0-9.]+)", [Parameter("Patient.weight", "NUMBER")]),
    Sentence("63", "", r"genetic syndromes?: (.+)", [Parameter("Patient.geneticSyndrome", "TEXT")]),
    Sentence("64", "No genetic syndrome"),
    Sentence("74", "", r"age at diagnosis: ([0-9]+)", [Parameter("Patient.birthYear", "NUMBER")]),
    Sentence("76", "Radiotherapy induced sarcoma"),
    Sentence("80", "", r"grade: ([a-z]+)", [Parameter("Diagnosis.grading", "ENUM", [("low", "4"), ("high", "5")]), Parameter("Diagnosis.secondGrading", "ENUM", [("low", "14"), ("high", "15")])]),
    Sentence("91", "Stage at diagnosis: localized"),
    Sentence("92", "", r"stage at diagnosis: loco-regional, ([a-z -]+)", [Parameter("DiseaseExtent.stage", "DEFAULT", value="loco")]),
    Sentence("93", "Regional node metastases"),
    Sentence("94", "", r"distant metastases: (.+)", [Parameter("ClinicalStage.distantMetastases", "DEFAULT", value="36769180")]),
    Sentence("187", "", r"mitotic count: ([0-9.]+)/([0-9.]+) ?hpf", [Parameter("Diagnosis.mitoses", "NUMBER")]),
    Sentence("188", "", r"mitotic count: ([0-9.]+)/([0-9.]+) ?mm2", [Parameter("Diagnosis.mitoses", "NUMBER")]),
    Sentence("211", "", r"limb perfusion from ([0-9-]+) with (.+)", [Parameter("IsolatedLimbPerfusion.startDate", "DATE")]),
    Sentence("217", "", r"radiotherapy site: ([a-z ]+), details: (.+)", [Parameter("Radiotherapy.site", "TEXT")]),
    Sentence("219", "", r"hyperthermia: (in combination with [a-z]+|alone)", [Parameter("RegionalDeepHyperthemia.startDate", "DEFAULT", value="started")]),
    Sentence("225", "Patient status: Dead of Disease (DOD)"),
    Sentence("227", "Patient status: Dead of Unknown Cause (DUC)"),
    Sentence("228", "Patient status: Alive, No Evidence of Disease (NED)"),
    Sentence("230", "Patient status: Alive With Disease (AWD), nodes"),
    Sentence("239", "", r"episode on ([0-9-]+)", [Parameter("EpisodeEvent.dateOfEpisode", "DATE")]),
    Sentence("240", "", r"cancer from ([0-9-]+)", [Parameter("CancerEpisode.cancerStartDate", "DATE")]),
    Sentence("241", "", r"episode status: ([a-z]+)", [Parameter("EpisodeEvent.diseaseStatus", "ENUM", [("progression", "32949"), ("recurrence", "32945")])]),
    Sentence("242", "", r"recurrence type: (local and metastatic|metastatic|local)(?: in (.+))?", [Parameter("DiseaseExtent.recurrence", "TEXT")]),
]

#: One annotation an order, in words that both engines take: the text and the prompt.
TEXT = """CASE o_orderkey % 20
WHEN 0 THEN 'Annotation: Weight: ' || CAST(50 + o_custkey % 50 AS STRING) || ' kg, height: ' || CASE WHEN o_orderkey % 40 = 0 THEN CAST(150 + o_custkey % 50 AS STRING) ELSE '1.' || CAST(50 + o_custkey % 50 AS STRING) END
WHEN 1 THEN '"Genetic syndromes: ' || CASE o_custkey % 3 WHEN 0 THEN 'Li-Fraumeni syndrome, Retinoblastoma and Paget disease' WHEN 1 THEN 'Werner Syndrome; werner-syndrome' ELSE 'unknown' END || '"'
WHEN 2 THEN 'No genetic syndrome.'
WHEN 3 THEN 'Radiotherapy induced sarcoma'
WHEN 4 THEN 'Stage at diagnosis: localized'
WHEN 5 THEN 'Stage at diagnosis: loco-regional, ' || CASE o_custkey % 3 WHEN 0 THEN 'in-transit metastasis' WHEN 1 THEN 'multifocal' ELSE 'none' END
WHEN 6 THEN 'Regional node metastases'
WHEN 7 THEN 'Distant metastases: ' || CASE o_custkey % 3 WHEN 0 THEN 'in the lungs; soft tissue and other' WHEN 1 THEN 'bones, to liver, Liver' ELSE 'kidney' END
WHEN 8 THEN 'Radiotherapy site: ' || CASE WHEN o_custkey % 4 = 0 THEN 'primary' ELSE 'metastatic' END || ', details: lung, soft-tissue, skin, Bone'
WHEN 9 THEN 'Recurrence type: ' || CASE o_custkey % 3 WHEN 0 THEN 'metastatic in lungs, brain metastases' WHEN 1 THEN 'local' ELSE 'local and metastatic in unknown site' END
WHEN 10 THEN 'Patient status: ' || CASE o_custkey % 4 WHEN 0 THEN 'Dead of Disease (DOD)' WHEN 1 THEN 'Dead of Unknown Cause (DUC)' WHEN 2 THEN 'Alive, No Evidence of Disease (NED)' ELSE 'Alive With Disease (AWD), nodes' END
WHEN 11 THEN 'Biopsy mitotic count: ' || CAST(o_custkey % 30 AS STRING) || '/10HPF'
WHEN 12 THEN 'Biopsy mitotic count: ' || CAST(o_custkey % 30 AS STRING) || '/' || CAST(o_custkey % 7 AS STRING) || ' mm2'
WHEN 13 THEN 'Limb perfusion from ' || CAST(CAST(o_orderdate AS DATE) AS STRING) || ' with melphalan, tnf'
WHEN 14 THEN 'Hyperthermia: ' || CASE WHEN o_custkey % 2 = 0 THEN 'in combination with radiotherapy' ELSE 'alone' END
WHEN 15 THEN 'ERROR: no answer'
WHEN 16 THEN 'Grade: high, then grade: low, then grade: ' || CASE WHEN o_custkey % 2 = 0 THEN 'low' ELSE 'none' END
WHEN 17 THEN 'Age at diagnosis: ' || CAST(20 + o_custkey % 60 AS STRING)
WHEN 18 THEN 'Episode status: ' || CASE WHEN o_custkey % 2 = 0 THEN 'progression' ELSE 'Recurrence' END
WHEN 19 THEN CASE o_custkey % 3 WHEN 0 THEN 'Cancer from ' || CAST(CAST(o_orderdate AS DATE) - 40 AS STRING) WHEN 1 THEN 'Episode on ' || CAST(CAST(o_orderdate AS DATE) - 5 AS STRING) ELSE 'unknown' END
ELSE 'unknown' END"""
PROMPT = "CASE WHEN o_orderkey % 20 = 10 AND o_custkey % 5 != 0 THEN 'patient-status-int' ELSE 'other-int' END"
STORED = {0: "DiseaseExtent", 1: "ClinicalStage", 2: "PatientFollowUp", 3: "EpisodeEvent", 4: "CancerEpisode", 5: "Patient"}


def annotations(spark, sf_dir):
    """note_id, seq, patient_id, day, prompt_type, text."""
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("note_id"), F.col("o_orderkey").alias("seq"), F.col("o_custkey").alias("patient_id"), F.to_date("o_orderdate").alias("day"), F.expr(PROMPT).alias("prompt_type"), F.expr(TEXT).alias("text"))


def stored(spark, sf_dir):
    """patient_id, entity, day (number), record_id of facts that are there before the run."""
    li, o = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    entity = F.element_at(F.create_map(*[x for k, v in STORED.items() for x in (F.lit(k), F.lit(v))]), (F.col("l_partkey") % 6).cast("int"))
    return li.join(o, li["l_orderkey"] == o["o_orderkey"]).select(F.col("o_custkey").alias("patient_id"), entity.alias("entity"), F.unix_date(F.to_date("l_shipdate")).alias("day"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("record_id"))


def found(spark, sf_dir):
    return extract.matches(annotations(spark, sf_dir), SENTENCES)


_PATTERNS = ", ".join(f"({i}, '{s.id}', '(?i){s.pattern}', {s.groups})" for i, s in enumerate(SENTENCES) if s.pattern)
_PLAIN = ", ".join(f"({i}, '{s.id}', '{s.content.lower()}')" for i, s in enumerate(SENTENCES) if not s.pattern)
_PHRASES = ", ".join(f"('{k}', {v})" for k, v in extract.STATUS_PHRASES.items())
FOUND = f"""ann AS (SELECT o_orderkey AS note_id, o_orderkey AS seq, o_custkey AS patient_id, CAST(o_orderdate AS DATE) AS day, {PROMPT} AS prompt_type, regexp_replace(trim(replace({TEXT}, 'Annotation:', '')), '^"+|"+$', '', 'g') AS text FROM orders),
ok AS (SELECT * FROM ann WHERE NOT starts_with(text, 'ERROR:')),
pat(ord, sentence_id, pattern, n) AS (VALUES {_PATTERNS}), plain(ord, sentence_id, content) AS (VALUES {_PLAIN}), phrases(sentence_id, phrases) AS (VALUES {_PHRASES}),
pm AS (SELECT ok.*, ord, sentence_id, regexp_extract_all(text, pattern, 1) AS a1, CASE WHEN n > 1 THEN regexp_extract_all(text, pattern, 2) ELSE [] END AS a2 FROM ok, pat),
m1 AS (SELECT * EXCLUDE (a1, a2), i - 1 AS pos, a1[i] AS g1, coalesce(a2[i], '') AS g2 FROM (SELECT *, unnest(range(1, len(a1) + 1)) AS i FROM pm)),
m2 AS (SELECT ok.*, plain.ord, plain.sentence_id, 0 AS pos, '' AS g1, '' AS g2 FROM ok JOIN plain ON contains(lower(trim(text)), content) OR contains(content, lower(trim(text))) LEFT JOIN phrases USING (sentence_id)
  WHERE CASE WHEN phrases IS NOT NULL THEN prompt_type = 'patient-status-int' AND len(list_filter(phrases, lambda p: contains(lower(text), p))) > 0 AND (contains(lower(text), 'status') OR contains(lower(text), 'follow-up') OR contains(lower(text), 'followup'))
  ELSE contains(lower(trim(text)), content) OR len(list_intersect(list_distinct(string_split(content, ' ')), string_split_regex(lower(trim(text)), '\\s+'))) * 2 >= len(list_distinct(string_split(content, ' '))) END),
fo AS (SELECT note_id, seq, patient_id, day, prompt_type, ord, sentence_id, i AS pos, g1, g2 FROM (SELECT note_id, seq, patient_id, day, prompt_type, ord, sentence_id, CAST(i AS BIGINT) AS i, g1, g2 FROM (SELECT note_id, seq, patient_id, day, prompt_type, ord, sentence_id, i - 1 AS i, g1, g2 FROM (SELECT *, pos + 1 AS i FROM (SELECT note_id, seq, patient_id, day, prompt_type, ord, sentence_id, pos, g1, g2 FROM m1 UNION ALL SELECT note_id, seq, patient_id, day, prompt_type, ord, sentence_id, pos, g1, g2 FROM m2)))))"""
_PARAMS = ", ".join(f"('{s.id}', {k}, '{p.variable}', '{p.kind}', {'NULL' if p.value is None else repr(p.value)})" for s in SENTENCES for k, p in enumerate(s.parameters))
_CHOICES = ", ".join(f"('{s.id}', {k}, {j}, '{part}', '{c}')" for s in SENTENCES for k, p in enumerate(s.parameters) for j, (part, c) in enumerate(p.choices))
BAD = "(lower(trim(coalesce(value, ''))) IN ('n/a', 'na', 'none', 'null', 'unknown', 'unk', '-', '--', '') OR regexp_full_match(lower(trim(value)), '\\[[^\\]]+\\]'))"
DEFAULTS = f"""{FOUND}, par(sentence_id, pos, core_variable, kind, fixed) AS (VALUES {_PARAMS}), cho(sentence_id, pos, nth, part, concept) AS (VALUES {_CHOICES}),
np AS (SELECT sentence_id, count(*) AS n FROM par GROUP BY 1),
dp AS (SELECT fo.*, par.core_variable, par.kind, par.fixed, par.pos AS ppos FROM fo JOIN np USING (sentence_id) JOIN par ON par.sentence_id = fo.sentence_id AND par.pos = CASE WHEN fo.pos < n THEN fo.pos ELSE 0 END),
dv AS (SELECT note_id, seq, patient_id, day, ord, sentence_id, pos, core_variable, kind, CASE WHEN kind = 'ENUM' THEN (SELECT arg_min(concept, nth) FROM cho WHERE cho.sentence_id = dp.sentence_id AND cho.pos = dp.ppos AND contains(lower(g1), part)) WHEN kind = 'DEFAULT' THEN fixed WHEN core_variable = 'Patient.birthYear' THEN CAST(year(day) - CAST(g1 AS INTEGER) AS VARCHAR) ELSE g1 END AS value FROM dp),
de AS (SELECT * FROM dv WHERE NOT {BAD} AND NOT (kind = 'DATE' AND NOT regexp_matches(value, '\\d{{1,2}}/\\d{{1,2}}/\\d{{4}}|\\d{{4}}-\\d{{2}}-\\d{{2}}')))"""


@query(f"WITH {DEFAULTS} SELECT note_id, sentence_id, pos, core_variable, value FROM de")
def t31_annotation_facts(spark, sf_dir):
    rows = extract.default_rows(found(spark, sf_dir), SENTENCES)
    return rows.select("note_id", "sentence_id", F.col("pos").cast("long").alias("pos"), "core_variable", "value")


@query(f"WITH {FOUND} SELECT sentence_id, count(*) AS n, count(DISTINCT note_id) AS notes FROM fo GROUP BY 1")
def p7_p8_sentences_found(spark, sf_dir):
    """Sentences found, without error annotations, and those of a patient's status in their prompt only."""
    return found(spark, sf_dir).groupBy("sentence_id").agg(F.count("*").alias("n"), F.count_distinct("note_id").alias("notes"))


#: Rows of handlers for the SQL twins: (sentence, variable, value) by match.
_SYN = ", ".join(f"('{k}', '{v}', '{c}')" for k, (v, c) in extract.SYNDROMES.items())
_ORG = ", ".join(f"('94', '{k}', '{v}', '{c}')" for k, (v, c) in extract.STAGE_ORGANS.items()) + ", " + ", ".join(f"('242', '{k}', '{v}', '{c}')" for k, (v, c) in extract.EXTENT_ORGANS.items())
_SITES = ", ".join(f"('{k}', '{v}')" for k, (v, _) in extract.RADIOTHERAPY_SITES.items())
_STATUS = ", ".join(f"('{k}', '{v}')" for k, v in extract.STATUS_CONCEPTS.items())
HANDLED = f"""{FOUND}, syn(name, v, c) AS (VALUES {_SYN}), org(sid, name, v, c) AS (VALUES {_ORG}), sit(name, v) AS (VALUES {_SITES}), sta(sid, c) AS (VALUES {_STATUS}),
tok AS (SELECT *, trim(regexp_replace(lower(t), '[^a-z0-9]+', ' ', 'g')) AS name FROM (SELECT fo.*, unnest(string_split_regex(g1, ',|;|/| and ')) AS t FROM fo WHERE sentence_id = '63')),
ot AS (SELECT *, regexp_replace(trim(lower(trim(t)), '. '), '^(in|to|at|on|the)\\s+', '') AS t1 FROM (SELECT fo.*, unnest(string_split_regex(CASE sentence_id WHEN '94' THEN g1 ELSE lower(g2) END, ',|;|/| and ')) AS t FROM fo WHERE sentence_id = '94' OR sentence_id = '242' AND contains(lower(g1), 'metast'))),
ot2 AS (SELECT *, CASE sentence_id WHEN '94' THEN t1 ELSE trim(regexp_replace(t1, 'metastases?', '')) END AS t2 FROM ot),
ot3 AS (SELECT *, CASE WHEN contains(t2, 'soft tissue') THEN 'soft tissue' WHEN t2 IN ('lungs', 'bones', 'livers', 'brains') THEN left(t2, length(t2) - 1) WHEN contains(t2, 'unknown') THEN 'unknown' WHEN contains(t2, 'other') THEN 'other' ELSE t2 END AS name FROM ot2),
rt AS (SELECT fo.*, CASE WHEN starts_with(n, 'soft') OR contains(n, 'soft tissue') THEN 'soft tissue' ELSE n END AS name FROM (SELECT fo.*, trim(regexp_replace(lower(trim(unnest(string_split(g2, ',')))), '[-_]', ' ', 'g')) AS n FROM fo WHERE sentence_id = '217' AND contains(lower(g1), 'metastatic')) AS fo),
wh AS (SELECT *, TRY_CAST(g1 AS DOUBLE) AS w, CASE WHEN TRY_CAST(g2 AS DOUBLE) > 3 THEN TRY_CAST(g2 AS DOUBLE) / 100 ELSE TRY_CAST(g2 AS DOUBLE) END AS h FROM fo WHERE sentence_id = '61'),
mm AS (SELECT *, round(TRY_CAST(g1 AS DOUBLE) / nullif(TRY_CAST(g2 AS DOUBLE), 0), 2) AS r FROM fo WHERE sentence_id = '188'),
ha AS (SELECT note_id, sentence_id, 'Patient.heightWeight' AS core_variable, CAST(round(w / (h * h), 2) AS VARCHAR) AS value FROM wh WHERE w != 0 AND h > 0
UNION ALL SELECT DISTINCT note_id, sentence_id, v, c FROM tok JOIN syn USING (name)
UNION ALL SELECT note_id, sentence_id, CASE sentence_id WHEN '64' THEN 'Patient.noGeneticSyndrome' WHEN '76' THEN 'Diagnosis.radiotherapyInducedSarcoma' WHEN '91' THEN 'DiseaseExtent.localised' WHEN '92' THEN 'DiseaseExtent.locoRegional' ELSE 'ClinicalStage.regionalNodalMetastases' END, 'true' FROM fo WHERE sentence_id IN ('64', '76', '91', '92', '93')
UNION ALL SELECT note_id, sentence_id, CASE WHEN contains(lower(g1), 'transit') THEN 'DiseaseExtent.isTransitMetastasisWithClinicalConfirmation' ELSE 'DiseaseExtent.isMultifocalTumor' END, 'true' FROM fo WHERE sentence_id = '92' AND (contains(lower(g1), 'transit') OR contains(lower(g1), 'multifocal'))
UNION ALL SELECT DISTINCT note_id, sentence_id, v, c FROM ot3 JOIN org ON org.sid = ot3.sentence_id AND org.name = ot3.name
UNION ALL SELECT DISTINCT note_id, sentence_id, v, 'true' FROM rt JOIN sit USING (name)
UNION ALL SELECT note_id, sentence_id, 'DiseaseExtent.localised', '32942' FROM fo WHERE sentence_id = '242' AND contains(lower(g1), 'local')
UNION ALL SELECT note_id, sentence_id, 'PatientFollowUp.statusAtLastFollowUp', c FROM fo JOIN sta ON sid = sentence_id
UNION ALL SELECT note_id, sentence_id, 'Diagnosis.biopsyMitoticCount', g1 || '/' || g2 || 'HPF' FROM fo WHERE sentence_id = '187'
UNION ALL SELECT note_id, sentence_id, 'Diagnosis.biopsyMitoticCount', CASE WHEN r = floor(r) THEN CAST(CAST(r AS BIGINT) AS VARCHAR) ELSE CAST(r AS VARCHAR) END || '/10HPF' FROM mm WHERE r IS NOT NULL
UNION ALL SELECT note_id, sentence_id, v, CASE WHEN v = 'DrugsForTreatments.drug' THEN d ELSE 'true' END FROM (SELECT note_id, sentence_id, trim(unnest(string_split(g2, ','))) AS d FROM fo WHERE sentence_id = '211'), (VALUES ('DrugsForTreatments.drug'), ('DrugsForTreatments.isolatedLimbPerfusion')) x(v) WHERE d != '')"""


def handled(spark, sf_dir, *ids):
    f = found(spark, sf_dir)
    return extract.handled_rows(f.where(F.col("sentence_id").isin(list(ids))))


def _of(*ids):
    listed = ", ".join(f"'{i}'" for i in ids)
    return f"WITH {HANDLED} SELECT note_id, core_variable, value FROM ha WHERE sentence_id IN ({listed})"


def _plain(spark, sf_dir, *ids):
    return handled(spark, sf_dir, *ids).select("note_id", "core_variable", "value")


@query(_of("61"))
def h1_body_mass_index(spark, sf_dir):
    return _plain(spark, sf_dir, "61")


@query(_of("63"))
def h2_syndromes(spark, sf_dir):
    return _plain(spark, sf_dir, "63")


@query(_of("64", "76"))
def h3_flags(spark, sf_dir):
    return _plain(spark, sf_dir, "64", "76")


@query(_of("94"))
def h7_distant_metastases(spark, sf_dir):
    return _plain(spark, sf_dir, "94")


@query(_of("217", "261"))
def h8_radiotherapy_sites(spark, sf_dir):
    return _plain(spark, sf_dir, "217", "261")


@query(_of("187", "188"))
def h12_mitotic_counts(spark, sf_dir):
    return _plain(spark, sf_dir, "187", "188")


@query(f"WITH {HANDLED} SELECT sentence_id, core_variable, count(*) AS n FROM ha GROUP BY 1, 2")
def f1_handler_rows(spark, sf_dir):
    """All handlers of the registry in one pass, with one that a user adds for their own sentence."""
    return extract.handled_rows(found(spark, sf_dir)).groupBy("sentence_id", "core_variable").agg(F.count("*").alias("n"))


#: Rows of a run with the entity whose groups they join.
def grouped(spark, sf_dir, ids=None):
    """The rows of the run of sentences ids in order, with place, made and created of their record."""
    f = found(spark, sf_dir)
    f = f if ids is None else f.where(F.col("sentence_id").isin(list(ids)))
    rows = f.select("note_id", "patient_id", "day", "sentence_id", "g1", "g2", F.split_part(F.element_at(extract_entity(), F.col("sentence_id")), F.lit("."), F.lit(1)).alias("entity"), "seq")
    rows = rows.withColumns({"date": F.col("day"), "day": F.unix_date("day"), "fresh": F.col("sentence_id") == "242"})
    if ids is None or "242" in ids:
        rows = _with_recent_episode(spark, sf_dir, rows)
    return groups.assign(written(rows.where("entity IS NOT NULL").dropDuplicates(["seq"]), "run-rows"), written(stored(spark, sf_dir), "stored-records"))


#: The entity of a handler's group.
GROUPED = {"91": "DiseaseExtent.", "92": "DiseaseExtent.", "242": "DiseaseExtent.", "93": "ClinicalStage.", "94": "ClinicalStage.", "225": "PatientFollowUp.", "227": "PatientFollowUp.", "228": "PatientFollowUp.", "230": "PatientFollowUp.", "219": "RegionalDeepHyperthemia.", "211": "IsolatedLimbPerfusion.", "241": "EpisodeEvent."}


def extract_entity():
    return F.create_map(*[F.lit(x) for kv in GROUPED.items() for x in kv])


def _episodes(spark, sf_dir, entity="EpisodeEvent"):
    return stored(spark, sf_dir).where(F.col("entity") == entity).select("patient_id", "day", F.col("record_id").alias("episode"))


def _bucket():
    return F.floor(F.col("day") / 64)


def _with_recent_episode(spark, sf_dir, rows):
    """rows with episode: of the newest within 14 days before; recurrences (242) without one are left out."""
    out = links.asof(rows, _episodes(spark, sf_dir), "patient_id", "day", ["episode"], [F.col("episode")], _bucket())
    out = out.withColumn("episode", F.when(F.col("day") - F.col("found.day") <= groups.DAYS, F.col("found.episode"))).drop("found")
    return out.where("sentence_id != '242' OR episode IS NOT NULL")


_ENT = ", ".join(f"('{k}', '{v[:-1]}')" for k, v in GROUPED.items())
_STORED = " ".join(f"WHEN {k} THEN '{v}'" for k, v in STORED.items())


def _grouped_sql(ids):
    listed = ", ".join(f"'{i}'" for i in ids)
    recent = "arg_max(s.rid, struct_pack(d := s.d, i := s.rid))"
    return f"""RECURSIVE {HANDLED}, ent(sentence_id, entity) AS (VALUES {_ENT}),
st AS (SELECT o_custkey AS p, CASE l_partkey % 6 {_STORED} END AS e, date_diff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE)) AS d, l_orderkey * 8 + l_linenumber AS rid FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
g0 AS (SELECT fo.note_id, fo.seq, patient_id AS p, entity AS e, date_diff('day', DATE '1970-01-01', day) AS d, fo.sentence_id, g1, g2 FROM fo JOIN ent USING (sentence_id) WHERE fo.sentence_id IN ({listed})),
g1 AS (SELECT g0.*, (SELECT {recent} FROM st s WHERE s.p = g0.p AND s.e = 'EpisodeEvent' AND s.d <= g0.d AND s.d >= g0.d - 14) AS episode, (SELECT coalesce({recent} FILTER (s.d <= g0.d), {recent}) FROM st s WHERE s.p = g0.p AND s.e = 'EpisodeEvent') AS latest,
  (SELECT arg_max(s.rid, struct_pack(d := s.d, i := -s.rid)) FROM st s WHERE s.p = g0.p AND s.e = 'CancerEpisode' AND s.d <= g0.d) AS cancer FROM g0),
g2 AS (SELECT *, row_number() OVER (PARTITION BY p, e ORDER BY seq) AS rn FROM g1 WHERE sentence_id != '242' OR episode IS NOT NULL),
held AS (SELECT p, e, list({{'d': CAST(d AS BIGINT), 'i': CAST(rid AS BIGINT)}}) AS l FROM st GROUP BY 1, 2), big AS (SELECT CAST(max(rid) AS BIGINT) + 1 AS b FROM st),
fold AS (SELECT p, e, CAST(0 AS BIGINT) AS rn, coalesce(l, []) AS l, CAST(NULL AS BIGINT) AS seq, CAST(NULL AS BIGINT) AS id, FALSE AS created FROM (SELECT DISTINCT p, e FROM g2) LEFT JOIN held USING (p, e)
UNION ALL SELECT p, e, rn, list_append(l, {{'d': CAST(d AS BIGINT), 'i': CAST(coalesce(near, b + seq) AS BIGINT)}}), seq, CAST(coalesce(near, b + seq) AS BIGINT), near IS NULL FROM (
  SELECT fold.p, fold.e, g2.rn, fold.l, g2.seq, g2.d, b, CASE WHEN g2.sentence_id = '242' THEN NULL ELSE list_sort(list_transform(list_filter(fold.l, lambda x: abs(x.d - g2.d) <= 14), lambda x: {{'g': abs(x.d - g2.d), 'i': x.i}}))[1].i END AS near FROM fold JOIN g2 ON g2.p = fold.p AND g2.e = fold.e AND g2.rn = fold.rn + 1, big)),
gr AS (SELECT g2.*, id, created, b FROM g2 JOIN fold USING (p, e, seq), big),
nw AS (SELECT id, (SELECT max(rid) FROM st) + row_number() OVER (ORDER BY id) AS record_id FROM (SELECT DISTINCT id FROM gr WHERE id >= b)),
gi AS (SELECT gr.*, coalesce(nw.record_id, gr.id) AS record_id FROM gr LEFT JOIN nw USING (id))"""


def with_ids(rows, spark, sf_dir):
    """rows with record_id: the place, or a new number after all stored ones."""
    top = stored(spark, sf_dir).agg(F.max("record_id").alias("top"))
    new = groups.numbered(rows.where("made IS NOT NULL").select("made").distinct(), top)
    return rows.join(new, "made", "left").withColumn("record_id", F.coalesce("place", "record_id"))


def _placed(spark, sf_dir, ids):
    return with_ids(grouped(spark, sf_dir, ids), spark, sf_dir)


def stored_facts(spark, sf_dir):
    """The stored records as facts, and some that annotations repeat."""
    held = stored(spark, sf_dir)
    variable = F.concat("entity", F.when(F.col("entity") == "EpisodeEvent", ".dateOfEpisode").when(F.col("entity") == "CancerEpisode", ".cancerStartDate").otherwise(".note"))
    date = F.date_from_unix_date("day")
    value = F.when(F.col("entity").isin("EpisodeEvent", "CancerEpisode"), date.cast("string")).otherwise(F.col("record_id").cast("string"))
    again = table(spark, sf_dir, "orders").where("o_orderkey % 20 = 2 AND o_custkey % 2 = 0")
    again = again.select(F.col("o_custkey").alias("patient_id"), F.lit("Patient.noGeneticSyndrome").alias("core_variable"), F.lit("true").alias("value"), F.to_date("o_orderdate").alias("day"), (F.col("o_orderkey") * 8).alias("record_id"))
    return held.select("patient_id", variable.alias("core_variable"), value.alias("value"), date.alias("day"), "record_id").unionByName(again)


def facts(spark, sf_dir, *ids):
    """The facts of the run over all annotations; of the sentences ids, if any are given."""
    out = annotate.facts_of(annotations(spark, sf_dir), stored_facts(spark, sf_dir), SENTENCES)
    return out.where(F.col("sentence_id").isin(list(ids))) if ids else out


_RULES = ", ".join(f"('{k}', '{g.entity}', {repr(g.link[0]) if g.link else 'NULL'}, {repr(g.link[1]) if g.link else 'NULL'}, {g.recent})" for k, g in annotate.GROUPED.items())
_AFTER = ", ".join(f"('{k}', '{v}')" for k, vs in annotate.AFTER.items() for v in sorted(vs))
_NEAR = "list_sort(list_transform(list_filter(l, lambda x: x.e = en AND abs(x.d - d) <= 14), lambda x: {'g': abs(x.d - d), 'i': x.i}))[1].i"
_PRIOR = "list_sort(list_filter({0}, lambda x: x.d <= d))"
#: The run in SQL: static rows are events in order, which a recursion over each patient's places, with the records, rows, episodes so far as lists.
RUN = f"""RECURSIVE {HANDLED}{DEFAULTS.removeprefix(FOUND)}, rul(sentence_id, entity, link, how, recent) AS (VALUES {_RULES}), aft(sentence_id, variable) AS (VALUES {_AFTER}),
st AS (SELECT o_custkey AS p, CASE l_partkey % 6 {_STORED} END AS e, CAST(date_diff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE)) AS BIGINT) AS d, CAST(l_orderkey * 8 + l_linenumber AS BIGINT) AS i, CAST(CAST(l_shipdate AS DATE) AS VARCHAR) AS v FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
sf AS (SELECT p, e, d, i, e || CASE e WHEN 'EpisodeEvent' THEN '.dateOfEpisode' WHEN 'CancerEpisode' THEN '.cancerStartDate' ELSE '.note' END AS variable, CASE WHEN e IN ('EpisodeEvent', 'CancerEpisode') THEN v ELSE CAST(i AS VARCHAR) END AS value FROM st
  UNION ALL SELECT o_custkey, 'Patient', CAST(date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS BIGINT), CAST(o_orderkey * 8 AS BIGINT), 'Patient.noGeneticSyndrome', 'true' FROM orders WHERE o_orderkey % 20 = 2 AND o_custkey % 2 = 0),
e0 AS (SELECT fo.seq, ord, pos, 0 AS sub, 'a' AS kind, sentence_id, link AS variable, NULL AS value FROM fo JOIN rul USING (sentence_id)
  UNION ALL SELECT fo.seq, ord, pos, 1, CASE WHEN rul.entity IS NULL THEN 'p' ELSE 'h' END, sentence_id, ha.core_variable, ha.value FROM fo JOIN ha USING (note_id, sentence_id) LEFT JOIN rul USING (sentence_id) WHERE sentence_id NOT IN (SELECT sentence_id FROM aft)
  UNION ALL SELECT seq, ord, pos, 2, 'd', sentence_id, core_variable, CAST(value AS VARCHAR) FROM de
  UNION ALL SELECT fo.seq, fo.ord, fo.pos, 3, 'b', fo.sentence_id, ha.core_variable, ha.value FROM fo JOIN ha USING (note_id, sentence_id) JOIN de ON de.seq = fo.seq AND de.ord = fo.ord AND de.pos = fo.pos JOIN aft ON aft.sentence_id = fo.sentence_id AND aft.variable = de.core_variable
  UNION ALL SELECT fo.seq, fo.ord, fo.pos, 3, CASE fo.sentence_id WHEN '241' THEN 'c' ELSE 'r' END, fo.sentence_id, CASE fo.sentence_id WHEN '241' THEN 'EpisodeEvent.cancerEpisode' ELSE 'Radiotherapy.regionalDeepHyperthemia' END, NULL FROM fo JOIN de ON de.seq = fo.seq AND de.ord = fo.ord AND de.pos = fo.pos JOIN aft ON aft.sentence_id = fo.sentence_id AND aft.variable = de.core_variable WHERE fo.sentence_id = '241' OR fo.sentence_id = '219' AND contains(lower(g1), 'radiotherapy')),
big AS (SELECT max(i) + 1 AS b FROM sf),
e1 AS (SELECT e0.*, ann.note_id, ann.patient_id AS p, CAST(date_diff('day', DATE '1970-01-01', ann.day) AS BIGINT) AS d, coalesce(rul.entity, split_part(variable, '.', 1)) AS en, how, coalesce(recent, FALSE) AS recent, b + row_number() OVER (ORDER BY e0.seq, ord, pos, sub, variable, value) AS new,
  row_number() OVER (PARTITION BY ann.patient_id ORDER BY e0.seq, ord, pos, sub, variable, value) AS rn FROM e0 JOIN ann USING (seq) LEFT JOIN rul ON e0.kind = 'a' AND rul.sentence_id = e0.sentence_id, big),
hl AS (SELECT p, list({{'e': e, 'd': d, 'i': i}}) AS l, list({{'d': d, 'i': i}}) FILTER (variable = 'EpisodeEvent.dateOfEpisode') AS ep, list({{'d': d, 'i': i}}) FILTER (variable = 'CancerEpisode.cancerStartDate') AS ca FROM sf GROUP BY p),
hk AS (SELECT p, list({{'k': k, 'i': i}}) AS k FROM (SELECT p, variable || '|' || value || '|' || d AS k, min(i) AS i FROM sf GROUP BY 1, 2) GROUP BY p),
fold AS (SELECT p, CAST(0 AS BIGINT) AS rn, coalesce(l, []) AS l, coalesce(k, []) AS k, coalesce(ep, []) AS ep, coalesce(ca, []) AS ca, CAST(NULL AS BIGINT) AS cur, CAST(NULL AS VARCHAR) AS value, FALSE AS put FROM (SELECT DISTINCT p FROM e1) LEFT JOIN hl USING (p) LEFT JOIN hk USING (p)
UNION ALL SELECT p, rn, CASE WHEN put THEN list_append(l, {{'e': split_part(variable, '.', 1), 'd': d, 'i': id}}) ELSE l END, CASE WHEN put THEN list_append(k, {{'k': key, 'i': id}}) ELSE k END,
  CASE WHEN put AND variable = 'EpisodeEvent.dateOfEpisode' THEN list_append(ep, {{'d': own, 'i': id}}) ELSE ep END, CASE WHEN put AND variable = 'CancerEpisode.cancerStartDate' THEN list_append(ca, {{'d': own, 'i': id}}) ELSE ca END, id, v, put FROM (
  SELECT *, coalesce(id IS NOT NULL AND v IS NOT NULL AND variable IS NOT NULL AND NOT list_contains(list_transform(k, lambda x: x.k), key) AND (kind != 'a' OR recent OR near IS NULL) AND (kind != 'c' OR len(list_filter(k, lambda x: x.i = id AND starts_with(x.k, 'EpisodeEvent.cancerEpisode|'))) = 0), FALSE) AS put FROM (
  SELECT *, variable || '|' || v || '|' || d AS key, CAST(date_diff('day', DATE '1970-01-01', TRY_CAST(v AS DATE)) AS BIGINT) AS own FROM (
  SELECT *, CASE kind WHEN 'a' THEN CASE how WHEN 'patient' THEN CAST(p AS VARCHAR) ELSE CAST(epi AS VARCHAR) END WHEN 'r' THEN CAST(id AS VARCHAR) WHEN 'c' THEN CAST(can AS VARCHAR) ELSE value END AS v FROM (
  SELECT *, CASE WHEN kind = 'a' AND recent THEN CASE WHEN epi IS NOT NULL THEN new END WHEN kind IN ('h', 'b', 'c', 'r') THEN cur WHEN kind = 'd' THEN coalesce(was, near, new) ELSE coalesce(near, new) END AS id FROM (
  SELECT e1.* EXCLUDE (new), CAST(new AS BIGINT) AS new, l, k, ep, ca, cur, {_NEAR} AS near, list_filter(k, lambda x: x.k = variable || '|' || e1.value || '|' || d)[1].i AS was,
    CASE WHEN recent THEN CASE WHEN {_PRIOR.format('ep')}[-1].d >= d - 14 THEN {_PRIOR.format('ep')}[-1].i END ELSE coalesce({_PRIOR.format('ep')}[-1].i, list_sort(ep)[-1].i) END AS epi,
    list_min(list_transform(list_filter(ca, lambda x: x.d = {_PRIOR.format('ca')}[-1].d), lambda x: x.i)) AS can FROM fold JOIN e1 ON e1.p = fold.p AND e1.rn = fold.rn + 1)))))),
pu AS (SELECT e1.*, cur AS id, fold.value AS v FROM fold JOIN e1 USING (p, rn) WHERE put),
nw AS (SELECT id, (SELECT max(i) FROM sf) + row_number() OVER (ORDER BY id) AS rid FROM (SELECT DISTINCT id FROM pu, big WHERE id >= b)),
facts AS (SELECT note_id, p AS patient_id, sentence_id, coalesce(pu.variable, '') AS core_variable, CASE WHEN kind IN ('c', 'r') OR kind = 'a' AND how = 'episode' THEN CAST(coalesce(y.rid, TRY_CAST(v AS BIGINT)) AS VARCHAR) ELSE v END AS value, CAST(coalesce(x.rid, pu.id) AS BIGINT) AS record_id,
  CASE kind WHEN 'a' THEN 'link' WHEN 'd' THEN 'default' WHEN 'p' THEN 'handler' WHEN 'h' THEN 'handler' ELSE 'after' END AS step FROM pu LEFT JOIN nw x ON x.id = pu.id LEFT JOIN nw y ON pu.kind IN ('a', 'c', 'r') AND y.id = TRY_CAST(v AS BIGINT) AND coalesce(how, '') != 'patient')"""


def _facts_sql(where):
    return f"WITH {RUN} SELECT note_id, core_variable, value, record_id FROM facts WHERE {where}"


def _rows(facts):
    return facts.select("note_id", "core_variable", "value", "record_id")


@query(f"WITH {RUN} SELECT note_id, patient_id, sentence_id, core_variable, value, record_id, step FROM facts")
def t31_facts(spark, sf_dir):
    """The whole run: sentences found, rows of handlers, default rows and what follows them, each with its record."""
    return facts(spark, sf_dir).select("note_id", "patient_id", "sentence_id", "core_variable", "value", "record_id", "step")


@query(_facts_sql("sentence_id = '91' AND step != 'default'"))
def h4_localized(spark, sf_dir):
    """The group of 14 days or a new one; a new one gets the latest episode, if possible before."""
    return _rows(facts(spark, sf_dir, "91").where("step != 'default'"))


@query(_facts_sql("sentence_id = '92' AND step != 'default'"))
def h5_loco_regional(spark, sf_dir):
    return _rows(facts(spark, sf_dir, "92").where("step != 'default'"))


@query(_facts_sql("sentence_id = '93' AND step != 'default'"))
def h6_regional_nodes(spark, sf_dir):
    return _rows(facts(spark, sf_dir, "93").where("step != 'default'"))


@query(_facts_sql("sentence_id = '242' AND step != 'default'"))
def h9_recurrence_extent(spark, sf_dir):
    """Recurrences with an episode in the 14 days before, each in a new group with a reference to it."""
    return _rows(facts(spark, sf_dir, "242").where("step != 'default'"))


@query(_facts_sql("sentence_id IN ('225', '227', '230', '231')"))
def h10_follow_up(spark, sf_dir):
    return _rows(facts(spark, sf_dir, "225", "227", "230", "231"))


@query(_facts_sql("sentence_id IN ('226', '228', '229')"))
def h11_follow_up_after(spark, sf_dir):
    """The other statuses, in the same form as H10."""
    return _rows(facts(spark, sf_dir, "226", "228", "229"))


@query(_facts_sql("sentence_id = '211'"))
def h13_perfusion_drugs(spark, sf_dir):
    """Drugs in the record of the start date."""
    return _rows(facts(spark, sf_dir, "211"))


@query(_facts_sql("sentence_id = '241' AND step = 'after'"))
def h14_episode_link(spark, sf_dir):
    """A link to the latest earlier cancer episode, once for each record."""
    return _rows(facts(spark, sf_dir, "241").where("step = 'after'"))


@query(_facts_sql("sentence_id = '219' AND step = 'after'"))
def h15_hyperthermia_link(spark, sf_dir):
    return _rows(facts(spark, sf_dir, "219").where("step = 'after'"))


J4_SQL = _grouped_sql(("91", "92", "93", "94", "225", "227", "228", "230"))


@query(f"WITH {J4_SQL} SELECT note_id, e AS entity, CAST(record_id AS BIGINT) AS record_id, created FROM gi")
def j4_w7_groups(spark, sf_dir):
    """Each row joins the nearest group of its patient and entity within 14 days, stored or made earlier in the run, or makes one."""
    return _placed(spark, sf_dir, ("91", "92", "93", "94", "225", "227", "228", "230")).select("note_id", "entity", "record_id", "created")


@query(f"WITH {DEFAULTS}, fi AS (SELECT patient_id, core_variable, value, min(seq * 1000 + ord * 10 + pos) AS at FROM de GROUP BY patient_id, core_variable, value, CAST(day AS VARCHAR)) SELECT core_variable, count(*) AS n, count(DISTINCT patient_id) AS patients FROM fi GROUP BY 1")
def t31_j8_new_facts(spark, sf_dir):
    """The facts of the run, each patient, variable, value and date once."""
    rows = extract.default_rows(found(spark, sf_dir), SENTENCES).withColumn("at", F.struct("seq", "order", "pos"))
    first = links.new_rows(rows.select("patient_id", "core_variable", "value", "day", "at"), rows.limit(0).select("patient_id", "core_variable", "value", "day"), ["patient_id", "core_variable", "value", "day"], "at")
    return first.groupBy("core_variable").agg(F.count("*").alias("n"), F.count_distinct("patient_id").alias("patients"))


@query(f"WITH {DEFAULTS} SELECT sentence_id, count(*) AS n FROM de GROUP BY 1")
def f4_dictionary_files(spark, sf_dir):
    """The same sentences out of a dictionary and a pattern file, both JSON by sentence id."""
    entries = {s.id: {"sentence_content": s.content, "parameters": [{"associated_variable": p.variable, "parameter_type": p.kind, "possible_values": [{k: v} for k, v in p.choices], "value": p.value} for p in s.parameters]} for s in SENTENCES}
    where = [new_path(spark, "dictionary"), new_path(spark, "patterns")]
    for path, content in zip(where, (entries, {s.id: s.pattern for s in SENTENCES if s.pattern})):
        spark.createDataFrame([(json.dumps(content),)], "value string").write.text(path)
    return extract.default_rows(extract.matches(annotations(spark, sf_dir), extract.read_sentences(spark, *where)), extract.read_sentences(spark, *where)).groupBy("sentence_id").agg(F.count("*").alias("n"))
