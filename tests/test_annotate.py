"""Edge rows of the annotation run: nulls, repeated annotations, no rows, and one patient with most of them."""

import time

import pyarrow as pa
from pyspark.sql import functions as F

from factloom.operators import annotate
from factloom.plans.clinical import SENTENCES

A = "patient_id long, seq long, note_id long, prompt_type string, day date, text string, key int"
S = "patient_id long, core_variable string, value string, day date, record_id long"


def run(spark, annotations, stored=()):
    rows = spark.createDataFrame(annotations, "patient_id long, seq long, note_id long, prompt_type string, day string, text string, key int").withColumn("day", F.col("day").cast("date"))
    held = spark.createDataFrame(list(stored), "patient_id long, core_variable string, value string, day string, record_id long").withColumn("day", F.col("day").cast("date"))
    out = annotate.facts_of(rows, held, SENTENCES).orderBy("seq", "nth").collect()
    return [(r.seq, r.step, r.core_variable, r.value, r.record_id) for r in out]


def test_edge_rows(spark):
    local = "Stage at diagnosis: localized"
    got = run(spark, [
        (1, 1, 1, None, "2020-01-01", local, 0), (1, 2, 2, None, "2020-01-10", local, 0), (1, 3, 3, None, "2020-01-10", local, 0), (1, 4, 4, None, None, local, 0), (1, 5, 5, None, None, local, 0),
        (None, 6, 6, None, "2020-01-01", local, 0), (2, 7, 7, None, "2020-01-01", None, 0), (2, 8, 8, None, "2020-01-01", "", 0), (2, 9, 9, None, "2020-01-01", "ERROR: x", 0),
    ], [(1, "EpisodeEvent.dateOfEpisode", "2019-12-30", "2019-12-30", 50), (1, "DiseaseExtent.x", "y", "2020-01-24", None), (None, "DiseaseExtent.x", "y", "2020-01-01", 70)])
    # The first makes a record with a link, the second joins it, the third is there already, as is the fifth; without a day no record is near.
    assert got == [(1, "link", "DiseaseExtent.episodeEvent", "50", 71), (1, "handler", "DiseaseExtent.localised", "true", 71), (2, "handler", "DiseaseExtent.localised", "true", 71), (4, "link", "DiseaseExtent.episodeEvent", "50", 72), (4, "handler", "DiseaseExtent.localised", "true", 72)]


def test_rows_of_a_run_lead_to_later_ones(spark):
    """An episode that an annotation brings is the link of a later recurrence, by its number; a record of the run is joined."""
    got = run(spark, [(1, 1, 1, None, "2020-01-01", "Recurrence type: local", 0), (1, 2, 2, None, "2020-02-01", "Episode on 2020-02-28", 0), (1, 3, 3, None, "2020-03-05", "Recurrence type: local", 0), (1, 4, 4, None, "2020-03-05", "Stage at diagnosis: loco-regional, none", 0)])
    kept = [r for r in got if r[1] != "default" or r[0] == 2]
    assert kept == [(2, "default", "EpisodeEvent.dateOfEpisode", "2020-02-28", 2), (3, "link", "DiseaseExtent.episodeEvent", "2", 3), (3, "handler", "DiseaseExtent.localised", "32942", 3), (4, "handler", "DiseaseExtent.locoRegional", "true", 3)]


def test_no_annotations(spark):
    assert run(spark, []) == []


def test_one_patient_with_all_rows(spark):
    """Time of a patient's rows is about linear in their number."""
    took = []
    for n in (20_000, 80_000):
        rows = spark.range(n).select(F.lit(1).cast("long").alias("patient_id"), F.col("id").alias("seq"), F.col("id").alias("note_id"), F.lit("x").alias("prompt_type"), F.expr("date_add(DATE '1900-01-01', cast(id * 7919 % 40000 as int))").alias("day"), F.lit("Stage at diagnosis: localized").alias("text"))
        began = time.time()
        assert annotate.facts_of(rows, spark.createDataFrame([], S), SENTENCES).count() == min(n, 40_000)
        took.append(time.time() - began)
    assert took[1] < 8 * took[0] + 5


def test_stored_facts_are_looked_into_when_asked_for(monkeypatch):
    """Over batches that cut patients: of the stored facts only those of an entity that a row asks for are put in order, once."""
    asked = []
    add_all = annotate.Days.add_all
    monkeypatch.setattr(annotate.Days, "add_all", lambda days, rows: asked.append(rows := list(rows)) or add_all(days, rows))
    stored = [{"patient_id": p, "stored": True, "day": 10 * i, "core_variable": f"{e}.note", "value": str(i), "record_id": i} for p in (1, 2, 3) for i in range(40) for e in ("DiseaseExtent", "Other")]
    new = [{"patient_id": p, "stored": False, "seq": 10 * p + k, "sentence_id": "92", "day": 100 * k + 4, "handled": [{"core_variable": "DiseaseExtent.locoRegional", "value": "true", "types": "boolean"}]} for p in (1, 3) for k in range(3)]
    rows = sorted(stored + new, key=lambda r: (r["patient_id"], not r["stored"]))
    row = pa.struct([("core_variable", pa.string()), ("value", pa.string()), ("types", pa.string())])
    kinds = {"patient_id": pa.int64(), "stored": pa.bool_(), "seq": pa.int64(), "sentence_id": pa.string(), "day": pa.int32(), "core_variable": pa.string(), "value": pa.string(), "at": pa.int32(), "record_id": pa.int64(), "handled": pa.list_(row), "default": pa.struct([("core_variable", pa.string()), ("kind", pa.string()), ("value", pa.string())]), "g1": pa.string()}
    whole = pa.RecordBatch.from_pylist(rows, schema=pa.schema(list(kinds.items())))
    for size in (7, 1000):
        asked.clear()
        out = pa.Table.from_batches(annotate._fold(whole.slice(i, size) for i in range(0, len(rows), size))).to_pylist()
        assert [(r["patient_id"], r["seq"], r["place"]) for r in out] == [(p, 10 * p + k, 10 * k) for p in (1, 3) for k in range(3)]
        assert [len(a) for a in asked] == [40, 40]
