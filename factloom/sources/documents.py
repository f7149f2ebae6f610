"""JSON sources: annotated patients, prompts, dictionaries, and objects in the scripts of pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions.text import clean_text, squeezed

NOTE = "struct<note_id:string,text:string,date:string,p_id:string,report_type:string,annotations:array<string>,annotations_with_spans:array<struct<template_text:string,supporting_text_spans:array<struct<text:string>>>>>"
PATIENTS = f"patient_id string, notes array<{NOTE}>"
OBJECT = r"\{[^{}]*(?:\{[^{}]*\}[^{}]*)*\}"


def read_patients(spark: SparkSession, path: str) -> DataFrame:
    """The notes of annotated patients (one JSON object a line), all patients: patient_id and the note's fields."""
    return spark.read.schema(PATIENTS).json(path).select("patient_id", F.explode("notes").alias("n")).select("patient_id", "n.*")


def note_rows(notes: DataFrame) -> DataFrame:
    """text, date, p_id, note_id, report_type, each cleaned."""
    return notes.select(*[clean_text(F.coalesce(c, F.lit(""))).alias(c) for c in ("text", "date", "p_id", "note_id", "report_type")])


def found_by(patterns: list[str]):
    """Whether a text has any of the patterns, as a function of one column."""

    def hit(text):
        out = F.lit(False)
        for p in patterns:
            out = out | text.rlike(p)
        return out

    return hit


def prompt_rows(notes: DataFrame, patterns: dict[str, list[str]]) -> DataFrame:
    """A row for each note and prompt: the annotations that one of the prompt's patterns finds, joined by " | ", and all of them.

    patterns (configuration) are literals of one projection, so there is no join and no pair that is thrown away.
    """
    each = []
    for prompt, some in patterns.items():
        mine = F.filter(F.coalesce("annotations", F.array().cast("array<string>")), found_by(some))
        each.append(F.struct(F.lit(prompt).alias("prompt_type"), F.array_join(F.transform(mine, squeezed), " | ").alias("matching_annotation")))
    text = clean_text(F.coalesce("text", F.lit("")))
    preview = F.when(F.length(text) > 200, F.concat(F.left(text, F.lit(200)), F.lit("..."))).otherwise(text)
    every = F.array_join(F.transform(F.coalesce("annotations", F.array().cast("array<string>")), squeezed), " | ")
    rows = notes.select("note_id", "report_type", every.alias("all_annotations"), preview.alias("note_text_preview"), F.explode(F.array(*each)).alias("p")).select("*", "p.*").drop("p")
    return rows.withColumns({c: clean_text(F.col(c)) for c in ("all_annotations", "matching_annotation")})


def examples(notes: DataFrame, patterns: list[str]) -> DataFrame:
    """note_original_text, annotation: the first annotation of each note that a pattern finds, with its supporting spans joined
    by " ... " (the whole note where it has none); equal ones once."""
    hit = F.filter("annotations", found_by(patterns))
    rows = notes.select("text", "annotations_with_spans", F.get(hit, F.lit(0)).alias("annotation")).where("annotation IS NOT NULL")
    of = F.get(F.filter("annotations_with_spans", lambda s: s["template_text"] == F.col("annotation")), F.lit(0))
    spans = F.filter(F.transform(of["supporting_text_spans"], lambda s: F.trim(F.coalesce(s["text"], F.lit("")))), lambda t: t != "")
    text = F.when(F.size(spans) > 0, F.array_join(spans, " ... ")).otherwise(F.col("text"))
    return rows.select(text.alias("note_original_text"), "annotation").distinct()


def scripts(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit(r"(?is)<script[^>]*>(.*?)</script>"), F.lit(1))


def script_objects(html: Column) -> Column:
    """The texts of all JSON objects in the scripts of a page, in order."""
    found = F.flatten(F.transform(scripts(html), lambda s: F.regexp_extract_all(s, F.lit(OBJECT), F.lit(0))))
    return F.filter(found, lambda x: F.try_parse_json(x).isNotNull())


def script_variable(html: Column, name: str) -> Column:
    """The text of the first JSON object that a script assigns to a name: var, let, const, window. or plain, in this order."""
    found = []
    for before in (r"\bvar\s+", r"\blet\s+", r"\bconst\s+", r"window\.", r"\b"):
        one = F.regexp_extract(html, rf"(?s){before}{name}\s*=\s*(\{{.*?\}})\s*;", 1)
        found.append(F.when(F.try_parse_json(one).isNotNull() & (one != ""), one))
    return F.coalesce(*found)


def adapted(template: Column) -> Column:
    """A prompt's template with the places that the pipeline fills."""
    for old, new in (("{{note_original_text}}", "{note}"), ("{few_shot_examples}", "{fewshots}"), ("{static_samples}\n", ""), ("{static_samples}", ""), ("{{annotation}}", "")):
        template = F.replace(template, F.lit(old), F.lit(new))
    return F.trim(template)


def read_prompts(spark: SparkSession, path: str) -> DataFrame:
    """center, prompt_type, template, entity_mapping (JSON) out of {center: {prompt: template or {template, entity_mapping}}}."""
    whole = spark.read.text(path, wholetext=True)
    centers = whole.select(F.explode(F.from_json("value", "map<string,map<string,string>>")).alias("center", "prompts"))
    rows = centers.select("center", F.explode("prompts").alias("prompt_type", "p"))
    template = F.coalesce(F.get_json_object("p", "$.template"), F.col("p"))
    return rows.select("center", "prompt_type", adapted(template).alias("template"), F.get_json_object("p", "$.entity_mapping").alias("entity_mapping"))


def normal(text: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(text, r"\s+", " ")))


def read_codes(spark: SparkSession, path: str) -> DataFrame:
    """code_id, category, label (both normalised) out of {code: "Category - Label"}; of equal pairs the last code stays.

    A dictionary in one file; the place of an entry is its place there.
    """
    entries = spark.read.text(path, wholetext=True).select(F.posexplode(F.map_entries(F.from_json("value", "map<string,string>"))).alias("pos", "e"))
    parts = F.split("e.value", " - ", 2)
    rows = entries.where(F.contains("e.value", F.lit(" - "))).select("pos", F.col("e.key").alias("code_id"), normal(parts[0]).alias("category"), normal(parts[1]).alias("label"))
    return rows.groupBy("category", "label").agg(F.max_by("code_id", "pos").alias("code_id"))
