"""Annotations to facts: sentences with their parameters, and row handlers by sentence."""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from factloom.operators.facts import PLACEHOLDERS
from factloom.operators.patterns import Finder, folded, needed

#: Sentences that only one prompt may give, and the phrases that tell them.
STATUS_PROMPT = "patient-status-int"
STATUS_PHRASES = {
    "225": ["dead of disease", "dod"],
    "226": ["dead of other cause", "doc"],
    "227": ["dead of unknown cause", "duc"],
    "228": ["alive, no evidence of disease", "ned"],
    "229": ["alive with disease", "awd", "localised"],
    "230": ["alive with disease", "awd", "nodes"],
    "231": ["alive with disease", "awd", "metastatic"],
}
#: The type that a fact gets from its parameter's.
TYPES = {"ENUM": "CodeableConcept", "NUMBER": "float", "DATE": "date in the ISO format ISO8601  https://en.wikipedia.org/wiki/ISO_8601 ", "TEXT": "string", "DEFAULT": "CodeableConcept"}


#: Annotations whose sentences a task keeps at most.
REMEMBERED = 20_000


@dataclass
class Parameter:
    variable: str
    kind: str
    choices: list[tuple[str, str]] = field(default_factory=list)  # of an ENUM: part of the text, concept
    value: str | None = None  # of a DEFAULT


@dataclass
class Sentence:
    id: str
    content: str
    pattern: str | None = None
    parameters: list[Parameter] = field(default_factory=list)

    @property
    def groups(self) -> int:
        return (self.pattern or "").replace("(?:", "").count("(")


def cleaned(text: Column) -> Column:
    """Without the "Annotation:" label and the double quotes around it."""
    return F.regexp_replace(F.trim(F.replace(text, F.lit("Annotation:"), F.lit(""))), '^"+|"+$', "")


def invalid(kind: Column, value: Column) -> Column:
    """Nothing, a placeholder, or a DATE without a date."""
    v = F.lower(F.trim(F.coalesce(value, F.lit(""))))
    return v.isin(PLACEHOLDERS) | v.rlike(r"^\[[^\]]+\]$") | ((kind == "DATE") & ~v.rlike(r"\d{1,2}/\d{1,2}/\d{4}|\d{4}-\d{2}-\d{2}"))


class Matcher:
    """Finds sentences in annotations: the ones that an automaton over their needed letters leaves are tried."""

    def __init__(self, sentences: list[Sentence]):
        self.sentences = sentences
        self.patterns = [re.compile(s.pattern, re.IGNORECASE) if s.pattern else None for s in sentences]
        self.contents = [s.content.lower().strip() for s in sentences]
        self.words = [set(c.split()) for c in self.contents]
        self.finder = Finder([needed(s.pattern) if s.pattern else folded(s.content).strip() for s in sentences])
        self.statuses = [i for i, s in enumerate(sentences) if s.id in STATUS_PHRASES]
        self.by_word: dict[str, list[int]] = {}
        for i, s in enumerate(sentences):
            if not s.pattern:
                for w in self.words[i]:
                    self.by_word.setdefault(w, []).append(i)

    def _plain(self, i: int, low: str, words: set[str]) -> bool:
        """Whether a sentence without parameters is in the text (or the text in it, with half of its words)."""
        content, phrases = self.contents[i], STATUS_PHRASES.get(self.sentences[i].id)
        if content not in low and low not in content:
            return False
        if phrases:
            return any(p in low for p in phrases) and any(w in low for w in ("status", "follow-up", "followup"))
        return content in low or 2 * len(self.words[i] & words) >= len(self.words[i])

    def find(self, text: str, prompt: str | None) -> list[tuple[int, int, str, str]]:
        """(order, place, first group, second group) of each match; without groups, the match is the first."""
        low = text.lower().strip()
        words = set(low.split())
        # A text that is inside a sentence counts only if it has half of its words.
        tried = set(self.finder.candidates(text))
        for w in words:
            tried.update(self.by_word.get(w, ()))
        if prompt == STATUS_PROMPT:
            tried.update(self.statuses)
        out = []
        for i in sorted(tried):
            if self.sentences[i].id in STATUS_PHRASES and prompt != STATUS_PROMPT:
                continue
            if self.patterns[i] is None:
                if self._plain(i, low, words):
                    out.append((i, 0, "", ""))
                continue
            for pos, m in enumerate(self.patterns[i].finditer(text)):
                groups = [g or "" for g in m.groups()]
                out.append((i, pos, groups[0] if groups else m.group(), groups[1] if len(groups) > 1 else ""))
        return out


def matches(annotations: DataFrame, sentences: list[Sentence]) -> DataFrame:
    """A row for each sentence found in each annotation, again for each place: order, sentence_id, pos, g1, g2 beside the columns.

    annotations: text, prompt_type, seq and others. Those that begin with "ERROR:" are dropped, null texts find nothing. Equal annotations
    of a task are searched once, as far as it keeps them (REMEMBERED); how many sentences there are hardly matters, as those that cannot
    match are not tried.
    """
    rows = annotations.withColumn("text", cleaned(F.col("text"))).where(~F.col("text").startswith("ERROR:"))
    schema = StructType(rows.schema.fields + StructType.fromDDL("order int, sentence_id string, pos int, g1 string, g2 string").fields)

    def run(batches):
        matcher = Matcher(sentences)
        seen: dict[tuple[str, str], list] = {}
        for b in batches:
            own, found = [], []
            for n, pair in enumerate(zip(b.column("text").to_pylist(), b.column("prompt_type").to_pylist())):
                if pair not in seen:
                    if len(seen) >= REMEMBERED:
                        seen.clear()
                    seen[pair] = matcher.find(*pair)
                own += [n] * len(seen[pair])
                found += seen[pair]
            order, pos, g1, g2 = ([m[k] for m in found] for k in range(4))
            ids = [sentences[i].id for i in order]
            columns = b.take(pa.array(own, pa.int64())).columns
            yield pa.RecordBatch.from_arrays([*columns, pa.array(order, pa.int32()), pa.array(ids, pa.string()), pa.array(pos, pa.int32()), pa.array(g1, pa.string()), pa.array(g2, pa.string())], names=schema.names)

    return rows.mapInArrow(run, schema)


def parameter_values(sentences: list[Sentence]) -> Column:
    """Of a match (sentence_id, pos, g1, day), a struct: core_variable, kind and value of the parameter at its place, the first beyond the last.

    ENUM: the concept of the first choice that the first group contains; NUMBER, DATE and TEXT: the first group; DEFAULT: the
    constant. An age (Patient.birthYear of sentence 74) becomes the year of birth by the note's date. Null without a value that is valid.
    The parameters are one literal of the plan, however many there are.
    """
    known = {s.id: [{"variable": p.variable, "kind": p.kind, "value": p.value, "choices": [{"part": part.lower(), "concept": c} for part, c in p.choices]} for p in s.parameters] for s in sentences if s.parameters}
    kind = "map<string, array<struct<variable:string,kind:string,value:string,choices:array<struct<part:string,concept:string>>>>>"
    own = F.try_element_at(F.from_json(F.lit(json.dumps(known)), kind), F.col("sentence_id"))

    def bound(value: Column, use: Callable[[Column], Column]) -> Column:
        """use of a value that is worked out once."""
        return F.get(F.transform(F.array(value), use), F.lit(0))

    def valued(p: Column) -> Column:
        age = (F.col("sentence_id") == "74") & (p["variable"] == "Patient.birthYear")
        enum = F.get(F.filter(p["choices"], lambda c: F.contains(F.lower("g1"), c["part"])), F.lit(0))["concept"]
        value = F.when(p["kind"] == "ENUM", enum).when(p["kind"] == "DEFAULT", p["value"])
        value = value.when(age, (F.year("day") - F.expr("try_cast(g1 AS DOUBLE)").cast("int")).cast("string")).otherwise(F.col("g1"))
        return F.when(p.isNotNull(), F.struct(p["variable"].alias("core_variable"), p["kind"].alias("kind"), value.alias("value")))

    of_place = bound(own, lambda o: F.get(o, F.when(F.col("pos") < F.size(o), F.col("pos")).otherwise(0)))
    return bound(bound(of_place, valued), lambda x: F.when(x.isNotNull() & ~invalid(x["kind"], x["value"]), x))


def default_rows(found: DataFrame, sentences: list[Sentence]) -> DataFrame:
    """found with core_variable, kind, value of each match's parameter (see parameter_values); rows without a valid value are dropped."""
    return found.withColumn("_p", parameter_values(sentences)).where("_p IS NOT NULL").select("*", "_p.*").drop("_p")


#: What a handler gives: rows (core_variable, value, types) of a match, from its groups and date.
ROW = "array<struct<core_variable:string,value:string,types:string>>"
HANDLERS: dict[str, Callable[[], Column]] = {}


def handler(*ids: str):
    """Registers a column function as the handler of sentences; a user's own handlers are added the same way."""

    def add(f):
        HANDLERS.update(dict.fromkeys(ids, f))
        return f

    return add


def row(variable: str | Column, value: str | Column, types: str) -> Column:
    lit = lambda x: F.lit(x) if isinstance(x, str) else x.cast("string")
    return F.struct(lit(variable).alias("core_variable"), lit(value).alias("value"), F.lit(types).alias("types"))


def _none() -> Column:
    return F.array().cast(ROW)


def _number(text: Column) -> Column:
    """The first number in a text."""
    return F.regexp_extract(text, r"\d+\.?\d*", 0).try_cast("double")


def _list(text: Column) -> Column:
    """The trimmed parts between commas, semicolons, slashes and "and"."""
    return F.filter(F.transform(F.split(text, r",|;|/| and "), lambda t: F.trim(t)), lambda t: t != "")


def _coded(parts: Column, table: dict[str, tuple[str, str]], types: str) -> Column:
    """A row for each part that the table knows, in its order, each once."""
    entries = F.create_map(*[x for k, (v, c) in table.items() for x in (F.lit(k), row(v, c, types))])
    return F.filter(F.transform(F.array_distinct(parts), lambda t: F.try_element_at(entries, t)), lambda r: r.isNotNull())


@handler("61")
def body_mass_index() -> Column:
    """Weight and height; heights over 3 are centimetres."""
    w, h = _number(F.col("g1")), _number(F.col("g2"))
    metres = F.when(h > 3, h / 100).otherwise(h)
    return F.when((w != 0) & (metres > 0), F.array(row("Patient.heightWeight", F.round(w / (metres * metres), 2), "float"))).otherwise(_none())


#: Variables and concepts of syndromes.
SYNDROMES = {
    "olliers disease": ("Patient.olliersDisease", "4145177"),
    "maffucci syndrome": ("Patient.maffuciSyndrome", "4187683"),
    "li fraumeni syndrome": ("Patient.liFraumeniSyndrome", "4323645"),
    "mccune albright syndrome": ("Patient.mccuneAlBrightSyndrome", "37117262"),
    "multiple osteochondromas": ("Patient.multipleOsteochondromas", "37396802"),
    "neurofibromatosis type 1": ("Patient.neurofibromatosisType1", "377252"),
    "rothmund thomson syndrome": ("Patient.rothmundThomsonSyndrome", "4286355"),
    "werner syndrome": ("Patient.wernerSyndrome", "4197821"),
    "retinoblastoma": ("Patient.retinoblastoma", "4158977"),
    "paget disease": ("Patient.pagetDisease", "75910"),
}


@handler("63")
def syndromes() -> Column:
    names = F.transform(_list(F.col("g1")), lambda t: F.trim(F.regexp_replace(F.lower(t), "[^a-z0-9]+", " ")))
    return _coded(names, SYNDROMES, "concept")


@handler("64")
def no_syndrome() -> Column:
    return F.array(row("Patient.noGeneticSyndrome", "true", "boolean"))


@handler("76")
def radiotherapy_induced() -> Column:
    return F.array(row("Diagnosis.radiotherapyInducedSarcoma", "true", "boolean"))


@handler("91")
def localized() -> Column:
    return F.array(row("DiseaseExtent.localised", "true", "boolean"))


@handler("92")
def loco_regional() -> Column:
    """The flag, and one more for transit metastases, else for multifocal tumours."""
    more = F.when(F.lower("g1").contains("transit"), F.array(row("DiseaseExtent.isTransitMetastasisWithClinicalConfirmation", "true", "boolean")))
    more = more.when(F.lower("g1").contains("multifocal"), F.array(row("DiseaseExtent.isMultifocalTumor", "true", "boolean"))).otherwise(_none())
    return F.concat(F.array(row("DiseaseExtent.locoRegional", "true", "boolean")), more)


@handler("93")
def regional_nodes() -> Column:
    return F.array(row("ClinicalStage.regionalNodalMetastases", "true", "boolean"))


def _organ(text: Column) -> Column:
    """An organ's name out of a part of a list."""
    t = F.regexp_replace(F.trim(F.regexp_replace(F.lower(text), r"^[. ]+|[. ]+$", "")), r"^(in|to|at|on|the)\s+", "")
    plural = F.regexp_extract(t, "^(lung|bone|liver|brain)s$", 1)
    return F.when(t.contains("soft tissue"), "soft tissue").when(plural != "", plural).when(t.contains("other") & ~t.contains("unknown"), "other").when(t.contains("unknown"), "unknown").otherwise(t)


#: Variables of organs.
STAGE_ORGANS = {k: (f"ClinicalStage.{v}", "true") for k, v in {"lung": "lung", "liver": "liver", "brain": "brain", "bone": "metastasisatbone", "soft tissue": "softTissue", "other": "otherViscera", "unknown": "unknown"}.items()}
EXTENT_ORGANS = {
    "lung": ("DiseaseExtent.lung", "36770283"),
    "liver": ("DiseaseExtent.liver", "36770544"),
    "brain": ("DiseaseExtent.brain", "36768862"),
    "bone": ("DiseaseExtent.metastasisatbone", "36769301"),
    "soft tissue": ("DiseaseExtent.softTissue", "35225724"),
    "other": ("DiseaseExtent.otherViscera", "4077953"),
    "unknown": ("DiseaseExtent.otherViscera", "4129922"),
}
RADIOTHERAPY_SITES = {k: (f"Radiotherapy.metastaticTreatmentSite{v}", "true") for k, v in {"lung": "Lung", "mediastinum": "Mediastinum", "bone": "Bone", "soft tissue": "SoftTissue", "liver": "Liver"}.items()}


@handler("94")
def distant_metastases() -> Column:
    return _coded(F.transform(_list(F.col("g1")), _organ), STAGE_ORGANS, "boolean")


@handler("217", "261")
def radiotherapy_sites() -> Column:
    """Of metastatic sites only."""
    names = F.transform(F.split("g2", ","), lambda t: F.trim(F.regexp_replace(F.lower(F.trim(t)), "[-_]", " ")))
    names = F.transform(names, lambda t: F.when(t.startswith("soft") | t.contains("soft tissue"), "soft tissue").otherwise(t))
    return F.when(F.lower("g1").contains("metastatic"), _coded(names, RADIOTHERAPY_SITES, "boolean")).otherwise(_none())


@handler("242")
def recurrence_extent() -> Column:
    """Rows of a local or metastatic recurrence; they stand only with an episode of the 14 days before."""
    kind, text = F.lower(F.trim("g1")), F.lower(F.trim("g2"))
    local = F.when(kind.contains("local"), F.array(row("DiseaseExtent.localised", "32942", "concept"))).otherwise(_none())
    parts = F.filter(_list(F.replace(text, F.lit("[select site if metastatic]"), F.lit(""))), lambda t: ~t.contains("select site"))
    names = F.transform(parts, lambda t: _organ(F.trim(F.regexp_replace(F.regexp_replace(t, r"^(in|to|at|on|the)\s+", ""), "metastases?", ""))))
    names = F.when((F.size(F.filter(names, lambda t: t != "")) == 0) & (text != ""), F.array(F.lit("other"))).otherwise(names)
    return F.concat(local, F.when(kind.contains("metast"), _coded(names, EXTENT_ORGANS, "concept")).otherwise(_none()))


#: The concepts of a patient's status.
STATUS_CONCEPTS = {"225": "2000100072", "226": "2000100073", "227": "2000100074", "228": "2000100071", "229": "2000100075", "230": "2000100075", "231": "2000100075"}


@handler(*STATUS_CONCEPTS)
def status() -> Column:
    concept = F.try_element_at(F.create_map(*[F.lit(x) for kv in STATUS_CONCEPTS.items() for x in kv]), F.col("sentence_id"))
    return F.array(row("PatientFollowUp.statusAtLastFollowUp", concept, "concept"))


@handler("187")
def mitoses_of_fields() -> Column:
    m, n = (F.regexp_extract(g, r"\d+\.?\d*", 0) for g in ("g1", "g2"))
    return F.when((m != "") & (n != ""), F.array(row("Diagnosis.biopsyMitoticCount", F.concat(m, F.lit("/"), n, F.lit("HPF")), "string"))).otherwise(_none())


@handler("188")
def mitoses_of_area() -> Column:
    """Per square millimetre, which is per ten fields: whole numbers plain, others with two digits at most."""
    rate = F.try_divide(_number(F.col("g1")), _number(F.col("g2")))
    text = F.regexp_replace(F.regexp_replace(F.format_string("%.2f", F.round(rate, 2)), "0+$", ""), r"\.$", "")
    return F.when(rate.isNotNull(), F.array(row("Diagnosis.biopsyMitoticCount", F.concat(text, F.lit("/10HPF")), "string"))).otherwise(_none())


@handler("211")
def perfusion_drugs() -> Column:
    """Two rows for each drug, in the record of the start date."""
    drugs = F.filter(F.transform(F.split("g2", ","), lambda t: F.trim(t)), lambda t: t != "")
    return F.flatten(F.transform(drugs, lambda d: F.array(row("DrugsForTreatments.isolatedLimbPerfusion", "true", "boolean"), row("DrugsForTreatments.drug", d, "string"))))


def handled_array(handlers: dict[str, Callable[[], Column]] | None = None) -> Column:
    """The rows (ROW) that a match's handler gives; none without a handler. Invalid values are left out."""
    handlers = HANDLERS if handlers is None else handlers
    rows = _none()
    for f in dict.fromkeys(handlers.values()):
        rows = F.when(F.col("sentence_id").isin([i for i, g in handlers.items() if g is f]), f()).otherwise(rows)
    return F.filter(rows, lambda r: ~invalid(F.lit("TEXT"), r["value"]))


def handled_rows(found: DataFrame, handlers: dict[str, Callable[[], Column]] | None = None) -> DataFrame:
    """found with the rows of its sentences' handlers: core_variable, value, types, nth."""
    return found.select("*", F.posexplode(handled_array(handlers)).alias("nth", "_r")).select("*", "_r.*").drop("_r")


def read_sentences(spark: SparkSession, dictionary: str, patterns: str) -> list[Sentence]:
    """Sentences out of two JSON files by sentence id: content and parameters, and patterns.

    A configuration of a few hundred entries, so it is read to the driver, where it becomes literals of the plan. Sentences with
    parameters but without a pattern find nothing and are left out.
    """
    whole = lambda path: json.loads(spark.read.text(path, wholetext=True).head().value)
    entries, regexes = whole(dictionary), whole(patterns)
    out = []
    for i, e in entries.items():
        parameters = [Parameter(p["associated_variable"], p.get("parameter_type") or "DEFAULT", [(k, v) for one in p.get("possible_values") or [] for k, v in one.items()], p.get("value")) for p in e.get("parameters") or []]
        if not parameters or (regexes.get(i) or "").strip():
            out.append(Sentence(i, e.get("sentence_content", ""), regexes.get(i) if parameters else None, parameters))
    return out
