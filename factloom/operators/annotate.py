"""Annotations to facts in one job: sentences found, row handlers, default rows and record ids, each row seeing those before it.

What a row holds is known from its annotation alone and is made by column functions. Where it goes depends on the rows before it: it joins
the nearest record of its patient and entity, may be there already, or needs an episode that an earlier row has brought. So a patient's
rows are folded in their order, in one pass over sorted Arrow batches that holds what it needs of one patient only and looks up days by bisection.
New records are numbered over the whole run afterwards, in the order they were made.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections import defaultdict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from factloom.operators import extract, groups
from factloom.operators.groups import Days
from factloom.sources.shared import written

DAYS = groups.DAYS
SOURCE = "NLP_LLM"


@dataclass(frozen=True)
class Grouped:
    """How a handler's rows are placed: in one record of an entity, the nearest within 14 days or a new one, which then gets a link.

    link: None, (variable, "patient") or (variable, "episode"). recent: always a new record, and only with an episode of the 14 days
    before, which is its link.
    """

    entity: str
    link: tuple[str, str] | None = None
    recent: bool = False


#: The entity and link of handlers that place their rows together, and what handlers that follow a default row refer to.
GROUPED = {
    "91": Grouped("DiseaseExtent", ("DiseaseExtent.episodeEvent", "episode")),
    "92": Grouped("DiseaseExtent"),
    "93": Grouped("ClinicalStage", ("ClinicalStage.diagnosisReference", "patient")),
    "94": Grouped("ClinicalStage", ("ClinicalStage.diagnosisReference", "patient")),
    "242": Grouped("DiseaseExtent", ("DiseaseExtent.episodeEvent", "episode"), True),
} | {str(i): Grouped("PatientFollowUp", ("PatientFollowUp.patient", "patient")) for i in range(225, 232)}
#: Sentences whose handler runs after their default row, with the default variables that call it.
AFTER = {"211": {"IsolatedLimbPerfusion.startDate"}, "241": {"EpisodeEvent.diseaseStatus", "EpisodeEvent.dateOfEpisode"}, "219": {"RegionalDeepHyperthemia.startDate"}}
EPISODE, CANCER, LINK = "EpisodeEvent.dateOfEpisode", "CancerEpisode.cancerStartDate", "EpisodeEvent.cancerEpisode"


class Patient:
    """What the rows of a patient so far leave for those that follow.

    Ids are (0, stored id, 0) or (1, seq of the annotation, number of the row in it), so that stored ones come first. Stored facts are held
    by variable and looked into only when a row asks for their entity or variable.
    """

    def __init__(self, patient):
        self.patient = patient
        self.held: dict[str, list[tuple]] = defaultdict(list)  # variable: (value, day, day that the value states, record)
        self.entities: dict[str, Days] = {}
        self.known: dict[str, dict[tuple, tuple]] = {}  # variable: (value, day): id
        self.dated: dict[str, list[tuple[int, tuple]]] = {}  # EPISODE, CANCER: (day, id) in order
        self.linked: set[tuple] | None = None

    def _known(self, variable: str) -> dict[tuple, tuple]:
        if variable not in self.known:
            known = self.known[variable] = {}
            for value, day, _, record in self.held.get(variable, ()):
                known.setdefault((value, day), (0, record, 0))
        return self.known[variable]

    def _days(self, entity: str) -> Days:
        if entity not in self.entities:
            days = self.entities[entity] = Days()
            for variable, rows in self.held.items():
                if variable.split(".", 1)[0] == entity:
                    days.add_all((day, (0, record, 0)) for _, day, _, record in rows if day is not None)
        return self.entities[entity]

    def _dated(self, variable: str) -> list[tuple[int, tuple]]:
        if variable not in self.dated:
            of = ((day if at is None else at, (0, record, 0)) for _, day, at, record in self.held.get(variable, ()))
            self.dated[variable] = sorted(x for x in of if x[0] is not None)
        return self.dated[variable]

    def has_link(self, one: tuple) -> bool:
        if self.linked is None:
            self.linked = {(0, record, 0) for *_, record in self.held.get(LINK, ())}
        return one in self.linked

    def add(self, variable: str, value, day: int | None, at: int | None, one: tuple) -> bool:
        """Takes a row in, unless it is there already. at: the day that its value states, or its own."""
        known = self._known(variable)
        if (value, day) in known:
            return False
        known[value, day] = one
        if day is not None:
            self._days(variable.split(".", 1)[0]).add(day, one)
        if at is not None and variable in (EPISODE, CANCER):
            insort(self._dated(variable), (at, one))
        if variable == LINK and not self.has_link(one):
            self.linked.add(one)
        return True

    def there(self, variable: str, value, day: int | None) -> tuple | None:
        return self._known(variable).get((value, day))

    def nearest(self, entity: str, day: int | None) -> tuple | None:
        return self._days(entity).nearest(day, DAYS) if day is not None else None

    def episode(self, day: int | None, recent: bool) -> tuple | None:
        """The latest episode up to a day (of equally late ones the greatest id); else, unless it must be recent, the latest of all."""
        episodes = self._dated(EPISODE)
        if not episodes or (recent and day is None):
            return None
        at = len(episodes) if day is None else bisect_right(episodes, (day, (2,)))
        if recent:
            return episodes[at - 1][1] if at and day - episodes[at - 1][0] <= DAYS else None
        return episodes[at - 1 if at else -1][1]

    def cancer(self, day: int | None) -> tuple | None:
        """The latest cancer episode up to a day, of equally late ones the least id."""
        cancers = self._dated(CANCER)
        at = bisect_right(cancers, (day, (2,))) if day is not None else 0
        return cancers[bisect_left(cancers, (cancers[at - 1][0],))][1] if at else None


def _values(column: pa.Array) -> list:
    """to_pylist, by numpy where it can."""
    return column.to_numpy().tolist() if pa.types.is_integer(column.type) and not column.null_count else column.to_pylist()


def _parts(b: pa.RecordBatch):
    """A batch's stored rows and its others, and its pieces of one patient and kind in order: patient, whether stored, first and end there."""
    stored = b.column("stored").to_numpy(zero_copy_only=False)
    codes = b.column("patient_id").dictionary_encode().indices.to_numpy()
    first = np.concatenate([[0], np.flatnonzero((np.diff(codes) != 0) | (stored[1:] != stored[:-1])) + 1])
    before = np.cumsum(stored) - stored  # stored rows before each row
    starts = np.where(stored[first], before[first], first - before[first])
    ends = starts + np.diff(np.append(first, len(stored)))
    pieces = zip(b.column("patient_id").take(pa.array(first)).to_pylist(), stored[first].tolist(), starts.tolist(), ends.tolist())
    return b.filter(pa.array(stored)), b.filter(pa.array(~stored)), pieces


def _fold(batches):
    """Rows of patients, each patient's in order, stored facts (stored is true) first: the facts that are new, with ids."""
    state = last = None
    nth = 0

    def put(step, variable, value, kind, one, at=None):
        nonlocal nth
        nth += 1
        if state.add(variable, value, day, day if at is None else at, one):
            out.append((n, nth, variable, None if isinstance(value, tuple) else value, kind, step, one, value if isinstance(value, tuple) else None))

    def new():
        return 1, seq, nth + 1

    for b in batches:
        if not b.num_rows:
            continue
        out: list[tuple] = []
        held, rows, pieces = _parts(b)
        facts = list(zip(*(_values(held.column(c)) for c in ("core_variable", "value", "day", "at", "record_id"))))
        lists = rows.column("handled")
        of_handlers = list(zip(*(c.to_pylist() for c in lists.flatten().flatten())))
        upto = np.cumsum(lists.value_lengths().fill_null(0).to_numpy()).tolist()
        columns = [_values(rows.column(c)) for c in ("seq", "sentence_id", "day", "at", "g1")] + [c.to_pylist() for c in rows.column("default").flatten()]
        events = list(zip(*columns))
        for patient, stored, i, j in pieces:
            if state is None or state.patient != patient:
                state, last = Patient(patient), None
            if stored:
                for variable, *fact in facts[i:j]:
                    state.held[variable].append(fact)
                continue
            for n in range(i, j):
                seq, sentence, day, at, g1, variable, kind, value = events[n]
                handled = of_handlers[upto[n - 1] if n else 0 : upto[n]]
                if seq != last:
                    last, nth = seq, 0
                rule = GROUPED.get(sentence)
                if sentence not in AFTER and (rule or handled):
                    episode = state.episode(day, rule.recent) if rule and rule.link and rule.link[1] == "episode" else None
                    if rule is None:
                        for v, x, types in handled:
                            put("handler", v, x, types, state.nearest(v.split(".", 1)[0], day) or new())
                    elif not rule.recent or episode:
                        near = None if rule.recent else state.nearest(rule.entity, day)
                        one = near or new()
                        link = episode if rule.link and rule.link[1] == "episode" else str(patient)
                        if rule.link and near is None and link is not None:
                            put("link", rule.link[0], link, "reference", one)
                        for v, x, types in handled:
                            put("handler", v, x, types, one)
                if variable is None:
                    continue
                one = state.there(variable, value, day) or state.nearest(variable.split(".", 1)[0], day) or new()
                put("default", variable, value, extract.TYPES.get(kind, "NOT SPECIFIED"), one, at)
                if variable not in AFTER.get(sentence, ()):
                    continue
                if sentence == "241":
                    link = state.cancer(day) if not state.has_link(one) else None
                    if link:
                        put("after", LINK, link, "reference", one)
                elif sentence == "219":
                    if "radiotherapy" in (g1 or "").lower():
                        put("after", "Radiotherapy.regionalDeepHyperthemia", one, "reference", one)
                else:
                    for v, x, types in handled:
                        put("after", v, x, types, one)
        if out:
            row, nth_, variables, values, kinds, steps, ones, refers = zip(*out)
            ids = [[None if x is None or (x[0] != c) else x[1] for x in xs] for xs in (ones, refers) for c in (0, 1)]
            numbers = [[None if x is None or x[0] != 1 else x[2] for x in xs] for xs in (ones, refers)]
            about = rows.select(["patient_id", "seq", "sentence_id"]).take(pa.array(row))
            yield pa.RecordBatch.from_arrays(
                [*about.columns, *(pa.array(c, t) for c, t in zip((nth_, variables, values, kinds, steps), (pa.int32(), *[pa.string()] * 4)))]
                + [pa.array(ids[k], pa.int64()) if k % 2 == 0 else pa.StructArray.from_arrays([pa.array(ids[k], pa.int64()), pa.array(numbers[k // 2], pa.int32())], ["seq", "nth"], mask=pa.array([i is None for i in ids[k]])) for k in range(4)],
                names=["patient_id", "seq", "sentence_id", "nth", "core_variable", "value", "types", "step", "place", "made", "refers", "refers_made"],
            )


def facts_of(annotations: DataFrame, stored: DataFrame, sentences: list[extract.Sentence], handlers=None) -> DataFrame:
    """The new facts of a run over annotations.

    annotations: patient_id, seq (the order of the run, unique), note_id, prompt_type, day, text. stored: patient_id, core_variable, value, day,
    record_id of facts that are there. Returns patient_id, original_source, core_variable, date_ref, value, record_id, note_id, prompt_type,
    types, sentence_id, seq, nth and step: link, handler, default or after, the kind of row.

    Annotations go by seq, their matches by sentence and place; of a match the handler's rows come first, then the default row, then what
    follows it (perfusion drugs, links of episodes and of hyperthermia, in the default row's record). A row that is there already, by
    patient, variable, value and day, stored or earlier in the run, is left out. Rows without a day join no record. A patient's
    rows are one task's work, in time that grows with their number (and its logarithm), as each depends on those before it; patients are dealt out
    over tasks. Stored facts without an id, and rows without a patient, are left out.
    """
    annotations = annotations.where("patient_id IS NOT NULL")
    found = extract.matches(annotations, sentences)
    rows = found.withColumns({"handled": extract.handled_array(handlers), "default": extract.parameter_values(sentences)})
    rows = rows.select("patient_id", F.lit(False).alias("stored"), "seq", "sentence_id", F.unix_date("day").alias("day"), "order", "pos", "handled", "default", "g1")
    value_day = F.unix_date(F.to_date(F.expr("try_to_timestamp(value)")))
    held = stored.where("patient_id IS NOT NULL AND record_id IS NOT NULL AND core_variable IS NOT NULL").withColumn("at", F.when(F.col("core_variable").isin(EPISODE, CANCER), value_day))
    held = held.select("patient_id", F.lit(True).alias("stored"), F.unix_date("day").alias("day"), "core_variable", F.col("value").cast("string").alias("value"), "at", "record_id")
    of_default = F.when(F.col("default.core_variable").isin(EPISODE, CANCER), F.unix_date(F.to_date(F.expr("try_to_timestamp(default.value)"))))
    both = held.unionByName(rows.withColumn("at", of_default), allowMissingColumns=True)
    sorted_rows = both.repartition("patient_id").sortWithinPartitions("patient_id", F.desc("stored"), "record_id", "seq", "order", "pos")
    names = ["patient_id", "stored", "seq", "sentence_id", "day", "core_variable", "value", "at", "record_id", "handled", "default", "g1"]
    made = "struct<seq:bigint,nth:int>"
    kind = rows.schema["patient_id"].dataType.simpleString()
    schema = f"patient_id {kind}, seq long, sentence_id string, nth int, core_variable string, value string, types string, step string, place long, made {made}, refers long, refers_made {made}"
    folded = written(sorted_rows.select(*names).mapInArrow(_fold, StructType.fromDDL(schema)), "annotation-facts")
    top = stored.agg(F.max("record_id").alias("top"))
    numbers = written(groups.numbered(folded.where("made IS NOT NULL").select("made").distinct(), top), "annotation-records")
    out = folded.join(numbers.withColumnsRenamed({"record_id": "new_id"}), "made", "left").withColumn("record_id", F.coalesce("place", "new_id")).drop("made", "new_id")
    refer = numbers.select(F.col("made").alias("refers_made"), F.col("record_id").alias("new_id"))
    out = out.join(refer, "refers_made", "left").withColumn("value", F.coalesce("value", F.coalesce("refers", "new_id").cast("string")))
    about = annotations.select(F.col("seq").alias("a_seq"), F.col("day").alias("date_ref"), "note_id", "prompt_type")
    out = out.join(about, F.col("seq") == F.col("a_seq"))
    return out.select("patient_id", F.lit(SOURCE).alias("original_source"), "core_variable", "date_ref", "value", "record_id", "note_id", "prompt_type", "types", "sentence_id", "seq", "nth", "step")
