"""Record ids of rows that join the nearest group of their patient and entity, stored or made earlier in the run."""

from __future__ import annotations

from bisect import bisect_left, insort

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.sources.shared import written

DAYS = 14


class Days:
    """Days with the least id of each, in order; the nearest is found by bisection."""

    def __init__(self):
        self.days: list[int] = []
        self.least: dict[int, tuple] = {}

    def add(self, day: int, one: tuple) -> None:
        if day in self.least:
            self.least[day] = min(self.least[day], one)
        else:
            insort(self.days, day)
            self.least[day] = one

    def add_all(self, rows) -> None:
        """Days and ids, in order only once."""
        for day, one in rows:
            if day not in self.least or one < self.least[day]:
                self.least[day] = one
        self.days = sorted(self.least)

    def nearest(self, day: int, within: int) -> tuple | None:
        """The id of the nearest day; the least of two equally near ones."""
        at = bisect_left(self.days, day)
        near = [(abs(d - day), self.least[d]) for d in self.days[max(0, at - 1) : at + 1]]
        best = min(near, default=None)
        return best[1] if best and best[0] <= within else None


def assign(rows: DataFrame, stored: DataFrame, days: int = DAYS) -> DataFrame:
    """rows with place: the group's stored record_id, or null and made: the seq of the row that made the group; created.

    rows: patient_id, entity, day (days since an epoch), seq (the order of the run, unique), fresh (always a new group)
    and others, which are kept. stored: patient_id, entity, day, record_id. A row joins the group of the nearest row at most
    `days` apart, stored or earlier in the run; of equally near ones the least id, where stored ids come before new ones
    and new ones are in the order they were made. A row without a day makes a group of its own.

    rows are read several times and the result is written, so rows that are costly to make should be written before. Rows more than
    `days` apart in a line never meet, so a patient's line is cut where days are missing: what one task folds is
    a run of near dates, not a patient, in time that grows as n log n.
    """
    key = ["patient_id", "entity"]
    line = Window.partitionBy(*key).orderBy("day")
    both = rows.where("day IS NOT NULL").select(*key, "day").unionByName(stored.where("day IS NOT NULL").select(*key, "day")).distinct()
    cut = (F.col("day") - F.lag("day").over(line) > days).cast("int")
    runs = both.withColumn("run", F.sum(F.coalesce(cut, F.lit(1))).over(line.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    new = rows.where("day IS NOT NULL").select(*key, "day", "seq", "fresh").join(runs, [*key, "day"]).withColumn("record_id", F.lit(None).cast("long"))
    # Of stored rows of one day only the least id can be taken; runs without a new row are not folded.
    old = stored.groupBy(*key, "day").agg(F.min("record_id").alias("record_id")).join(runs, [*key, "day"])
    old = old.join(new.select(*key, "run").distinct(), [*key, "run"], "left_semi").withColumns({"seq": F.lit(None).cast("long"), "fresh": F.lit(False)})

    def fold(batches):
        at, days = None, Days()
        for b in batches:
            out = []
            for *where, day, seq, fresh, record in zip(*(b.column(c).to_pylist() for c in names)):
                if where != at:
                    at, days = where, Days()
                if seq is None:
                    days.add(day, (0, record))
                    continue
                near = None if fresh else days.nearest(day, within)
                one = near or (1, seq)
                days.add(day, one)
                out.append((seq, None if one[0] else one[1], one[1] if one[0] else None, near is None))
            columns = list(zip(*out)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.bool_()))], ["seq", "place", "made", "created"])

    # Runs are dealt out by patient, entity and run, and passed once in their order, stored rows first.
    names, within = [*key, "run", "day", "seq", "fresh", "record_id"], days
    ordered = new.unionByName(old).select(*names).repartition(*key, "run").sortWithinPartitions(*key, "run", F.col("seq").asc_nulls_first())
    folded = ordered.mapInArrow(fold, "seq long, place long, made long, created boolean")
    out = rows.join(folded, "seq", "left")
    alone = F.col("created").isNull()
    return written(out.withColumns({"made": F.when(alone, F.col("seq")).otherwise(F.col("made")), "created": F.coalesce("created", F.lit(True))}), "groups")


def numbered(made: DataFrame, start: DataFrame) -> DataFrame:
    """made (column made, distinct) with record_id: the ids after start's (one row, top), in the order of made.

    Places are counted in ranges of made, so no task sees them all: a count for each range first.
    """
    ranges = made.repartitionByRange("made").withColumn("_part", F.spark_partition_id()).groupBy("_part").agg(F.sort_array(F.collect_list("made")).alias("_all"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    ranges = ranges.withColumn("_before", F.coalesce(F.sum(F.size("_all")).over(before), F.lit(0)))
    out = ranges.select("_before", F.posexplode("_all").alias("_at", "made")).join(F.broadcast(start))
    return out.select("made", (F.coalesce("top", F.lit(0)) + F.col("_before") + F.col("_at") + 1).alias("record_id"))
