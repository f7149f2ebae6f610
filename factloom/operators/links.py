"""As-of, nearest and anti joins on the records of a patient."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _packed(rows: DataFrame) -> Column:
    """A row as one struct, so that none of its names meets one of ours; a column `found` gives way to the one found."""
    return F.struct(*[F.col(f"`{c}`") for c in rows.columns if c != "found"]).alias("_row")


def asof(left: DataFrame, right: DataFrame, key: str, at: str, payload: list[str], prefer: list[Column], bucket: Column | None = None) -> DataFrame:
    """left with `found` (in place of a column of that name): the struct (at, payload) of the latest right row of the same key at or before its own time.

    Ties go to the greatest of prefer (columns of right). Rows without key or time find nothing. One shuffle on
    (key, bucket) and no pair is made: right rows run along with left ones and a running maximum carries them.
    bucket is a function of `at` that rises with it (a month by default); a key with very many rows is so spread
    over tasks, and what earlier buckets carry into a bucket comes from one small row each.
    """
    bucket = F.date_trunc("month", F.col(at)) if bucket is None else bucket
    best = F.struct(F.col(at), *[c.alias(f"_prefer{i}") for i, c in enumerate(prefer)], *payload)
    r = right.where(F.col(key).isNotNull() & F.col(at).isNotNull()).select(F.col(key), F.col(at), best.alias("_best"))
    r = r.withColumn("_bucket", bucket)
    last = r.groupBy(key, "_bucket").agg(F.max("_best").alias("_last"))
    l = left.select(_packed(left), F.col(key), F.col(at), bucket.alias("_bucket"))
    # What each bucket of the left rows gets from the buckets before it.
    line = Window.partitionBy(key).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    spine = l.select(key, "_bucket").where(F.col("_bucket").isNotNull()).distinct().join(last, [key, "_bucket"], "full")
    carried = spine.select(key, "_bucket", F.max("_last").over(line).alias("_carried"))
    rows = l.select("_row", key, at, "_bucket", F.lit(None).cast(r.schema["_best"].dataType).alias("_best"), F.lit(True).alias("_left"))
    rows = rows.unionByName(r.select(F.lit(None).cast(rows.schema["_row"].dataType).alias("_row"), key, at, "_bucket", "_best", F.lit(False).alias("_left")))
    inside = Window.partitionBy(key, "_bucket").orderBy(at).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("_near", F.max("_best").over(inside)).where("_left")
    rows = rows.join(carried, [key, "_bucket"], "left")
    found = F.when(F.col(at).isNotNull(), F.greatest("_near", "_carried"))
    return rows.select("_row.*", F.struct(found[at].alias(at), *[found[p].alias(p) for p in payload]).alias("found"))


def nearest(left: DataFrame, right: DataFrame, key: str, at: str, days: int, payload: str) -> DataFrame:
    """left with `found`: payload of the right row of the key nearest in days, at most `days` apart; the least payload in a tie.

    The nearest is the latest one before or the first one after, so it is two as-of searches by day, one of them in reversed time: no
    pairs, no row ids, and a key with very many rows is spread over tasks by month.
    """
    day = F.unix_date(F.to_date(at))
    r = right.where(F.col(at).isNotNull()).groupBy(key, day.alias("_day")).agg(F.min(payload).alias("_p"))
    month = F.floor(F.col("_day") / 32)
    out = left.select(_packed(left).alias("_whole"), F.col(key), day.alias("_day"))
    out = asof(out, r, key, "_day", ["_p"], [], month).withColumnRenamed("found", "_before")
    back = r.withColumn("_day", -F.col("_day"))
    out = asof(out.withColumn("_day", -F.col("_day")), back, key, "_day", ["_p"], [], month).withColumnRenamed("found", "_after")
    gap_b, gap_a = -F.col("_day") - F.col("_before._day"), -F.col("_after._day") + F.col("_day")
    b = F.when(gap_b <= days, F.struct(gap_b.alias("g"), F.col("_before._p").alias("p")))
    a = F.when(gap_a <= days, F.struct(gap_a.alias("g"), F.col("_after._p").alias("p")))
    return out.select("_whole.*", F.least(b, a)["p"].alias("found"))


def new_rows(rows: DataFrame, stored: DataFrame, key: list[str], order: str) -> DataFrame:
    """rows that are not in stored by key, each key once, first in order."""
    first = rows.groupBy(*key).agg(F.min_by(F.struct(*rows.columns), order).alias("_r")).select("_r.*")
    return first.join(stored.select(*key).distinct(), key, "left_anti")
