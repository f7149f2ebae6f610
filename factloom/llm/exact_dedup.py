"""Exact duplicates by distributed MSD radix partitioning over the bytes of the normalised text.

A group starts as all documents; every round splits each live group by its next run of bytes (the
radix digit, 16 bytes at first and 16 times longer each round). Groups of one row leave at once,
groups whose texts end are sets of equal texts. Rows are compared by their bytes and known by their ids, never by a
digest; the SHA-256 is only a column of the result.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, maybe_broadcast, trimmed, written

FIRST_DIGIT = 16
GROWTH = 16
#: What a row is known by: its doc_id, and a number where other rows share it.
KEY = ["doc_id", "nth"]


def _numbered(docs: DataFrame) -> DataFrame:
    """doc_id, nth, text: nth is 0 but for rows without a doc_id of their own, which are written with a number each."""
    rows = docs.select("doc_id", "text")
    shared = written(rows.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 OR doc_id IS NULL").select(F.col("doc_id").alias("_id"), F.lit(True).alias("_shared")), "shared-ids")
    if shared.isEmpty():
        return rows.select("doc_id", F.lit(0).cast("long").alias("nth"), "text")
    marked = rows.join(maybe_broadcast(shared), F.col("doc_id").eqNullSafe(F.col("_id")), "left")
    own = marked.where("_shared IS NULL").select("doc_id", F.lit(0).cast("long").alias("nth"), "text")
    return own.unionByName(written(marked.where("_shared").select("doc_id", (F.monotonically_increasing_id() + 1).alias("nth"), "text"), "rows-of-shared-ids"))


def _normalised(rows: DataFrame, with_text: bool) -> DataFrame:
    """(doc_id, nth, n_chars, text_sha256, ended, bytes: the first digit or the rest) of each row."""

    def run(batches):
        for b in batches:
            texts = b.column("text").fill_null("").to_pylist()
            plain = [t.encode().translate(None, SPACE) for t in texts]
            yield pa.RecordBatch.from_pydict({
                "doc_id": b.column("doc_id"),
                "nth": b.column("nth"),
                "n_chars": pa.array([len(t) for t in texts], pa.int64()),
                "text_sha256": pa.array([None if with_text else hashlib.sha256(p).hexdigest() for p in plain], pa.string()),
                "ended": pa.array([len(p) <= FIRST_DIGIT for p in plain], pa.bool_()),
                "bytes": pa.array([p[FIRST_DIGIT:] if with_text else p[:FIRST_DIGIT] for p in plain], pa.binary()),
            })

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(trimmed(run), f"doc_id {kind}, nth long, n_chars long, text_sha256 string, ended boolean, bytes binary")


def _same(columns: list[str], prefix: str) -> Column:
    return reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"{prefix}{c}")) for c in columns])


def _split(live: DataFrame, by: list[str], what: str) -> DataFrame:
    """Live rows that still share a group, with the group's new name: its least member.

    The names are summed up before the shuffle and written; the join back is one of two tables, so one large group can be
    split over tasks (or the names are broadcast).
    """
    names = live.groupBy(*by).agg(F.count("*").alias("_n"), F.min(F.struct(*KEY)).alias("_name"))
    names = written(names.where("_n > 1").select(*[F.col(c).alias(f"_{c}") for c in by], "_name"), what)
    return live.join(names, _same(by, "_")).drop(*[f"_{c}" for c in by])


def exact_groups(docs: DataFrame) -> DataFrame:
    """Sets of texts that are equal but for white space (0x20, 0x09 to 0x0D).

    docs: doc_id (a number), text and any other columns, which are ignored. Returns one row per input row:
    doc_id, keep_id, group_size, kept, text_sha256. The row with the most code points, then the
    smallest doc_id stays (a row without doc_id only where all are). Null and empty texts are equal to each other. Fully
    repeated rows each get a row of which one at most is kept. Long texts take a round for each 16-fold of 16 bytes.
    An empty table gives an empty one.
    """
    rows = _numbered(docs)
    base = written(_normalised(rows, False), "radix-base")

    first = _split(base, ["bytes", "ended"], "radix-names-0")
    ended = [first.where("ended").select(*KEY, F.col("_name").alias("group"))]
    live = first.where("NOT ended").select(*[F.col(c).alias(f"k_{c}") for c in KEY], F.col("_name").alias("group"))
    live = maybe_broadcast(written(live, "radix-live"))
    live = written(_normalised(rows, True).where("NOT ended").select(*KEY, "bytes").join(live, _same(KEY, "k_")).select(*KEY, "group", "bytes"), "radix-0")
    width, turn = FIRST_DIGIT * GROWTH, 0
    while not live.isEmpty():
        turn += 1
        digits = live.select(
            *KEY, "group", F.expr(f"substring(bytes, 1, {width})").alias("digit"), F.expr(f"length(bytes) <= {width}").alias("ended"), F.expr(f"substring(bytes, {width + 1}, 2147483647)").alias("bytes")
        )
        groups = written(_split(digits, ["group", "digit", "ended"], f"radix-names-{turn}").select(*KEY, F.col("_name").alias("group"), "ended", "bytes"), f"radix-{turn}")
        ended.append(groups.where("ended").select(*KEY, "group"))
        live = groups.where("NOT ended").drop("ended")
        width *= GROWTH

    members = written(reduce(DataFrame.unionByName, ended).select(*[F.col(c).alias(f"k_{c}") for c in KEY], "group"), "radix-members")
    named = written(base.drop("bytes", "ended").join(maybe_broadcast(members), _same(KEY, "k_"), "left"), "radix-named")
    best = F.max(F.struct("n_chars", (-F.col("doc_id")).alias("minus"), (-F.col("nth")).alias("nth"))).alias("best")
    groups = written(named.where("group IS NOT NULL").groupBy("group").agg(best, F.count("*").alias("size")).withColumnRenamed("group", "g"), "radix-groups")
    out = named.join(maybe_broadcast(groups), F.col("group").eqNullSafe(F.col("g")), "left")
    keep = F.when(F.col("g").isNull(), F.col("doc_id")).otherwise(-F.col("best.minus"))
    kept = F.col("g").isNull() | (F.col("doc_id").eqNullSafe(-F.col("best.minus")) & (F.col("nth") == -F.col("best.nth")))
    return out.select("doc_id", keep.alias("keep_id"), F.coalesce("size", F.lit(1)).cast("long").alias("group_size"), kept.alias("kept"), "text_sha256")


ORACLE = r"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS t FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = first_value(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM d WINDOW w AS (PARTITION BY t ORDER BY n DESC, doc_id)
"""
