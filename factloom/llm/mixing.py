"""Mixing sources to target weights by Efraimidis-Spirakis sampling, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import maybe_broadcast, written

WORD = r"[^\x20\x09-\x0D]+"
#: Steps of the sampling order in which a source's sizes are summed before single documents are.
BINS = 4096


def text_quality(text: Column, size: Column) -> Column:
    """A document's weight: 1 where its words have 3 to 12 characters on average, else 0.5."""
    mean = F.length(text) / F.greatest(size, F.lit(1)).cast("double")
    return F.when((size > 0) & mean.between(3, 12), 1.0).otherwise(0.5)


def source_targets(sources: DataFrame, weights: tuple[float, ...], share: float, cap: float) -> DataFrame:
    """source_key, source_size and target of each source; sources: source_key, source, source_size.

    Sources by code point, null last, have the weights in turn. They share share times all sizes by weight;
    what a target has over cap times its source's size goes to the others by weight, until none is over.
    In the order of cap size / weight, the sources that are capped come first: the first whose fair share of
    what those before leave is within its own cap ends them.
    """
    turn = F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")) - 1
    w = sources.withColumn("weight", F.get(F.lit([float(x) for x in weights]), F.pmod(turn, F.lit(len(weights))).cast("int"))).withColumn("most", F.col("source_size") * F.lit(float(cap)))
    line = Window.orderBy(F.col("most") / F.col("weight"), "source_key")
    before = F.coalesce(F.sum("most").over(line.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("weight").over(line.rowsBetween(0, Window.unboundedFollowing))
    everything = Window.partitionBy()
    level = w.withColumn("level", (F.sum("source_size").over(everything) * F.lit(float(share)) - before) / rest).withColumn("nth", F.row_number().over(line))
    fits = F.col("level") <= F.col("most") / F.col("weight")
    level = level.withColumn("level", F.min(F.when(fits, F.struct("nth", "level"))).over(everything)["level"])
    return level.select("source_key", "source_size", F.when(F.col("level").isNull(), F.col("most")).otherwise(F.least("most", F.col("level") * F.col("weight"))).alias("target"))


def mix_sources(docs: DataFrame, weights=(3, 1, 2), share: float = 1.5, cap: float = 2.0, quality: Column | None = None, seed: int = 7) -> DataFrame:
    """What a mix takes of each document.

    docs: doc_id, text, source and other columns, which are ignored. Returns doc_id, size (words),
    source_size, target (of the source), taken (words, repeats counted) and copies (whole documents: the
    last one, taken in part, counts if its greater part is). Every document is taken in all complete epochs;
    of the fraction that remains, documents are taken by the least -ln(u) / quality, u a hash of doc_id,
    until the target is met, the last one in part. Null texts have no words and are taken as 0 words.
    Equal doc_ids tie by size. The same input gives the same mix. Sizes are summed by bins of the order
    first; only the bin in which a target falls is sorted, so a source of any size is spread over tasks.
    """
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    rows = docs.select("doc_id", F.coalesce(F.concat(F.lit("="), "source"), F.lit("")).alias("source_key"), "source", size.alias("size"), F.col("text"))
    u = (F.shiftright(F.xxhash64(F.lit(seed), "doc_id"), 11).bitwiseAND((1 << 52) - 1) + 0.5) / float(1 << 52)
    rows = rows.withColumn("order", -F.log(u) / (text_quality(F.col("text"), F.col("size")) if quality is None else quality)).drop("text")
    rows = rows.withColumn("bin", F.floor((1 - F.exp(-F.col("order"))) * BINS).cast("int"))
    rows = written(rows, "mix")
    sources = rows.groupBy("source_key", "source").agg(F.sum("size").alias("source_size"))
    targets = source_targets(sources, weights, share, cap)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    targets = targets.withColumn("epochs", epochs.cast("long")).withColumn("left", F.round(F.col("target") - F.col("epochs") * F.col("source_size")).cast("long"))
    line = Window.partitionBy("source_key").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    bins = rows.groupBy("source_key", "bin").agg(F.sum("size").alias("bin_size"))
    bins = bins.withColumn("bin_end", F.sum("bin_size").over(line)).withColumn("bin_start", F.col("bin_end") - F.col("bin_size"))
    bins = written(bins.join(targets, "source_key").drop("bin_size"), "mix-bins")
    placed = rows.drop("source").join(maybe_broadcast(bins, 100), ["source_key", "bin"])

    cut = (F.col("bin_start") < F.col("left")) & (F.col("bin_end") > F.col("left"))
    inner = Window.partitionBy("source_key", "bin").orderBy("order", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    cols = ["doc_id", "size", "source_size", "target", "epochs"]
    sure = placed.where(~cut).select(*cols, F.when(F.col("bin_end") <= F.col("left"), F.col("size")).otherwise(0).alias("part"), (F.col("bin_end") <= F.col("left")).alias("whole"))
    some = placed.where(cut).withColumn("start", F.col("bin_start") + F.sum("size").over(inner) - F.col("size"))
    part = F.least("size", F.greatest(F.lit(0), F.col("left") - F.col("start")))
    some = some.select(*cols, part.alias("part"), ((F.col("start") < F.col("left")) & (2 * part >= F.col("size"))).alias("whole"))
    out = sure.unionByName(some)
    return out.select("doc_id", "size", "source_size", "target", (F.col("epochs") * F.col("size") + F.col("part")).alias("taken"), (F.col("epochs") + F.col("whole").cast("int")).alias("copies"))
