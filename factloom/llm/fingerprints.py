"""Document fingerprints by consistent weighted sampling, with DataFrame functions only.

A document is the bag of its words, each weighing its number. For every sample, a word draws two Gamma(2, 1)
variates r and c and a uniform b, all functions of the word, and with t = floor(ln w / r + b) the value
ln a = ln c - r (t - b + 1); the word with the least value is the sample. Two documents agree in a
sample with the probability sum(min(w)) / sum(max(w)), their generalised Jaccard similarity.
"""

from __future__ import annotations

import math
import random

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import written

SAMPLES = 32
SEED = 20240601
#: Documents that go together in a part of the descending order; parts are found through levels of FAN - 1 cuts each,
#: and so many levels at most.
PART_DOCS, FAN, MOST_LEVELS = 512, 64, 3
SPLIT = r"[\x20\x09-\x0D]+"


def _gamma_quantiles(n: int) -> list[float]:
    """Quantiles of Gamma(2, 1) in the middles of n equal steps: 1 - (1 + x) exp(-x) = u by bisection."""
    out = []
    for i in range(n):
        u, lo, hi = (i + 0.5) / n, 0.0, 60.0
        for _ in range(80):
            x = (lo + hi) / 2
            lo, hi = (x, hi) if 1 - (1 + x) * math.exp(-x) < u else (lo, x)
        out.append(lo)
    return out


def _tables(spark: SparkSession) -> DataFrame:
    """One row with the quantiles of Gamma(2, 1) and their logarithms. As a written table they stand in the plan as two
    columns, not as 1024 numbers at each use."""
    gamma = _gamma_quantiles(1024)
    constant = lambda values: F.split(F.lit(",".join(map(repr, values))), ",").cast("array<double>")
    return written(spark.range(1).select(constant(gamma).alias("r_table"), constant([math.log(g) for g in gamma]).alias("c_table")), "quantiles")


def _samples(n: int, low: Column, high: Column, log_weight: Column) -> list[Column]:
    """The least packed values (ln a above, the word's bits below) of n samples, as aggregates."""
    draw = random.Random(SEED)
    out = []
    for _ in range(n):
        # Bits of the word for this sample, from the middle of two products of 31 and 31 bits, which do not
        # overflow; each use pairs other bits.
        x = low.bitwiseXOR(draw.getrandbits(31)) * (draw.getrandbits(30) * 2 + 1)
        y = high.bitwiseXOR(draw.getrandbits(31)) * (draw.getrandbits(30) * 2 + 1)
        r = F.get("r_table", F.shiftright(x, 20).bitwiseXOR(F.shiftright(y, 27)).bitwiseAND(1023).cast("int"))
        c = F.get("c_table", F.shiftright(x, 30).bitwiseXOR(F.shiftright(y, 17)).bitwiseAND(1023).cast("int"))
        b = F.shiftright(x, 14).bitwiseXOR(F.shiftright(y, 23)).bitwiseAND((1 << 20) - 1) / F.lit(float(1 << 20))
        z = x.bitwiseXOR(y)
        value = c - r * (F.floor(log_weight / r + b) - b + 1)
        out.append(F.min(F.shiftleft(((value + 64) * (1 << 24)).cast("long"), 32).bitwiseOR(z.bitwiseAND(0xFFFFFFFF))))
    return out


def signatures(bags: DataFrame, keys: list[str], n: int = SAMPLES) -> DataFrame:
    """keys and signature (n integers) of each bag; bags has a row (keys, word) for each word met."""
    h = F.xxhash64("word")
    words = bags.select(*keys, h.bitwiseAND(0x7FFFFFFF).alias("low"), F.shiftright(h, 33).bitwiseAND(0x7FFFFFFF).alias("high"))
    counts = words.groupBy(*keys, "low", "high").agg(F.log(F.count("*").cast("double")).alias("log_weight"))
    counts = counts.join(F.broadcast(_tables(bags.sparkSession)))  # one row
    least = counts.groupBy(*keys).agg(*[s.alias(f"s{i}") for i, s in enumerate(_samples(n, F.col("low"), F.col("high"), F.col("log_weight")))])
    return least.select(*keys, F.array(*[F.hash(f"s{i}") for i in range(n)]).alias("signature"))


def likeness(a: Column, b: Column) -> Column:
    """The share of equal samples; texts without words are like each other and like no other."""
    same = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda x: x)) / F.size(a).cast("double")
    return F.when(a.isNull() & b.isNull(), 1.0).when(a.isNull() | b.isNull(), 0.0).otherwise(same)


def as_text(signature: Column) -> Column:
    hexed = F.transform(signature, lambda x: F.lpad(F.lower(F.hex(x.cast("long").bitwiseAND(0xFFFFFFFF))), 8, "0"))
    return F.coalesce(F.array_join(hexed, ""), F.lit(""))


def _in_parts(rows: DataFrame, levels: list[DataFrame]) -> DataFrame:
    """rows with part: parts are in descending order of doc_id, rows without one are in the last."""
    rows = rows.withColumn("part", F.lit(0).cast("long"))
    for cuts in levels:
        # At most FAN to the power of MOST_LEVELS - 1 rows.
        place = F.when(F.col("doc_id").isNull(), FAN).when(F.col("cuts").isNull(), 0).otherwise(F.size(F.filter("cuts", lambda x: x >= F.col("doc_id"))))
        rows = rows.join(F.broadcast(cuts), "part", "left").withColumn("part", F.col("part") * (FAN + 1) + place).drop("cuts")
    return rows


def _levels(docs: DataFrame, n: int, part_docs: int) -> list[DataFrame]:
    """Tables (part, cuts) of the quantiles of doc_id in each part of the level before, until parts are small enough."""
    levels: list[DataFrame] = []
    while n > part_docs * FAN ** len(levels) and len(levels) < MOST_LEVELS:
        cuts = F.percentile_approx("doc_id", [i / FAN for i in range(1, FAN)], 20 * FAN).alias("cuts")
        levels.append(written(_in_parts(docs.select("doc_id"), levels).groupBy("part").agg(cuts), "cuts"))
    return levels


def compare_with_edits(docs: DataFrame, part_docs: int = PART_DOCS) -> DataFrame:
    """Fingerprints of every document, of its edited text, and their likeness.

    docs: doc_id (a number), text and other columns, which are ignored whatever their names. The edited text is the text
    with its last floor(n / 2) code points replaced by as many first ones of the next document by descending doc_id
    (after the last the first). Rows repeated under a doc_id follow one another by a hash of the text;
    rows without doc_id come last, and the order does not go on from the last of them. Null texts count as
    empty; a text without words has an empty fingerprint, whatever its length. Long texts are read whole: their words are
    counted by Spark, row by row. An empty table gives an empty one. Returns doc_id, n_chars, edited_sha256,
    fingerprint, edited_fingerprint, near_edited, near_next.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    n = rows.count()
    levels = _levels(docs, n, part_docs)
    parts = max(1, min(FAN**MOST_LEVELS, n // part_docs))
    rows = _in_parts(rows, levels)

    # Each part also gets the head of the part after it, and the last part the head of all.
    heads = _in_parts(docs.select("doc_id"), levels).groupBy("part").agg(F.max("doc_id").alias("head"))
    order = Window.orderBy("part")
    heads = heads.select("head", F.coalesce(F.lag("part").over(order), F.max("part").over(Window.partitionBy())).alias("to"))
    ahead = rows.join(F.broadcast(heads), F.col("doc_id") == F.col("head")).select("doc_id", "text", "part", "to", F.lit(1).alias("ahead"))
    laid = rows.select("doc_id", "text", "part", F.col("part").alias("to"), F.lit(0).alias("ahead")).unionByName(ahead)
    laid = laid.repartition(parts, "to")  # a task then counts the words of few documents at a time

    line = Window.partitionBy("to").orderBy("ahead", F.col("doc_id").desc_nulls_last(), F.xxhash64("text"))
    place = F.row_number().over(line)
    seen = laid.select(
        "to", "ahead", "doc_id", "text", place.alias("place"), F.lead("text").over(line).alias("next_text"), F.lead("part").over(line).alias("next_part"), F.when(F.lead("ahead").over(line) == 1, 1).otherwise(place + 1).alias("next_place")
    ).where("ahead = 0")
    size = F.length("text")
    half = F.floor(size / 2).cast("int")
    edited = F.concat(F.expr("left(text, length(text) - length(text) div 2)"), F.coalesce(F.expr("left(next_text, cast(length(text) div 2 as int))"), F.lit("")))
    seen = seen.withColumn("edited", F.when(half == 0, F.col("text")).otherwise(edited))
    facts = seen.select("to", "place", F.lit(-1).alias("side"), "doc_id", size.cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), "next_part", "next_place")
    # The condition holds for all rows; it keeps both branches on the same columns, so they share one shuffle.
    sides = seen.where("coalesce(next_part, 0) >= 0").select("to", "place", F.posexplode(F.array("text", "edited")).alias("side", "one"))
    words = sides.select("to", "place", "side", F.explode(F.split("one", SPLIT)).alias("word")).where("word != ''")
    table = written(facts.unionByName(signatures(words, ["to", "place", "side"]), allowMissingColumns=True), "signatures")

    whole = table.groupBy("to", "place").agg(
        *[F.max(c).alias(c) for c in ("doc_id", "n_chars", "edited_sha256", "next_part", "next_place")], F.max(F.when(F.col("side") == 0, F.col("signature"))).alias("own"), F.max(F.when(F.col("side") == 1, F.col("signature"))).alias("changed")
    )
    after = table.where("side = 0").select(F.col("to").alias("next_part"), F.col("place").alias("next_place"), F.col("signature").alias("following"))
    out = whole.join(after, ["next_part", "next_place"], "left")
    return out.select(
        "doc_id", "n_chars", "edited_sha256", as_text(F.col("own")).alias("fingerprint"), as_text(F.col("changed")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("changed")).alias("near_edited"), likeness(F.col("own"), F.col("following")).alias("near_next"),
    )
