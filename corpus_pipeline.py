"""A corpus from documents to token ids: toxicity, exact and near duplicates, mixing, byte-level BPE.

Each stage takes (spark, docs, sf_dir), works on all that the stage before kept and returns the rows that
stay with the columns of documents; the last returns their token ids. Rows without doc_id pass the filters
of the first three stages except as exact copies; null and empty texts are texts without words; long texts are
read whole; empty tables give empty results; other columns pass through, whatever their names. Rows that share a doc_id are told apart by their text in the first
two stages; in the third and fourth they are one document: they go together and are taken equally often.

A stage's result must be written before the next one is called, as STAGES asks: that removes the tables that the stage before wrote for itself.
"""

from __future__ import annotations

from functools import wraps

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom.llm import byte_bpe, exact_dedup, mixing, toxicity
from factloom.llm.common import BATCH_ROWS, made, maybe_broadcast, removed, table, written
from factloom.llm.jaccard_join import Similarity
from factloom.plans.shipping import ship

#: The near-duplicate stage: shingles of five words, similarity of 0.8 or more.
NEAR = Similarity(5, 80, 100)


def _packed(docs: DataFrame, *more: Column) -> DataFrame:
    """docs with each row as one struct, beside columns of a stage's own: no name in docs can clash with those."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").alias("id"), *more)


def _without(docs: DataFrame, dropped: DataFrame) -> DataFrame:
    """docs without the rows of the given ids (doc_id); ids are broadcast while they are few."""
    dropped = maybe_broadcast(written(dropped.select(F.col("doc_id").alias("gone")).distinct(), "dropped"))
    return _packed(docs).join(dropped, F.col("id") == F.col("gone"), "left_anti").select("row.*")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text is not predicted to be toxic. Repeated rows score alike, so they stay or go together."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    keyed = docs.select(F.struct(F.col("doc_id").alias("id"), F.xxhash64("text").alias("key")).alias("doc_id"), "text")
    toxic = toxicity.score(keyed, model).where(F.col("score") >= toxicity.THRESHOLD)
    toxic = maybe_broadcast(written(toxic.select(F.col("doc_id.id").alias("toxic_id"), F.col("doc_id.key").alias("toxic_key")).distinct(), "toxic"))
    same = F.col("id").eqNullSafe(F.col("toxic_id")) & (F.col("key") == F.col("toxic_key"))
    return _packed(docs, F.xxhash64("text").alias("key")).join(toxic, same, "left_anti").select("row.*")


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts equal but for white space, the longest original, then the smallest doc_id, and of fully repeated rows one."""
    groups = written(exact_dedup.exact_groups(docs), "exact-groups")
    dropped = groups.where("NOT kept").select(F.col("doc_id").alias("gone")).distinct()
    kept = groups.where("kept").select(F.col("doc_id").alias("kept_id"), "text_sha256")
    # Ids that have kept and dropped rows: repeated rows, or other texts under one id.
    both = written(kept.join(dropped, F.col("kept_id").eqNullSafe(F.col("gone")), "left_semi"), "kept-and-dropped")
    dropped = maybe_broadcast(written(dropped, "dropped"))
    same = F.col("id").eqNullSafe(F.col("gone"))
    rest = _packed(docs).join(dropped, same, "left_anti").select("row.*")
    sha = F.sha2(F.regexp_replace(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]", ""), 256)
    some = _packed(docs, sha.alias("sha"), F.length("text").alias("length"), F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns]).alias("hash"))
    some = some.join(maybe_broadcast(both, 150), F.col("id").eqNullSafe(F.col("kept_id")) & (F.col("sha") == F.col("text_sha256")), "left_semi")
    first = Window.partitionBy("id", "sha").orderBy(F.col("length").desc_nulls_last(), "hash")
    some = some.withColumn("nth", F.row_number().over(first)).where("nth = 1").select("row.*")
    return rest.unionByName(some)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by five-word shingles, directly or through others, the smallest doc_id, so there are no ties. All rows of
    a doc_id stay or go together."""
    return _without(docs, NEAR.join(docs).where("component_id != doc_id"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as the mix takes it; rows of one doc_id as often as the one of them taken most. Ties of the
    sampling order go by the hash of the doc_id, so reruns agree."""
    taken = mixing.mix_sources(docs).groupBy(F.col("doc_id").alias("taken_id")).agg(F.max("copies").alias("copies"))
    taken = maybe_broadcast(written(taken.where("copies > 0"), "taken"), 32)
    times = _packed(docs).join(taken, F.col("id").eqNullSafe(F.col("taken_id"))).select("row", F.explode(F.expr("sequence(1L, copies)")).alias("nth"))
    return times.select("row.*")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and the digests of the ids and of the text they decode to, of each row."""
    ranks = byte_bpe.read_ranks(spark, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return byte_bpe.encode(docs, ranks, public_tokenizers.PATTERN, decoded=True, texts=False)


#: Tables of the stage before.
_tables: list[str] = []


def _stage(work):
    """The stage as a function that first removes what the stage before has written for itself: its result is a table of its own by then.
    Its own result, which the caller writes, is made in small batches, too: the session keeps that setting."""

    @wraps(work)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        ship(spark)
        spark.conf.set(*BATCH_ROWS)
        removed(spark, _tables)
        with made(_tables):
            return work(spark, docs, sf_dir)

    return run_stage


STAGES = [
    ("toxicity", _stage(drop_toxic)),
    ("exact dedup", _stage(drop_exact_copies)),
    ("n-gram Jaccard join", _stage(drop_near_copies)),
    ("mixing sources", _stage(mix_sources)),
    ("byte-level BPE", _stage(encode)),
]
#: The scores, the sampling order and the merges cannot be expressed in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
