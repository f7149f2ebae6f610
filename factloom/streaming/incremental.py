"""Notes processed as they come, once each, with resume."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def process_new(spark: SparkSession, source: str, target: str, checkpoint: str, work, key: str) -> None:
    """Applies work to the rows of new Parquet files under source and appends them to target, once each.

    The checkpoint keeps which files are done. Each batch is a partition of target named by its number, written over if the batch is
    repeated after a failure, so nothing is added twice and no batch reads what earlier ones wrote. Rows of a key that a file repeats are
    worked on once. work maps a DataFrame to one that keeps key; a row's own failure belongs into its status column (see isolated).
    """

    def batch(rows: DataFrame, number: int) -> None:
        work(rows.dropDuplicates([key])).write.mode("overwrite").parquet(f"{target}/batch={number}")

    rows = spark.readStream.schema(spark.read.parquet(source).schema).parquet(source)
    rows.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


STORE = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def process_prompts(spark: SparkSession, source: str, target: str, checkpoint: str, key: str, applicable: Column, problem: Column, work) -> None:
    """Applies work to each new pair of a row (key) and a prompt, and appends what it gives to target, once each, with resume.

    source: a folder of Parquet files, each read once. applicable: a row's prompts, an array; rows without any are skipped, and a null one is
    left out. A pair is done once it has come without a problem (a text, null if none): a row that comes again, in another file or the same,
    is left out but for prompts that are new to it. Pairs with a problem are given to work each time they come, so they can be
    made good later. Of repeated rows of a key in one batch, one counts.

    Which pairs are done is keyed state of the stream, on the executors' disks and in the checkpoint; a batch looks up its own keys only. State
    and files commit together: a batch that fails is repeated from the state before it, and its partition of target is written over.
    """

    def batch(rows: DataFrame, number: int) -> None:
        work(rows.dropDuplicates([key, "prompt"])).write.mode("overwrite").parquet(f"{target}/batch={number}")

    rows = spark.readStream.schema(spark.read.parquet(source).schema).parquet(source)
    pairs = rows.withColumn("prompt", F.explode(F.array_distinct(F.array_compact(applicable)))).withColumn("problem", problem).where(F.col(key).isNotNull())
    new = pairs.where("problem IS NULL").dropDuplicates([key, "prompt"])
    name, provider = STORE
    before = spark.conf.get(name)
    spark.conf.set(name, provider)
    try:
        new.unionByName(pairs.where("problem IS NOT NULL")).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(name, before)


def isolated(rows: DataFrame, value: Column, problem: Column) -> DataFrame:
    """rows with status and value: rows whose problem (a text, null if none) is set have status "error: ..." and no value."""
    return rows.withColumns({"status": F.when(problem.isNotNull(), F.concat(F.lit("error: "), problem)).otherwise("done"), "value": F.when(problem.isNull(), value)})


def summary(status: DataFrame) -> DataFrame:
    """Rows by status with the least, greatest and mean cost of one."""
    return status.groupBy("status").agg(F.count("*").alias("n"), F.min("cost").alias("min"), F.max("cost").alias("max"), F.round(F.avg("cost"), 4).alias("mean"))
