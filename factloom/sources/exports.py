"""Exports through Spark's writers, and their readers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DateType, MapType, StructType, TimestampNTZType, TimestampType

#: Fixed columns of a label export, in order.
LABEL_COLUMNS = ["patient_id", "original_source", "core_variable", "date_ref", "value", "record_id", "linked_to", "quality"]
#: Rows of a packed file, some 70 MB of text.
FILE_ROWS = 1_000_000


def write_labels(facts: DataFrame, path: str) -> None:
    """Rows as text with ';' between fields and a header in each file; nulls and columns that are not there are empty fields.

    Facts repeat themselves, so files are packed, by Hadoop's lz4, which takes no more time than writing them plain. A packed file is
    read by one task, so it has FILE_ROWS rows at most.
    """
    rows = facts.select(*[(F.col(c) if c in facts.columns else F.lit(None)).cast("string").alias(c) for c in LABEL_COLUMNS])
    rows.write.options(sep=";", header=True, compression="lz4", maxRecordsPerFile=FILE_ROWS).csv(path)


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """The rows of write_labels, all strings."""
    return spark.read.option("sep", ";").option("header", True).schema(", ".join(f"{c} string" for c in LABEL_COLUMNS)).csv(path)


def as_text(rows: DataFrame) -> DataFrame:
    """Nested values as JSON, dates as ISO text, the rest as strings."""
    def one(f):
        if isinstance(f.dataType, (ArrayType, MapType, StructType)):
            return F.to_json(f.name)
        if isinstance(f.dataType, DateType):
            return F.date_format(f.name, "yyyy-MM-dd")
        if isinstance(f.dataType, (TimestampType, TimestampNTZType)):
            return F.date_format(f.name, "yyyy-MM-dd'T'HH:mm:ss")
        return F.col(f.name).cast("string")

    return rows.select(*[one(f).alias(f.name) for f in rows.schema.fields])


def store_step(rows: DataFrame, table: str, path: str) -> None:
    """A stage's output as a table of strings that replaces an earlier one."""
    as_text(rows).write.mode("overwrite").option("path", path).saveAsTable(table)


def step_as_csv(spark: SparkSession, table: str, path: str) -> DataFrame:
    """A stored stage written as CSV, and that file as a table."""
    rows = spark.table(table)
    rows.write.options(header=True, escape='"').csv(path)
    return spark.read.options(header=True, escape='"').schema(rows.schema).csv(path)


def add_examples(rows: DataFrame, path: str, center: str) -> None:
    """Rows (prompt_type, note_text, annotation) of a center, keyed with its name; incomplete rows are dropped."""
    rows.dropna(subset=["prompt_type", "note_text", "annotation"]).select(F.concat_ws("-", "prompt_type", F.lit(center)).alias("prompt_key"), "note_text", "annotation", F.lit(center).alias("center")).write.mode("append").partitionBy("center").parquet(path)


def read_examples(spark: SparkSession, path: str, center: str) -> DataFrame:
    """A center's rows with the plain prompt type; only its folder is read."""
    return spark.read.parquet(path).where(F.col("center") == center).select(F.regexp_replace("prompt_key", f"-{center}$", "").alias("prompt_type"), "note_text", "annotation")


def delete_examples(spark: SparkSession, path: str, center: str) -> None:
    """Replaces a center's folder by nothing; others are not read or written."""
    rows = spark.read.parquet(path).where(F.col("center") == center)
    rows.limit(0).drop("center").write.mode("overwrite").parquet(f"{path}/center={center}")


def upserted(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old without the keys of new, and new."""
    return old.join(new.select(*keys), keys, "left_anti").unionByName(new)


def write_reports(reports: dict[str, DataFrame], base: str) -> None:
    """Each report as CSV and as JSON under base/name."""
    for name, rows in reports.items():
        rows.write.option("header", True).csv(f"{base}/{name}/csv")
        rows.write.json(f"{base}/{name}/json")


def read_report(spark: SparkSession, base: str, name: str, form: str, schema: str) -> DataFrame:
    reader = spark.read.schema(schema)
    return reader.json(f"{base}/{name}/json") if form == "json" else reader.option("header", True).csv(f"{base}/{name}/csv")


def ordered_columns(columns: list[str], first: list[str]) -> list[str]:
    """The fixed columns that are there in their order, then the others by name."""
    return [c for c in first if c in columns] + sorted(c for c in columns if c not in first)


def back_up(rows: DataFrame, path: str) -> None:
    rows.write.json(path)


def restore(spark: SparkSession, path: str, schema: str, required: list[str]) -> DataFrame:
    """The rows of a backup that have all required fields."""
    rows = spark.read.schema(schema).json(path)
    return rows.dropna(subset=required)
