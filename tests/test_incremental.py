"""Notes by prompt: repeated notes, added prompts and failed batches."""

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from factloom.streaming import incremental


def rows_of(spark, target):
    return sorted((r.batch, r.note, r.prompt, r.status) for r in spark.read.parquet(target).collect())


def test_notes_by_prompt(spark, tmp_path):
    source, target, checkpoint = (str(tmp_path / x) for x in ("notes", "target", "checkpoint"))

    def add(rows):
        spark.createDataFrame(rows, "note long, text string").coalesce(1).write.mode("append").parquet(source)

    def run(prompts, work=None):
        problem = F.when(F.col("text") == "bad", "bad")
        plain = lambda rows: incremental.isolated(rows, F.length("text"), F.col("problem")).select("note", "prompt", "status")
        incremental.process_prompts(spark, source, target, checkpoint, "note", F.array(*[F.lit(p) for p in prompts]), problem, work or plain)

    add([(1, "a"), (2, "bad"), (2, "bad"), (3, None), (None, "x")])
    run(["p"])
    first = [(0, 1, "p", "done"), (0, 2, "p", "error: bad"), (0, 3, "p", "done")]
    assert rows_of(spark, target) == first

    # A batch that fails changes nothing, and is done whole when it is repeated.
    add([(1, "a again"), (4, "d")])
    with pytest.raises(StreamingQueryException):
        run(["p", "q"], lambda rows: rows.select("note", "prompt", F.raise_error(F.lit("lost")).alias("status")))
    run(["p", "q"])
    second = [(1, 1, "q", "done"), (1, 4, "p", "done"), (1, 4, "q", "done")]
    assert rows_of(spark, target) == first + second

    # Nothing new; then a note with a problem made good, and known ones, which are left out.
    run(["p", "q"])
    assert rows_of(spark, target) == first + second
    add([(2, "good"), (1, "a"), (4, "d")])
    run(["p", "q"])
    assert rows_of(spark, target)[len(first + second) :] == [(2, 2, "p", "done"), (2, 2, "q", "done")]


def test_no_prompts(spark, tmp_path):
    source, target = str(tmp_path / "notes"), str(tmp_path / "target")
    spark.createDataFrame([(1, "a")], "note long, text string").write.parquet(source)
    none = F.array(F.lit(None).cast("string"))
    incremental.process_prompts(spark, source, target, str(tmp_path / "c"), "note", none, F.lit(None).cast("string"), lambda rows: rows.select("note", "prompt"))
    assert spark.read.schema("note long, prompt string").parquet(target).isEmpty()
