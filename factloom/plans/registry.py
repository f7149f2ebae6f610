"""The registered queries of the library's own operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.plans import answers, clinical, core, evaluation, ingest, more, reports, review, texts


def queries():
    return core.QUERIES | texts.QUERIES | more.QUERIES | clinical.QUERIES | answers.QUERIES | ingest.QUERIES | evaluation.QUERIES | review.QUERIES | reports.QUERIES


def oracle_sql():
    return core.SQL | texts.SQL | more.SQL | clinical.SQL | answers.SQL | ingest.SQL | evaluation.SQL | review.SQL | reports.SQL


def flagship(spark, sf_dir) -> DataFrame:
    """Events linked to the latest earlier order of their patient, counted by whether one was found."""
    linked = core.j1_asof_link(spark, sf_dir)
    return linked.groupBy(F.col("linked_to").isNotNull().alias("linked")).agg(F.count("*").alias("events"))
