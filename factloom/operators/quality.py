"""Declarative quality rules over the fact table and the reports on their outcomes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A patient passes with at least this share of checks passed.
PATIENT_PASS = 0.8


def blank() -> Column:
    return F.trim(F.coalesce(F.col("value"), F.lit(""))) == ""



#: Kinds of rule that a user has added: a condition on the fact (true is a failure).
ADDED: dict[str, Column] = {}


def register(kind: str, condition: Column) -> None:
    """Adds a kind of rule; rules of that kind then fail where the condition on the fact's columns holds."""
    ADDED[kind] = condition


def unregister(kind: str) -> None:
    ADDED.pop(kind, None)


def failed(as_of: str) -> Column:
    """Whether the rule of a joined row fails; nulls only fail not_null."""
    number = F.expr("try_cast(value AS DOUBLE)")
    cases = {
        "not_null": blank(),
        "in_set": F.col("value").isNotNull() & ~F.array_contains("allowed", F.col("value")),
        "of_type": F.col("value").isNotNull() & F.when(F.col("kind") == "number", number.isNull()).otherwise(F.expr("try_cast(value AS DATE)").isNull()),
        "between": F.coalesce(~number.between(F.col("lo"), F.col("hi")), F.lit(False)),
        "not_future": F.coalesce(F.expr("try_cast(value AS DATE)") > F.lit(as_of).cast("date"), F.lit(False)),
    } | ADDED
    out = F.lit(None).cast("boolean")
    for rule, condition in cases.items():
        out = F.when(F.col("rule") == rule, condition).otherwise(out)
    return out


def checked(facts: DataFrame, rules: DataFrame, as_of: str) -> DataFrame:
    """A row for each fact and rule of its variable, with `failed`. rules: core_variable, rule, dimension, allowed, lo, hi, kind.

    The rules are a small hand-written table, so it is broadcast; the facts are read once for all rules.
    """
    return facts.join(F.broadcast(rules), "core_variable").withColumn("failed", failed(as_of))


def outcome(rows: DataFrame, *by: str) -> DataFrame:
    """checks, failed and percent passed by the given columns."""
    n, bad = F.count("*"), F.count_if("failed")
    return rows.groupBy(*by).agg(n.alias("checks"), bad.alias("n_failed"), F.round((n - bad) * 100.0 / n, 4).alias("percent_passed"))


def patients_passing(rows: DataFrame, *by: str) -> DataFrame:
    """patients and those with at least PATIENT_PASS of their checks passed, by the given columns."""
    each = rows.groupBy(*by, "patient_id").agg((F.count_if(~F.col("failed")) / F.count("*")).alias("share"))
    return each.groupBy(*by).agg(F.count("*").alias("patients"), F.count_if(F.col("share") >= PATIENT_PASS).alias("passing"))


def missing_matrix(facts: DataFrame, variables: list[str]) -> DataFrame:
    """patient_id, core_variable, state for all patients and variables, long: Not present, Missing, Sometimes or ''.

    The variables are a fixed list and are broadcast; the matrix has a row for each patient and variable by definition.
    """
    counts = facts.groupBy("patient_id", "core_variable").agg(F.count("*").alias("n"), F.count_if(~blank()).alias("filled"))
    spine = facts.select("patient_id").distinct().withColumn("core_variable", F.explode(F.array(*[F.lit(v) for v in variables])))
    state = F.when(F.col("n").isNull(), "Not present").when(F.col("filled") == 0, "Missing").when(F.col("filled") < F.col("n"), "Sometimes").otherwise("")
    return spine.join(counts, ["patient_id", "core_variable"], "left").select("patient_id", "core_variable", state.alias("state"))


def conflicts(facts: DataFrame, single: list[str]) -> DataFrame:
    """Variables with more than one value: of a patient for entities in single, of a patient and date for others.

    The least and greatest value of each key tell whether it has several, in one partial sum of fixed size; values and sources
    are looked at for those keys only.
    """
    by_date = F.when(F.split_part("core_variable", F.lit("."), F.lit(1)).isin(single), F.lit(None)).otherwise(F.col("date_ref"))
    rows = facts.where(F.col("value").isNotNull()).select("patient_id", "core_variable", by_date.alias("on_date"), "value", "original_source")
    key = ["patient_id", "core_variable", "on_date"]
    several = rows.groupBy(*[F.col(c).alias(f"k_{c}") for c in key]).agg(F.min("value").alias("low"), F.max("value").alias("high")).where("low < high")
    same = reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"k_{c}")) for c in key])
    found = rows.join(several, same).groupBy(*key, "low", "high")
    return found.agg(F.count_distinct("value").alias("n_values"), F.array_join(F.array_sort(F.collect_set("original_source")), ",").alias("sources")).select(*key, "n_values", "low", "high", "sources")


#: Texts that stand for no value.
NO_VALUES = ["", "nan", "None", "NaT"]


def in_set(rows: DataFrame, *by: str) -> DataFrame:
    """Of rows of in_set rules (see checked) by the given columns: checks, n_failed, expected, observed, unexpected and patients.

    expected: the values allowed; observed: the values there are, trimmed, without those that stand for none; unexpected: those of
    them that are not allowed; sorted lists. patients: how many have one of those. Values are distinct before they are listed,
    in two partial sums, so a list holds what a coded variable can have.
    """
    value = F.when(~F.trim("value").isin(NO_VALUES), F.trim("value"))
    each = rows.groupBy(*by, value.alias("v")).agg(F.count("*").alias("n"), F.count_if("failed").alias("bad"), F.first("allowed").alias("allowed"))
    seen = each.groupBy(*by).agg(F.sum("n").alias("checks"), F.sum("bad").alias("n_failed"), F.array_sort(F.first("allowed")).alias("expected"), F.array_sort(F.collect_list("v")).alias("observed"))
    seen = seen.withColumn("unexpected", F.array_except("observed", "expected"))
    patients = rows.where(F.col("failed") & value.isNotNull()).groupBy(*[F.col(c).alias(f"p_{c}") for c in by]).agg(F.count_distinct("patient_id").alias("patients"))
    out = seen.join(patients, [F.col(c).eqNullSafe(F.col(f"p_{c}")) for c in by], "left")
    return out.select(*by, "checks", "n_failed", "expected", "observed", "unexpected", F.coalesce("patients", F.lit(0)).alias("patients"))


def failing_records(rows: DataFrame) -> DataFrame:
    """core_variable, record ("patient:record", either may be empty) and the values of each record that fails an in_set rule: a row each,
    however many there are."""
    record = F.concat_ws(":", F.coalesce(F.col("patient_id").cast("string"), F.lit("")), F.coalesce(F.col("record_id").cast("string"), F.lit("")))
    bad = rows.where(F.col("failed") & ~F.trim("value").isin(NO_VALUES)).select("core_variable", record.alias("record"), F.trim("value").alias("value")).distinct()
    return bad.groupBy("core_variable", "record").agg(F.array_join(F.array_sort(F.collect_list("value")), ",").alias("values"))
