"""The registered core queries against their SQL twins, and the operators' edge cases."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

from factloom.operators import facts, links, quality
from factloom.plans import registry

DATA = "/root/testdata/sf0.001"


def plain(rows, columns):
    def value(x):
        if x is None or x != x:
            return None
        return round(float(x), 5) if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x)

    return sorted((tuple(value(r[c]) for c in columns) for r in rows), key=repr)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DATA}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    got = registry.queries()[name](spark, DATA)
    want = duck.sql(registry.oracle_sql()[name]).fetch_arrow_table().to_pylist()
    assert plain([r.asDict() for r in got.collect()], sorted(got.columns)) == plain(want, sorted(got.columns))
    assert not want or sorted(want[0]) == sorted(got.columns)


def test_asof_ties_nulls_and_buckets(spark):
    left = spark.createDataFrame([(1, "a", "2024-01-31 00:00:00"), (2, "a", "2024-03-01 00:00:00"), (3, "b", "2024-01-01 00:00:00"), (4, None, "2024-01-01 00:00:00"), (5, "a", None)], "i int, k string, t string").withColumn("t", F.col("t").cast("timestamp"))
    right = spark.createDataFrame([("a", "2024-01-31 00:00:00", 7), ("a", "2024-01-31 00:00:00", 5), ("b", "2024-01-02 00:00:00", 1), (None, "2023-01-01 00:00:00", 9)], "k string, t string, id int").withColumn("t", F.col("t").cast("timestamp"))
    got = {r.i: r.found.id if r.found else None for r in links.asof(left, right, "k", "t", ["id"], [-F.col("id")]).collect()}
    assert got == {1: 5, 2: 5, 3: None, 4: None, 5: None}


def test_nearest_takes_the_closest_then_the_least(spark):
    left = spark.createDataFrame([(1, "a", "2024-01-20"), (2, "a", "2024-03-20")], "i int, k string, t string").withColumn("t", F.col("t").cast("date"))
    right = spark.createDataFrame([("a", "2024-01-15", 9), ("a", "2024-01-25", 4), ("a", "2024-01-01", 1)], "k string, t string, id int").withColumn("t", F.col("t").cast("date"))
    assert {r.i: r.found for r in links.nearest(left, right, "k", "t", 14, "id").collect()} == {1: 4, 2: None}


def test_links_keep_columns_of_any_name(spark):
    names = ["found", "_bucket", "_day", "_left", "_best", "_row", "_near", "_whole", "_carried"]
    left = spark.createDataFrame([(1, "a", "2024-01-20")], "i int, k string, t string").select("i", "k", F.col("t").cast("date").alias("t"), *[F.lit(n).alias(n) for n in names])
    right = spark.createDataFrame([("a", "2024-01-15", 9)], "k string, t string, id int").withColumn("t", F.col("t").cast("date"))
    for out in (links.asof(left, right, "k", "t", ["id"], []), links.nearest(left, right, "k", "t", 14, "id")):
        r = out.head()
        assert out.columns == ["i", "k", "t", *names[1:], "found"] and all(r[n] == n for n in names[1:])
        assert (r.found if isinstance(r.found, int) else r.found.id) == 9


def test_pivot_has_all_columns_on_empty_input(spark):
    empty = spark.createDataFrame([], "patient_id long, record_id string, seq long, core_variable string, value string")
    assert facts.pivot(empty, ["patient_id"], ["Order.status", "Order.x"]).columns == ["patient_id", "status", "x"]


def test_matrix_states(spark):
    rows = spark.createDataFrame([(1, "A.x", "v"), (1, "A.x", " "), (2, "A.x", None), (3, "A.y", "v")], "patient_id int, core_variable string, value string")
    got = {(r.patient_id, r.core_variable): r.state for r in quality.missing_matrix(rows, ["A.x", "A.y"]).collect()}
    assert got[1, "A.x"] == "Sometimes" and got[2, "A.x"] == "Missing" and got[3, "A.x"] == "Not present" and got[3, "A.y"] == ""
