import pytest

SPACES = "\x20\x09\x0a\x0b\x0c\x0d"
DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def edge_docs(spark):
    """Documents of the smallest table and edge rows: nulls, blanks, copies, repeated rows, long texts, clashing columns."""
    long = " ".join(f"w{i % 977}" for i in range(6000))
    rows = [(900001, None), (900002, ""), (900003, " \t\n"), (900004, "one"), (900005, "One "), (900006, "one two"), (900007, long), (900008, long + " more"), (900009, "x" * 5000), (900009, "x" * 5000), (900010, "é ñ 漢字 😀 'S it's"), (None, "no id at all"), (None, "one")]
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text")
    docs = docs.union(spark.createDataFrame(rows, "doc_id long, text string"))
    out = docs.selectExpr("doc_id", "text", "'l' AS lang", "CASE WHEN doc_id % 3 = 0 THEN NULL ELSE concat('s', doc_id % 4) END AS source", "length(text) AS n_chars", "1 AS key", "2 AS start", "3 AS kept", "4 AS size", "5 AS `group`", "6 AS part").cache()
    return out


@pytest.fixture(scope="session")
def rows(edge_docs):
    return [(r.doc_id, r.text) for r in edge_docs.select("doc_id", "text").collect()]
