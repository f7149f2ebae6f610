"""Quoted line breaks over many blocks of a file, rows like the header, and quotes that do not pair."""

import csv
import io
import random

import pytest

from factloom.sources import delimited


def saved(tmp_path, name, text, encoding="utf-8"):
    path = tmp_path / name
    path.write_bytes(text.encode(encoding))
    return str(path)


@pytest.fixture
def small_blocks(spark):
    """Files are read in blocks of 200 bytes."""
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


@pytest.mark.parametrize("delimiter", [",", ";", "\t"])
def test_quoted_line_breaks(spark, tmp_path, small_blocks, delimiter):
    rows = [["id", "text", "p"], ["id", "text", "p"]]
    rows += [[str(i), ["plain", "two\nlines", 'say "so"\n\n\nend', "", "x" * 300 + "\n" + "y" * 300, f"a{delimiter}b\n{delimiter}"][i % 6], f"p{i}"] for i in range(120)]
    out = io.StringIO()
    csv.writer(out, delimiter=delimiter, lineterminator="\n").writerows(rows)
    path = saved(tmp_path, "notes.csv", out.getvalue())
    assert len(spark.read.text(path).inputFiles()) == 1 and spark.read.text(path).rdd.getNumPartitions() > 20
    for read in (delimited.read_notes(spark, path, ["id", "text"]), delimited.read_table(spark, path)):
        assert sorted(map(tuple, read.collect())) == sorted(map(tuple, rows[1:]))


def test_rows_like_the_header(spark, tmp_path):
    """Each of several files loses its first record only."""
    for i in range(3):
        saved(tmp_path, f"{i}.csv", f"id,text\nid,text\n{i},x\n\nid,text\n")
    found = sorted(map(tuple, delimited.read_table(spark, str(tmp_path)).collect()))
    assert found == sorted([("id", "text")] * 6 + [(str(i), "x") for i in range(3)])


def test_quotes_that_do_not_pair(spark, tmp_path, small_blocks):
    """An open quote, or pairs that swallow rows, make every line a row."""
    one = saved(tmp_path, "one.csv", "text;id\n5\" nail;1\n" + "".join(f"row {i};{i}\n" for i in range(2, 60)))
    assert len(delimited.read_notes(spark, one, ["text", "id"]).collect()) == 59
    two = saved(tmp_path, "two.csv", "text;id\n5\" nail;1\n" + "".join(f"row {i};{i}\n" for i in range(2, 60)) + "6\" nail;60\n")
    found = delimited.read_notes(spark, two, ["text", "id"]).collect()
    assert sorted(int(r.id) for r in found) == list(range(1, 61))


def test_records_without_bound(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(delimited, "MOST_RECORD", 50)
    path = saved(tmp_path, "long.csv", 'text;id\n"' + "line\n" * 40 + '";1\nb;2\n')
    assert len(delimited.read_notes(spark, path, ["text", "id"]).collect()) == 42


def test_no_lines(spark, tmp_path):
    with pytest.raises(ValueError):
        delimited.read_table(spark, saved(tmp_path, "empty.csv", "\n \n"))


def test_utf_16(spark, tmp_path):
    path = saved(tmp_path, "wide.csv", 'id;text\n1;"a\nb"\nid;text\n', "utf-16")
    assert sorted(map(tuple, delimited.read_notes(spark, path, ["id", "text"]).collect())) == [("1", "a\nb"), ("id", "text")]


def brute_records(lines):
    out, held = [], None
    for line in lines:
        held = line if held is None else f"{held}\n{line}"
        if held.count('"') % 2 == 0:
            if held.strip(" "):
                out.append(held)
            held = None
    return out


def test_records_are_joined_where_lines_are_read(spark, tmp_path, small_blocks, monkeypatch):
    """Whatever the blocks and batches; lines are written once, as records, and only pieces at the ends of blocks pass between tasks."""
    made = {}
    monkeypatch.setattr(delimited, "written", lambda df, what, f=delimited.written: made.setdefault(what, f(df, what)))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    rng, want = random.Random(5), []
    try:
        for i in range(3):
            lines = [rng.choice(["", " ", "plain", 'an "open', 'one "shut" one', '"', '""', "x" * 70]) if k % 40 > 25 else rng.choice(["", "y" * 30, "z"]) for k in range(160)]
            lines += ['"'] * (sum(x.count('"') for x in lines) % 2)
            saved(tmp_path, f"{i}.csv", "\n".join(lines) + "\n")
            want += brute_records(lines)
        records = delimited.records_of(delimited.lines_of(spark, str(tmp_path), "UTF-8"))
        got = [r.line for r in records.orderBy("file", "block", "id").collect()]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted(got) == sorted(want) and got[: len(want) // 4] == want[: len(want) // 4] and any(x.count("\n") > 20 for x in want)
    blocks = made["quote-blocks"].count()
    tables = [t for t in made.values() if "line" in t.columns]
    assert blocks > 30 and sum(t.count() for t in tables) <= len(want) + 2 * blocks
    plan = delimited.without_header(records, got[0])._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and not any("Aggregate" in x and "line#" in x for x in plan.splitlines())
