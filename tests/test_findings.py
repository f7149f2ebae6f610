"""Queries on tables of odd rows against their SQL twins, and steps that took too much of one task or of the driver."""

import re
import unicodedata
from datetime import datetime
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from factloom.functions import answers as an
from factloom.functions import history
from factloom.operators import evaluate, resolve
from factloom.operators import facts as fx
from factloom.plans import ingest, registry
from factloom.sources import bind, delimited, exports
from factloom.sources.shared import new_path
from tests.test_more import brute_chunks


@pytest.fixture
def equal(spark, tmp_path):
    """Whether a query gives what its SQL does over tables {name: (schema, rows)}."""

    def compare(name, tables):
        duck = duckdb.connect()
        for t, (schema, rows) in tables.items():
            spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{t}.parquet")
            duck.sql(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
        got = registry.queries()[name](spark, str(tmp_path))
        want = duck.sql(f"SELECT {', '.join(chr(34) + c + chr(34) for c in got.columns)} FROM ({registry.oracle_sql()[name]})").to_arrow_table().to_pylist()
        key = lambda r: repr(sorted(r.items()))
        assert sorted((r.asDict() for r in got.collect()), key=key) == sorted(want, key=key)
        return want

    return compare


def test_quotes_with_other_spaces(equal):
    texts = ["Anouble thwh.", "one two\nfour. a two four", "a  b", "a b\nb  ", "b", " b c d e", "", "x y z\r", "x y\r\n", "a b c d ", "two\nfour two one four", "one two three four", "a\n b c d"]
    rows = [(12 * i + k, t) for i, t in enumerate(texts) for k in range(6)]
    assert len(equal("t4_j26_evidence", {"documents": ("doc_id long, text string", rows)})) > 40


LOUD = ["Weiß, groß und naß", "Straße; Fuß", "ﬁne ŉ, ᾳ ᾀ", "plain, text", "ß", "Größe: 4 cm, weiß"]


@pytest.mark.parametrize("name", ["t13_values", "t15_evaluation"])
def test_upper_case_of_several_letters(equal, name):
    rows = [(9 * i + 2, j, role, t) for i, t in enumerate(LOUD) for j, role in enumerate(("user", "assistant"))]
    assert equal(name, {"conversations": ("conv_id long, turn int, role string, text string", rows)})


def test_ends_of_words_and_texts(equal):
    texts = ["weiß.\n", "naß", "na ü", "[a]\n", "a: none\n", "[a\rb]", "done.\x85", "size:\x0b4 cm", "name: unknown\r\n", "ünone here", "a.\n.\n"]
    rows = [(9 * i + k, j, role, t) for i, t in enumerate(texts) for k in (0, 1, 2, 5, 8) for j, role in enumerate(("user", "assistant"))]
    equal("t15_evaluation", {"conversations": ("conv_id long, turn int, role string, text string", rows)})


def test_averages_are_rounded_as_in_sql(spark):
    rows = [(1, x, True, True, True, 0, 0) for x in [0.9729] + [0.0] * 5] + [(2, x, True, True, True, 0, 0) for x in (0.8831, 0.0, 1.0, 0.9876, 0.1118, 0.0, 1.0, 0.0, 1.0, 0.0)]
    got = evaluate.totals(spark.createDataFrame(rows, "turn int, similarity double, exact boolean, high boolean, overall boolean, total_values int, values_matched int"), "turn")
    assert {r.turn: (r.n, r.mean_similarity, r.mean_value_match) for r in got.collect()}.items() >= {1: (6, 0.1621, None), 2: (10, 0.4983, None)}.items()


def test_texts_within_others_are_not_broadcast(spark):
    words = ["a", "ab", "abc", "bcd", "abcd", "abcdefgh", "bcdefghij", "xabcdefghijk", "zz", "", "123", "21234", "1212121212", "12121"]
    rows = spark.createDataFrame([(w,) for w in words], "short string")
    got = resolve.containments(rows, rows.toDF("long"))
    assert "Broadcast" not in got._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, got.collect())) == sorted((s, w) for s in words for w in words if s and s in w)


@pytest.mark.parametrize("encoding", ["utf-16-le", "utf-16-be"])
def test_wide_files_are_read_in_blocks(spark, tmp_path, encoding):
    """Also where the bytes of a line feed belong to two letters."""
    odd = "ਕĀ Āਕ ਊ਀ਊ"
    texts = ["plain", "two\nlines\n\nend", odd, f"{odd}\n{odd * 3}", "a" * 400, "ä;ö"]
    rows = [(str(i), texts[i % len(texts)]) for i in range(60)]
    path = tmp_path / "wide notes.csv"
    path.write_bytes(("﻿id;text\r\n" + "".join(f'{i};"{t}"\r\n' for i, t in rows)).encode(encoding))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "501")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        lines = delimited.lines_of(spark, str(path), "UTF-16")
        assert lines.select("block").distinct().count() > 10
        assert sorted(map(tuple, delimited.read_notes(spark, str(path), ["id", "text"]).collect())) == sorted(rows)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


@pytest.mark.parametrize("name", ["s4_s6_s7_notes_file", "s1_s4_quoted_line_breaks", "s5_encodings"])
def test_uploads_are_written_by_several_tasks(equal, monkeypatch, name):
    paths = []
    monkeypatch.setattr(ingest, "new_path", lambda spark, what: paths.append(new_path(spark, what)) or paths[-1])
    rows = [(i, f"Note {i} of plain text.\nSecond line; end", "en", "web") for i in range(40)]
    equal(name, {"documents": ("doc_id long, text string, lang string, source string", rows)})
    assert paths and all(len(list(Path(p.removeprefix("file:")).glob("part-*"))) > 1 for p in paths)


def test_patterns_in_any_case(spark):
    """Factored patterns find what (?iu) finds; each text is searched once, also where notes are then filtered."""
    words = ["Status post", "s/p", "s/pü", "PO  usunięciu", "po\nusuni", "ęciu", "trattamento neoadiuvante", "sottopost a", "si ricovera", "Sı RİCOVERA", "eseguita in data", "E. I.:", "ei:", "seguiva ", "ſtatus efter", "genomgÅtt", "beKandlad med", "reſeKcjı", "operation", "CHTH", "cht", "cht1", "cİclo", "ifosfamide", "RTH_", "rth", "str\u212blterapi", "progressione", "progresS", "recidiv", "Återfall", "Ripresa di malattia"]
    texts = [f"{a}{gap}{b}" for a in words for b in words for gap in ("", " ")]
    d = spark.createDataFrame([(t,) for t in texts], "t string")
    for p in (history.EVENTS.removeprefix("(?:").removesuffix(")"), *history.TREATMENTS.values()):
        plain, factored = (F.regexp_extract_all("t", F.lit(x), F.lit(0)) for x in (f"(?iu)(?:{history.explicit(p)})", history.any_case(p)))
        assert d.where(F.size(plain) > 0).count() > 100 and d.where(plain != factored).count() == 0
    plan = registry.queries()["k6_history_notes"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(r"\(\d{4}\)") == 1


@pytest.mark.parametrize("name, part", [("t23_clean_examples", r"\(\s*:\s*\)"), ("t30_clean_text", r"regexp_replace(text#")])
def test_what_a_filter_reads_is_worked_out_once(spark, name, part):
    plan = registry.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(part) == 1


def test_variables_are_distinct_before_they_are_compared(spark):
    plan = registry.queries()["u6_never_checked"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate [core_variable") >= 2 and "Join LeftAnti" in plan


LINES = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz"
ORDERS = "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string"
CUSTOMERS = "c_custkey long, c_nationkey int, c_acctbal double, c_mktsegment string"
DAY = datetime(1995, 1, 2)


def fact_tables(lines, segments=("BUILDING",)):
    orders = [(k, k % 3, "FOP"[k % 3], 10.5 * k, None if k % 5 == 4 else DAY, "1-URGENT") for k in range(1, 30)]
    return {"lineitem": (LINES, lines), "orders": (ORDERS, orders), "customer": (CUSTOMERS, [(i, i, -2.5 * i, s) for i, s in enumerate(segments)])}


def test_records_that_come_twice_have_one_value(equal):
    lines = [(k, 7, 5, 1, q, f, "O", None if k % 4 == 3 else DAY) for k in range(1, 20) for q, f in ((9.0, "R"), (None, "N"), (3.0, None), (17.0, "A"))]
    assert len(equal("a1_pivot_of_found_variables", fact_tables(lines))) == 19


def test_a_pivot_without_variables(spark, tmp_path):
    for t, (schema, _) in fact_tables([]).items():
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{t}.parquet")
    got = registry.queries()["a1_pivot_of_found_variables"](spark, str(tmp_path))
    assert got.columns == ["patient_id", "record_id", "never"] and got.collect() == []


def test_names_of_facts_need_no_values(spark):
    lines = bind.facts(spark, "/root/testdata/sf0.001").where(fx.entity(F.col("core_variable")) == "Line")
    plan = lines.select("core_variable").distinct()._jdf.queryExecution().optimizedPlan().toString()
    assert not any(made in plan for made in ("concat_ws(", "round(", "cast(l_quantity"))


def test_keys_of_facts_are_made_once(spark):
    """Below the step that multiplies the rows."""
    plan = bind.facts(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    depth = lambda line: len(line) - len(line.lstrip(" :+-"))
    lines = plan.splitlines()
    made, multiplied = (next(x for x in lines if a in x and b in x) for a, b in (("Project", "concat_ws(-"), ("explode(", "Line.returnflag")))
    assert depth(made) > depth(multiplied)


@pytest.mark.parametrize("name", ["s11_label_export", "s12_j17_coded_export"])
def test_exports_are_packed_in_files_of_so_many_rows(equal, monkeypatch, name):
    paths = []
    monkeypatch.setattr(ingest, "new_path", lambda spark, what: paths.append(new_path(spark, what)) or paths[-1])
    monkeypatch.setattr(exports, "FILE_ROWS", 20, raising=False)
    lines = [(k, 7 * k, 5, 1, q, f, "O", None if k % 4 == 3 else DAY) for k in range(1, 30) for q, f in ((9.0, "R"), (None, None), (-3.0, "A;"))]
    rows = equal(name, fact_tables(lines, ["BUILDING", "a;b", None, "MACHINERY"]))
    files = [f for p in paths for f in Path(p.removeprefix("file:")).glob("part-*")]
    assert len(files) >= len(rows) / 20 and all(f.name.endswith(".csv.lz4") for f in files)


def test_codes_are_found_without_a_join(spark, monkeypatch):
    """Coded within the scan of each table: of its joins only that of lines and orders is left."""
    plans = []
    monkeypatch.setattr(exports, "write_labels", lambda facts, path: plans.append(facts._jdf.queryExecution().optimizedPlan().toString()))
    monkeypatch.setattr(exports, "read_labels", lambda spark, path: None)
    registry.queries()["s12_j17_coded_export"](spark, "/root/testdata/sf0.001")
    assert plans[0].count("Join ") == 1


def test_first_integers(spark):
    texts = ["12", "-7", "007", "-0", "a 5 b 6", "", None, "3.5", " 4", "99999999999999999999", "+8", "none"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", fx.first_integer(F.col("t")).alias("n")).collect()
    assert [r.n for r in rows] == ["12", "-7", "007", "-0", "5", None, None, "3", "4", "99999999999999999999", "8", None]


ASKED = "id long, morphology string, topography string, query string, histology_text string, topography_text string"


def listed(spark):
    rows = [(f"M{i % 5}-T{i // 5}", f"M{i % 5}", f"T{i // 5}", f"name {'abcde'[i % 5]} of {i // 5}", i) for i in range(40)]
    return spark.createDataFrame(rows, "code string, morphology string, topography string, name string, seq int")


def test_queries_that_ask_the_same_are_resolved_once(spark):
    """What multiplies rows by their candidates is below the join that gives each id its own."""
    kinds = [("M1", "T2", None, None, None), (None, None, "M2-T3", " Name A ", ""), (None, "T4", None, "name b of 4.", None), ("Mx", "Tx", None, None, None), (None, None, None, "NAME C", "of 7")]
    queries = spark.createDataFrame([(i, *kinds[i % 5]) for i in range(100)], ASKED)
    got = resolve.top_candidates(queries, listed(spark), 5)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join ") < plan.index("Window ")
    by_id = {}
    for r in sorted(got.collect(), key=lambda r: (r.id, r["rank"])):
        by_id.setdefault(r.id, []).append(tuple(r)[1:])
    assert all(by_id.get(i) == by_id.get(i % 5) for i in range(100)) and [r[0] for r in by_id[0][:1] + by_id[1][:1]] == ["M1-T2", "M2-T3"]
    assert 3 not in by_id and len(by_id) == 80 and all(len(rows) == 5 for rows in by_id.values())


def test_an_id_with_several_queries(spark):
    queries = [(1, "M1", "T2", None, None, None), (1, None, None, "M2-T3", None, None), (1, "M1", "T2", None, None, None), (2, "M1", "T2", None, None, None), (None, None, None, "M4-T4", None, None)]
    got = resolve.top_candidates(spark.createDataFrame(queries, ASKED), listed(spark), 2).collect()
    assert sorted(((r.id or 0, r["rank"], r.code, r.score) for r in got)) == [(0, 1, "M4-T4", 1.0), (1, 1, "M2-T3", 1.0), (1, 2, "M1-T2", 0.9), (2, 1, "M1-T2", 0.9), (2, 2, "M1-T0", 0.6)]


def brute_clean(text):
    """Letter by letter, in the order of the survey's source."""
    text = re.sub(r"\s+", " ", text)
    kept = [c if unicodedata.category(c)[0] != "C" else " " for c in text if unicodedata.category(c)[0] != "C" or unicodedata.category(c) == "Cc"]
    return re.sub(r"\s+", " ", re.sub(r"[\x00-\x1f\x7f-\x9f]", "", unicodedata.normalize("NFKC", "".join(kept)))).strip()


def test_texts_of_any_letters_are_cleaned(equal):
    """Every text is a row, and every letter is read as it is: no text is left out for its letters, no letter blanked before."""
    letters = [chr(i) for i in range(1, 0x110000) if not 0xD800 <= i < 0xE000]
    texts = ["\u0301".join(letters[i : i + 500]) for i in range(0, len(letters), 500)]
    texts += ["", " ", "plain", "4 cm² ª ¨ x", "½ dose, 5 µg", "αβγ ŉ Ĳ ſt", "日本語　ｶﾞ", "so\u00adft ze\u200bro", "뚀\u11a7 각", "a\x00b\r\n\tc\x85d\u2028e", "🫠 \U0001fae8", "e\u0323\u0301 ẛ̣"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(-1, None)]
    want = equal("t30_clean_text", {"documents": ("doc_id long, text string", rows)})
    added = "…\x01ﬁ\xa0０"
    assert {r["doc_id"]: r["text"] for r in want} == {i: None if t is None else brute_clean(t + added) for i, t in rows}


def test_chunks_of_odd_and_long_texts(spark):
    """Any white space ends sentences and words, and a text is gone through once, not with its chunks copied at each sentence."""
    texts = ["One.\u00a0Two\u2003three! " * 30, "\x1c a\u3000b\x85c " * 60, "\u00a0" * 300, "w" * 300 + "\u2028" + "v " * 90, "", None, "end.\n\n\u2029\n\nnext " * 20, "Short one. " * 20000, "word " * 20000 + ". Then more. " * 50]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    for budget in (5, 40):
        got = {r.i: r.c for r in rows.select("i", an.chunks(F.col("t"), F.lit(budget)).alias("c")).collect()}
        assert got == {i: None if t is None else brute_chunks(t, budget) for i, t in enumerate(texts)}
    plan = registry.queries()["t2_chunks"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "aggregate(" not in plan
