"""What operators shuffle and write: as few rows as their work needs, with the same results."""

import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from factloom.llm import phrases, substring_dedup
from factloom.llm.jaccard_join import Similarity

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_substrings(rows):
    first: dict = {}
    for i, t in rows:
        w = WORD.findall(t or "")
        for k in range(len(w) - 49):
            if i is not None:
                key = tuple(w[k : k + 50])
                first[key] = min(first.get(key, i), i)
    out = Counter()
    for i, t in rows:
        w = WORD.findall(t or "")
        gone = set()
        for k in range(len(w) - 49):
            if i is not None and first[tuple(w[k : k + 50])] < i:
                gone.update(range(k, k + 50))
        out[i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)] += 1
    return out


@pytest.mark.parametrize("hot, held, bits", [(4096, 1 << 18, 64), (3, 40, 64), (3, 40, 1)])
def test_windows_of_one_key_are_one_row(spark, monkeypatch, hot, held, bits):
    """A row without id shares the passage, too: it neither removes it from others nor keeps them from losing it. Keys that many rows have are dealt out by window."""
    monkeypatch.setattr(substring_dedup, "HOT_ROWS", hot)
    monkeypatch.setattr(substring_dedup, "HELD_WINDOWS", held)
    passage = " ".join(f"p{i}" for i in range(120))
    rows = [(None, f"x {passage}"), (None, passage)]
    for i in range(1, 9):
        own = " ".join(f"d{i}w{k}" for k in range(40))
        rows.append((i, f"{own} {passage if i % 3 else ' '.join(passage.split()[:70])} {own} {i} " + (f"{passage} end" if i == 7 else "")))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    written, tables = substring_dedup.written, {}

    def kept(df, what):
        tables[what] = written(df, what)
        return tables[what]

    monkeypatch.setattr(substring_dedup, "written", kept)
    got = substring_dedup.dedup_passages(docs, bits).collect()
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in got) == brute_substrings(rows)
    windows = sum(max(0, len(t.split()) - 49) for _, t in rows)
    if bits == 64:
        assert tables["windows"].count() < windows / 5


def test_stripes_go_in_bundles(spark, monkeypatch):
    """Tasks pass on rows of many stripes each, not a row for each stripe; counts are those of Python, also if tasks merge often and rows are short."""
    docs = spark.createDataFrame([(f"{a} {b} {c}", "en") for a in "abcdefg" for b in "hijklmn" for c in "opqrst"] * 3, "text string, lang string").repartition(3)
    blooms = []
    for _ in range(3):
        hashes = phrases._frequent_hashes(docs, blooms, 2)
        blooms.append(phrases._bloom(hashes, hashes.count()))
    want = Counter()
    for r in docs.collect():
        w = r.text.split()
        want["", None] += len(w)
        for k in range(1, 4):
            want.update((" ".join(w[i : i + k - 1]), w[i + k - 1]) for i in range(4 - k))
    for held, entries in ((phrases.HELD, phrases.ROW_ENTRIES), (50, 4)):
        monkeypatch.setattr(phrases, "HELD", held)
        monkeypatch.setattr(phrases, "ROW_ENTRIES", entries)
        got = phrases.merged(docs, blooms, 2, 8)
        assert Counter({(r.prefix, r.word): r.n for r in got.collect()}) == want
    table = pa.table([["en"] * 900, [f"p{i}" for i in range(900)], ["w"] * 900, [1] * 900, np.zeros(900, np.int32)], ["lang", "prefix", "word", "n", "part"])
    made = [*phrases._bundled(phrases._stripes_of(table, ["lang", "prefix", "part"]), 8)]
    assert sum(b.num_rows for b in made) <= 900 // 4 + 8 and sum(len(x) for b in made for x in b.column("stripes")) == 900


def test_second_round_takes_rows_with_likely_links_only(spark, monkeypatch):
    """Documents that share a passage and are not near: the first round has compared them all, so the second has only the near copies."""
    passage = [f"p{i}" for i in range(12)]
    docs = [(i, " ".join([*passage, *(f"d{i}w{k}" for k in range(30))])) for i in range(60)]
    docs += [(100 + i, docs[i][1] + f" more{i}") for i in range(5)]
    seen = {}
    for name in ("likely", "near_across"):

        def watched(self, dealt, name=name, plain=getattr(Similarity, name)):
            seen[name] = dealt.count()
            return plain(self, dealt)

        monkeypatch.setattr(Similarity, name, watched)
    got = {r.doc_id: r.component_id for r in Similarity(3, 90, 100).join(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {i: i - 100 if i >= 100 else i for i, _ in docs}
    assert seen["near_across"] < seen["likely"] / 2
