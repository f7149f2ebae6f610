"""Each stage of the pipeline against brute force on its own input."""

import hashlib
import re
from collections import Counter

import corpus_pipeline
from pyspark.sql import functions as F
from factloom.llm.common import written

from .test_operators import WORD, groups, shingles

DATA = "/root/testdata/sf0.001"


def test_stages(spark, edge_docs):
    docs = written(edge_docs.select("doc_id", "text", "lang", "source", "n_chars"), "test-docs")
    kept = [docs]
    for _, stage in corpus_pipeline.STAGES:
        kept.append(written(stage(spark, kept[-1], DATA), "test-stage"))
    rows = [[(r.doc_id, r.text) for r in k.collect()] for k in kept[:5]]
    assert all(k.columns == docs.columns for k in kept[:5])

    toxic = {r.doc_id for r in spark.read.parquet(f"{DATA}/labels.parquet").where("toxic = 0").collect()} & {i for i, _ in rows[0]}
    assert len(toxic & {i for i, _ in rows[1]}) >= 0.97 * len(toxic)

    plain = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t or "")
    assert Counter(plain(t) for _, t in rows[2]) == Counter({plain(t) for _, t in rows[1]})
    for i, t in rows[2]:
        same = [m for m in rows[1] if plain(m[1]) == plain(t)]
        assert (i, len(t or "")) == min(((j, len(u or "")) for j, u in same), key=lambda m: (-m[1], m[0] is None, m[0] or 0))

    sets = {i: shingles(t, 5) for i, t in rows[2] if i is not None}
    linked = groups(sets, [(a, b) for a in sets for b in sets if a < b and sets[a] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])])
    assert sorted(i for i, _ in rows[3] if i is not None) == sorted(set(linked.values()))

    times = Counter(i for i, _ in rows[4])
    assert set(times) <= {i for i, _ in rows[3]} and max(times.values()) <= 2
    words = {i: len(WORD.findall(t or "")) for i, t in rows[3]}
    assert sum(times[i] * words[i] for i in times) >= 1.2 * sum(words.values())

    got = kept[5].collect()
    assert Counter((r.doc_id, r.decoded_sha256) for r in got) == Counter((i, hashlib.sha256((t or "").encode()).hexdigest()) for i, t in rows[4])


def test_run_equals_its_stages(spark):
    assert corpus_pipeline.run(spark, DATA).columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]


def test_any_other_column_passes_through(spark, edge_docs):
    """Columns with the names of the stages' own ones come out as they went in."""
    names = ["_key", "_nth", "_copies", "_sha", "t_id", "k_id", "m_id", "id", "row", "key", "gone", "sha", "hash", "nth", "copies", "taken_id", "kept_id", "kept", "toxic_id", "toxic_key", "text_sha256", "component_id", "score", "a.b"]
    docs = edge_docs.select("doc_id", "text", "lang", "source", "n_chars")
    docs = written(docs.select("*", *[F.concat(F.lit(n), F.xxhash64("doc_id", "text")).alias(n) for n in names]), "clashing")
    whole = Counter(map(tuple, docs.collect()))
    for _, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, docs, DATA)
        assert out.columns == docs.columns
        got = Counter(map(tuple, out.collect()))
        assert got and set(got) <= set(whole)
    assert corpus_pipeline.STAGES[4][1](spark, docs, DATA).count() == docs.count()
