"""SimHash links, vector codes and phrases against brute force over edge rows, and the parts that their methods rest on."""

import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from factloom.llm import phrases, simhash_join, vector_codes
from factloom.llm.components import components


def lower(text):
    return text.translate({k: k + 32 for k in range(65, 91)})


def simhash(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", lower(text or ""))
    shingles = [" ".join(words[k : k + 3]) for k in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups_of(f):
    """The group (least place) of each fingerprint."""
    up = list(range(len(f)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(f)):
        for j in np.flatnonzero(np.bitwise_count(f[i] ^ f[i + 1 :]) <= 2) + i + 1:
            a, b = find(i), find(int(j))
            up[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(f))]


def test_segment_distances_tell_all_values_apart():
    for k, mask in enumerate(simhash_join.SEGMENTS):
        bits = int(np.bitwise_count(mask))
        values = np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 * k // 10)
        assert len(np.unique(simhash_join.segment_distances(values)[:, k])) == 1 << bits


def test_reference_distances_bound_the_distance():
    f = np.random.default_rng(3).integers(0, 1 << 63, 500, dtype=np.uint64)
    d = simhash_join.reference_distances(f).reshape(len(f), -1).astype(int)
    far = np.abs(d[:1] - d[1:]).max(axis=1)
    assert (far <= np.bitwise_count(f[0] ^ f[1:])).all()


def test_simhash_join(edge_docs, rows):
    found = sorted((r.doc_id or -1, r.fingerprint, r.component_id) for r in simhash_join.near_duplicates(edge_docs).collect())
    f = np.array([simhash(t) for _, t in rows], np.uint64)
    group = groups_of(f)
    least = {}
    for g, (i, _) in zip(group, rows):
        if i is not None:
            least[g] = min(least.get(g, i), i)
    assert found == sorted((i or -1, f"{x:016x}", least.get(g)) for (i, _), x, g in zip(rows, f.tolist(), group))


@pytest.mark.parametrize("size", [16, 512])
def test_crowded_fingerprints(spark, monkeypatch, size):
    """Fingerprints about one centre share most segments: large groups are divided and dealt out, with no link lost."""
    monkeypatch.setattr(simhash_join, "GROUP", size)
    rng = np.random.default_rng(5)
    f = np.unique(np.array([0x1234567890ABCDEF ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 6), False)) for _ in range(2500)], np.uint64))
    links = simhash_join.links(spark.createDataFrame([(int(x),) for x in f.view(np.int64)], "fp long"))
    found = {r.node: r.component for r in components(links).collect()}
    members = defaultdict(list)
    for g, x in zip(groups_of(f), f.view(np.int64).tolist()):
        members[g].append(x)
    assert found == {x: min(m) for m in members.values() if len(m) > 1 for x in m}


def test_simhash_of_no_documents(spark):
    assert simhash_join.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def brute_codes(rows):
    """code and error of each (vec_id, vector), all of one length."""
    q = np.array([[int(np.floor(256 * x)) for x in v] for _, v in rows]).reshape(len(rows), 16, -1)
    books = q[:64].copy()
    for turn in range(3):
        d = ((q[:, None] - books[None]) ** 2).sum(axis=3)
        code = d.argmin(axis=1)
        if turn < 2:
            for p in range(16):
                for e in set(code[:, p].tolist()):
                    books[e, p] = q[code[:, p] == e, p].sum(axis=0) // (code[:, p] == e).sum()
    return ["".join(f"{c:02x}" for c in r) for r in code], d.min(axis=1).sum(axis=1).tolist()


def test_vector_codes(spark):
    rng = np.random.default_rng(7)
    rows = [(i, (rng.normal(0, 0.3, 32) + (i % 5)).tolist()) for i in range(900)]
    rows += [(900 + i, rows[3][1]) for i in range(50)] + [(950, [0.0] * 32), (951, [-1e300] * 32)]
    bad = [(960, None), (961, []), (962, [1.0] * 31 + [None]), (963, [float("nan")] * 32), (964, [float("inf")] + [0.0] * 31), (965, [1.0] * 16), (966, [1.0] * 31)]
    table = [(i, v, None if i % 4 == 0 else i % 3, "x", 1) for i, v in rows + bad]
    out = vector_codes.compress(spark.createDataFrame(table, "vec_id long, embedding array<double>, label int, code string, q int")).collect()
    clipped = [(i, [max(-65536.0, x) for x in v]) for i, v in rows]
    code, error = brute_codes(clipped)
    assert sorted((r.vec_id, r.code, r.error) for r in out) == [(i, c, e) for (i, _), c, e in zip(rows, code, error)]
    total = Counter()
    for r in out:
        total[r.label] += r.error
    assert all(r.label_error == total[r.label] for r in out) and len({r.codebooks_sha256 for r in out}) == 1


def test_whole_nodes_are_assigned():
    """Nodes and leaves together assign what comparing one by one does."""
    rng = np.random.default_rng(9)
    points = np.concatenate([rng.integers(-20, 20, (500, 4)) + c for c in rng.integers(-2000, 2000, (20, 4))])
    entries = points[rng.choice(len(points), 64, False)]
    tree, other = vector_codes.Tree(points, vector_codes.LEAF), vector_codes.Tree(entries, 1)
    nearest, sums, counts = vector_codes.assign(tree, other)
    want = ((points[:, None] - entries[None]) ** 2).sum(axis=2).argmin(axis=1)
    assert (nearest == want[tree.order]).all()
    assert (counts == np.bincount(want, minlength=64)).all()
    assert all((sums[e] == points[want == e].sum(axis=0)).all() for e in range(64))


def test_few_and_equal_vectors(spark):
    out = vector_codes.compress(spark.createDataFrame([(1, [1.0] * 16, 1), (1, [1.0] * 16, 1), (None, [2.0] * 16, None)], "vec_id long, embedding array<float>, label int")).collect()
    assert sorted((r.vec_id or 0, r.code, r.error) for r in out) == [(0, "02" * 16, 0), (1, "00" * 16, 0), (1, "00" * 16, 0)]
    assert vector_codes.compress(spark.createDataFrame([(1, None, 1)], "vec_id long, embedding array<float>, label int")).collect() == []


def brute_phrases(rows, least, top):
    count, total = defaultdict(Counter), Counter()
    for text, lang in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text or "")):
            words = re.findall(r"[^\x20\x09]+", piece)
            total[lang or "und"] += len(words)
            for k in range(1, 6):
                count[lang or "und"].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, f in count.items():
        candidates = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        inside = defaultdict(int)
        for p, a in candidates.items():
            for i in range(len(p)):
                for j in range(i + 2, len(p) + 1):
                    if j - i < len(p):
                        inside[p[i:j]] = max(inside[p[i:j]], a)
        found = []
        for p, a in candidates.items():
            if inside[p] < a:
                score, k = min((1000 * a * total[lang] // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
                found.append((score, a, " ".join(p), f[p[:k]], f[p[k:]]))
        found.sort(key=lambda x: (-x[0], -x[1], x[2].encode()))
        out += [(lang, n + 1, p, a, l, r, total[lang], s) for n, (s, a, p, l, r) in enumerate(found[:top])]
    return sorted(out)


@pytest.mark.parametrize("bits", [8, 1 << 16])
def test_phrases(spark, edge_docs, monkeypatch, bits):
    """Small filters pass phrases that are not frequent; counts and results are the same."""
    monkeypatch.setattr(phrases, "LEAST_BITS", max(bits, 8))
    monkeypatch.setattr(phrases, "MOST_BITS", bits)
    more = [("a b c. A B c; a b\nc a\tb  c", None), ("x y z " * 50, "und"), ("p q " * 4000 + "p", "en"), (" ,.;", "fr"), ("one. two", "de"), ("é Ü é Ü É ü", "de"), ("a b c d e f g " * 30, None)]
    docs = edge_docs.select("text", "lang", "key", "part", "start").union(spark.createDataFrame([(*r, 1, 2, 3) for r in more], "text string, lang string, key int, part int, start int"))
    rows = [(r.text, r.lang) for r in docs.collect()]
    found = sorted((r.lang, r.rank, r.phrase, r.a, r.l, r.r, r.n, r.score) for r in phrases.collocations(docs, 20, 40).collect())
    assert found == brute_phrases(rows, 20, 40)


def test_phrases_of_no_documents(spark):
    assert phrases.collocations(spark.createDataFrame([], "text string, lang string")).collect() == []
    assert phrases.collocations(spark.createDataFrame([(None, "en"), ("", None)], "text string, lang string")).collect() == []
