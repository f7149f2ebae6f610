"""SimHash near-duplicates through tables of distances to reference fingerprints.

Every distinct fingerprint gets its Hamming distances to many references. Fingerprints that differ in at most two bits have
distances that differ by at most two at every reference, so a pair with a greater difference anywhere is discarded; what is left is verified.

The table also says which pairs to look at, so that no pairs of all fingerprints are made. The references come in families: one
pattern, and the same pattern with the bits of one of ten segments inverted. Half the difference of the distances to those two is, but for
a constant, the distance within the segment, which two differing bits leave as it is in eight segments at least. Pairs
are looked for among fingerprints with equal segment distances only: in six segments (three of five pairs of segments), and where
many share these, in eight. The patterns tell all values of a segment apart, so eight equal segments leave 2^13 fingerprints at most.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import maybe_broadcast, mix, randoms, trimmed, written
from .components import components, local_stars

SHINGLE, SEED, BITS, RADIUS = 3, 42, 64, 2
#: Patterns, and segments of six or seven bits, as masks.
PATTERNS = randoms(12, 20)
_CUTS = [BITS * i // 10 for i in range(11)]
SEGMENTS = np.array([(1 << b) - (1 << a) for a, b in zip(_CUTS, _CUTS[1:])], np.uint64)
#: Fingerprints of a group that one task compares with each other; larger groups are divided.
GROUP = 512
#: Shingles whose bits are counted at once, and fingerprints compared at once.
PIECE, BLOCK = 1 << 16, 1 << 15
#: Six segments that two differing bits may leave equal: three of five pairs; then two of the other four.
TRIPLES = [tuple(s for p in pairs for s in (2 * p, 2 * p + 1)) for pairs in combinations(range(5), 3)]
_LOWER = bytes(b + 32 if 65 <= b <= 90 else 32 if 9 <= b <= 13 else b for b in range(256))


def _hashes(text: bytes) -> list[int]:
    """XXH64 of every run of three words, lower-cased and joined by a space; of all words where there are fewer."""
    words = [w for w in text.translate(_LOWER).split(b" ") if w]
    if not words:
        return []
    plain = b" ".join(words)
    ends = (np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1).tolist()
    starts = [0, *(e + 1 for e in ends[:-1])]
    digest = xxhash.xxh64_intdigest
    return [digest(plain[a:b], SEED) for a, b in zip(starts, ends[SHINGLE - 1 :])] or [digest(plain, SEED)]


def fingerprint_rows(texts: list[bytes]) -> np.ndarray:
    """The 64-bit SimHash of each text: a bit is set if over half the hashes of its shingles, repeats included, have it set."""
    counts, sizes = np.zeros((len(texts), BITS), np.int64), np.zeros(len(texts), np.int64)
    held: list[tuple[int, np.ndarray]] = []

    def count():
        h = np.concatenate([x for _, x in held])
        rows = np.repeat([r for r, _ in held], [len(x) for _, x in held])
        for i in range(0, len(h), PIECE):
            bits = np.unpackbits(h[i : i + PIECE].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
            row = rows[i : i + PIECE]
            cut = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
            counts[row[cut]] += np.add.reduceat(bits, cut, axis=0, dtype=np.int64)
        held.clear()

    n = 0
    for r, text in enumerate(texts):
        h = np.array(_hashes(text), np.uint64)
        sizes[r] = len(h)
        if len(h):
            held.append((r, h))
            n += len(h)
        if held and (n >= PIECE or r == len(texts) - 1):
            count()
            n = 0
    if held:
        count()
    return np.packbits(2 * counts > sizes[:, None], axis=1).view(">u8").astype(np.uint64).ravel()


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fp, the fingerprint as a signed 64-bit number, of each row; null texts count as empty."""

    def run(batches):
        for b in batches:
            texts = b.column("text").cast(pa.large_binary()).fill_null(b"").to_pylist()
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fingerprint_rows(texts).view(np.int64))], ["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(trimmed(run), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, fp long")


def reference_distances(f: np.ndarray) -> np.ndarray:
    """Hamming distances (rows, 12, 11) to each pattern, and to it with each of the ten segments inverted."""
    families = PATTERNS[:, None] ^ np.concatenate([[np.uint64(0)], SEGMENTS])[None, :]
    return np.bitwise_count(f[:, None, None] ^ families[None])


def segment_distances(f: np.ndarray) -> np.ndarray:
    """For each fingerprint and segment, the distances within the segment to the twelve patterns, three bits each."""
    d = reference_distances(f).astype(np.int64)
    within = (d[:, :, :1] - d[:, :, 1:] + np.bitwise_count(SEGMENTS).astype(np.int64)) // 2
    return (within << (3 * np.arange(len(PATTERNS)))[None, :, None]).sum(axis=1).astype(np.uint64)


def _keys(segments: np.ndarray, chosen: tuple[int, ...], number: int) -> np.ndarray:
    out = np.full(len(segments), number + 1, np.uint64)
    with np.errstate(over="ignore"):
        for s in chosen:
            out = mix(out * np.uint64(0x9E3779B97F4A7C15) + segments[:, s])
    return out.view(np.int64)


def _by_six(batches):
    """(t, key, fp): a key of the distances in the segments of each triple t."""
    for b in batches:
        f = b.column("fp").to_numpy().view(np.uint64)
        segments = segment_distances(f)
        for t, six in enumerate(TRIPLES):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(f), t, np.int8)), pa.array(_keys(segments, six, t)), b.column("fp")], ["t", "key", "fp"])


def _by_eight(batches):
    """(t, key, fp): keys of two more segments, for fingerprints of large groups by the six segments of triple t."""
    for b in batches:
        f, t = b.column("fp").to_numpy().view(np.uint64), b.column("t").to_numpy()
        segments = segment_distances(f)
        for k, six in enumerate(TRIPLES):
            mine = np.flatnonzero(t == k)
            rest = [s for s in range(len(SEGMENTS)) if s not in six]
            for n, two in enumerate(combinations(rest, 2)):
                key = _keys(segments[mine], six + two, 1000 + 10 * k + n)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(mine), k, np.int8)), pa.array(key), pa.array(f[mine].view(np.int64))], ["t", "key", "fp"])


def near_pairs(key: np.ndarray, f: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j) of fingerprints under the same key that differ in two bits at most."""
    table = np.bitwise_count(f[:, None] ^ PATTERNS[None, :]).astype(np.int8)
    order = np.lexsort((table[:, 0], key))
    key, f, table = key[order], f[order], table[order]
    i, found = np.arange(len(f)), []
    step = 0
    while len(i):
        step += 1
        i = i[i + step < len(f)]
        # Those after the first that is too far by the first reference, or under another key, are too far as well.
        i = i[(key[i] == key[i + step]) & (table[i + step, 0] - table[i, 0] <= RADIUS)]
        left = i
        for c in range(1, len(PATTERNS)):
            left = left[np.abs(table[left + step, c] - table[left, c]) <= RADIUS]
        left = left[np.bitwise_count(f[left] ^ f[left + step]) <= RADIUS]
        found.append((left, left + step))
    return tuple(order[np.concatenate([x[k] for x in found]) if found else np.zeros(0, np.int64)] for k in (0, 1))


def _forests(batches):
    """Rows (key, fp) in the order of their keys: the true links between them, as stars (u, v) of what these connect in each block."""
    empty = {"key": np.zeros(0, np.int64), "fp": np.zeros(0, np.int64)}

    def stars(key, fp):
        i, j = near_pairs(key, fp.view(np.uint64))
        return local_stars(pa.table({"u": fp[i], "v": fp[j]}))

    held = dict(empty)
    for b in batches:
        held = {c: np.concatenate([held[c], b.column(c).to_numpy()]) for c in held}
        if len(held["key"]) >= BLOCK:
            cut = int(np.searchsorted(held["key"], held["key"][-1]))  # the last key may go on
            if cut:
                yield stars(held["key"][:cut], held["fp"][:cut])
                held = {c: x[cut:] for c, x in held.items()}
    if len(held["key"]):
        yield stars(held["key"], held["fp"])


def _shared(keyed: DataFrame, what: str) -> DataFrame:
    """Rows (t, key, fp) whose key others have, with their number n; numbers are summed up before the shuffle and joined back."""
    keyed = written(keyed, f"{what}-keys")
    sizes = written(keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), f"{what}-sizes")
    return written(keyed.join(maybe_broadcast(sizes), "key"), f"{what}-shared")


def links(distinct: DataFrame) -> DataFrame:
    """A table of true links (a, b) that connects all of the distinct fingerprints (fp) that links connect.

    Groups of up to GROUP rows are compared as they are. Larger ones are divided by two more segments, which leaves 2^13 rows at most;
    of these, groups that are still larger are dealt out as pairs of parts, 17 at most for a row.
    """
    first = _shared(distinct.select("fp").mapInArrow(trimmed(_by_six), "t byte, key long, fp long"), "six")
    second = _shared(first.where(F.col("n") > GROUP).select("t", "fp").mapInArrow(trimmed(_by_eight), "t byte, key long, fp long"), "eight")
    parts = F.ceil(F.col("n") / GROUP).cast("int")
    dealt = second.where(F.col("n") > GROUP).withColumn("part", F.pmod(F.xxhash64("fp"), parts).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1)))
    dealt = dealt.select(F.xxhash64("key", F.least("part", "other"), F.greatest("part", "other")).alias("key"), "fp")
    small = [x.where(F.col("n") <= GROUP).select("key", "fp") for x in (first, second)]
    groups = small[0].unionByName(small[1]).unionByName(dealt)
    found = groups.repartition("key").sortWithinPartitions("key").mapInArrow(trimmed(_forests), "u long, v long")
    return written(found.select(F.col("u").alias("a"), F.col("v").alias("b")).distinct(), "simhash-links")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Documents and what they are linked to by fingerprints that differ in two bits at most, directly or through others.

    docs: doc_id (a number), text and any other columns, which are ignored. Returns doc_id, fingerprint (16 hex digits)
    and component_id (the smallest doc_id of those reachable) of each row. Null and empty texts, and those of white space, have
    fingerprint zero, which is linked like any other. A text of fewer than three words is one shingle. Rows without doc_id count for no
    component_id but have one, null if nothing they reach has a doc_id. Repeated rows give repeated rows, an empty table an empty one.
    Equal fingerprints are one from the start, so copies cost nothing.
    """
    rows = written(fingerprints(docs), "simhash-rows")
    distinct = written(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-distinct")
    reached = written(components(links(distinct)).select(F.col("node").alias("fp"), F.col("component").alias("root")), "simhash-reached")
    rooted = written(distinct.join(maybe_broadcast(reached), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root")), "simhash-rooted")
    ids = written(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "simhash-ids")
    named = written(rooted.join(maybe_broadcast(ids), "root").select("fp", "component_id"), "simhash-components")
    out = rows.join(maybe_broadcast(named), "fp")
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
