"""Byte-level BPE by merge ranks, on distinct words, with Spark's higher-order functions.

Documents are packed in blocks: the distinct pieces of their texts, as arrays of byte ids, and for each
document the numbers of its pieces. A fold merges the pair of least rank in each piece until none is left;
ranks of pairs stand in a literal array, a hash table with two places for each pair. Then every document's
ids are gathered from its block. No stage shuffles: a lost executor costs the blocks it held. As that fold takes
some 60 microseconds a piece, encode() by default makes it over numpy arrays of all pieces of a block at once.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import heapq
import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import trimmed

#: A block ends with the document that brings it to this many pieces.
BLOCK_PIECES = 250_000
#: Pieces whose ids a task remembers.
CACHE_PIECES = 200_000
#: Pieces of more bytes are merged with a heap in the task, as a fold takes quadratic time.
LONG = 256
NO_PAIR = 1 << 20
RANK_BITS = 17


def read_ranks(spark: SparkSession, path: str) -> dict[bytes, int]:
    """The ranks of a tiktoken file, which the driver can open."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


def pair_ranks(ranks: dict[bytes, int]) -> dict[int, int]:
    """(left << 17 | right) -> rank of every pair of tokens that is a token."""
    out = {}
    for token, rank in ranks.items():
        for cut in range(1, len(token)):
            left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
            if left is not None and right is not None:
                out[left << RANK_BITS | right] = rank
    return out


class PairTable:
    """pair -> rank as an array of longs in which each pair has one of two places (cuckoo hashing)."""

    def __init__(self, pairs: dict[int, int]):
        self.bits = max(4, (3 * len(pairs)).bit_length())
        draw = random.Random(11)
        while True:
            self.factors = (draw.getrandbits(28) * 2 + 1, draw.getrandbits(28) * 2 + 1)
            slots = self._placed(pairs, draw)
            if slots is not None:
                self.slots = slots
                return

    def places(self, pair: int) -> tuple[int, int]:
        mask = (1 << self.bits) - 1
        return tuple((pair * f >> 24) & mask for f in self.factors)

    def _placed(self, pairs, draw):
        slots = [-1] * (1 << self.bits)
        for pair, rank in pairs.items():
            entry = pair << RANK_BITS | rank
            for turn in range(200):
                a, b = self.places(entry >> RANK_BITS)
                at = a if slots[a] < 0 else b if slots[b] < 0 else (a, b)[draw.getrandbits(1)]
                entry, slots[at] = slots[at], entry
                if entry < 0:
                    break
            else:
                return None
        return slots

    def rank(self, table: Column, left: Column, right: Column) -> Column:
        """The rank of a pair in the table's slots, or NO_PAIR."""
        pair = F.shiftleft(left.cast("long"), RANK_BITS).bitwiseOR(right)
        mask = (1 << self.bits) - 1
        one, two = (F.get(table, F.shiftright(pair * f, 24).bitwiseAND(mask).cast("int")) for f in self.factors)

        def rank(entry):
            return entry.bitwiseAND((1 << RANK_BITS) - 1).cast("int")

        return F.when(F.shiftright(one, RANK_BITS) == pair, rank(one)).when(F.shiftright(two, RANK_BITS) == pair, rank(two)).otherwise(NO_PAIR)


def bound(value: Column, body) -> Column:
    """body(value) with value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def merge_pieces(pieces: Column, slots: Column, table: PairTable) -> Column:
    """Each piece with all merges done, least rank first, leftmost first.

    A piece is a struct of s, its token ids, and r, the ranks of its adjacent pairs (NO_PAIR where there is
    none); each step of the fold makes one merge and looks up the two pairs it makes.
    """

    def step(state: Column, _):
        s, r = state["s"], state["r"]

        def merged(least: Column, at: Column) -> Column:
            left = F.when(at > 1, F.array(table.rank(slots, F.get(s, at - 2), least))).otherwise(F.array().cast("array<int>"))
            right = F.when(at < F.size(r), F.array(table.rank(slots, least, F.get(s, at + 1)))).otherwise(F.array().cast("array<int>"))
            tail = F.size(r)
            return F.struct(
                F.concat(F.slice(s, 1, at - 1), F.array(least), F.slice(s, at + 2, tail)).alias("s"),
                F.concat(F.slice(r, 1, F.greatest(at - 2, F.lit(0))), left, right, F.slice(r, at + 2, tail)).alias("r"),
            )

        def once(least: Column) -> Column:
            return F.when(least == NO_PAIR, state).otherwise(bound(F.array_position(r, least).cast("int"), lambda at: merged(least, at)))

        return bound(F.coalesce(F.array_min(r), F.lit(NO_PAIR)), once)

    def fold(piece: Column) -> Column:
        done = F.aggregate(F.sequence(F.lit(1), F.size(piece["r"])), piece, step, lambda state: state["s"])
        return F.when(F.size(piece["r"]) == 0, piece["s"]).otherwise(done)

    return F.transform(pieces, fold)


def merge_long(piece: list[int], pairs: dict[int, int]) -> list[int]:
    """The same merges over a linked list with a heap of pairs."""
    n = len(piece)
    after, before, ids = list(range(1, n + 1)), list(range(-1, n - 1)), list(piece)
    heap = []

    def offer(i):
        j = after[i]
        if j < n and (rank := pairs.get(ids[i] << RANK_BITS | ids[j])) is not None:
            heapq.heappush(heap, (rank, i, ids[i], ids[j]))

    for i in range(n - 1):
        offer(i)
    while heap:
        rank, i, a, b = heapq.heappop(heap)
        j = after[i] if ids[i] == a else n
        if j >= n or ids[j] != b:
            continue
        ids[i], ids[j] = rank, -1
        after[i] = after[j]
        if after[j] < n:
            before[after[j]] = i
        offer(i)
        if before[i] >= 0:
            offer(before[i])
    return [x for x in ids if x >= 0]


def _ascii_pattern(pattern: str):
    """The same for texts of ASCII alone, where the faster library has all classes."""
    return re.compile(pattern.replace(r"[^\s\p{L}\p{N}]", "[^\t-\r A-Za-z0-9]").replace(r"\p{L}", "[A-Za-z]").replace(r"\p{N}", "[0-9]").replace(r"\S", "[^\t-\r ]").replace(r"\s", "[\t-\r ]"))


def _pattern(pattern: str):
    """The split pattern with white space as Unicode's property, as in the rank files' own library."""
    import regex

    return regex.compile(pattern.replace(r"[^\s\p{L}\p{N}]", r"[^\p{White_Space}\p{L}\p{N}]").replace(r"\S", r"\P{White_Space}").replace(r"\s", r"\p{White_Space}"))


def merge_arrays(flat: np.ndarray, length: np.ndarray, keys: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The fold over many pieces at once: flat token ids and the pieces' lengths, before and after all merges.

    keys are the sorted pairs and ranks theirs. In each round every piece that can makes its leftmost merge of
    least rank; pieces that are done leave.
    """
    done_flat, done_length, done_piece = [], [], []
    piece = np.arange(len(length))
    flat = flat.copy()

    def rank_of(at: np.ndarray) -> np.ndarray:
        """Ranks of the pairs that start at the given places of flat."""
        pair = flat[at].astype(np.int64) << RANK_BITS | flat[at + 1]
        found = np.minimum(np.searchsorted(keys, pair), len(keys) - 1)
        return np.where(keys[found] == pair, ranks[found], NO_PAIR)

    last = np.cumsum(length) - 1
    rank = np.full(len(flat), NO_PAIR, np.int64)
    inner = np.ones(len(flat), bool)
    inner[last] = False
    inner = np.flatnonzero(inner)
    rank[inner] = rank_of(inner)
    while len(length):
        last = np.cumsum(length) - 1
        # The least (rank, place) of each piece.
        least = np.minimum.reduceat(rank * len(flat) + np.arange(len(flat)), last - length + 1)
        busy = least < NO_PAIR * len(flat)
        place = least[busy] % len(flat)
        flat[place] = least[busy] // len(flat)
        keep = np.repeat(busy, length)
        done_flat.append(flat[~keep])
        done_length.append(length[~busy])
        done_piece.append(piece[~busy])
        keep[place + 1] = False
        # What is left closes up; only the pairs beside a merge have new ranks.
        moved = np.cumsum(keep) - 1
        flat, rank, length, piece, place = flat[keep], rank[keep], length[busy] - 1, piece[busy], moved[place]
        last = np.cumsum(length) - 1
        first = last - length + 1
        rank[place] = NO_PAIR
        right = place[place < last]
        left = place[place > first] - 1
        rank[right] = rank_of(right)
        rank[left] = rank_of(left)
    flat, length, piece = np.concatenate(done_flat or [flat]), np.concatenate(done_length or [length]), np.concatenate(done_piece or [piece])
    order = np.argsort(piece, kind="stable")
    start = (np.cumsum(length) - length)[order]
    length = length[order]
    ends = np.cumsum(length)
    return flat[np.repeat(start - (ends - length), length) + np.arange(len(flat))], length


class Block:
    """Documents and the distinct pieces of their texts, numbered as they come."""

    def __init__(self):
        self.number: dict[str, int] = {}
        self.names: list = []
        self.sizes: list[int] = []
        self.places: list[int] = []

    def add(self, name, words: list[str]) -> None:
        number = self.number
        for w in set(words).difference(number):
            number[w] = len(number)
        self.places += map(number.__getitem__, words)
        self.names.append(name)
        self.sizes.append(len(words))

    def pieces(self, ranks: dict[bytes, int], pairs: dict[int, int], single: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Token ids before the merges, how many each piece has, and which pieces are final: tokens and long ones."""
        parts, final = [], []
        for w in self.number:
            raw = w.encode()
            rank = ranks.get(raw)
            if rank is not None:
                parts.append(np.array([rank], np.int32))
            else:
                part = single[np.frombuffer(raw, np.uint8)]
                parts.append(np.array(merge_long(part.tolist(), pairs), np.int32) if len(raw) > LONG else part)
            final.append(rank is not None or len(raw) > LONG)
        return np.concatenate(parts or [np.zeros(0, np.int32)]), np.array([len(p) for p in parts], np.int64), np.array(final, bool)


class Encoder:
    """The ids of pieces, with memory of those that a task met before."""

    def __init__(self, ranks: dict[bytes, int], pairs: dict[int, int], pattern: str):
        self.ranks, self.pairs = ranks, pairs
        self.keys = np.array(sorted(pairs), np.int64)
        self.values = np.array([pairs[k] for k in self.keys.tolist()], np.int64)
        self.single = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        self.any = _pattern(pattern).findall
        self.ascii = _ascii_pattern(pattern).findall
        self.known: dict[str, bytes] = {}

    def split(self, text: str) -> list[str]:
        return self.ascii(text) if text.isascii() else self.any(text)

    def _learn(self, words: list[str]) -> None:
        known, merging = self.known, []
        for w in words:
            raw = w.encode()
            if (rank := self.ranks.get(raw)) is not None:
                known[w] = rank.to_bytes(4, "little")
            elif len(raw) > LONG:
                known[w] = np.array(merge_long(self.single[np.frombuffer(raw, np.uint8)].tolist(), self.pairs), "<i4").tobytes()
            else:
                merging.append((w, raw))
        if merging:
            flat = self.single[np.frombuffer(b"".join(raw for _, raw in merging), np.uint8)]
            flat, length = merge_arrays(flat, np.array([len(raw) for _, raw in merging], np.int64), self.keys, self.values)
            raw, ends = flat.astype("<i4").tobytes(), (4 * np.cumsum(length)).tolist()
            for (w, _), a, e in zip(merging, [0, *ends[:-1]], ends):
                known[w] = raw[a:e]

    def ids(self, words) -> tuple[np.ndarray, np.ndarray]:
        """All ids of words one after another, and how many each has."""
        new = [w for w in words if w not in self.known]
        if len(self.known) + len(new) > CACHE_PIECES:
            self.known.clear()
            new = list(words)
        self._learn(new)
        found = [self.known[w] for w in words]
        return np.frombuffer(b"".join(found), "<i4"), np.array([len(x) for x in found], np.int64) // 4


_encoders: dict = {}


def _encoder(shared, pattern: str) -> Encoder:
    """One for each Python worker and vocabulary."""
    ranks, pairs = shared.value
    key = pattern, len(ranks), hash(tuple(sorted(ranks.items())[::997]))
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(ranks, pairs, pattern)
    return _encoders[key]


def _gathered(sizes: np.ndarray, places: np.ndarray, flat: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All documents' ids one after another, and where each document's end."""
    start = np.cumsum(length) - length
    count = length[places]
    ends = np.cumsum(count)
    ids = flat[np.repeat(start[places] - (ends - count), count) + np.arange(int(count.sum()))]
    return ids, np.concatenate([[0], ends])[np.cumsum(sizes)]


def _blocks(batches, find):
    block, kind = Block(), None
    for b in batches:
        kind = b.schema.field("doc_id").type
        for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text")):
            block.add(doc, find(text.as_py() or ""))
            if len(block.places) >= BLOCK_PIECES:
                yield block, kind
                block = Block()
    if block.names:
        yield block, kind


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, native: bool = False, decoded: bool = False, texts: bool = True) -> DataFrame:
    """doc_id and ids (packed little-endian unsigned 32-bit integers) of each row of docs (doc_id, text, ...).

    Null and empty texts have no ids. Every match of the pattern is a piece of its own; a piece that is a
    token is that token. Special tokens are ordinary text. Repeated rows are encoded alike. native makes the
    merges with Spark's higher-order functions; otherwise tasks make the same fold over numpy arrays. decoded gives
    the rows of decode() instead, made in the same tasks; without texts, of what they decode to only the digest leaves the tasks.
    """
    spark = docs.sparkSession
    pairs = pair_ranks(ranks)
    shared = spark.sparkContext.broadcast((ranks, pairs))  # the vocabulary's size
    kind = docs.schema["doc_id"].dataType.simpleString()
    out_schema = f"doc_id {kind}, ids binary"

    def rows(names, name_type, ids, ends):
        raw, cut = ids.astype("<u4").tobytes(), np.concatenate([[0], ends]).tolist()
        whole = pa.RecordBatch.from_arrays([pa.array(names, name_type), pa.array([raw[4 * a : 4 * e] for a, e in zip(cut[:-1], cut[1:])], pa.binary())], ["doc_id", "ids"])
        for i in range(0, whole.num_rows, 2000):
            yield whole.slice(i, 2000)

    def singles(ranks):
        return np.array([ranks[bytes([b])] for b in range(256)], np.int32)

    def arrays(batches):
        encoder = _encoder(shared, pattern)
        try:
            for block, name_type in _blocks(batches, encoder.split):
                flat, length = encoder.ids(block.number)
                yield from rows(block.names, name_type, *_gathered(np.array(block.sizes, np.int64), np.array(block.places, np.int64), flat, length))
        finally:
            encoder.known.clear()  # the worker may go on with other work

    if not native and decoded:
        shape = DECODED if texts else DECODED.replace(" decoded binary,", "")
        return docs.select("doc_id", "text").mapInArrow(trimmed(lambda batches: _decoded(arrays(batches), ranks_of(shared), texts)), f"doc_id {kind}, {shape}")
    if not native:
        return docs.select("doc_id", "text").mapInArrow(trimmed(arrays), out_schema)

    table = PairTable(pairs)
    slots = spark.sparkContext.broadcast(table.slots)

    def pack(batches):
        ranks, pairs = shared.value
        single = singles(ranks)
        for block, name_type in _blocks(batches, _pattern(pattern).findall):
            flat, length, final = block.pieces(ranks, pairs, single)
            flat, cut, pieces = flat.tolist(), [0, *np.cumsum(length).tolist()], []
            for a, e, f in zip(cut[:-1], cut[1:], final.tolist()):
                s = flat[a:e]
                pieces.append({"s": s, "r": [] if f else [pairs.get(x << RANK_BITS | y, NO_PAIR) for x, y in zip(s, s[1:])]})
            yield pa.RecordBatch.from_pylist(
                [{"doc_ids": block.names, "sizes": block.sizes, "places": block.places, "slots": slots.value, "pieces": pieces}],
                pa.schema([("doc_ids", pa.list_(name_type)), ("sizes", pa.list_(pa.int32())), ("places", pa.list_(pa.int32())), ("slots", pa.list_(pa.int64())), ("pieces", pa.list_(pa.struct([("s", pa.list_(pa.int32())), ("r", pa.list_(pa.int32()))])))]),
            )

    def unpack(batches):
        for b in batches:
            name_type = b.schema.field("doc_ids").type.value_type
            for k in range(b.num_rows):
                names, sizes, places, pieces = (b.column(c)[k].values for c in ("doc_ids", "sizes", "places", "pieces"))
                flat, length = pieces.flatten().to_numpy(), np.diff(pieces.offsets.to_numpy())
                yield from rows(names, name_type, *_gathered(sizes.to_numpy().astype(np.int64), places.to_numpy().astype(np.int64), flat, length.astype(np.int64)))

    packed = docs.select("doc_id", "text").mapInArrow(pack, f"doc_ids array<{kind}>, sizes array<int>, places array<int>, slots array<long>, pieces array<struct<s:array<int>,r:array<int>>>")
    return packed.select("doc_ids", "sizes", "places", merge_pieces(F.col("pieces"), F.col("slots"), table).alias("pieces")).mapInArrow(unpack, out_schema)


DECODED = "n_tokens long, ids_sha256 string, decoded binary, decoded_sha256 string"


def ranks_of(shared) -> dict[bytes, int]:
    return shared.value[0]


def _decoded(batches, ranks: dict[bytes, int], texts: bool = True):
    size = max(ranks.values()) + 1
    raw, text = [b""] * size, [str(i).encode() for i in range(size)]
    for token, rank in ranks.items():
        raw[rank] = token
    names = ["doc_id", "n_tokens", "ids_sha256", *["decoded"] * texts, "decoded_sha256"]
    for b in batches:
        count, digest, whole, of_whole = [], [], [], []
        for x in b.column("ids"):
            ids = np.frombuffer(x.as_buffer(), "<u4").tolist()
            count.append(len(ids))
            digest.append(hashlib.sha256(b",".join(map(text.__getitem__, ids))).hexdigest())
            piece = b"".join(map(raw.__getitem__, ids))
            of_whole.append(hashlib.sha256(piece).hexdigest())
            if texts:
                whole.append(piece)
        columns = [pa.array(count, pa.int64()), pa.array(digest, pa.string()), *[pa.array(whole, pa.binary())] * texts, pa.array(of_whole, pa.string())]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), *columns], names)


def decode(encoded: DataFrame, ranks: dict[bytes, int]) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of the decimal ids joined by commas), decoded (bytes) and decoded_sha256 of
    rows of encode()."""
    shared = encoded.sparkSession.sparkContext.broadcast((ranks, None))
    kind = encoded.schema["doc_id"].dataType.simpleString()
    return encoded.mapInArrow(lambda batches: _decoded(batches, ranks_of(shared)), f"doc_id {kind}, {DECODED}")
