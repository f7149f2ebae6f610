"""Documents whose sets of word shingles have a Jaccard similarity at or over a threshold.

A grouped prefix join. Tokens (shingle hashes) have one order over the corpus: first those that a
merged sketch finds in one document only, then by rising coarse count, then by hash. A set of n tokens can
only reach the threshold t with another if their prefixes, the first n - ceil(t n) + 1 tokens, share one.
Equal sets are one row from the start. In the bucket of a prefix token, rows with the same prefix
and size form a group; pairs of groups are filtered by size and position, then expanded to members, which are
filtered by a lower bound of the symmetric difference (parity bitmaps) and verified on the whole sets. A pair counts
in the bucket of its first common token only, as far as the first tokens that a row carries can tell.

No pairs within a group are emitted. The first round deals each bucket out in blocks and emits a spanning forest of a
block's likely links, which are verified. The second takes buckets of several blocks, and of the others the rows with likely
links only, and compares what is then in different components: block
against block, so that no task holds a bucket; the rows that are still near across components come together again
with their whole sets, are verified in the block, and again only a forest of true links leaves it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Words, maybe_broadcast, mix, slices, text_bytes, trimmed, windows, written
from .components import components

CHUNK = 1 << 16
#: Tokens with hashes in the lowest 1/REGION come first in a document's order and have exact single counts.
REGION = 4
#: The sketch's bitmap for them: four counters a token, between these (the most is 16 MB when broadcast).
LEAST_WIDTH, MOST_WIDTH = 1 << 20, 1 << 27
#: Counters for coarse counts of all tokens, kept as one byte each.
COARSE = 1 << 20
#: Rows of a bucket that one block holds, more or less, in the two rounds, and tokens in the second; larger buckets are split.
FIRST_ROWS, BUCKET_ROWS, BUCKET_TOKENS = 256, 1024, 1 << 20
#: Prefix tokens that a row carries to tell whether a pair has met before.
CARRIED = 8
#: Rows held before their blocks are compared, pairs compared at once and pairs verified at once.
HELD_ROWS, PAIRS, VERIFIED = 4096, 1 << 16, 1024


def token_sets(data, at, k):
    """(row, token) of the distinct shingles of each row, sorted by row and token, and the words of each row."""
    w = Words(data, at, lower=True)
    starts = w.runs(k)
    token, row = windows(w.hash[0], k)[starts], w.row[starts]
    short = np.flatnonzero((w.count > 0) & (w.count < k))
    if len(short):
        extra = [mix(windows(w.hash[0][w.first[r] : w.first[r + 1]], int(w.count[r])) + np.uint64(int(w.count[r])))[0] for r in short]
        token, row = np.concatenate([token, np.array(extra, np.uint64)]), np.concatenate([row, short])
    order = np.lexsort((token, row))
    token, row = token[order], row[order]
    new = np.ones(len(token), bool)
    new[1:] = (token[1:] != token[:-1]) | (row[1:] != row[:-1])
    return row[new], token[new], w.count


def _needed(n, num, den):
    """ceil(num n / den)"""
    return (n * num + den - 1) // den


def _bits(n: int, each: int = 1) -> int:
    """The width of the parity bitmap of a set of n tokens, about `each` bits a token."""
    return min(8192 * each, max(512 * each, 1 << max(0, each * n - 1).bit_length()))


def parity(tokens: np.ndarray, width: int) -> bytes:
    odd = np.bincount((tokens & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1
    return np.packbits(odd.astype(bool), bitorder="little").tobytes()


class Bitmaps:
    """Parity bitmaps of rows, of different widths."""

    def __init__(self, bits: list[bytes]):
        self.bits = bits
        self.width = np.array([8 * len(b) for b in bits], np.int64)
        self.made: dict = {}

    def folded(self, width: int):
        """All bitmaps of at least this width as one matrix of words at that width, and each row's place in it."""
        if width not in self.made:
            place, parts, n = np.zeros(len(self.bits), np.int64), [], 0
            for w in np.unique(self.width[self.width >= width]).tolist():
                own = np.flatnonzero(self.width == w)
                m = np.frombuffer(b"".join([self.bits[r] for r in own.tolist()]), np.uint64).reshape(len(own), w // 64)
                while m.shape[1] * 64 > width:
                    half = m.shape[1] // 2
                    m = m[:, :half] ^ m[:, half:]
                place[own] = n + np.arange(len(own))
                parts.append(m)
                n += len(own)
            self.made[width] = np.concatenate(parts), place
        return self.made[width]

    def apart(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """A lower bound of the size of the symmetric difference of rows i and j."""
        out, to = np.zeros(len(i), np.int64), np.minimum(self.width[i], self.width[j])
        for width in np.unique(to).tolist():
            m, place = self.folded(width)
            own = np.flatnonzero(to == width)
            step = max(1, (1 << 18) // (width // 64))
            for s in range(0, len(own), step):
                x = own[s : s + step]
                out[x] = np.bitwise_count(m[place[i[x]]] ^ m[place[j[x]]]).sum(1, dtype=np.int64)
        return out


def _chunks(n: np.ndarray, most: int):
    """Runs (start, end) of items whose n sum up to about `most`."""
    total, at = np.cumsum(n), 0
    while at < len(n):
        end = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + most, side="right")))
        yield at, end
        at = end


def _inside(n: np.ndarray) -> np.ndarray:
    """0 .. n[k] - 1 for each k in turn."""
    return np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)


class Blocks:
    """Rows of whole blocks, sorted by block, side (id = lo first) and group, as columns."""

    def __init__(self, rows: pa.Table, num: int, den: int):
        self.num, self.den = num, den
        get = lambda c: rows.column(c).to_numpy()
        token, lo, hi, side, n, pos, prefix = (get(c) for c in ("token", "lo", "hi", "id", "n", "pos", "prefix"))
        side = (side != lo).astype(np.int64)
        order = np.lexsort((pos, n, prefix, side, hi, lo, token))
        self.rows = rows.take(pa.array(order))
        token, lo, hi, side, self.n, self.pos, prefix = (x[order] for x in (token, lo, hi, side, n.astype(np.int64), pos.astype(np.int64), prefix))
        new = np.ones(len(token), bool)
        new[1:] = (token[1:] != token[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])
        self.block = np.cumsum(new) - 1
        group = new.copy()
        group[1:] |= (side[1:] != side[:-1]) | (prefix[1:] != prefix[:-1]) | (self.n[1:] != self.n[:-1]) | (self.pos[1:] != self.pos[:-1])
        self.start = np.flatnonzero(group)
        self.size = np.diff(np.append(self.start, len(token)))
        # Where the groups that a group meets begin and end: those after it, or those of the other side.
        block_of, side_of, one = self.block[self.start], side[self.start], (lo == hi)[self.start]
        ends = np.searchsorted(block_of, np.arange(self.block[-1] + 1 if len(token) else 0), side="right")
        across = np.searchsorted(block_of * 2 + side_of, 2 * block_of + 1)
        self.first = np.where(one, np.arange(len(self.start)), np.where(side_of == 0, across, ends[block_of] if len(token) else 0))
        self.last = ends[block_of] if len(token) else self.first

    def pairs(self, bitmaps: Bitmaps, component: np.ndarray | None, carried=None, most: int = PAIRS):
        """(i, j, distance) of the pairs of rows that pass all filters, in pieces; of different components, if given."""
        num, den = self.num, self.den
        count = self.last - self.first
        for s, e in _chunks(count, most):
            g = np.repeat(np.arange(s, e), count[s:e])
            h = self.first[g] + _inside(count[s:e])
            a, b = self.n[self.start[g]], self.n[self.start[h]]
            i, j = self.pos[self.start[g]], self.pos[self.start[h]]
            both = np.minimum(i, j) + np.minimum(a - i, b - j)  # tokens they can share at most
            good = (np.minimum(a, b) * den >= np.maximum(a, b) * num) & (both * (num + den) >= num * (a + b))
            g, h = g[good], h[good]
            n = self.size[g] * self.size[h]
            for s2, e2 in _chunks(n, most):
                x, y, m = g[s2:e2], h[s2:e2], n[s2:e2]
                k, wide = _inside(m), np.repeat(self.size[y], m)
                i, j, same = np.repeat(self.start[x], m) + k // wide, np.repeat(self.start[y], m) + k % wide, np.repeat(x == y, m)
                keep = ~same | (i < j)
                if component is not None:
                    keep &= component[i] != component[j]
                i, j = i[keep], j[keep]
                apart = bitmaps.apart(i, j)
                keep = apart * (num + den) <= (den - num) * (self.n[i] + self.n[j])
                i, j, apart = i[keep], j[keep], apart[keep]
                if carried is not None and len(i):
                    keep = ~carried(i, j)
                    i, j, apart = i[keep], j[keep], apart[keep]
                if len(i):
                    yield i, j, apart / (self.n[i] + self.n[j])


class Carried:
    """Whether two rows share one of the first tokens that come before their bucket's, and so have met before."""

    def __init__(self, tokens: list[bytes], before: np.ndarray):
        self.n = np.minimum([len(t) // 8 for t in tokens], before)
        self.tokens = np.frombuffer(b"".join([t.ljust(8 * CARRIED, b"\0") for t in tokens]), np.uint64).reshape(len(tokens), CARRIED)

    def __call__(self, i, j):
        out = np.zeros(len(i), bool)
        for s in range(0, len(i), PAIRS // 8):
            a, b = i[s : s + PAIRS // 8], j[s : s + PAIRS // 8]
            for x in range(CARRIED):
                for y in range(CARRIED):
                    out[s : s + len(a)] |= (self.tokens[a, x] == self.tokens[b, y]) & (x < self.n[a]) & (y < self.n[b])
        return out


def forest(i: np.ndarray, j: np.ndarray, weight: np.ndarray, nodes: int) -> np.ndarray:
    """Edges (as positions) that join all that the given ones join, light ones first, without a circle."""
    root, out, live = np.arange(nodes), [], np.arange(len(i))
    while True:
        live = live[root[i[live]] != root[j[live]]]
        if not len(live):
            return np.array(out, np.int64)
        a, b = root[i[live]], root[j[live]]
        low, high = np.minimum(a, b), np.maximum(a, b)
        order = np.lexsort((weight[live], high))
        first = order[np.concatenate([[True], high[order][1:] != high[order][:-1]])]
        out.extend(live[first].tolist())
        root[high[first]] = low[first]
        while (root[root] != root).any():
            root = root[root]


def whole_blocks(batches, most: int):
    """Tables of whole blocks (token, lo, hi) of sorted batches, of about `most` rows if blocks are smaller."""
    held, n = [], 0
    for b in batches:
        held.append(b)
        n += b.num_rows
        if n < most:
            continue
        rows = pa.Table.from_batches(held).combine_chunks()
        key = [rows.column(c).to_numpy() for c in ("token", "lo", "hi")]
        last = np.flatnonzero((key[0] != key[0][-1]) | (key[1] != key[1][-1]) | (key[2] != key[2][-1]))
        cut = int(last[-1]) + 1 if len(last) else 0
        if cut:
            yield rows.slice(0, cut).combine_chunks()
        held = rows.slice(cut).to_batches()
        n = rows.num_rows - cut
    if n:
        yield pa.Table.from_batches(held).combine_chunks()


class Similarity:
    """The join's parameters: shingles of k words, threshold num / den."""

    def __init__(self, k: int, num: int, den: int):
        self.k, self.num, self.den = k, num, den

    def sets(self, docs: DataFrame) -> DataFrame:
        """doc_id, key, n_shingles and 128 bits of digest of each document's set."""
        k = self.k

        def run(batches):
            for b in batches:
                data, at = text_bytes(b.column("text"))
                for i, j in slices(at):
                    row, token, _ = token_sets(data, at[i : j + 1], k)
                    n = np.bincount(row, minlength=j - i)
                    first = np.searchsorted(row, np.arange(j - i))
                    sums = []
                    for salt in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F):
                        with np.errstate(over="ignore"):
                            total = np.concatenate([[np.uint64(0)], np.cumsum(mix(token + np.uint64(salt)), dtype=np.uint64)])
                            sums.append((total[first + n] - total[first]).view(np.int64))
                    yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(i, j - i), b.column("key").slice(i, j - i), pa.array(n.astype(np.int64)), pa.array(sums[0]), pa.array(sums[1])], ["doc_id", "key", "n_shingles", "s1", "s2"])

        kind = docs.schema["doc_id"].dataType.simpleString()
        return docs.mapInArrow(trimmed(run), f"doc_id {kind}, key long, n_shingles long, s1 long, s2 long")

    def counts(self, docs: DataFrame, width: int):
        """Rows of the merged sketches: a bitmap of region counters that two documents reached, and coarse counts."""
        k = self.k

        def count(batches):
            region, coarse = [], np.zeros(COARSE, np.int64)
            for b in batches:
                data, at = text_bytes(b.column("text"))
                for i, j in slices(at):
                    _, token, _ = token_sets(data, at[i : j + 1], k)
                    coarse += np.bincount((token & np.uint64(COARSE - 1)).astype(np.int64), minlength=COARSE)
                    low = token[token < np.uint64((1 << 64) // REGION)]
                    region.append((mix(low) & np.uint64(width - 1)).astype(np.uint32))
            names = ["kind", "chunk", "seen", "again"]
            if region:
                place, n = np.unique(np.concatenate(region), return_counts=True)
                chunk, low, twice = place // CHUNK, (place % CHUNK).astype(np.uint16), n > 1
                cut = np.flatnonzero(np.concatenate([[True], chunk[1:] != chunk[:-1]])) if len(place) else np.zeros(0, int)
                ends = [*cut[1:], len(low)]
                yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(cut), np.int32)), pa.array(chunk[cut].astype(np.int32)), pa.array([low[a:e].tobytes() for a, e in zip(cut, ends)], pa.binary()), pa.array([low[a:e][twice[a:e]].tobytes() for a, e in zip(cut, ends)], pa.binary())], names)
                parts = np.minimum(coarse, 65535).astype(np.uint16).reshape(-1, CHUNK)
                yield pa.RecordBatch.from_arrays([pa.array(np.ones(len(parts), np.int32)), pa.array(np.arange(len(parts), dtype=np.int32)), pa.array([p.tobytes() for p in parts], pa.binary()), pa.array([b""] * len(parts), pa.binary())], names)

        def merge(batches):
            found: dict = {}
            for b in batches:
                for r in b.to_pylist():
                    at = r["kind"], r["chunk"]
                    if at not in found:
                        found[at] = np.zeros(CHUNK, np.int64 if r["kind"] else np.uint8)
                    if r["kind"]:
                        found[at] += np.frombuffer(r["seen"], np.uint16)
                    else:
                        for name in ("seen", "again"):
                            place = np.frombuffer(r[name], np.uint16)
                            found[at][place] = np.minimum(found[at][place] + 1, 2)
            for (kind, chunk), c in found.items():
                bits = np.log2(np.maximum(c, 1)).astype(np.uint8) if kind else np.packbits(c > 1)
                yield pa.RecordBatch.from_pylist([{"kind": kind, "chunk": chunk, "bits": bits.tobytes()}], pa.schema([("kind", pa.int32()), ("chunk", pa.int32()), ("bits", pa.binary())]))

        parts = docs.select("text").mapInArrow(trimmed(count), "kind int, chunk int, seen binary, again binary")
        return parts.repartition("kind", "chunk").mapInArrow(trimmed(merge), "kind int, chunk int, bits binary")

    def index(self, docs: DataFrame, width: int, shared) -> DataFrame:
        """A row for each prefix token that another document may have: token, doc_id, n, pos, before (such tokens ahead of
        it), prefix (hash of all), the set's parity bitmap and the first of its tokens."""
        k, num, den = self.k, self.num, self.den
        names = ["token", "doc_id", "n", "pos", "before", "prefix", "bits", "carried"]

        def run(batches):
            often, coarse = shared.value
            common = np.log2(max(1.0, coarse[1])) + 1
            for b in batches:
                data, at = text_bytes(b.column("text"))
                for i, j in slices(at):
                    row, token, _ = token_sets(data, at[i : j + 1], k)
                    level = np.maximum(0, coarse[0][(token & np.uint64(COARSE - 1)).astype(np.int64)] - common).astype(np.int8) + 2
                    place = (mix(token) & np.uint64(width - 1)).astype(np.int64)
                    alone = (often[place >> 3] >> (7 - (place & 7)) & 1) == 0
                    inside = token < np.uint64((1 << 64) // REGION)
                    rank = np.where(inside & alone, 0, np.where(inside, level, level + 1)).astype(np.int8)
                    order = np.lexsort((token, rank, row))
                    token_o, rank_o = token[order], rank[order]
                    n = np.bincount(row, minlength=j - i)
                    first = np.searchsorted(row, np.arange(j - i))
                    size = np.where(n > 0, n - _needed(n, num, den) + 1, 0)
                    own = np.array([np.count_nonzero(rank_o[f : f + s] == 0) for f, s in zip(first, size)], np.int64)
                    live = np.flatnonzero(own < size)
                    if not len(live):
                        continue
                    prefix, bits, carried = [], [], []
                    for r in live.tolist():
                        f, s, o, m = int(first[r]), int(size[r]), int(own[r]), int(n[r])
                        bits.append(parity(token[f : f + m], _bits(m)))
                        carried.append(token_o[f + o : f + min(s, o + CARRIED)].tobytes())
                        with np.errstate(over="ignore"):
                            prefix.append(int(mix(np.add.reduce(token_o[f : f + s] * (2 * np.arange(s, dtype=np.uint64) + np.uint64(1))) + np.uint64(m)).view(np.int64)))
                    times = (size - own)[live]
                    of, before = pa.array(np.repeat(np.arange(len(live)), times)), _inside(times)
                    pos = before + np.repeat(own[live], times)
                    out = pa.RecordBatch.from_arrays([
                        pa.array(token_o[np.repeat(first[live], times) + pos].view(np.int64)), b.column("doc_id").take(pa.array(np.repeat(live + i, times))),
                        *(pa.array(c.astype(np.int32)) for c in (np.repeat(n[live], times), pos, before)),
                        pa.array(prefix, pa.int64()).take(of), pa.array(bits, pa.binary()).take(of), pa.array(carried, pa.binary()).take(of),
                    ], names)
                    for c in range(0, out.num_rows, 20_000):
                        yield out.slice(c, 20_000)

        return docs.select("doc_id", "text").mapInArrow(trimmed(run), f"token long, doc_id {docs.schema['doc_id'].dataType.simpleString()}, n int, pos int, before int, prefix long, bits binary, carried binary")

    def hot(self, index: DataFrame) -> DataFrame:
        """The tokens of more than one block, and their rows (_n)."""
        return written(index.groupBy("token").agg(F.count("*").alias("_n")).where(F.col("_n") > FIRST_ROWS), "hot-tokens")

    def dealt(self, index: DataFrame, hot: DataFrame) -> DataFrame:
        """The rows with the block (lo = hi = id) of their token that each is in. Any split will do: the second round tries what
        blocks keep apart. It differs by token, so blocks of other tokens join them. Only tokens of more than one block, a
        few, are joined."""
        block = F.coalesce(F.pmod(F.xxhash64("doc_id", "token"), F.ceil(F.col("_n") / FIRST_ROWS)), F.lit(0)).cast("long")
        return index.join(maybe_broadcast(hot, 24), "token", "left").withColumn("id", block).withColumns({"lo": F.col("id"), "hi": F.col("id")}).drop("_n")

    def unsettled(self, index: DataFrame, hot: DataFrame, pairs: DataFrame) -> DataFrame:
        """The rows that the second round compares. The first compared all rows of a token of one block, by the same filters: of these only
        rows that were likely to link there can be near another. Of hot tokens it did not compare all, so all their rows stay."""
        some = pairs.select("token", F.explode(F.array("a", "b")).alias("doc_id")).join(maybe_broadcast(hot, 24), "token", "left_anti").distinct()
        cold = index.join(maybe_broadcast(written(some, "likely-rows"), 32), ["token", "doc_id"], "left_semi")
        return cold.unionByName(index.join(maybe_broadcast(hot, 24), "token", "left_semi"))

    def across_dealt(self, live: DataFrame, wide: DataFrame) -> DataFrame:
        """The rows (live), once for each two blocks (lo, hi) of their token that they are compared in; id is the row's block.
        wide has the tokens of more than one block and whether they are mixed, of several components; those that are not have nothing
        to compare and are left out. Other tokens are one block. All pairs across components meet: a
        large component has blocks of its own that need not meet each other, smaller ones share blocks, and all other blocks
        meet, themselves included."""
        zero = F.lit(0).cast("long")
        small = live.join(maybe_broadcast(wide.select("token"), 24), "token", "left_anti").withColumns({"id": zero, "lo": zero, "hi": zero})
        mixed = wide.where("mixed").select("token")
        if mixed.isEmpty():
            return small
        rows = live.join(maybe_broadcast(mixed, 24), "token", "left_semi")
        sizes = written(rows.groupBy("token", "component").agg(self.blocks().alias("blocks")), "component-sizes")
        own = F.col("blocks") * 2 >= 1
        shared = written(sizes.where(~own).groupBy("token").agg(F.ceil(F.sum("blocks")).cast("long").alias("shared")), "shared-blocks")
        # A few rows a token: components of half a block or more.
        before = Window.partitionBy("token").orderBy("component").rowsBetween(Window.unboundedPreceding, -1)
        large = sizes.where(own).select("token", "component", F.ceil("blocks").cast("long").alias("parts"))
        large = large.withColumn("before", F.coalesce(F.sum("parts").over(before), zero)).join(shared, "token", "left")
        large = written(large.select("token", "component", "parts", (F.col("before") + F.coalesce("shared", zero)).alias("first")), "own-blocks")
        blocks = large.select("token", F.col("component").alias("owner"), F.explode(F.expr("sequence(first, first + parts - 1)")).alias("id"))
        blocks = written(blocks.unionByName(shared.select("token", F.lit(None).cast(live.schema["component"].dataType).alias("owner"), F.explode(F.expr("sequence(0L, shared - 1)")).alias("id"))), "blocks")
        meet = blocks.alias("x").join(blocks.alias("y"), "token").where("x.id <= y.id AND (x.owner IS NULL OR y.owner IS NULL OR x.owner != y.owner)")
        meet = meet.select("token", F.col("x.id").alias("lo"), F.col("y.id").alias("hi")).withColumn("id", F.explode(F.array_distinct(F.array("lo", "hi"))))
        rows = rows.join(maybe_broadcast(large), ["token", "component"], "left").join(maybe_broadcast(shared, 24), "token", "left")
        block = F.coalesce(F.col("first") + F.pmod(F.xxhash64("doc_id", "token"), F.col("parts")), F.pmod(F.xxhash64("component"), F.col("shared")))
        rows = rows.withColumn("id", block).drop("parts", "first", "shared").join(maybe_broadcast(written(meet, "meeting")), ["token", "id"])
        return small.unionByName(rows)

    @staticmethod
    def blocks():
        """The blocks' worth of rows (an aggregate): a block is full by rows or by the tokens of their sets."""
        return F.sum(F.greatest(F.lit(1.0) / BUCKET_ROWS, F.col("n") / float(BUCKET_TOKENS)))

    def likely(self, dealt: DataFrame) -> DataFrame:
        """Pairs (token, a, b): a forest of the likely links of each block. A row that is likely to link with any of its block is in one."""
        num, den, held, most = self.num, self.den, HELD_ROWS, PAIRS
        kind = dealt.schema["doc_id"].dataType.simpleString()

        def run(batches):
            for table in whole_blocks(batches, held):
                rows = Blocks(table, num, den)
                carried = Carried(rows.rows.column("carried").to_pylist(), rows.rows.column("before").to_numpy())
                found = [*rows.pairs(Bitmaps(rows.rows.column("bits").to_pylist()), None, carried, most)]
                if found:
                    i, j, weight = (np.concatenate(x) for x in zip(*found))
                    at, ids = forest(i, j, weight, len(rows.n)), rows.rows.column("doc_id").combine_chunks()
                    yield pa.RecordBatch.from_arrays([rows.rows.column("token").combine_chunks().take(pa.array(i[at])), ids.take(pa.array(i[at])), ids.take(pa.array(j[at]))], ["token", "a", "b"])

        pairs = dealt.repartition("token", "lo", "hi").sortWithinPartitions("token", "lo", "hi").mapInArrow(trimmed(run), f"token long, a {kind}, b {kind}")
        return pairs.where("a != b").select("token", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()

    def near_across(self, dealt: DataFrame) -> DataFrame:
        """The rows (token, lo, hi, id, doc_id, component) of each block that may link with one of another component there."""
        num, den, held, most = self.num, self.den, HELD_ROWS, PAIRS
        names = ["token", "lo", "hi", "id", "doc_id", "component"]

        def run(batches):
            for table in whole_blocks(batches, held):
                rows = Blocks(table, num, den)
                component = rows.rows.column("component").combine_chunks().dictionary_encode().indices.to_numpy()
                carried = Carried(rows.rows.column("carried").to_pylist(), rows.rows.column("before").to_numpy())
                near = np.zeros(len(rows.n), bool)
                for i, j, _ in rows.pairs(Bitmaps(rows.rows.column("bits").to_pylist()), component, carried, most):
                    near[i] = near[j] = True
                if near.any():
                    yield from rows.rows.select(names).filter(pa.array(near)).combine_chunks().to_batches()

        kinds = {f.name: f.dataType.simpleString() for f in dealt.schema}
        return dealt.repartition("token", "lo", "hi").sortWithinPartitions("token", "lo", "hi").mapInArrow(trimmed(run), ", ".join(f"{c} {kinds[c]}" for c in names))

    def links_across(self, near: DataFrame) -> DataFrame:
        """Links (a, b) that join the components of each block: a forest of them. near has the rows' whole sets (tokens)."""
        num, den, held, most, verified = self.num, self.den, HELD_ROWS, PAIRS, VERIFIED
        kind = near.schema["doc_id"].dataType.simpleString()

        def reach(x, y):
            both = np.count_nonzero(y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x)
            return both * den >= num * (len(x) + len(y) - both)

        def run(batches):
            for table in whole_blocks(batches, held):
                sets = [np.frombuffer(t.as_buffer(), np.uint64) for t in table.column("tokens")]
                n = pa.array([len(t) for t in sets], pa.int64())
                table = table.append_column("n", n).append_column("pos", pa.array(np.zeros(len(n), np.int64))).append_column("prefix", n).append_column("at", pa.array(np.arange(len(n))))
                rows = Blocks(table, num, den)
                sets = [sets[k] for k in rows.rows.column("at").to_pylist()]
                component = rows.rows.column("component").combine_chunks().dictionary_encode().indices.to_numpy().astype(np.int64)
                _, code = np.unique(rows.block * (component.max() + 1) + component, return_inverse=True)
                root, links = np.arange(code.max() + 1), []
                for i, j, weight in rows.pairs(Bitmaps([parity(t, _bits(len(t), 8)) for t in sets]), component, None, most):
                    # The nearest first; most of the others are of one component by then.
                    order = np.argsort(weight, kind="stable")
                    for s in range(0, len(order), verified):
                        some = order[s : s + verified]
                        for k in some[root[code[i[some]]] != root[code[j[some]]]].tolist():
                            a, b = sorted((root[code[i[k]]], root[code[j[k]]]))
                            if a != b and reach(sets[i[k]], sets[j[k]]):
                                root[root == b] = a
                                links.append((i[k], j[k]))
                if links:
                    ids, at = rows.rows.column("doc_id").combine_chunks(), np.array(links)
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(at[:, 0])), ids.take(pa.array(at[:, 1]))], ["a", "b"])

        return near.repartition("token", "lo", "hi").sortWithinPartitions("token", "lo", "hi").mapInArrow(trimmed(run), f"a {kind}, b {kind}")

    def sets_of(self, docs: DataFrame, nodes: DataFrame) -> DataFrame:
        """node and tokens (the whole set, sorted, 8 bytes each) of the documents whose doc_id is in nodes (a written table)."""
        k, kind = self.k, docs.schema["doc_id"].dataType.simpleString()

        def sets(batches):
            for b in batches:
                data, at = text_bytes(b.column("text"))
                for i, j in slices(at):
                    row, token, _ = token_sets(data, at[i : j + 1], k)
                    cut = np.searchsorted(row, np.arange(j - i + 1))
                    yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(i, j - i), pa.array([token[s:e].tobytes() for s, e in zip(cut[:-1], cut[1:])], pa.binary())], ["node", "tokens"])

        return written(docs.select("doc_id", "text").join(maybe_broadcast(nodes), "doc_id", "left_semi").mapInArrow(trimmed(sets), f"node {kind}, tokens binary"), "token-sets")

    def verified(self, pairs: DataFrame, docs: DataFrame) -> DataFrame:
        """Those pairs (a, b) whose whole sets reach the threshold."""
        num, den = self.num, self.den
        kind = docs.schema["doc_id"].dataType.simpleString()

        def check(batches):
            for b in batches:
                good = []
                for x, y in zip(b.column("x"), b.column("y")):
                    p, q = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                    both = np.count_nonzero(q[np.minimum(np.searchsorted(q, p), len(q) - 1)] == p)
                    good.append(both * den >= num * (len(p) + len(q) - both))
                yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], ["a", "b"]).filter(pa.array(good, pa.bool_()))

        own = self.sets_of(docs, written(pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct(), "nodes"))
        both = pairs.join(own.select(F.col("node").alias("a"), F.col("tokens").alias("x")), "a").join(own.select(F.col("node").alias("b"), F.col("tokens").alias("y")), "b")
        return both.select("a", "b", "x", "y").mapInArrow(trimmed(check), f"a {kind}, b {kind}")

    def join(self, docs: DataFrame) -> DataFrame:
        """doc_id, n_shingles, component_id of each row of docs (doc_id, text, ...).

        component_id is the least doc_id reachable by links, itself included. Links are found only as far as
        components need them, not all of them, so links are not counted. Null and empty texts have no
        shingles and link with nothing; texts of fewer than k words have their whole sequence as one
        shingle. Repeated rows are equal sets and so linked; rows under one doc_id are one node. A null
        doc_id links with nothing and has a null component.
        """
        spark = docs.sparkSession
        docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("key", F.xxhash64("text"))
        whole = written(self.sets(docs), "sets")
        full = whole.where("n_shingles > 0 AND doc_id IS NOT NULL")
        firsts = full.groupBy("n_shingles", "s1", "s2").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").drop("last")
        firsts = maybe_broadcast(written(firsts, "first-copies"))  # else both sides are shuffled, and a large group is split
        copies = written(full.join(firsts, ["n_shingles", "s1", "s2"]).where("doc_id > first").select("doc_id", "key", "first").distinct(), "copies")
        rest = docs.where("doc_id IS NOT NULL").join(maybe_broadcast(copies.select("doc_id", "key")), ["doc_id", "key"], "left_anti").select("doc_id", "text")

        total = full.agg(F.sum("n_shingles")).head()[0] or 0
        width = LEAST_WIDTH
        while width < min(MOST_WIDTH, 4 * total // REGION):
            width *= 2
        # One bitmap of at most 16 MB and 1 MB of coarse counts.
        often, coarse = np.zeros(width // 8, np.uint8), np.zeros(COARSE, np.uint8)
        for r in self.counts(rest, width).toLocalIterator():
            to, step = (coarse, CHUNK) if r["kind"] else (often, CHUNK // 8)
            to[r["chunk"] * step : (r["chunk"] + 1) * step] = np.frombuffer(r["bits"], np.uint8)
        shared = spark.sparkContext.broadcast((often, (coarse, total / COARSE)))

        index = written(self.index(rest, width, shared), "prefixes")
        hot = self.hot(index)
        pairs = written(self.likely(self.dealt(index, hot)), "likely-links")
        links = written(self.verified(pairs.select("a", "b").distinct(), rest), "links")
        # What the first round has not joined: buckets of more than one component, across components.
        found = written(components(links), "components").withColumnRenamed("node", "doc_id")
        live = written(self.unsettled(index, hot, pairs), "unsettled").join(maybe_broadcast(found), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
        wide = live.groupBy("token").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), self.blocks().alias("blocks")).where("blocks > 1")
        wide = written(wide.select("token", (F.col("lo") < F.col("hi")).alias("mixed")), "wide-tokens")
        near = written(self.near_across(self.across_dealt(live, wide)), "near-rows")
        sets = self.sets_of(rest, written(near.select("doc_id").distinct(), "nodes"))
        across = self.links_across(near.join(sets.withColumnRenamed("node", "doc_id"), "doc_id"))
        edges = links.unionByName(across).unionByName(copies.select(F.col("doc_id").alias("a"), F.col("first").alias("b")))
        found = written(components(edges), "components").withColumnRenamed("node", "doc_id")
        return whole.join(found, "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
