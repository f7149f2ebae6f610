"""Product codes of vectors by dual-tree Lloyd: a tree over the parts of a block of vectors, one over the entries of their codebook.

Boxes of both trees bound the distance of any part in a node to any entry in another. A pair of nodes is dropped once another pair
bounds the same parts nearer; where one entry is left for a node of parts, the whole node takes it, and its cached sum and count
move the entry. Parts in leaves with several entries left are compared by their integers. All bounds are integers, too, so
nothing is rounded and ties are seen. Tasks send a sum for each entry, however many vectors they hold.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import maybe_broadcast, trimmed, written

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Integers are held within this, so that squared distances of 8,192 components fit 64 bits.
MOST = 1 << 24
#: Components of the vectors that a tree is made of, and parts of a leaf.
BLOCK_VALUES, LEAF = 1 << 20, 8


class Tree:
    """A balanced tree over points (n, m): each level halves the nodes of the one above along their widest dimension.

    order: the points in the tree's order. bounds[l][i] and bounds[l][i + 1]: the range of node i of level l in it. kids[l][i]
    and kids[l][i + 1]: its children's range in the next level. low, high: boxes. Leaves hold `leaf` points at most; with a leaf of
    one, the last level is the points themselves.
    """

    def __init__(self, points: np.ndarray, leaf: int):
        n = len(points)
        self.order = np.arange(n)
        depth = 0
        while n >> depth > leaf and n >> (depth + 1) > 0:
            depth += 1
        self.bounds, self.kids, self.low, self.high = [], [], [], []
        for level in range(depth + 1):
            bounds = np.arange((1 << level) + 1) * n >> level
            self._add(points[self.order], bounds)
            if level < depth:
                node = np.repeat(np.arange(1 << level), np.diff(bounds))
                widest = (self.high[-1] - self.low[-1]).argmax(axis=1)
                self.order = self.order[np.lexsort((points[self.order, widest[node]], node))]
                self.kids.append(np.arange(0, (2 << level) + 1, 2))
        if leaf == 1 and n > 1 << depth:
            self.kids.append(self.bounds[-1])
            self._add(points[self.order], np.arange(n + 1))
        self.points = points[self.order]
        self.sums = np.concatenate([np.zeros((1, points.shape[1]), np.int64), np.cumsum(self.points, axis=0)])

    def _add(self, points, bounds):
        self.bounds.append(bounds)
        self.low.append(np.minimum.reduceat(points, bounds[:-1], axis=0))
        self.high.append(np.maximum.reduceat(points, bounds[:-1], axis=0))


def _spread(first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For ranges first .. first + count: the range that each value is of, and the values."""
    of = np.repeat(np.arange(len(count)), count)
    return of, np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count) + first[of]


def assign(tree: Tree, entries: Tree) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The nearest entry (ties: the least index) of every point in the tree's order, and the sums and counts of each entry's points."""
    nearest = np.empty(len(tree.order), np.int64)
    sums, counts = np.zeros(entries.points.shape, np.int64), np.zeros(len(entries.order), np.int64)
    p = e = np.zeros(1, np.int64)
    at, to = 0, 0
    while True:
        gap = np.maximum(np.maximum(tree.low[at][p] - entries.high[to][e], entries.low[to][e] - tree.high[at][p]), 0)
        far = np.maximum(tree.high[at][p] - entries.low[to][e], entries.high[to][e] - tree.low[at][p])
        least, most = (gap * gap).sum(axis=1), (far * far).sum(axis=1)
        cut = np.flatnonzero(np.concatenate([[True], p[1:] != p[:-1]]))
        reach = np.repeat(np.minimum.reduceat(most, cut), np.diff(np.append(cut, len(p))))
        near = least <= reach
        p, e = p[near], e[near]
        last = to == len(entries.bounds) - 1
        if last:
            cut = np.flatnonzero(np.concatenate([[True], p[1:] != p[:-1]]))
            alone = np.diff(np.append(cut, len(p))) == 1
            whole, entry = p[cut[alone]], entries.order[e[cut[alone]]]
            start, end = tree.bounds[at][whole], tree.bounds[at][whole + 1]
            np.add.at(sums, entry, tree.sums[end] - tree.sums[start])
            np.add.at(counts, entry, end - start)
            of, points = _spread(start, end - start)
            nearest[points] = entry[of]
            rest = np.repeat(~alone, np.diff(np.append(cut, len(p))))
            p, e = p[rest], e[rest]
        if not len(p):
            return nearest, sums, counts
        if not last:
            of, e = _spread(entries.kids[to][e], np.diff(entries.kids[to])[e])
            p, to = p[of], to + 1
        if at < len(tree.bounds) - 1:
            of, p = _spread(tree.kids[at][p], np.diff(tree.kids[at])[p])
            order = np.argsort(p, kind="stable")
            p, e, at = p[order], e[of][order], at + 1
        elif last:
            break
    # Leaves of points that several entries may be nearest to.
    of, points = _spread(tree.bounds[at][p], np.diff(tree.bounds[at])[p])
    order = np.argsort(points, kind="stable")
    points, e = points[order], e[of][order]
    off = tree.points[points] - entries.points[e]
    d2, entry = (off * off).sum(axis=1), entries.order[e]
    cut = np.flatnonzero(np.concatenate([[True], points[1:] != points[:-1]]))
    size = np.diff(np.append(cut, len(points)))
    entry = np.where(d2 == np.repeat(np.minimum.reduceat(d2, cut), size), entry, len(entries.order))
    entry, points = np.minimum.reduceat(entry, cut), points[cut]
    nearest[points] = entry
    np.add.at(sums, entry, tree.points[points])
    np.add.at(counts, entry, 1)
    return nearest, sums, counts


def _blocks(batches, width: int):
    """The batches in tables of BLOCK_VALUES components, with these as an array (rows, width)."""
    held, n = [], 0
    rows = max(1, BLOCK_VALUES // width)
    for b in batches:
        for i in range(0, b.num_rows, rows):
            held.append(b.slice(i, rows))
            n += held[-1].num_rows
            if n >= rows:
                yield _block(held, width)
                held, n = [], 0
    if n:
        yield _block(held, width)


def _block(held, width):
    table = pa.Table.from_batches(held)
    return table, table.column("q").combine_chunks().flatten().to_numpy().reshape(-1, width)


def integers(rows: DataFrame) -> DataFrame:
    """vec_id, label, q: floor(256 * x) of every component, of the vectors whose length is a multiple of 16 and whose components are all finite."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    q = F.transform(F.col("embedding").cast("array<double>"), lambda x: F.greatest(F.lit(-MOST), F.least(F.lit(MOST), F.floor(x * SCALE))).cast("long"))
    usable = F.col("embedding").isNotNull() & (F.size("embedding") > 0) & (F.size("embedding") % PARTS == 0)
    return rows.where(usable).where(finite).select("vec_id", "label", q.alias("q"))


def _moved(kept: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks (part, entry, component) after one round: each entry at the floor of its parts' mean, unused ones as before."""
    parts, _, m = books.shape

    def run(batches):
        trees = [Tree(b, 1) for b in books]
        total = np.zeros((parts, books.shape[1], m + 1), np.int64)
        for _, q in _blocks(batches, parts * m):
            for k in range(parts):
                _, sums, counts = assign(Tree(q[:, k * m : (k + 1) * m], LEAF), trees[k])
                total[k, :, 0] += counts
                total[k, :, 1:] += sums
        k, e = np.nonzero(total[:, :, 0])
        yield pa.RecordBatch.from_pydict({"part": k.astype(np.int32), "entry": e.astype(np.int32), "sums": pa.array(list(total[k, e]), pa.list_(pa.int64()))})

    found = kept.select("q").mapInArrow(trimmed(run), "part int, entry int, sums array<long>")
    found = found.select("part", "entry", F.posexplode("sums").alias("i", "s")).groupBy("part", "entry", "i").agg(F.sum("s").alias("s"))
    total = np.zeros((parts, books.shape[1], m + 1), np.int64)
    for r in found.collect():  # a number for each number of the codebooks and each entry
        total[r.part, r.entry, r.i] = r.s
    used = total[:, :, 0] > 0
    out = books.copy()
    out[used] = total[used][:, 1:] // total[used][:, :1]
    return out


def codebooks(kept: DataFrame, width: int) -> np.ndarray:
    """Codebooks (part, entry, component) of integer vectors of one width: the first 64 by vec_id (null last, then by their integers), moved twice."""
    seeds = kept.orderBy(F.col("vec_id").asc_nulls_last(), "q").select("q").limit(ENTRIES).collect()
    books = np.array([r.q for r in seeds], np.int64).reshape(len(seeds), PARTS, width // PARTS).transpose(1, 0, 2)
    for _ in range(ROUNDS):
        books = _moved(kept, books)
    return books


def compress(rows: DataFrame) -> DataFrame:
    """Product codes of vectors, 16 parts of 64 entries each.

    rows: vec_id, label, embedding and any other columns, which are ignored. Returns vec_id, label, code, error, label_error and
    codebooks_sha256 of each row kept. Rows are dropped whose vector is null, empty, of a length that is not a multiple of 16 or not that
    of the least kept vec_id's, or holds null or non-finite components. Integers beyond 2^24 count as 2^24. Repeated rows get the same
    code each; with fewer than 64 rows codebooks have as many entries as rows. Equal labels share label_error, null labels too.
    An empty table, or one without a usable vector, gives an empty result. The codebooks, 64 entries of a vector's length, are all that
    passes the driver.
    """
    label, key = (rows.schema[c].dataType.simpleString() for c in ("label", "vec_id"))
    kept = written(integers(rows), "vector-integers")
    first = kept.orderBy(F.col("vec_id").asc_nulls_last(), "q").select(F.size("q").alias("n")).head()
    if first is None:
        return kept.selectExpr("vec_id", "label", "'' AS code", "0L AS error", "0L AS label_error", "'' AS codebooks_sha256")
    width = first.n
    kept = kept.where(F.size("q") == width)
    books = codebooks(kept, width)
    m = width // PARTS

    def run(batches):
        trees = [Tree(b, 1) for b in books]
        for table, q in _blocks(batches, width):
            codes, error = np.zeros((len(q), PARTS), np.uint8), np.zeros(len(q), np.int64)
            for k in range(PARTS):
                part = q[:, k * m : (k + 1) * m]
                tree = Tree(part, LEAF)
                codes[tree.order, k] = assign(tree, trees[k])[0]
                off = part - books[k][codes[:, k]]
                error += (off * off).sum(axis=1)
            for b in table.select(["vec_id", "label"]).append_column("code", pa.array([c.tobytes().hex() for c in codes], pa.string())).append_column("error", pa.array(error)).combine_chunks().to_batches():
                yield b

    coded = written(kept.mapInArrow(trimmed(run), f"vec_id {key}, label {label}, code string, error long"), "vector-codes")
    of_label = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit((1 << 63) - 1).cast("decimal(38,0)")).cast("long")
    labels = written(coded.groupBy(F.col("label").alias("l_label")).agg(of_label.alias("label_error")), "label-errors")
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    out = coded.join(maybe_broadcast(labels), F.col("label").eqNullSafe(F.col("l_label")))
    return out.select("vec_id", "label", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def _oracle() -> str:
    """The same in SQL, each distance computed."""
    distance = "list_sum(list_transform(list_zip(xs, cs), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    sql = f"""
WITH v AS (SELECT * FROM embeddings WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM v QUALIFY entry < {ENTRIES}),
p AS (SELECT vec_id, part, list_transform(embedding[part * len(embedding) // {PARTS} + 1 : (part + 1) * len(embedding) // {PARTS}], lambda x: CAST(floor(CAST(x AS DOUBLE) * {SCALE}) AS BIGINT)) AS xs
      FROM v, range({PARTS}) r(part)),
c0 AS (SELECT part, entry, xs AS cs FROM p JOIN s USING (vec_id))"""
    for k in range(ROUNDS + 1):
        sql += f""",
a{k} AS (SELECT vec_id, part, any_value(xs) AS xs, min({{'d': {distance}, 'e': entry}}) AS best FROM p JOIN c{k} USING (part) GROUP BY vec_id, part)"""
        if k < ROUNDS:
            sql += f""",
u{k} AS (SELECT part, best.e AS entry, unnest(xs) AS x, generate_subscripts(xs, 1) AS i FROM a{k}),
m{k} AS (SELECT part, entry, i, CAST(sum(x) AS BIGINT) AS t, count(*) AS n FROM u{k} GROUP BY ALL),
n{k} AS (SELECT part, entry, list((t - ((t % n) + n) % n) // n ORDER BY i) AS cs FROM m{k} GROUP BY part, entry),
c{k + 1} AS (SELECT part, entry, coalesce(n{k}.cs, c{k}.cs) AS cs FROM c{k} LEFT JOIN n{k} USING (part, entry))"""
    return (
        sql
        + f""",
f AS (SELECT vec_id, string_agg(printf('%02x', best.e), '' ORDER BY part) AS code, CAST(sum(best.d) AS BIGINT) AS error FROM a{ROUNDS} GROUP BY vec_id),
h AS (SELECT sha256(string_agg(array_to_string(cs, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM c{ROUNDS})
SELECT vec_id, label, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM f JOIN v USING (vec_id), h
"""
    )


ORACLE = _oracle()
