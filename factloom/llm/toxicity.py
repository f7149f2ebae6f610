"""Toxicity of texts by their nearest labelled examples.

Features are lower-case words and their first 4, 5 and 6 bytes, hashed. Those that tell toxic from other
training rows, by the likelihood ratio over all of them, span a TF-IDF space; other words do not count, as a cosine over all
words finds texts of like topics, not of like tone. The nearest examples by exact cosine over these features come from an
inverted index over a bounded sample of labelled rows. Its postings lie in blocks of rows with the greatest weight of each
feature: a block's postings are read in the order of its bound, until no block that is left can hold a nearer one.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType

from .common import Words, maybe_broadcast, mix, slices, text_bytes, trimmed, written

PREFIXES = (4, 5, 6)
#: Parameters: labelled examples of each label in the index, neighbours, rows of a block, blocks read at once, the
#: weight of the prior in a vote, a feature's least likelihood ratio and its least lift (how much more often toxic
#: rows have it than others). Features must also be in a toxic example of the index, which bounds their number.
EXAMPLES, NEIGHBOURS, BLOCK = 4096, 15, 64
READ_BLOCKS = 16
PRIOR_WEIGHT, LEAST_RATIO, LEAST_LIFT = 0.5, 20.0, 1.5
THRESHOLD = 0.7
#: Local counts that a task holds before it passes them on.
HELD = 1_000_000

LETTERS = np.array([b >= 128 or chr(b).isalnum() for b in range(256)])


def known(feature: np.ndarray, names: np.ndarray) -> np.ndarray:
    if not len(names):
        return np.zeros(len(feature), bool)
    return names[np.minimum(np.searchsorted(names, feature), len(names) - 1)] == feature


def features(data: np.ndarray, at: np.ndarray, names: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, feature, times) of each row's features, sorted; only those of names (sorted), if given."""
    w = Words(data, at, lower=True, letters=LETTERS)
    length = w.end - w.start
    rows, found = [w.row], [w.hash[0]]
    for p in PREFIXES:
        longer = length > p
        rows.append(w.row[longer])
        found.append(mix(w.hashed(1, p)[longer] ^ np.uint64(p)))
    row, feature = np.concatenate(rows), np.concatenate(found)
    if names is not None:
        own = known(feature, names)
        row, feature = row[own], feature[own]
    order = np.lexsort((feature, row))
    row, feature = row[order], feature[order]
    new = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (feature[1:] != feature[:-1])])) if len(row) else np.zeros(0, int)
    return row[new], feature[new], np.diff(np.append(new, len(row)))


def training_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, text, toxic of the labelled rows that are not held out; of repeated labels the greatest counts."""
    labels = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    labels = written(labels.where("crc32(cast(doc_id AS string)) % 3 != 1"), "training-labels")
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(maybe_broadcast(labels, 32), "doc_id")


def _counts(train: DataFrame) -> DataFrame:
    """feature, pos, neg: the toxic and other training rows that have it."""

    def run(batches):
        held, size = [], 0

        def out():
            f = np.concatenate([h[0] for h in held])
            y = np.concatenate([h[1] for h in held])
            feature, at = np.unique(f, return_inverse=True)
            pos = np.bincount(at, weights=y, minlength=len(feature)).astype(np.int64)
            total = np.bincount(at, minlength=len(feature)).astype(np.int64)
            whole = pa.RecordBatch.from_arrays([pa.array(feature.view(np.int64)), pa.array(pos), pa.array(total - pos)], ["feature", "pos", "neg"])
            for i in range(0, whole.num_rows, 100_000):
                yield whole.slice(i, 100_000)

        for b in batches:
            data, at = text_bytes(b.column("text"))
            toxic = np.array(b.column("toxic").to_pylist(), np.int64) > 0
            for i, j in slices(at):
                row, feature, _ = features(data, at[i : j + 1])
                held.append((feature, toxic[i:j][row]))
                size += len(feature)
                if size > HELD:
                    yield from out()
                    held, size = [], 0
        if size:
            yield from out()

    return train.mapInArrow(trimmed(run), "feature long, pos long, neg long").groupBy("feature").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))


def _ranges(begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of the ranges begin .. end, and which range each is of."""
    n = end - begin
    return np.repeat(begin - (np.cumsum(n) - n), n) + np.arange(int(n.sum())), np.repeat(np.arange(len(n)), n)


@dataclass
class Model:
    """The features (sorted) with their idf, and the examples' unit vectors as postings by feature and block."""

    names: np.ndarray
    idf: np.ndarray
    doc_ids: list
    toxic: np.ndarray
    rows: np.ndarray  # of each posting, by feature and row
    weights: np.ndarray
    own: np.ndarray  # where a feature's slots begin; a slot is a block in which it has postings
    block: np.ndarray  # of each slot
    bounds: np.ndarray  # of each slot: its greatest weight
    places: np.ndarray  # where a slot's postings begin
    prior: float  # of rows that have features
    prior_without: float
    id_type: DataType  # of doc_ids
    rates: np.ndarray  # of either label: training rows with features for each example in the index

    def vector(self, feature: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions among the model's features and the unit TF-IDF weights."""
        if not len(self.names):
            return np.zeros(0, int), np.zeros(0)
        at = np.minimum(np.searchsorted(self.names, feature), len(self.names) - 1)
        own = self.names[at] == feature
        at, w = at[own], (1 + np.log(times[own])) * self.idf[at[own]]
        return at, w / (np.sqrt((w * w).sum()) or 1.0)

    def nearest(self, at: np.ndarray, weights: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The k examples of the greatest cosine, nearest first, ties by position; exact."""
        slot, of = _ranges(self.own[at], self.own[at + 1])
        bound = np.bincount(self.block[slot], weights=weights[of] * self.bounds[slot], minlength=1)
        order = np.argsort(-bound, kind="stable")
        order = order[: int(np.count_nonzero(bound > 0))]
        turn = np.empty(len(bound), np.int64)
        turn[order] = np.arange(len(order))
        by_turn = np.argsort(turn[self.block[slot]], kind="stable")
        slot, of = slot[by_turn], of[by_turn]
        starts = np.searchsorted(turn[self.block[slot]], np.arange(0, len(order) + READ_BLOCKS, READ_BLOCKS))
        ids, sims, bar = np.zeros(0, np.int64), np.zeros(0), 0.0
        for n, s in enumerate(range(0, len(order), READ_BLOCKS)):
            if bound[order[s]] < bar:
                break
            some = slice(starts[n], starts[n + 1])
            posting, which = _ranges(self.places[slot[some]], self.places[slot[some] + 1])
            share = self.weights[posting] * weights[of[some]][which]
            found, own = np.unique(self.rows[posting], return_inverse=True)
            ids, sims = np.append(ids, found), np.append(sims, np.bincount(own, weights=share, minlength=len(found)))
            if len(sims) >= k:
                bar = np.partition(sims, -k)[-k] - 1e-12
        best = np.lexsort((ids, -sims))[:k]
        return ids[best], sims[best]

    def score(self, feature: np.ndarray, times: np.ndarray) -> tuple[float, list]:
        """The vote of the nearest examples, each by its squared cosine and for as many rows as it stands for,
        drawn to the prior; and their doc_ids."""
        at, weights = self.vector(feature, times)
        if not len(at):
            return self.prior_without, []
        ids, sims = self.nearest(at, weights, NEIGHBOURS)
        sims = sims * sims
        mass, stands = float(sims.sum()), sims * self.rates[self.toxic[ids].astype(int)]
        share = float((stands * self.toxic[ids]).sum()) / (float(stands.sum()) or 1.0)
        vote = (mass * share + PRIOR_WEIGHT * self.prior) / (mass + PRIOR_WEIGHT)
        return min(1.0, max(0.0, vote)), [self.doc_ids[i] for i in ids[:3]]


def _examples(train: DataFrame, names: np.ndarray | None) -> DataFrame:
    """doc_id, toxic, features, times of the training rows that have a feature (of names, if given)."""

    def run(batches):
        for b in batches:
            data, at = text_bytes(b.column("text"))
            toxic = (b.column("toxic").to_numpy(zero_copy_only=False) > 0).astype(np.int32)
            for i, j in slices(at):
                row, feature, times = features(data, at[i : j + 1], names)
                first = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]])) if len(row) else np.zeros(0, int)
                ends, own = pa.array(np.append(first, len(row)).astype(np.int32)), row[first] + i
                lists = [pa.ListArray.from_arrays(ends, pa.array(v)) for v in (feature.view(np.int64), times.astype(np.int64))]
                yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(own)), pa.array(toxic[own]), *lists], ["doc_id", "toxic", "features", "times"])

    return train.mapInArrow(trimmed(run), f"doc_id {train.schema['doc_id'].dataType.simpleString()}, toxic int, features array<long>, times array<long>")


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Feature counts cover all training rows; the index holds EXAMPLES rows of each label at most, those of
    the least hashes among rows that have a feature. Without rows of both labels there are no features."""
    train = training_rows(docs, labels)
    totals = {bool(r["t"]): r["n"] for r in train.groupBy((F.col("toxic") > 0).alias("t")).agg(F.count("*").alias("n")).collect()}
    pos, neg = totals.get(True, 0), totals.get(False, 0)
    chosen = []
    if pos and neg:

        def term(observed, expected):
            return F.when(observed > 0, observed * F.log(observed / expected)).otherwise(0.0)

        n = float(pos + neg)
        p, q = F.col("pos").cast("double"), F.col("neg").cast("double")
        both = p + q
        ratio = 2 * (term(p, both * pos / n) + term(q, both * neg / n) + term(pos - p, (n - both) * pos / n) + term(neg - q, (n - both) * neg / n))
        useful = written(_counts(train).where(p / pos >= LEAST_LIFT * q / neg).where(ratio >= LEAST_RATIO), "useful-features")
        # Only features of a bounded sample of toxic rows come to the driver, however many the corpus has.
        sampled = train.where("toxic > 0").orderBy(F.xxhash64("doc_id"), "doc_id").limit(EXAMPLES)
        in_sample = _examples(sampled, None).select(F.explode("features").alias("feature")).distinct()
        chosen = useful.join(in_sample, "feature", "left_semi").collect()
    names = np.array([r["feature"] for r in chosen], np.int64).view(np.uint64)
    order = np.argsort(names)
    names = names[order]
    idf = np.log((pos + neg + 1) / (np.array([r["pos"] + r["neg"] for r in chosen], float)[order] + 1)) + 0.1

    examples, having = [], {0: 0, 1: 0}
    if len(names):
        rows = written(_examples(train, names), "examples")
        having |= {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
        for y in (0, 1):
            examples += rows.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(EXAMPLES).collect()
    blocks = -(-max(1, len(examples)) // BLOCK)
    model = Model(names, idf, [r["doc_id"] for r in examples], np.array([r["toxic"] for r in examples], float), np.zeros(0, int), np.zeros(0), np.zeros(len(names) + 1, int), np.zeros(0, int), np.zeros(0), np.zeros(1, int), 0.5, 0.5, docs.schema["doc_id"].dataType, np.ones(2))
    if pos + neg:
        model.prior = (having[1] + 1) / (sum(having.values()) + 2)
        model.prior_without = (pos - having[1] + 0.5) / (pos + neg - sum(having.values()) + 1)
    for y in (0, 1):
        # The index takes less of the label that has more rows; its votes make up for it.
        model.rates[y] = having[y] / max(1, int((model.toxic == y).sum())) if having[y] else 1.0
    if examples:
        vectors = [model.vector(np.array(r["features"], np.int64).view(np.uint64), np.array(r["times"], float)) for r in examples]
        feature, weight = (np.concatenate([v[c] for v in vectors]) for c in (0, 1))
        row = np.repeat(np.arange(len(vectors)), [len(v[0]) for v in vectors])
        order = np.lexsort((row, feature))
        feature, model.rows, model.weights = feature[order], row[order], weight[order]
        slot = feature * blocks + model.rows // BLOCK
        begin = np.flatnonzero(np.concatenate([[True], slot[1:] != slot[:-1]])) if len(slot) else np.zeros(0, int)
        model.places, model.block = np.append(begin, len(slot)), slot[begin] % blocks
        model.bounds = np.maximum.reduceat(model.weights, begin) if len(begin) else np.zeros(0)
        model.own = np.searchsorted(slot[begin] // blocks, np.arange(len(names) + 1))
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score and evidence (doc_ids of up to three nearest examples) of each row of docs (doc_id, text).

    Null and empty texts, and others without a known feature, get the share of toxic ones among such
    training rows, with no evidence. Without any labels all scores are 0.5. Repeated rows score alike.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by EXAMPLES and what their texts hold
    kind = docs.schema["doc_id"].dataType.simpleString()

    evidence_type = to_arrow_type(model.id_type)

    def run(batches):
        model = shared.value
        for b in batches:
            data, at = text_bytes(b.column("text"))
            scores, evidence = np.full(b.num_rows, model.prior_without), [[] for _ in range(b.num_rows)]
            for i, j in slices(at):
                row, feature, times = features(data, at[i : j + 1], model.names)
                cut = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]])) if len(row) else []
                for s, e in zip(cut, [*cut[1:], len(row)]):
                    scores[i + row[s]], evidence[i + row[s]] = model.score(feature[s:e], times[s:e])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(scores), pa.array(evidence, pa.list_(evidence_type))], ["doc_id", "score", "evidence"])

    return docs.select("doc_id", "text").mapInArrow(trimmed(run), f"doc_id {kind}, score double, evidence array<{model.id_type.simpleString()}>")


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted, evidence of each row of docs; labels has doc_id and toxic.

    Rows whose crc32 of the doc_id modulo 3 is 1 give no label. Null and empty texts and such without a feature get one score;
    rows without doc_id are scored and not held out; repeated rows score alike; of repeated labels the greatest counts,
    null ones are left out. Ties among neighbours go by the hash order of the examples. Other columns are ignored whatever
    their names; long texts are read whole. An empty table gives an empty one; without labels all scores are 0.5.
    """
    scored = score(docs, fit(docs, labels))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "evidence")
