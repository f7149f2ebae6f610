"""Passages that repeat across documents: a count-min prefilter, then exact groups of windows.

A window is 50 consecutive words. Its key is the least hash of the 10-word runs in it, so equal windows
have equal keys and a document has about one key for every twenty words. Each task counts the documents
of its keys in a sketch; merged, the sketches overestimate the documents of every window. Only windows
whose key is estimated in two documents or more are dealt out, consecutive ones of one key as one row, and grouped by the key and a
hash of their words; windows of a key that very many rows have are dealt out one by one. Then the words of every
run of windows are compared, by SHA-256, with those of the run they repeat, and windows of runs that differ are grouped by their words.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, maybe_broadcast, mix, slices, text_bytes, trimmed, windows, written

WINDOW, RUN = 50, 10
CHUNK = 1 << 16
#: Counters of a sketch row: four for each key expected, within these bounds (the most is 16 MB a row).
LEAST_WIDTH, MOST_WIDTH, DEPTH = 1 << 20, 1 << 27, 2
ROWS_OUT = 50_000
#: Rows of a key from which on its windows are dealt out one by one, and windows that a task groups at once if no key has more.
HOT_ROWS, HELD_WINDOWS = 4096, 1 << 18


def _window_keys(hashes: np.ndarray) -> np.ndarray:
    """For every window of consecutive words: the least hash of its runs."""
    least = windows(hashes, RUN)
    span = WINDOW - RUN + 1
    n = len(least) - span + 1
    out, done, power, size = None, 0, least, 1
    while size <= span:
        if span & size:
            part = power[done : done + n]
            out = part if out is None else np.minimum(out, part)
            done += size
        power = np.minimum(power[:-size], power[size:]) if len(power) > size else power[:0]
        size *= 2
    return out


def _places(keys: np.ndarray, row: int, width: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(keys + np.uint64(0x632BE59BD9B4E019 * (row + 1) & (1 << 64) - 1)) & np.uint64(width - 1)


def _sketches(rows: DataFrame, width: int):
    """Merged sketches as bitmaps of the counters that reached two documents, by (row, chunk)."""

    def count(batches):
        found = [[] for _ in range(DEPTH)]
        for b in batches:
            data, at = text_bytes(b.column("text"))
            for i, j in slices(at):
                w = Words(data, at[i : j + 1])
                starts = w.runs(WINDOW)
                if not len(starts):
                    continue
                keys = _window_keys(w.hash[0])[starts]
                row = w.row[starts]
                # each key once a document
                order = np.lexsort((keys, row))
                keys, row = keys[order], row[order]
                keys = keys[np.concatenate([[True], (keys[1:] != keys[:-1]) | (row[1:] != row[:-1])])]
                for d in range(DEPTH):
                    found[d].append(_places(keys, d, width).astype(np.uint32))
        for d in range(DEPTH):
            if not found[d]:
                continue
            place, n = np.unique(np.concatenate(found[d]), return_counts=True)
            chunk = place // CHUNK
            cut = np.flatnonzero(np.concatenate([[True], chunk[1:] != chunk[:-1]]))
            low, twice = (place % CHUNK).astype(np.uint16), n > 1
            yield pa.RecordBatch.from_arrays([
                pa.array(np.full(len(cut), d, np.int32)), pa.array(chunk[cut].astype(np.int32)),
                pa.array([x.tobytes() for x in np.split(low, cut[1:])], pa.binary()),
                pa.array([x.tobytes() for x in (low[a:e][twice[a:e]] for a, e in zip(cut, [*cut[1:], len(low)]))], pa.binary()),
            ], ["d", "chunk", "seen", "again"])

    def merge(batches):
        counts: dict = defaultdict(lambda: np.zeros(CHUNK, np.uint8))
        for b in batches:
            for r in b.to_pylist():
                c = counts[r["d"], r["chunk"]]
                for name in ("seen", "again"):
                    at = np.frombuffer(r[name], np.uint16)
                    c[at] = np.minimum(c[at] + 1, 2)
        for (d, chunk), c in counts.items():
            yield pa.RecordBatch.from_pylist([{"d": d, "chunk": chunk, "bits": np.packbits(c > 1).tobytes()}], pa.schema([("d", pa.int32()), ("chunk", pa.int32()), ("bits", pa.binary())]))

    parts = rows.select("text").mapInArrow(trimmed(count), "d int, chunk int, seen binary, again binary")
    return parts.repartition("d", "chunk").mapInArrow(trimmed(merge), "d int, chunk int, bits binary")


def repeated_windows(docs: DataFrame, hash_bits: int = 64) -> DataFrame:
    """doc_id, key (xxhash64 of the text) and ranges of the words to remove, of the documents that have any.

    ranges holds start and end (exclusive) of each range in turn, by start; they may overlap. A document whose words all equal those
    of one with a smaller doc_id has the range from 0 to its end. hash_bits: of each of two hashes that group windows; fewer
    make more work, never another result.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("key", F.xxhash64("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def sequences(batches):
        for b in batches:
            words = [t.as_py().encode().split() for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("key"), pa.array([len(w) for w in words], pa.int32()), pa.array([hashlib.sha256(b" ".join(w)).digest() for w in words], pa.binary())], ["doc_id", "key", "n", "sequence"])

    all_docs = docs.mapInArrow(trimmed(sequences), f"doc_id {kind}, key long, n int, sequence binary")
    narrow = written(all_docs, "sequences")
    firsts = narrow.where(f"n >= {WINDOW}").groupBy("sequence").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").drop("last")
    firsts = maybe_broadcast(written(firsts, "first-sequences"))
    copies = written(narrow.where(f"n >= {WINDOW}").join(firsts, "sequence").where("doc_id > first").select("doc_id", "key", F.array(F.lit(0), "n").alias("ranges")).distinct(), "copies")
    words = narrow.agg(F.sum("n")).head()[0] or 0
    rest = docs.join(maybe_broadcast(copies.select("doc_id", "key")), ["doc_id", "key"], "left_anti")

    width = LEAST_WIDTH
    while width < min(MOST_WIDTH, words * 4 * 2 // (WINDOW - RUN + 2)):
        width *= 2
    # At most DEPTH bitmaps of MOST_WIDTH bits: 32 MB.
    bitmaps = np.zeros((DEPTH, width // 8), np.uint8)
    for r in _sketches(rest, width).toLocalIterator():
        bitmaps[r["d"], r["chunk"] * (CHUNK // 8) : (r["chunk"] + 1) * (CHUNK // 8)] = np.frombuffer(r["bits"], np.uint8)
    shared = spark.sparkContext.broadcast(bitmaps)

    def suspects(batches):
        bits = shared.value
        names = ["anchor", "doc_id", "key", "start", "hashes"]
        for b in batches:
            data, at = text_bytes(b.column("text"))
            ids, keys = b.column("doc_id"), b.column("key")
            for i, j in slices(at):
                w = Words(data, at[i : j + 1], seeds=(1, 2))
                starts = w.runs(WINDOW)
                if not len(starts):
                    continue
                key = _window_keys(w.hash[0])[starts]
                often = np.ones(len(key), bool)
                for d in range(DEPTH):
                    place = _places(key, d, width)
                    often &= (bits[d, (place >> np.uint64(3)).astype(np.int64)] >> (7 - (place & np.uint64(7))).astype(np.uint8) & 1).astype(bool)
                starts, key = starts[often], key[often]
                if not len(starts):
                    continue
                least = np.uint64(64 - hash_bits)
                key, h = (x >> least << least for x in (key, w.windows(WINDOW, 1)[starts]))
                row = w.row[starts]
                cut = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (starts[1:] != starts[:-1] + 1) | (row[1:] != row[:-1])]))
                of = row[cut]
                offsets = pa.py_buffer(np.append(cut * 8, len(h) * 8).astype(np.int32))
                hashes = pa.BinaryArray.from_buffers(pa.binary(), len(cut), [None, offsets, pa.py_buffer(np.ascontiguousarray(h))])
                out = pa.RecordBatch.from_arrays([pa.array(key[cut].view(np.int64)), ids.take(pa.array(of + i)), keys.take(pa.array(of + i)), pa.array((starts[cut] - w.first[of]).astype(np.int32)), hashes], names)
                for k in range(0, out.num_rows, ROWS_OUT):
                    yield out.slice(k, ROWS_OUT)

    rest_ids = rest.where("doc_id IS NOT NULL")
    found = written(rest_ids.mapInArrow(trimmed(suspects), f"anchor long, doc_id {kind}, key long, start int, hashes binary"), "windows")
    hot = written(found.groupBy("anchor").agg(F.count("*").alias("n")).where(F.col("n") > HOT_ROWS).select("anchor"), "hot-anchors")
    pieces = first_places(found.join(maybe_broadcast(hot), "anchor", "left_anti"))
    if not hot.isEmpty():
        each = written(single_windows(found.join(maybe_broadcast(hot), "anchor", "left_semi")), "hot-windows")
        first = each.groupBy("anchor", "h").agg(F.min(F.struct("doc_id", "key", "start")).alias("f"), F.max("doc_id").alias("last")).where("f.doc_id < last").drop("last")
        # A table of its own: broadcast, or joined by a shuffle in which Spark can split a window that very many have.
        more = each.join(maybe_broadcast(written(first, "first-windows")), ["anchor", "h"]).where("doc_id > f.doc_id")
        more = more.select("doc_id", "key", "start", (F.col("start") + WINDOW).alias("stop"), F.col("f.doc_id").alias("f_id"), F.col("f.key").alias("f_key"), F.col("f.start").alias("f_start"))
        pieces = pieces.unionByName(more)
    hits = pieces.groupBy("doc_id", "key").agg(F.collect_list(F.struct("start", "stop", "f_id", "f_key", "f_start")).alias("hits"))
    names = ["doc_id", "key", "start", "stop", "f_id", "f_key", "f_start"]

    def in_runs(batches):
        for b in batches:
            id_type = b.schema.field("doc_id").type
            out = []
            for r in b.to_pylist():
                now = None
                for h in sorted(r["hits"], key=lambda h: h["start"]):
                    s = h["start"]
                    if now and s == now[3] - WINDOW + 1 and (h["f_id"], h["f_key"], h["f_start"] - s) == (now[4], now[5], now[6] - now[2]):
                        now[3] = h["stop"]
                    elif not now or s > now[3] - WINDOW:
                        now = [r["doc_id"], r["key"], s, h["stop"], h["f_id"], h["f_key"], h["f_start"]]
                        out.append(now)
            cols = list(zip(*out)) or [()] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (id_type, pa.int64(), pa.int32(), pa.int32(), id_type, pa.int64(), pa.int32()))], names)

    runs = written(hits.mapInArrow(trimmed(in_runs), f"doc_id {kind}, key long, start int, stop int, f_id {kind}, f_key long, f_start int"), "runs")
    own = passages(rest, runs.withColumn("about", F.struct("f_id", "f_key", "f_start")))
    theirs = passages(rest, runs.select(F.col("f_id").alias("doc_id"), F.col("f_key").alias("key"), F.col("f_start").alias("start"), (F.col("f_start") + F.col("stop") - F.col("start")).alias("stop")).distinct().withColumn("about", F.lit(None).cast("int")))
    theirs = written(theirs.select(F.col("doc_id").alias("f_id"), F.col("key").alias("f_key"), F.col("start").alias("f_start"), (F.col("stop") - F.col("start")).alias("length"), F.sha2("words", 256).alias("wanted")), "passages")
    own = own.select("doc_id", "key", "start", "stop", "about.*", (F.col("stop") - F.col("start")).alias("length"), F.sha2("words", 256).alias("words"))
    odd = written(own.join(maybe_broadcast(theirs), ["f_id", "f_key", "f_start", "length"]).where("words != wanted").select("doc_id", "key", "start", "stop").distinct(), "odd-runs")
    ranges = runs.select("doc_id", "key", "start", "stop")
    if not odd.isEmpty():
        # Hashes that agree for different words: all windows of their groups are grouped by their words.
        o = odd.select(F.col("doc_id").alias("o_id"), F.col("key").alias("o_key"), F.col("start").alias("o_start"), F.col("stop").alias("o_stop"))
        same = (F.col("doc_id") == F.col("o_id")) & (F.col("key") == F.col("o_key")) & F.col("start").between(F.col("o_start"), F.col("o_stop") - WINDOW)
        every = written(single_windows(found), "all-windows")
        again = every.join(maybe_broadcast(written(every.join(maybe_broadcast(o), same).select("anchor", "h").distinct(), "odd-groups")), ["anchor", "h"])
        each = written(passages(rest, again.select("doc_id", "key", "start", (F.col("start") + WINDOW).alias("stop"), F.lit(None).cast("int").alias("about"))), "odd-windows")
        least = written(each.groupBy("words").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last"), "odd-firsts")
        exact = each.join(maybe_broadcast(least), "words").where("doc_id > first").select("doc_id", "key", "start", "stop")
        ranges = ranges.join(maybe_broadcast(odd), ["doc_id", "key", "start", "stop"], "left_anti").unionByName(exact)
    ranges = ranges.groupBy("doc_id", "key").agg(F.flatten(F.transform(F.array_sort(F.collect_set(F.struct("start", "stop"))), lambda r: F.array(r["start"], r["stop"]))).alias("ranges"))
    return written(ranges.unionByName(copies), "ranges")


def single_windows(found: DataFrame) -> DataFrame:
    """A row for each window of found (anchor, doc_id, key, start, hashes): anchor, h, doc_id, key, start."""
    kind = found.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for b in batches:
            h, row, inside = _unpacked(b.column("hashes"))
            at = pa.array(row)
            out = pa.RecordBatch.from_arrays([b.column("anchor").take(at), pa.array(h.view(np.int64)), b.column("doc_id").take(at), b.column("key").take(at), pa.array((b.column("start").to_numpy()[row] + inside).astype(np.int32))], ["anchor", "h", "doc_id", "key", "start"])
            for k in range(0, out.num_rows, ROWS_OUT):
                yield out.slice(k, ROWS_OUT)

    return found.mapInArrow(trimmed(run), f"anchor long, h long, doc_id {kind}, key long, start int")


def _unpacked(hashes: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The hash of every window, its row, and its place in that row."""
    data, at = text_bytes(hashes)
    h = np.frombuffer(data[int(at[0]) : int(at[-1])].tobytes(), np.uint64)
    n = np.diff(at) // 8
    return h, np.repeat(np.arange(len(n)), n), np.arange(len(h)) - np.repeat(np.cumsum(n) - n, n)


def first_places(found: DataFrame) -> DataFrame:
    """Pieces (doc_id, key, start, stop, f_id, f_key, f_start) of consecutive windows whose hashes, under the same anchor, start in a document with a
    smaller doc_id, and where they start there first. Rows come sorted by anchor and document; a task holds one anchor, or HELD_WINDOWS of several."""
    kind = found.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "key", "start", "stop", "f_id", "f_key", "f_start"]

    def pieces(rows: pa.Table):
        rows = rows.combine_chunks()
        ids, keys = (rows.column(c).combine_chunks() for c in ("doc_id", "key"))
        anchor, start = (rows.column(c).to_numpy() for c in ("anchor", "start"))
        number = ids.dictionary_encode().indices.to_numpy()
        h, row, inside = _unpacked(rows.column("hashes").combine_chunks())
        # Within equal hashes the first row is that of the least document: rows are sorted.
        order = np.lexsort((np.arange(len(h)), h, anchor[row]))
        new = np.concatenate([[True], (h[order][1:] != h[order][:-1]) | (anchor[row[order]][1:] != anchor[row[order]][:-1])])
        first = np.empty(len(h), np.int64)
        first[order] = order[np.flatnonzero(new)][np.cumsum(new) - 1]
        at = np.flatnonzero(number[row[first]] != number[row])
        if not len(at):
            return
        r, f = row[at], row[first[at]]
        ahead = start[f] + inside[first[at]]
        cut = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1] + 1) | (r[1:] != r[:-1]) | (f[1:] != f[:-1]) | (ahead[1:] != ahead[:-1] + 1)]))
        own = start[r] + inside[at]
        last = np.append(cut[1:], len(at)) - 1
        to, of = pa.array(r[cut]), pa.array(f[cut])
        yield pa.RecordBatch.from_arrays([ids.take(to), keys.take(to), *(pa.array(x.astype(np.int32)) for x in (own[cut], own[last] + WINDOW)), ids.take(of), keys.take(of), pa.array(ahead[cut].astype(np.int32))], names)

    def run(batches):
        held, n = [], 0
        for b in batches:
            if not b.num_rows:
                continue
            held.append(b)
            n += b.column("hashes").nbytes // 8
            if n < HELD_WINDOWS:
                continue
            rows = pa.Table.from_batches(held)
            anchor = rows.column("anchor").to_numpy()
            cut = int(np.searchsorted(anchor, anchor[-1]))
            if cut:
                yield from pieces(rows.slice(0, cut))
                held = rows.slice(cut).combine_chunks().to_batches()
                n = sum(x.column("hashes").nbytes // 8 for x in held)
        if held:
            yield from pieces(pa.Table.from_batches(held))

    order = ["anchor", "doc_id", "key", "start"]
    return found.repartition("anchor").sortWithinPartitions(*order).mapInArrow(trimmed(run), f"doc_id {kind}, key long, start int, stop int, f_id {kind}, f_key long, f_start int")


def passages(docs: DataFrame, places: DataFrame) -> DataFrame:
    """places (doc_id, key, start, stop, about) with words: those of docs (doc_id, text, key) there, joined by one space.

    Places go to texts while they are small enough to broadcast; beyond that both are shuffled by document.
    """
    about = places.schema["about"].dataType.simpleString()
    kind = docs.schema["doc_id"].dataType.simpleString()
    lists = written(places.groupBy("doc_id", "key").agg(F.collect_set(F.struct("start", "stop", "about")).alias("places")), "places")

    def cut(batches):
        for b in batches:
            cols = [[] for _ in range(6)]
            for i, k, t, places in zip(*(b.column(c).to_pylist() for c in ("doc_id", "key", "text", "places"))):
                words = t.encode().split()
                for p in places:
                    for col, v in zip(cols, (i, k, p["start"], p["stop"], p["about"], b" ".join(words[p["start"] : p["stop"]]))):
                        col.append(v)
            about_type = b.schema.field("places").type.value_type.field("about").type
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (b.schema.field("doc_id").type, pa.int64(), pa.int32(), pa.int32(), about_type, pa.binary()))], ["doc_id", "key", "start", "stop", "about", "words"])

    some = docs.join(maybe_broadcast(lists), ["doc_id", "key"]).select("doc_id", "key", "text", "places")
    return some.mapInArrow(trimmed(cut), f"doc_id {kind}, key long, start int, stop int, about {about}, words binary")


def dedup_passages(docs: DataFrame, hash_bits: int = 64) -> DataFrame:
    """doc_id, n_words, n_removed, kept_text of each row of docs (doc_id, text, ...).

    Words are runs of characters other than 0x20 and 0x09 to 0x0D; kept ones are joined by one space.
    Every word goes that a window covers whose words also start in a document with a smaller doc_id.
    Null and empty texts have no words; an empty table gives an empty one; other columns are ignored whatever their names. Rows repeated under one doc_id do not remove each other's words;
    a row without doc_id loses none and removes none. No text passes a shuffle while the ranges to
    remove are small enough to broadcast; beyond that Spark joins by shuffle.
    """
    ranges = repeated_windows(docs, hash_bits).withColumnRenamed("doc_id", "r_id").withColumnRenamed("key", "r_key")
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.join(maybe_broadcast(ranges), (F.col("doc_id") == F.col("r_id")) & (F.xxhash64("text") == F.col("r_key")), "left").select("doc_id", "text", "ranges")

    def cut(batches):
        for b in batches:
            total, removed, kept = [], [], []
            for t, ranges in zip(b.column("text"), b.column("ranges").to_pylist()):
                words = t.as_py().encode().split()
                total.append(len(words))
                if ranges:
                    left, at = [], 0
                    for s, e in zip(ranges[::2], ranges[1::2]):
                        left += words[at:s]
                        at = max(at, e)
                    words = left + words[at:]
                removed.append(total[-1] - len(words))
                kept.append(b" ".join(words).decode())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], ["doc_id", "n_words", "n_removed", "kept_text"])

    return rows.mapInArrow(trimmed(cut), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_words long, n_removed long, kept_text string")


def digest(kept: DataFrame) -> DataFrame:
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))
