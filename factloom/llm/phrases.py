"""Phrase collocations by stripes: every prefix keys an associative counter of the words that follow it.

Tasks build the stripes of their texts' prefixes, from the empty one, whose stripe counts the words, to those of four words. Merged entry by
entry, the stripes hold all that is asked: an entry is the count of a phrase as an extension of its prefix and, of that phrase as a prefix or as
the rest of another, its total; the greatest entry of a stripe tells whether some extension is as frequent as the prefix.

Only phrases that are frequent enough are in the stripes. Which these are is found word by word, over 64-bit hashes: a round counts
phrases of one more word whose two parts the round before found frequent. Bloom filters of bounded size tell tasks; they, and hashes that
collide, let some phrases too many into the stripes, which count words exactly and drop them, and keep none out.

Stripes are merged in the tasks that made them, then by prefix, elementwise. The longest ones, of the empty prefix and of prefixes of one word, are
cut by their words into parts that are merged apart; every merged stripe has frequent words only, each once. Between tasks, stripes go in bundles of
many, as most are short: all of a prefix, or of one part of it, are in one bundle.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import maybe_broadcast, mix, slices, text_bytes, trimmed, written

LONGEST, LEAST, TOP = 5, 100, 2000
#: Bits of a Bloom filter: sixteen for each phrase within these bounds (the most is 16 MB).
LEAST_BITS, MOST_BITS, PROBES = 1 << 16, 1 << 27, 2
#: Bytes of text of a block, and parts of a language that are sorted before its first phrases are taken.
BLOCK, SALTS = 1 << 22, 64
#: Entries of stripes that a task holds before it merges them, rows of a batch that it passes on, and parts of the stripe of a short prefix.
HELD, ROWS_OUT, PARTS = 1 << 20, 50_000, 16
#: Bundles at least, frequent phrases of a bundle, entries of a row of one and rows of a batch of them.
LEAST_BUNDLES, BUNDLED, ROW_ENTRIES, BUNDLES_OUT = 256, 1 << 13, 512, 2000
#: Multipliers of phrase hashes.
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1B54A32D192ED03)

_SPACE = np.isin(np.arange(256), [0x20, 0x09])
_BREAK = np.isin(np.arange(256), [*b".,;:!?", 0x0A, 0x0B, 0x0C, 0x0D])


class Block:
    """The words of a block of texts as numbers: of each place, the number of its (language, word) and whether the next word follows in the same piece."""

    def __init__(self, langs: pa.Array, data: np.ndarray, at: np.ndarray):
        data, at = data[int(at[0]) : int(at[-1])], at - int(at[0])
        data = np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)
        apart = _BREAK[data]
        word = ~(apart | _SPACE[data])
        before, after = np.zeros_like(word), np.zeros_like(word)
        before[1:], after[:-1] = word[:-1], word[1:]
        edges = at[(at > 0) & (at < len(data))]
        before[edges] = False
        after[edges - 1] = False
        start, end = np.flatnonzero(word & ~before), np.flatnonzero(word & ~after) + 1
        # A piece ends at its row's end, too; equal numbers of breaks before two words of one row: one piece.
        row = np.searchsorted(at, start, side="right") - 1
        breaks = np.cumsum(apart, dtype=np.int32)[start] if len(start) else np.zeros(0, np.int32)
        self.next = np.zeros(len(start), bool)
        self.next[:-1] = (row[1:] == row[:-1]) & (breaks[1:] == breaks[:-1])
        # The words without what is between them are an Arrow array.
        offsets = np.concatenate([[0], np.cumsum(end - start)]).astype(np.int64)
        words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(data[word])]).dictionary_encode()
        langs = langs.dictionary_encode()
        self.langs, self.words = langs.dictionary, words.dictionary
        width = max(1, len(self.words))
        lang = langs.indices.to_numpy(zero_copy_only=False).astype(np.int64)[row]
        distinct, self.number = np.unique(lang * width + words.indices.to_numpy(zero_copy_only=False), return_inverse=True)
        self.lang, self.word = distinct // width, distinct % width
        self.hash = mix(_hashed(self.langs)[self.lang] * _A + _hashed(self.words)[self.word])


def _hashed(values: pa.Array) -> np.ndarray:
    """A 64-bit hash of each string."""
    if not len(values):
        return np.zeros(0, np.uint64)
    data, at = text_bytes(values)
    data, at = data[int(at[0]) : int(at[-1])], at - int(at[0])
    length = np.diff(at)
    place = np.arange(len(data)) - np.repeat(at[:-1], length)
    with np.errstate(over="ignore"):
        terms = mix((data.astype(np.uint64) + np.uint64(1)) * _A + place.astype(np.uint64) * _B)
        sums = np.concatenate([[np.uint64(0)], np.cumsum(terms)])
        return mix(sums[at[1:]] - sums[at[:-1]] + length.astype(np.uint64))


def _probes(h: np.ndarray, bits: int) -> list[np.ndarray]:
    with np.errstate(over="ignore"):
        return [mix(h + np.uint64(k + 1) * _B) & np.uint64(bits - 1) for k in range(PROBES)]


def _passes(bloom: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Which hashes a filter (bytes) may hold."""
    out = np.ones(len(h), bool)
    for place in _probes(h, len(bloom) * 8):
        out &= (bloom[(place >> np.uint64(3)).astype(np.int64)] >> (place & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
    return out


def grown(block: Block, blooms: list[np.ndarray], longest: int):
    """For phrases of 1, 2 .. longest words of a block: their places, the number of the phrase at each place, the hash of each number, and for
    each number that of the phrase without its last word and the last word's number.

    A phrase is there only if the filters may hold all shorter ones in it; filter k is of the frequent phrases of k + 1 words.
    """
    words = block.number
    place, number, h = np.arange(len(words)), words, block.hash
    first = last = np.arange(len(h))
    for k in range(longest):
        yield place, number, h, first, last
        if k == longest - 1:
            return
        good = _passes(blooms[k], h)[number]
        place, number = place[good], number[good]
        often = np.zeros(len(words) + 1, bool)
        often[place] = True
        follows = block.next[place + k] & often[place + 1]
        place, number = place[follows], number[follows]
        width = max(1, len(block.hash))
        pair, number = np.unique(number * width + words[place + k + 1], return_inverse=True)
        first, last = pair // width, pair % width
        h = mix(h[first] * _A + block.hash[last] * _B)


def stripes(block: Block, blooms: list[np.ndarray]) -> pa.Table:
    """The entries (lang, prefix, word, n) of the stripes of a block, of phrases (prefix and word) that the filters may hold."""
    out, texts, langs = [], [], []
    names = block.words.take(pa.array(block.word)).cast(pa.large_string()) if len(block.word) else pa.array([], pa.large_string())
    for k, (_, number, h, first, last) in enumerate(grown(block, blooms, len(blooms))):
        if k == 0:
            prefix = pa.array([""], pa.large_string()).take(pa.array(np.zeros(len(h), np.int64)))
            texts, langs = names, block.lang
        else:
            prefix, langs = texts.take(pa.array(first)), langs[first]
            texts = pc.binary_join_element_wise(prefix, names.take(pa.array(last)), pa.scalar(" ", pa.large_string()))
        n = np.bincount(number, minlength=len(h))
        kept = np.flatnonzero(_passes(blooms[k], h) & (n > 0))
        rows = pa.array(kept)
        columns = [block.langs.take(pa.array(langs[kept])), prefix.take(rows), names.take(pa.array(last[kept])), pa.array(n[kept].astype(np.int64))]
        out.append(pa.table([x.cast(pa.large_string()) if i < 3 else x for i, x in enumerate(columns)], ["lang", "prefix", "word", "n"]))
    return pa.concat_tables(out)


def _blocks(batches):
    for b in batches:
        data, at = text_bytes(b.column("text"))
        for i, j in slices(at, BLOCK):
            if at[j] > at[i]:
                yield Block(b.column("lang").slice(i, j - i), data, at[i : j + 1])


def _frequent_hashes(docs: DataFrame, blooms: list[np.ndarray], least: int) -> DataFrame:
    """h: the hashes of phrases of one word more than there are filters that occur `least` times, or collide with others until they do."""

    def run(batches):
        for block in _blocks(batches):
            for _, number, h, _, _ in grown(block, blooms, len(blooms) + 1):
                pass
            n = np.bincount(number, minlength=len(h))
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n.astype(np.int32))], ["h", "n"])

    each = docs.select("lang", "text").mapInArrow(trimmed(run), "h long, n int")
    return each.groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") >= least).select("h")


def _bloom(hashes: DataFrame, count: int) -> np.ndarray:
    """A filter of hashes, as bytes: parts of at most 16 MB in each task, joined bit by bit."""
    bits = LEAST_BITS
    while bits < min(MOST_BITS, 16 * count):
        bits *= 2
    chunk = LEAST_BITS // 8

    def run(batches):
        bloom = np.zeros(bits // 8, np.uint8)
        for b in batches:
            for place in _probes(b.column("h").to_numpy().view(np.uint64), bits):
                np.bitwise_or.at(bloom, (place >> np.uint64(3)).astype(np.int64), np.uint8(1) << (place & np.uint64(7)).astype(np.uint8))
        for i in range(0, len(bloom), chunk):
            if bloom[i : i + chunk].any():
                yield pa.RecordBatch.from_pydict({"chunk": pa.array([i // chunk], pa.int32()), "bits": pa.array([bloom[i : i + chunk].tobytes()], pa.binary())})

    def union(batches):
        of: dict[int, np.ndarray] = {}
        for b in batches:
            for r in b.to_pylist():
                x = np.frombuffer(r["bits"], np.uint8)
                of[r["chunk"]] = of[r["chunk"]] | x if r["chunk"] in of else x
        for c, x in of.items():
            yield pa.RecordBatch.from_pydict({"chunk": pa.array([c], pa.int32()), "bits": pa.array([x.tobytes()], pa.binary())})

    parts = hashes.mapInArrow(trimmed(run), "chunk int, bits binary")
    out = np.zeros(bits // 8, np.uint8)
    for r in parts.repartition("chunk").mapInArrow(trimmed(union), "chunk int, bits binary").collect():  # of bounded size
        out[r.chunk * chunk : (r.chunk + 1) * chunk] = np.frombuffer(r.bits, np.uint8)
    return out


def _stripes_of(table: pa.Table, keys: list[str]) -> pa.RecordBatch:
    """Rows of a stripe each (its keys, words and their counts), from entries."""
    table = table.sort_by([(k, "ascending") for k in keys]).combine_chunks()
    columns = [table.column(c).combine_chunks() for c in keys]
    n = len(table)
    same = np.ones(n - 1, bool)
    for x in columns:
        same &= pc.equal(x.slice(1), x.slice(0, n - 1)).to_numpy(zero_copy_only=False)
    cut = np.concatenate([[0], np.flatnonzero(~same) + 1])
    ends, rows = pa.array(np.append(cut, n).astype(np.int32)), pa.array(cut)
    lists = [pa.ListArray.from_arrays(ends, table.column(c).combine_chunks().cast(t)) for c, t in (("word", pa.string()), ("n", pa.int64()))]
    firsts = [x.take(rows) for x in columns]
    return pa.RecordBatch.from_arrays([*[x.cast(pa.string()) if pa.types.is_large_string(x.type) else x for x in firsts], *lists], [*keys, "words", "counts"])


def _bundled(stripes: pa.RecordBatch, bundles: int):
    """Rows (bundle, stripes) of some ROW_ENTRIES entries of one bundle each. A stripe's bundle depends on its keys alone."""
    with np.errstate(over="ignore"):
        h = mix(_hashed(stripes.column("lang")) * _A + _hashed(stripes.column("prefix")) * _B + stripes.column("part").to_numpy().astype(np.uint64))
    bundle = (h % np.uint64(bundles)).astype(np.int32)
    order = np.argsort(bundle, kind="stable")
    bundle, stripes = bundle[order], stripes.take(pa.array(order))
    row = np.cumsum(pc.list_value_length(stripes.column("words")).to_numpy()) // ROW_ENTRIES
    cut = np.flatnonzero(np.concatenate([[True], (bundle[1:] != bundle[:-1]) | (row[1:] != row[:-1])]))
    lists = pa.ListArray.from_arrays(pa.array(np.append(cut, len(bundle)).astype(np.int32)), stripes.to_struct_array())
    whole = pa.RecordBatch.from_arrays([pa.array(bundle[cut]), lists], ["bundle", "stripes"])
    for i in range(0, whole.num_rows, BUNDLES_OUT):
        yield whole.slice(i, BUNDLES_OUT)


def _joined(held: list[pa.Table], keys: list[str]) -> pa.Table:
    """Entries with equal keys and words as one."""
    return pa.concat_tables(held).group_by([*keys, "word"]).aggregate([("n", "sum")]).rename_columns([*keys, "word", "n"])


def merged(docs: DataFrame, blooms: list[np.ndarray], least: int = 1, bundles: int = LEAST_BUNDLES) -> DataFrame:
    """(lang, prefix, word, n): the stripes of all texts (lang, text), merged elementwise, with entries of `least` or more.

    A task merges the stripes of its own blocks; those of all tasks are dealt out in bundles and merged again, so that a task holds
    one merged bundle and what it has read since. Stripes of short prefixes, which may be long, are dealt out in parts by their words.
    The empty prefix's entry without a word counts all words of the language and is always there.
    """
    keys = ["lang", "prefix"]

    def out(table):
        short = pc.invert(pc.match_substring(table.column("prefix"), " ")).to_numpy()
        part = np.where(short, _hashed(table.column("word").combine_chunks()) % np.uint64(PARTS), np.uint64(0))
        yield from _bundled(_stripes_of(table.append_column("part", pa.array(part.astype(np.int32))), [*keys, "part"]), bundles)

    def run(batches):
        held, rows = [], 0
        for block in _blocks(batches):
            held.append(stripes(block, blooms))
            words = np.bincount(block.lang[block.number], minlength=len(block.langs))
            held.append(pa.table([block.langs.cast(pa.large_string()), *[pa.array([x] * len(words), pa.large_string()) for x in ("", None)], pa.array(words.astype(np.int64))], ["lang", "prefix", "word", "n"]))
            rows += len(held[-2])
            if rows > HELD:
                held = [_joined(held, keys)]
                rows = len(held[0])
                if rows > HELD // 2:
                    yield from out(held[0])
                    held, rows = [], 0
        if held:
            yield from out(_joined(held, keys))

    def merge(batches):
        held, rows = [], 0

        def often(table):
            table = table.filter(pc.or_(pc.is_null(table.column("word")), pc.greater_equal(table.column("n"), least)))
            yield from table.select([*keys, "word", "n"]).combine_chunks().to_batches(ROWS_OUT)

        for b in batches:
            if not b.num_rows:
                continue
            found = b.column("stripes").flatten()
            lang, prefix, words, counts = (found.field(c) for c in (*keys, "words", "counts"))
            row = pc.list_parent_indices(words)
            bundle = b.column("bundle").take(pc.list_parent_indices(b.column("stripes"))).take(row)
            held.append(pa.table([bundle, lang.take(row), prefix.take(row), words.flatten(), counts.flatten()], ["bundle", *keys, "word", "n"]))
            rows += len(row)
            if rows > HELD:
                whole = _joined(held, ["bundle", *keys])
                # Rows come in order: of all bundles but the last nothing more follows.
                last = pc.equal(whole.column("bundle"), b.column("bundle")[-1])
                yield from often(whole.filter(pc.invert(last)))
                held = [whole.filter(last)]
                rows = len(held[0])
        if held:
            yield from often(_joined(held, ["bundle", *keys]))

    shape = "array<struct<lang string, prefix string, part int, words array<string>, counts array<long>>>"
    each = docs.select("lang", "text").mapInArrow(trimmed(run), f"bundle int, stripes {shape}")
    return each.repartition("bundle").sortWithinPartitions("bundle").mapInArrow(trimmed(merge), "lang string, prefix string, word string, n long")


def _first(scored: DataFrame, top: int) -> DataFrame:
    """The first rows of each language: first those of each of its parts, so that no language is sorted in one task."""
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    part = F.pmod(F.xxhash64("phrase"), F.lit(SALTS))
    some = scored.withColumn("part", part).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= top)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP) -> DataFrame:
    """The strongest phrases of two to five words of each language.

    docs: text, lang and any other columns, which are ignored; a null text has no words, a null lang is `und`. Returns lang, rank,
    phrase, a (its count), l and r (those of the two parts of its weakest cut), n (all words of the language) and score, for the first
    `top` phrases by score, a and the phrase's bytes. Candidates have `least` occurrences or more; one that is contained in a
    longer phrase with as many occurrences is dropped. Counts run over all rows, repeated ones too, and whole texts. Products are
    exact decimals of 38 digits. A language without candidates has no row, an empty table none at all.
    """
    docs = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), "text")
    blooms: list[np.ndarray] = []
    total = 0
    for k in range(LONGEST):
        hashes = written(_frequent_hashes(docs, blooms, least), f"phrase-hashes-{k}")
        count = hashes.count()
        if not count:
            break
        blooms.append(_bloom(hashes, count))
        total += count
    every = written(merged(docs, blooms, least, max(LEAST_BUNDLES, total // BUNDLED)), "stripes")
    stripe = every.where("word IS NOT NULL")
    phrase = F.when(F.col("prefix") == "", F.col("word")).otherwise(F.concat_ws(" ", "prefix", "word"))
    totals = stripe.select(F.col("lang").alias("t_lang"), phrase.alias("t_phrase"), F.col("n").alias("total"))
    candidates = stripe.where("prefix != ''").select("lang", phrase.alias("phrase"), F.col("n").alias("a"))

    # A word before the phrase, or one after it, that all its occurrences have.
    rest = candidates.select(F.col("lang").alias("c_lang"), F.expr("substring(phrase, instr(phrase, ' ') + 1)").alias("c_phrase"), "a")
    ahead = rest.groupBy("c_lang", "c_phrase").agg(F.max("a").alias("most"))
    behind = stripe.where("instr(prefix, ' ') > 0").groupBy(F.col("lang").alias("c_lang"), F.col("prefix").alias("c_phrase")).agg(F.max("n").alias("most"))
    longer = written(ahead.unionByName(behind).groupBy("c_lang", "c_phrase").agg(F.max("most").alias("most")).where("instr(c_phrase, ' ') > 0"), "phrase-extended")
    kept = candidates.join(maybe_broadcast(longer), (F.col("lang") == F.col("c_lang")) & (F.col("phrase") == F.col("c_phrase")), "left")
    kept = written(kept.where("most IS NULL OR most < a").select("lang", "phrase", "a"), "phrase-kept")

    totals = maybe_broadcast(written(totals, "phrase-totals"), 96)
    cuts = kept.select("lang", "phrase", "a", F.explode(F.sequence(F.lit(1), F.size(F.split("phrase", " ")) - 1)).alias("k"))
    cuts = cuts.withColumn("left", F.expr("substring_index(phrase, ' ', k)")).withColumn("right", F.expr("substring(phrase, char_length(left) + 2)"))
    for side, name in (("left", "l"), ("right", "r")):
        cuts = cuts.join(totals, (F.col("lang") == F.col("t_lang")) & (F.col(side) == F.col("t_phrase"))).withColumnRenamed("total", name).drop("t_lang", "t_phrase")
    sizes = written(every.where("word IS NULL").select(F.col("lang").alias("t_lang"), "n"), "words-of-languages")
    cuts = cuts.join(maybe_broadcast(sizes), F.col("lang") == F.col("t_lang"))
    a, n, l, r = (F.col(c).cast("decimal(19,0)") for c in ("a", "n", "l", "r"))
    cuts = cuts.withColumn("above", F.lit(1000).cast("decimal(4,0)") * (a * n)).withColumn("below", l * r).withColumn("score", F.expr("above DIV below"))
    weakest = cuts.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    scored = weakest.select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")
    return _first(scored, top)


ORACLE = rf"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents WHERE text IS NOT NULL),
p AS (SELECT lang, unnest(string_split_regex(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM d),
w AS (SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x != '') AS ws FROM p),
g AS (SELECT lang, k, ws, unnest(range(1, len(ws) - k + 2)) AS i FROM w, range(1, {LONGEST + 1}) r(k)),
f AS (SELECT lang, k, array_to_string(ws[i : i + k - 1], ' ') AS phrase, count(*) AS f FROM g GROUP BY ALL),
n AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT * FROM f WHERE k > 1 AND f >= {LEAST}),
s AS (SELECT * FROM c WHERE NOT EXISTS (SELECT 1 FROM c x WHERE x.lang = c.lang AND x.k > c.k AND 100 * x.f >= 100 * c.f AND contains(' ' || x.phrase || ' ', ' ' || c.phrase || ' '))),
u AS (SELECT lang, phrase, f, string_split(phrase, ' ') AS ws, unnest(range(1, k)) AS j FROM s),
v AS (SELECT u.lang, u.phrase, u.f AS a, j, x.f AS l, y.f AS r, n, CAST(1000 * CAST(u.f AS HUGEINT) * n // (CAST(x.f AS HUGEINT) * y.f) AS BIGINT) AS score
      FROM u JOIN f x ON x.lang = u.lang AND x.phrase = array_to_string(ws[:j], ' ') JOIN f y ON y.lang = u.lang AND y.phrase = array_to_string(ws[j + 1 :], ' ') JOIN n ON n.lang = u.lang
      QUALIFY row_number() OVER (PARTITION BY u.lang, u.phrase ORDER BY score, j) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM v QUALIFY rank <= {TOP}
"""
