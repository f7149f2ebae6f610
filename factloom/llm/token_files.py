"""Token ids in directly addressable blocks, and their writer and reader.

A block holds the ids of consecutive documents. Ids are cut into chunks of 8 bits: level k has the
k-th chunk of every id that reaches it, a bitmap that says which of them go on, and a directory of
the bitmap's set bits before every 512th bit. Any token is then found by one rank a level, without
decoding the block. Blocks are rows of a Parquet table in ascending doc_id order.
"""

from __future__ import annotations

import functools
import os
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Words, maybe_broadcast, new_path, slices, text_bytes, written

MAGIC = b"DAC1"
STEP = 512
#: A block ends with the document that brings it to this many tokens, or at this many documents.
BLOCK_TOKENS, BLOCK_DOCS = 1 << 18, 4096
#: Words that a task remembers the ids of.
CACHE_WORDS = 1_500_000


def pack(ids: np.ndarray) -> bytes:
    """The levels of ids (unsigned 32-bit)."""
    out, left = [], ids.astype("<u4")
    while True:
        more = left > 0xFF
        bits = np.packbits(more, bitorder="little")
        ones = np.concatenate([[0], np.cumsum(np.add.reduceat(more, np.arange(0, len(more), STEP)))[:-1]]) if len(more) else np.zeros(0)
        out.append(struct.pack("<II", len(left), int(more.any())) + (left & 0xFF).astype(np.uint8).tobytes() + bits.tobytes() + ones.astype("<u4").tobytes())
        if not more.any():
            return MAGIC + b"".join(out)
        left = left[more] >> 8


class Codes:
    """Reader of pack()'s bytes: all ids, or any one by rank."""

    def __init__(self, data: bytes):
        if data[:4] != MAGIC:
            raise ValueError("not a block of token codes")
        self.levels, at, more = [], 4, 1
        while more:
            n, more = struct.unpack_from("<II", data, at)
            at += 8
            chunk = np.frombuffer(data, np.uint8, n, at)
            at += n
            bits = np.frombuffer(data, np.uint8, (n + 7) // 8, at)
            at += len(bits)
            ones = np.frombuffer(data, "<u4", (n + STEP - 1) // STEP, at)
            at += 4 * len(ones)
            self.levels.append((chunk, bits, ones))

    def __len__(self) -> int:
        return len(self.levels[0][0])

    def __getitem__(self, i: int) -> int:
        value = 0
        for k, (chunk, bits, ones) in enumerate(self.levels):
            value |= int(chunk[i]) << (8 * k)
            if not bits[i >> 3] >> (i & 7) & 1:
                return value
            start = i // STEP
            i = int(ones[start]) + int(np.unpackbits(bits[start * STEP // 8 : (i >> 3) + 1], bitorder="little")[: i - start * STEP].sum())
        return value

    def all(self) -> np.ndarray:
        n = len(self)
        value, at = np.zeros(n, np.uint32), np.arange(n)
        for k, (chunk, bits, _) in enumerate(self.levels):
            value[at] |= chunk.astype(np.uint32) << np.uint32(8 * k)
            at = at[np.unpackbits(bits, count=len(chunk), bitorder="little").astype(bool)]
        return value


#: The letters that stand for bytes in byte-level vocabularies; Latin letters whose lower case
#: and composition depend on nothing around them.
_PLAIN = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTE_LETTERS = dict(zip([b for b in range(256) if b not in _PLAIN], range(256, 512)))
LETTERS = re.compile(r"[a-zA-Z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u012F\u0131-\u017F]+")


class WordEncoder:
    """Encodes texts with a tokenizers file, word by word with memory.

    The file's pre-tokenizer never joins what white space separates, so the ids of a text are those of its
    words. Words are known by 64-bit hashes. Rows with a special token's string are encoded whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self._forget()
        probe = ["a", "the", "thndesea", "größe", "œuvreç", "ññandú"]
        self.direct = self._whole(probe) == [self._merged(w) for w in probe]

    def _forget(self) -> None:
        self.words = np.zeros(0, np.uint64)  # sorted hashes
        self.start, self.size = np.zeros(0, np.int64), np.zeros(0, np.int64)  # of their ids
        self.ids = np.zeros(0, np.uint32)

    def _whole(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _merged(self, word: str) -> list[int]:
        """The ids of one lower-case word of letters by the merges alone: no split or mapping can change it."""
        word = word if word.isascii() else word.encode().decode("latin-1").translate(BYTE_LETTERS)
        return [t.id for t in self.model.tokenize(word)]

    def _learn(self, hashes: np.ndarray, words: list[str]) -> None:
        if len(self.words) + len(words) > CACHE_WORDS:
            self._forget()
        found: list = [None] * len(words)
        rest = []
        for i, w in enumerate(words):
            if self.direct and LETTERS.fullmatch(w):
                found[i] = self._merged(w.lower())
            elif self.direct and w[-1] in ".,;:!?" and LETTERS.fullmatch(w[:-1]):
                found[i] = self._merged(w[:-1].lower()) + self._mark(w[-1])
            else:
                rest.append(i)
        for i, ids in zip(rest, self._whole([words[i] for i in rest])):
            found[i] = ids
        size = np.array([len(x) for x in found], np.int64)
        start = len(self.ids) + np.cumsum(size) - size
        self.ids = np.concatenate([self.ids, np.array([i for x in found for i in x], np.uint32)])
        both = np.concatenate([self.words, hashes])
        order = np.argsort(both, kind="stable")
        self.words, self.start, self.size = both[order], np.concatenate([self.start, start])[order], np.concatenate([self.size, size])[order]

    @functools.cache
    def _mark(self, mark: str) -> list[int]:
        return self._whole([mark])[0]

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all rows one after another, and how many each has."""
        ids, sizes = [], []
        column = column.fill_null("")
        odd = np.zeros(len(column), bool)
        for s in self.special:
            odd |= pc.match_substring(column, s).to_numpy(zero_copy_only=False)
        data, at = text_bytes(column)
        for i, j in slices(at):
            w = Words(data, at[i : j + 1])
            hashes, where, back = np.unique(w.hash[0], return_index=True, return_inverse=True)
            place = np.minimum(np.searchsorted(self.words, hashes), max(0, len(self.words) - 1))
            new = self.words[place] != hashes if len(self.words) else np.ones(len(hashes), bool)
            if new.any():
                if len(self.words) + np.count_nonzero(new) > CACHE_WORDS:
                    self._forget()
                    new[:] = True
                raw = w.data.tobytes()
                self._learn(hashes[new], [raw[w.start[k] : w.end[k]].decode() for k in where[new].tolist()])
                place = np.searchsorted(self.words, hashes)
            start, size = self.start[place][back], self.size[place][back]
            ends = np.cumsum(size)
            own = self.ids[np.repeat(start - (ends - size), size) + np.arange(int(size.sum()))]
            count = np.diff(np.concatenate([[0], ends])[w.first])
            if odd[i:j].any():
                parts = np.split(own, np.cumsum(count)[:-1])
                for k in np.flatnonzero(odd[i:j]).tolist():
                    parts[k] = np.array(self._whole([column[i + k].as_py()])[0], np.uint32)
                own, count = np.concatenate(parts), np.array([len(p) for p in parts])
            ids.append(own)
            sizes.append(count)
        return np.concatenate(ids or [np.zeros(0, np.uint32)]), np.concatenate(sizes or [np.zeros(0, np.int64)])


@functools.cache
def _encoder(path: str) -> WordEncoder:
    """One for each Python worker, whose later tasks know the words of the earlier ones."""
    return WordEncoder(path)


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int) -> None:
    """Writes the ids of docs (doc_id, text), each with end_id behind, in ascending doc_id order.

    Null texts count as empty. Null doc_ids come first; repeated ids keep a row each. A task holds one
    batch of texts and one block.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"part int, block int, before long, docs array<struct<doc_id:{kind},n_tokens:int>>, n_tokens long, codes binary"

    def run(batches):
        encoder, part, block, before = _encoder(tokenizer), TaskContext.get().partitionId(), 0, 0
        ids: list[np.ndarray] = []
        names: list[dict] = []
        tokens, end = 0, np.array([end_id], np.uint32)

        def row():
            return pa.RecordBatch.from_pylist([{"part": part, "block": block, "before": before, "docs": names, "n_tokens": tokens, "codes": pack(np.concatenate(ids))}], out)

        out = pa.schema([("part", pa.int32()), ("block", pa.int32()), ("before", pa.int64()), ("docs", pa.list_(pa.struct([("doc_id", docs_kind), ("n_tokens", pa.int32())]))), ("n_tokens", pa.int64()), ("codes", pa.binary())])
        for b in batches:
            found, sizes = encoder.encode(b.column("text"))
            for doc, code in zip(b.column("doc_id").to_pylist(), np.split(found, np.cumsum(sizes)[:-1])):
                ids += (code, end)
                names.append({"doc_id": doc, "n_tokens": len(code) + 1})
                tokens += len(code) + 1
                if tokens >= BLOCK_TOKENS or len(names) >= BLOCK_DOCS:
                    yield row()
                    block, before = block + 1, before + tokens
                    ids, names, tokens = [], [], 0
        if names:
            yield row()

    from pyspark.sql.pandas.types import to_arrow_type

    docs_kind = to_arrow_type(docs.schema["doc_id"].dataType)
    rows = docs.select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    rows.mapInArrow(run, schema).write.parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document of the files."""
    blocks = spark.read.parquet(path)
    # One row for each file part; what comes before a block within its part stands beside it.
    parts = blocks.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    parts = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("offset"))
    kind = next(f for f in blocks.schema["docs"].dataType.elementType if f.name == "doc_id").dataType

    def run(batches):
        for b in batches:
            for r in b.to_pylist():
                ids = Codes(r["codes"]).all().astype("<u4")
                sizes = np.array([d["n_tokens"] for d in r["docs"]], np.int64)
                ends = np.cumsum(sizes)
                crc = [zlib.crc32(ids[e - n : e].tobytes()) for e, n in zip(ends.tolist(), sizes.tolist())]
                yield pa.RecordBatch.from_arrays([pa.array([d["doc_id"] for d in r["docs"]], docs_kind), pa.array(r["offset"] + r["before"] + ends - sizes), pa.array(sizes), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    from pyspark.sql.pandas.types import to_arrow_type

    docs_kind = to_arrow_type(kind)
    # One row a file: broadcast while they are few, as blocks are large.
    parts = maybe_broadcast(written(parts, "token-parts"))
    return blocks.join(parts, "part").select("docs", "codes", "before", "offset").mapInArrow(run, f"doc_id {kind.simpleString()}, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, tokenizer: str, end_id: int = 2) -> DataFrame:
    path = new_path(docs.sparkSession, "tokens")
    write_tokens(docs, path, tokenizer, end_id)
    return read_tokens(docs.sparkSession, path)
