"""Delimited files of unknown delimiter, encoding and quoting as tables of strings.

The driver reads a file's first record only; what has to be known of all lines (whether any is not UTF-8, has too many fields or an
open quote) is an aggregate over them. Records are split by Spark's own CSV functions.
"""

from __future__ import annotations

import csv
from contextlib import contextmanager
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom.sources.shared import written

#: A first line with a field of this length is data, not a header.
DATA_CHARS = 50
#: Characters of a record whose quotes are taken to span lines.
MOST_RECORD = 1 << 24
DELIMITERS = (";", ",", "\t", "|")
#: Where a row of a text file stands.
PLACE = ("_metadata.file_path AS file", "_metadata.file_block_start AS block", "monotonically_increasing_id() AS id")


def clean_name(name: str) -> str:
    """A column's name without spaces, a byte order mark and quotes around it."""
    return name.strip().lstrip("﻿").strip('"').strip()


def first_bytes(spark: SparkSession, path: str) -> bytes:
    row = spark.read.text(path).select(F.col("value").cast("binary").alias("b")).head()
    return bytes(row.b) if row else b""


def encoding_of(spark: SparkSession, path: str) -> str:
    """UTF-16 by its mark, UTF-8 if all lines are valid, else Latin-1."""
    if first_bytes(spark, path)[:2] in (b"\xff\xfe", b"\xfe\xff"):
        return "UTF-16"
    odd = spark.read.text(path).where(~F.expr("is_valid_utf8(value)"))
    return "UTF-8" if odd.isEmpty() else "ISO-8859-1"


def lines_of(spark: SparkSession, path: str, encoding: str) -> DataFrame:
    """file, block, id and line of each line: the last three tell a line's place in its file, whose blocks are read by different tasks."""
    if encoding == "UTF-16":
        lines = _wide_lines(spark, path)
    else:
        value = F.col("value") if encoding == "UTF-8" else F.decode(F.col("value").cast("binary"), encoding)
        lines = spark.read.text(path).selectExpr(*PLACE, "value").select("file", "block", "id", value.alias("line"))
    return lines.withColumn("line", F.regexp_replace("line", "^\ufeff|\r$", ""))


def _wide_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of UTF-16 files, each in the order of bytes that its mark tells (high bytes first without one).

    Files are split at the two bytes of a line feed. Where these are of two letters, a piece has an odd number of bytes; such pieces
    are put together again by the parity of the bytes before them, as lines are within quotes.
    """
    marks = spark.read.text(path).selectExpr(*PLACE, "value").select("file", "block", "id", F.hex(F.substring(F.col("value").cast("binary"), 1, 2)).alias("mark")).where("block = 0")
    files = marks.groupBy("file").agg(F.min_by("mark", "id").alias("mark")).collect()  # a row a file
    out = None
    for order, feed in (("UTF-16LE", "0A00"), ("UTF-16BE", "000A")):
        mine = [r.file for r in files if (r.mark == "FFFE") == (order == "UTF-16LE")]
        if not mine:
            continue
        pieces = spark.read.options(encoding=order, lineSep="\n").text([unquote(f) for f in mine]).selectExpr(*PLACE, "value").select("file", "block", "id", F.col("value").cast("binary").alias("line"))
        odd = F.length("line") % 2
        if not pieces.where(odd == 1).isEmpty():
            whole = records_of(pieces.withColumn("line", F.hex("line")), F.length("line") / 2 % 2, feed, blank=True)
            pieces = pieces if whole is None else whole.withColumn("line", F.unhex("line"))
        lines = pieces.withColumn("line", F.decode("line", order))
        out = lines if out is None else out.unionByName(lines)
    return out


def _not_blank(lines: DataFrame) -> DataFrame:
    return lines.where(F.trim("line") != "")


def _odd_quotes(line: Column) -> Column:
    return F.pmod(F.length(line) - F.length(F.replace(line, F.lit('"'), F.lit(""))), F.lit(2)).cast("long")


@contextmanager
def _same_blocks(spark: SparkSession):
    """Files are split alike in every job within it, also where executors come and go between them."""
    name = "spark.sql.files.minPartitionNum"
    if spark.conf.get(name, None):
        yield
        return
    spark.conf.set(name, spark.sparkContext.defaultParallelism)
    try:
        yield
    finally:
        spark.conf.unset(name)


class _Open:
    """The record that a task is within: its first line's place, and its lines as long as they are no more than MOST_RECORD characters."""

    def __init__(self, nr: int, at: int, place: int, most: int):
        self.nr, self.at, self.place, self.most, self.size, self.lines = nr, at, place, most, 0, []

    def add(self, lines: pa.Array, size: int) -> None:
        self.size += size
        if self.size > self.most:
            self.lines = []
        else:
            self.lines += lines.to_pylist()

    def row(self, closed: bool, feed: str) -> pa.RecordBatch:
        place = self.place or (0 if closed else 2)
        return _piece_rows([self.nr], [self.at], pa.array([feed.join(self.lines)], pa.string()), [place], [self.size])


def _piece_rows(nr, at, lines: pa.Array, place, size) -> pa.RecordBatch:
    columns = [pa.array(nr, pa.int64()), pa.array(at, pa.int64()), lines.cast(pa.string()), pa.array(place, pa.int32()), pa.array(size, pa.int64())]
    return pa.RecordBatch.from_arrays(columns, ["nr", "id", "line", "place", "size"])


def _pieces(feed: str, most: int):
    """Lines of blocks (nr, before, id, odd, line), in their order, to records and pieces of records: nr, id, line, place, size.

    place is 0 for a record of one block, 1 for what a block has of a record begun before it, 2 for what it has of one that goes on after
    it. size is the sum of characters, and one a line, of records of several lines. A task holds one batch and one record.
    """

    def run(batches):
        held, last, inside, seen = None, None, 0, -1
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            if b.column("nr").null_count:
                raise ValueError("the files have been split in another way since their quotes were counted")
            nr, before, ids, odd = (b.column(c).to_numpy(zero_copy_only=False) for c in ("nr", "before", "id", "odd"))
            if ids[0] <= seen or (np.diff(ids) <= 0).any():
                raise ValueError("lines are not in their order")
            lines = b.column("line")
            new = np.concatenate([[nr[0] != last], nr[1:] != nr[:-1]])
            starts = np.flatnonzero(new | (np.arange(n) == 0))
            first = np.where(new[starts], before[starts], inside)
            earlier = np.cumsum(odd) - odd
            within = (np.repeat(first - earlier[starts], np.diff(np.append(starts, n))) + earlier) % 2
            after = (within + odd) % 2
            size = pc.utf8_length(lines).to_numpy(zero_copy_only=False).astype(np.int64) + 1
            begins = np.flatnonzero((within == 0) | new)
            upto = begins[0] if len(begins) else n
            if upto:
                held.add(lines.slice(0, upto), int(size[:upto].sum()))
            if held and (len(begins) or not after[-1]):
                yield held.row(not (after[upto - 1] if upto else inside), feed)
                held = None
            if len(begins):
                ends = np.append(begins[1:], n)
                open_ = after[ends - 1] == 1
                place = np.where(within[begins] == 1, 1, np.where(open_, 2, 0))
                sizes = np.where((place == 0) & (ends - begins == 1), 0, np.add.reduceat(size, begins))
                k = len(begins) - int(open_[-1])
                if k < len(begins):
                    held = _Open(int(nr[begins[k]]), int(ids[begins[k]]), int(within[begins[k]]), most)
                    held.add(lines.slice(begins[k], n - begins[k]), int(sizes[k]))
                if k:
                    some = pa.ListArray.from_arrays(pa.array(np.append(begins[:k], ends[k - 1]) - begins[0], pa.int32()), lines.slice(begins[0], ends[k - 1] - begins[0]))
                    yield _piece_rows(nr[begins[:k]], ids[begins[:k]], pc.binary_join(some, feed), place[:k], sizes[:k])
            last, inside, seen = nr[-1], after[-1], ids[-1]
        if held:
            yield held.row(False, feed)

    return run


def records_of(lines: DataFrame, odd: Column | None = None, feed: str = "\n", blank: bool = False) -> DataFrame | None:
    """Lines (file, block, id, line) joined to records: lines that end within quotes (after an odd sum of `odd`) go on with the next, after
    `feed`; blank ones between records are left out, but for `blank`. None if the quotes of a file do not pair, or a record would be over MOST_RECORD characters.

    A line begins within quotes if an odd number of quotes is before it: the count of each block is added up over the blocks before (a row for
    each block, which is broadcast), then within the block as its lines are read, so that one file is read by as many tasks as it has blocks.
    The task that reads a block joins its lines, in their order, and the records are written once. Of what is read only the records that
    go over the end of a block are shuffled, two pieces a block at most.
    """
    lines = lines.withColumn("odd", (_odd_quotes(F.col("line")) if odd is None else odd).cast("long"))
    if lines.where("odd = 1").isEmpty():
        return _not_blank(lines).drop("odd")
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    with _same_blocks(lines.sparkSession):
        blocks = lines.groupBy("file", "block").agg(F.sum("odd").alias("odd")).withColumn("before", F.coalesce(F.sum("odd").over(earlier), F.lit(0)) % 2)
        goes_on = (F.col("before") + F.col("odd")) % 2
        blocks = blocks.withColumns({"goes_on": goes_on, "opens": F.when(F.col("odd") > 0, goes_on).otherwise(0)})
        # The number of a record that goes over the end of a block is that of the blocks, up to it, in which such records begin.
        blocks = blocks.select(F.monotonically_increasing_id().alias("nr"), "file", "block", "before", "goes_on", F.coalesce(F.sum("opens").over(earlier), F.lit(0)).alias("record"))
        blocks = written(blocks, "quote-blocks")
        if not blocks.groupBy("file").agg(F.max_by("goes_on", "block").alias("open")).where("open = 1").isEmpty():
            return None
        placed = lines.join(F.broadcast(blocks.select("file", "block", "nr", "before")), ["file", "block"], "left").select("nr", "before", "id", "odd", "line")
        pieces = placed.mapInArrow(_pieces(feed, MOST_RECORD), "nr long, id long, line string, place int, size long")
        pieces = pieces.where(F.lit(blank) | (F.col("place") > 0) | (F.trim("line") != ""))
        number = F.when(F.col("place") > 0, F.col("record") + (F.col("place") == 2).cast("int"))
        pieces = pieces.join(F.broadcast(blocks.select("nr", "file", "block", "record")), "nr").withColumn("record", number)
        pieces = written(pieces.select("file", "block", "id", "line", "record", "size"), "records")
    whole, parts = pieces.where("record IS NULL"), pieces.where("record IS NOT NULL")
    sizes = whole.select("size").unionByName(parts.groupBy("file", "record").agg(F.sum("size").alias("size")).select("size"))
    if not sizes.where(F.col("size") > MOST_RECORD).isEmpty():
        return None
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "id", "line"))), lambda x: x["line"]), feed)
    several = parts.groupBy("file", "record").agg(F.min(F.struct("block", "id")).alias("at"), text.alias("line"))
    several = written(several.select("file", "at.block", "at.id", "line"), "records-over-blocks")
    return whole.select("file", "block", "id", "line").unionByName(several)


def header_of(records: DataFrame) -> str | None:
    """The first record of the first file."""
    first = records.orderBy("file", "block", "id").select("line").limit(1).collect()
    return first[0].line if first else None


def without_header(records: DataFrame, header: str) -> DataFrame:
    """Records without the first of each file, where that is the header; others like it are rows. A row for each file is broadcast, so that
    no record is shuffled."""
    place = ["file", "block", "id"]
    least = records.groupBy("file", "block").agg(F.min("id").alias("id")).groupBy("file").agg(F.min(F.struct("block", "id")).alias("f"))
    first = records.join(F.broadcast(least.select("file", "f.block", "f.id")), place).where(F.col("line") == header).select(*place)
    return records.join(F.broadcast(first), place, "left_anti")


def fields(line: str, delimiter: str) -> list[str]:
    return next(csv.reader([line], delimiter=delimiter), [])


def most_frequent_delimiter(line: str, among: tuple[str, ...] = DELIMITERS) -> str:
    """The one that a line has most of outside of quotes; the first of equally frequent ones."""
    return max(among, key=lambda d: len(fields(line, d)))


def semicolon_or_comma(line: str) -> str:
    return ";" if line.count(";") > line.count(",") else ","


def _unquoted(value: Column) -> Column:
    return F.trim(F.regexp_replace(F.trim(value), '^"+|"+$', ""))


def quoted_rows(lines: DataFrame, names: list[str], delimiter: str) -> DataFrame:
    """Lines by the usual quoting; missing fields are empty."""
    schema = ", ".join(f"c{i} string" for i in range(len(names)))
    row = F.from_csv("line", F.lit(schema), {"sep": delimiter, "quote": '"', "escape": '"', "mode": "PERMISSIVE", "maxCharsPerColumn": "-1"})
    return lines.select(row.alias("r")).select(*[F.coalesce(f"r.c{i}", F.lit("")).alias(n) for i, n in enumerate(names)])


def repaired_rows(lines: DataFrame, names: list[str], delimiter: str) -> DataFrame:
    """Lines split at every delimiter: surplus fields belong to the first column, short lines are padded with empty fields."""
    n = len(names)
    parts = lines.select(F.split(F.trim("line"), f"\\{delimiter}" if delimiter == "|" else delimiter).alias("p"))
    surplus = F.greatest(F.size("p") - n, F.lit(0))
    first = F.array_join(F.slice("p", F.lit(1), surplus + 1), delimiter)
    rest = [F.coalesce(F.get("p", surplus + i), F.lit("")) for i in range(1, n)]
    return parts.select(*[_unquoted(v).alias(c) for c, v in zip(names, [first, *rest])])


def _odd_lines(lines: DataFrame, n: int, delimiter: str) -> bool:
    """Whether any line has more fields than names or an open quote."""
    quotes = F.size(F.regexp_extract_all("line", F.lit('"'), F.lit(0)))
    outside = F.regexp_replace("line", '"[^"]*"', "")
    many = F.size(F.split(outside, f"\\{delimiter}" if delimiter == "|" else delimiter)) > n
    return not lines.where((quotes % 2 == 1) | many).isEmpty()


def _swallows(records: DataFrame, delimiter: str) -> bool:
    """Whether a record of several lines has a quote that neither begins nor ends a field."""
    d = f"\\{delimiter}" if delimiter == "|" else delimiter
    left = F.regexp_replace(F.replace(F.col("line"), F.lit('""'), F.lit("")), f'(^|{d})"[^"]*+"(?={d}|\\z)', "$1")
    return not records.where(F.col("line").contains("\n") & left.contains('"')).isEmpty()


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A table of strings: by commas, or where a record has too many fields for that by the delimiter of the first one.

    Quoted fields may hold line breaks. ValueError if there is no line.
    """
    lines = lines_of(spark, path, encoding_of(spark, path))
    records = records_of(lines)
    records = _not_blank(lines) if records is None else records
    header = header_of(records)
    if header is None:
        raise ValueError("the file has no lines")
    delimiter = ","
    if len(fields(header, ",")) < 2 or _odd_lines(records, len(fields(header, ",")), ","):
        delimiter = most_frequent_delimiter(header, (",", ";", "\t", "|"))
    if _swallows(records, delimiter):
        records = _not_blank(lines)
    return quoted_rows(without_header(records, header), [clean_name(c) for c in fields(header, delimiter)], delimiter)


def read_cohort(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Several tables as one, by column name; files without a readable header are left out. paths are configuration."""
    tables = []
    for path in paths:
        try:
            tables.append(read_table(spark, path))
        except ValueError:  # no line in it
            continue
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out


def read_notes(spark: SparkSession, path: str, required: list[str]) -> DataFrame:
    """A notes file as a table of strings with at least the required columns.

    In order: semicolons, commas, tabs, the most frequent delimiter, by the usual quoting, in which fields may hold line breaks; a file of
    semicolons in which records have surplus fields or quotes stay open is split at every line and delimiter and repaired, one of commas is
    split without quotes; a file whose first record is data gets the required names. ValueError tells the columns that were found.
    """
    lines = lines_of(spark, path, encoding_of(spark, path))
    records = records_of(lines)
    paired = records is not None
    records = records if paired else _not_blank(lines)
    header = header_of(records)
    if header is None:
        raise ValueError("the file has no lines")
    best: list[str] = []
    for delimiter in dict.fromkeys([";", ",", "\t", most_frequent_delimiter(header)]):
        names = [clean_name(c) for c in fields(header, delimiter)]
        best = names if len(names) > len(best) else best
        if set(required) <= set(names):
            rows = without_header(records, header)
            paired = paired and not _swallows(rows, delimiter)
            if not paired and delimiter not in ";,":
                rows = without_header(_not_blank(lines), header)
            if delimiter in ";," and (not paired or _odd_lines(rows, len(names), delimiter)):
                return repaired_rows(without_header(_not_blank(lines), header), names, delimiter)
            return quoted_rows(rows, names, delimiter)
    for delimiter in (",", ";", "\t"):
        values = fields(header, delimiter)
        if len(values) == len(required) and any(len(v.strip()) >= DATA_CHARS for v in values):
            return quoted_rows(records, required, delimiter).select(*[_unquoted(F.col(c)).alias(c) for c in required])
    raise ValueError(f"required columns {required}, found {best}")
