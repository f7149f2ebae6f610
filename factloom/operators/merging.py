"""Answers of several events merged into one, and the format lines of prompt templates."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Answers that say nothing, and dates within an answer.
NULL_TEXTS = {
    "unknown", "n/a", "not mentioned", "not found", "not available", "not stated", "not provided", "not specified", "not documented",
    "not applicable", "information not available", "information not available in the note", "nessuno", "non specificato", "non disponibile",
}
DAY = r"\d{1,2}[./]\d{1,2}[./]\d{4}"
ISO = r"\d{4}-\d{1,2}-\d{1,2}"
MONTH = r"\d{1,2}[./]\d{4}"
REASONING = 2000


def plain(text: str) -> str:
    return re.sub(r"\s+", " ", unicodedata.normalize("NFKC", text).lower().strip().rstrip(".,;:!? "))


def date_of(text: str) -> str | None:
    """The first full date, else month, of an answer: YYYY-MM-DD or YYYY-MM."""
    if m := re.search(DAY, text):
        d, mo, y = re.split("[./]", m[0])
        return f"{y}-{mo:0>2}-{d:0>2}"
    if m := re.search(ISO, text):
        y, mo, d = m[0].split("-")
        return f"{y}-{mo:0>2}-{d:0>2}"
    if m := re.search(MONTH, text):
        mo, y = re.split("[./]", m[0])
        return f"{y}-{mo:0>2}"
    return None


def same(a: str, b: str) -> bool:
    """Equal, one (of over ten characters) within the other, or of one date and otherwise equal."""
    x, y = plain(a), plain(b)
    if x == y or (len(x) > 10 and len(y) > 10 and (x in y or y in x)):
        return True
    rest = [re.sub(f"{DAY}|{ISO}", "", t).strip() for t in (x, y)]
    return date_of(a) is not None and date_of(a) == date_of(b) and rest[0] == rest[1]


def merged(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys, answers (unique ones by date), reasoning (joined, cut at 2000), events, of rows (keys, pos, answer, reasoning).

    Null results and errors go; of answers that say the same the longer stays in the place of the first. Events of a note and
    prompt are few (a splitter gives 30 at most), so a group is one task's.
    """

    def fold(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("pos")
        kept: list[tuple[str, str]] = []
        for answer, why in zip(frame["answer"], frame["reasoning"]):
            if not answer or answer.startswith("ERROR:") or plain(answer) in NULL_TEXTS:
                continue
            for i, (other, _) in enumerate(kept):
                if same(answer, other):
                    if len(answer) > len(other):
                        kept[i] = (answer, why)
                    break
            else:
                kept.append((answer, why))
        kept.sort(key=lambda k: date_of(k[0]) or "9999")
        text = " | ".join(w for _, w in kept if w)
        answers = [a for a, _ in kept] or [frame["answer"].iloc[0]]
        return pd.DataFrame([(*frame[keys].iloc[0], "\n".join(a or "" for a in answers), text[: REASONING - 3] + "..." if len(text) > REASONING else text or None, len(frame), len(kept))], columns=[*keys, "answers", "reasoning", "events", "unique_values"])

    kinds = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in keys)
    return rows.groupBy(*keys).applyInPandas(fold, f"{kinds}, answers string, reasoning string, events long, unique_values long")


def format_lines(templates: DataFrame) -> DataFrame:
    """prompt and format (its output format lines) of templates (prompt, template).

    A section begins with a line of "output strictly", "formats:" or an output format that ends in a colon's place, and ends with a
    heading, "Notes:" or, once it has lines, a blank one; its lines with placeholders count, or its first one. Outside of
    sections, lines with [provide ..], [put ..] or [select ..] count. Null where there is none.
    """
    lines = templates.select("prompt", F.posexplode(F.split("template", "\n")).alias("i", "raw")).withColumn("line", F.trim("raw"))
    low = F.lower("line")
    starts = low.contains("output strictly") | low.contains("formats:") | (low.contains("format:") & low.contains("output"))
    order = Window.partitionBy("prompt").orderBy("i")
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = lines.withColumn("starts", starts).withColumn("inside", F.max(F.col("starts").cast("int")).over(upto) == 1)
    loose = ~F.col("inside") & F.col("line").rlike(r"(?i)\[(?:provide|put|select)[^\]]+\]")
    holds = F.col("inside") & ~F.col("starts") & F.col("line").contains("[") & F.col("line").contains("]")
    rows = rows.withColumns({"loose": loose, "holds": holds, "filled": F.col("inside") & ~F.col("starts") & (F.col("line") != "")})
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    had = F.coalesce(F.max((F.col("loose") | F.col("filled")).cast("int")).over(before), F.lit(0)) == 1
    rows = rows.withColumn("had", had)
    heading = F.col("inside") & ~F.col("starts") & (F.col("line").startswith("#") | F.col("line").startswith("Notes:"))
    blank = F.col("inside") & ~F.col("starts") & (F.col("line") == "") & F.col("had")
    rows = rows.withColumn("over", F.max((heading | blank).cast("int")).over(upto) == 1)
    # The first line of a section counts without a placeholder where nothing was found before.
    taken = ~F.col("over") & (F.col("loose") | F.col("holds") | (F.col("filled") & ~F.col("had")))
    return rows.where(taken).groupBy("prompt").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "line"))), lambda x: x["line"]), "\n").alias("format"))
