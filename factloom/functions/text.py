"""Column functions over notes and annotations."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Patterns of dates, placeholders and codes.
DATES = r"(\d{4}-\d{2}-\d{2}|\d{2}/\d{2}/\d{4})"
PLACEHOLDER = r"\[[^\]]*\]"
CODE = r"(\d{4}/\d)-(C\d{2}\.\d)"


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: w != "")


def _long_uppers() -> tuple[str, str]:
    """Letters whose upper case is several letters, and the one letter that stands for it: the title form, ẞ for ß, else the letter itself."""
    some = [c for c in map(chr, range(0x80, 0x10000)) if not 0xD800 <= ord(c) < 0xE000 and len(c.upper()) > 1]
    return "".join(some), "".join("ẞ" if c == "ß" else c.title() if len(c.title()) == 1 else c for c in some)


LONG_UPPERS, THEIR_UPPERS = _long_uppers()


def upper_letters(text: Column) -> Column:
    """Upper case letter for letter, so that texts keep their length (F.upper makes SS of ß) and lower case leads back to them."""
    return F.array_join(F.transform(F.split(text, ""), lambda c: F.when(F.length(F.upper(c)) > 1, F.translate(c, LONG_UPPERS, THEIR_UPPERS)).otherwise(F.upper(c))), "")


def token_overlap(a: Column, b: Column) -> Column:
    """Shared distinct words over the larger number of distinct words."""
    a, b = F.array_distinct(a), F.array_distinct(b)
    return F.size(F.array_intersect(a, b)) / F.greatest(F.size(a), F.size(b), F.lit(1)).cast("double")


def dates(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(DATES), F.lit(1)))


def repetition(text: Column, least: float = 0.5) -> Column:
    """struct(severity, ratio, total, distinct) of a text whose sentences repeat, null of others.

    Sentences end with a full stop, an exclamation or a question mark before white space, or with a line; those of over 20 characters count,
    from three on, in texts of 50 characters or more. ratio is the share of repeated ones with two digits; from `least` on it is medium, over 0.8 high.
    """
    parts = F.filter(F.transform(F.split(text, r"(?U)[.!?]\s+|\n"), stripped), lambda s: F.length(s) > 20)

    def flag(s: Column) -> Column:
        total, distinct = F.size(s), F.size(F.array_distinct(s))
        ratio = 1 - distinct / total
        return F.when((total >= 3) & (ratio >= least), F.struct(F.when(ratio > 0.8, "high").otherwise("medium").alias("severity"), F.round(ratio, 2).alias("ratio"), total.cast("long").alias("total"), distinct.cast("long").alias("distinct")))

    return F.when(F.length(text) >= 50, F.get(F.transform(F.array(parts), flag), F.lit(0)))


def stripped(text: Column) -> Column:
    """Without white space of any kind at the ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def repetition_flags(fields: dict[str, Column]) -> Column:
    """A flag (type, field, severity, duplicate_ratio, message) for each of the fields whose sentences repeat, in their order."""

    def of(name: str, text: Column) -> Column:
        def flag(r: Column) -> Column:
            message = F.concat(F.lit("Repetitive output detected: "), r["distinct"], F.lit("/"), r["total"], F.lit(" unique sentences"))
            return F.struct(F.lit("repetition_loop").alias("type"), F.lit(name).alias("field"), r["severity"].alias("severity"), r["ratio"].alias("duplicate_ratio"), message.alias("message"))

        return F.transform(F.array_compact(F.array(repetition(text))), flag)

    return F.concat(*[of(name, text) for name, text in fields.items()])


#: The forms of template sentences, the first that fits counts.
TEMPLATES = [
    r"^Biopsy grading.*?:\s*(.+?)\.?$", r"^Patient's gender\s+(.+?)\.?$", r"^Histological type:\s*(.+?)\.?$", r"^Tumor site.*?:\s*(.+?)\.?$",
    r"^Age at diagnosis:\s*(.+?)\.?$", r"^Margins after surgery:\s*(.+?)\.?$", r"^[^:]+:\s*(.+?)\.?$", r"^Annotation:\s*(.+?)\.?$",
]


def template_value(text: Column) -> Column:
    """The value that a template sentence ends with, without its full stop; a sentence of no such form itself, without full stops at its end.

    Null texts have the empty value.
    """
    t = stripped(F.coalesce(text, F.lit("")))
    values = [F.when(t.rlike(f"(?is){p}"), stripped(F.regexp_extract(t, f"(?is){p}", 1))) for p in TEMPLATES]
    found = F.coalesce(*values)
    return F.coalesce(F.when(found.endswith("."), stripped(F.regexp_replace(found, r"\.$", ""))).otherwise(found), F.regexp_replace(t, r"\.+$", ""))


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


#: Letters among which those are that do not print; few texts of European languages have any.
RARE = re.compile(r"[^\x20-\x7e\xa1-\xac\xae-\u0377]+")


def _printed(found: re.Match) -> str:
    letters = found[0]
    if letters.isprintable():
        return letters
    return "".join(c if c.isprintable() else " " if unicodedata.category(c) == "Cc" else "" for c in letters)


def _cleaned(text: str) -> str:
    """One text of clean_text. All but the letters that do not print is done by str's own functions."""
    text = " ".join(text.split())
    if not text.isprintable():
        text = RARE.sub(_printed, text)
    return " ".join(unicodedata.normalize("NFKC", text).split())


@F.pandas_udf(StringType())
def _cleaned_texts(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else _cleaned(t))


def squeezed(text: Column) -> Column:
    """Runs of white space and controls as one space, none at the ends; other marks that do not print are removed."""
    out = F.regexp_replace(F.regexp_replace(text, r"(?U)[\s\p{Cc}]+", " "), r"[\p{Cf}\p{Co}\p{Cn}\p{Cs}]", "")
    return F.trim(F.regexp_replace(out, r"(?U)\s+", " "))


def clean_text(text: Column) -> Column:
    """Runs of white space and controls as one space, none at the ends; other marks that do not print are removed, compatibility
    letters are plain ones (NFKC). Only texts beyond ASCII go to Python, as its tables of letters are newer than those of Spark's patterns."""
    cleaned = _cleaned_texts(F.when(text.rlike(r"[^\x00-\x7f]"), text))
    return F.coalesce(cleaned, F.trim(F.regexp_replace(text, r"[\x00-\x20\x7f]+", " ")))


def normal(text: Column) -> Column:
    """Lower case without codes in brackets, end punctuation and doubled spaces."""
    t = F.regexp_replace(F.trim(F.lower(text)), r"[(\[]\d{4}/\d[)\]]", "")
    return F.trim(F.regexp_replace(F.regexp_replace(t, "[.;,]+$", ""), r"\s+", " "))


def existing_code(text: Column) -> Column:
    """struct(code, morphology, topography, confidence) of the first joint code, else morphology (both 1.0), else topography (0.8)."""
    joint = r"(\d{4}/\d)\s*-\s*(C\d{2}\.\d)"
    m, t = (F.nullif(F.regexp_extract(text, joint, g), F.lit("")) for g in (1, 2))
    m2, t2 = (F.nullif(F.regexp_extract(text, p, 0), F.lit("")) for p in (r"\d{4}/\d", r"C\d{2}\.\d"))
    code = F.coalesce(F.concat(m, F.lit("-"), t), m2, t2)
    return F.struct(code.alias("code"), F.coalesce(m, m2).alias("morphology"), F.coalesce(t, F.when(m2.isNull(), t2)).alias("topography"), F.when(F.coalesce(m, m2).isNotNull(), 1.0).when(t2.isNotNull(), 0.8).alias("confidence"))


def split_values(text: Column) -> Column:
    """The values of an answer: a JSON array's, else parts by semicolons, by commas if all are under 100 characters, lines without bullets
    and numbers, or by bars; else the text itself. Errors are one value."""
    t = F.trim(text)
    parts = lambda d: F.filter(F.transform(F.split(t, d), lambda x: F.trim(x)), lambda x: x != "")
    bare = lambda x: F.regexp_replace(F.regexp_replace(F.trim(x), r"^[-*•]\s+", ""), r"^\d+[.)]\s+", "")
    lines = F.filter(F.transform(F.split(t, "\n"), bare), lambda x: x != "")
    array = F.filter(F.transform(F.from_json(t, "array<string>"), lambda x: F.trim(x)), lambda x: x != "")
    semi, comma, bar = parts(";"), parts(","), parts(r"\|")
    is_array = t.startswith("[") & t.endswith("]") & F.try_parse_json(t).isNotNull()
    out = F.when(text.startswith("ERROR:"), F.array(text)).when(is_array, array).when(F.size(semi) > 1, semi)
    out = out.when((F.size(comma) > 1) & F.forall(comma, lambda x: F.length(x) < 100), comma).when(F.size(lines) > 1, lines).when(F.size(bar) > 1, bar)
    return out.otherwise(F.array(t))
