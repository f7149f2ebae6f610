"""Pivots, typed views and clean-up of the fact table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values that mean no value.
PLACEHOLDERS = ["n/a", "na", "none", "null", "unknown", "unk", "-", "--", ""]


def entity(variable: Column) -> Column:
    return F.substring_index(variable, ".", 1)


def field(variable: Column) -> Column:
    return F.split_part(variable, F.lit("."), F.lit(2))


def is_placeholder(value: Column) -> Column:
    v = F.lower(F.trim(F.coalesce(value, F.lit(""))))
    return v.isin(PLACEHOLDERS) | v.rlike(r"^\[.*\]$")


def type_of(variable: Column) -> Column:
    """The logical type that a field's name implies; the first rule that fits."""
    name = F.lower(field(variable))
    return F.when(name.contains("date"), "date").when(name.contains("price") | name.contains("balance"), "float").when(name.contains("quantity") | name.contains("nation"), "Integer").otherwise("string")


def typed(rows: DataFrame) -> DataFrame:
    """rows with number and day: what the value is as its variable's type, null where it cannot be cast."""
    kind = type_of(F.col("core_variable"))
    number = F.expr("try_cast(value AS DOUBLE)")
    return rows.withColumns({"type": kind, "number": F.when(kind.isin("float", "Integer"), number), "day": F.when(kind == "date", F.expr("try_cast(value AS DATE)"))})


def pivot(rows: DataFrame, keys: list[str], variables: list[str], last: bool = False, order: tuple[str, ...] = ("seq", "record_id")) -> DataFrame:
    """A row for each keys with the first (or last) value by order of each variable, without an order the least (or greatest); the columns
    are always all variables.

    A conditional aggregate with partial sums on the map side; no value is collected.
    """
    some = rows.where(F.col("core_variable").isin(variables))
    if not variables:
        return some.select(*keys).distinct()

    def picked(v):
        mine = F.col("core_variable") == v
        if not order:
            return (F.max if last else F.min)(F.when(mine, F.col("value")))
        return (F.max_by if last else F.min_by)(F.when(mine, F.col("value")), F.when(mine & F.col("value").isNotNull(), F.struct(*order)))

    return some.groupBy(*keys).agg(*[picked(v).alias(v.split(".")[1]) for v in variables])


def first_integer(value: Column) -> Column:
    """The first integer in a text; one that is an integer as a whole is not searched."""
    return F.when(value.try_cast("long").cast("string") == value, value).otherwise(F.nullif(F.regexp_extract(value, "-?[0-9]+", 0), F.lit("")))


def code_or_text(value: Column, codes: dict[str, str]) -> Column:
    """The code of a value by a prompt's map, which is configuration, UNRESOLVED:: and the value where it has none."""
    known = F.create_map(*[F.lit(x) for pair in codes.items() for x in pair])
    return F.coalesce(known[value], F.concat(F.lit("UNRESOLVED::"), value))


def aligned(tables: list[DataFrame], columns: list[str]) -> DataFrame:
    """Tables under each other with the given columns as strings; what one has not, or is null, is empty."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out.select(*[(F.coalesce(F.col(c).cast("string"), F.lit("")) if c in out.columns else F.lit("")).alias(c) for c in columns])


#: What says that there is no value, in the order of the reasons; and that nothing is known.
ABSENCES = [
    r"(?i)\bnot\s+(?:specified|available|applicable|mentioned|present|found)\b", r"(?i)^unknown\b", r"(?i)\bno\s+(?:information|data|result|finding|value)\b",
    r"(?i)\binformation\s+not\s+available\b", r"^\[.*\]$", r"(?i)^absent\.?$", r"(?i)^none\.?$",
]
NO_INFORMATION = ["not available", "not mentioned", "not stated", "not provided", "unknown", "cannot be determined", "does not state", "does not provide", "does not mention", "information is not available", "no information", "not found"]


def absence(value: Column) -> Column:
    """Why a value is none, null if it is one."""
    v = F.trim(F.coalesce(value, F.lit("")))
    found = F.coalesce(*[F.when(v.rlike(p), F.trim(F.regexp_extract(v, p, 0))) for p in ABSENCES])
    return F.when(v == "", "Empty value").otherwise(F.concat(F.lit('Absence indicator detected: "'), found, F.lit('"')))


def export_type(name: Column) -> Column:
    """The type that a field's name implies; the first rule that fits."""
    f = F.lower(F.element_at(F.split(name, r"\."), -1))
    out = F.when(f.rlike("date|lastcontact"), "date").when(f.rlike("age|count|number|cycles"), "Integer").when(f.rlike("bmi|diameter|dose|fractions|size"), "float")
    out = out.when(f.rlike("rupture|hyperthermia") | (f.contains("completed") & ~f.contains("asplanned")), "boolean")
    return out.when(f.isin("patient", "cancerepisode", "episodeevent", "systemictreatment"), "reference").when(f.rlike("hospital|location|doneby|definedat"), "String").otherwise("CodeableConcept")


def cleaned_by_type(value: Column, kind: Column) -> Column:
    """The first date (as D/M/YYYY), integer or number of a text, by type; the text if it has none or for other types."""
    v = F.trim(value)
    first = lambda p: F.nullif(F.regexp_extract(v, p, 1), F.lit(""))
    dmy = first(r"\b(\d{1,2}/\d{1,2}/\d{4})\b")
    iso = F.nullif(F.regexp_replace(F.regexp_extract(v, r"\b(\d{4}-\d{2}-\d{2})\b", 1), r"^(\d{4})-(\d{2})-(\d{2})$", "$3/$2/$1"), F.lit(""))
    day = F.coalesce(dmy, first(r"\b(\d{1,2}-\d{1,2}-\d{4})\b"), iso)
    return F.coalesce(F.when(kind == "date", day).when(kind == "Integer", first(r"\b(\d+)\b")).when(kind == "float", first(r"\b(\d+(?:\.\d+)?)\b")), value)


def expected_part(notes: Column, prompt: Column) -> Column:
    """Out of "key: text | key: text" the text of the first key that holds the prompt's name or is within it, else after its name."""
    parts = F.filter(F.transform(F.split(notes, r"\|"), lambda p: F.trim(p)), lambda p: p.contains(":"))
    low = F.lower(prompt)
    key = lambda p: F.lower(F.trim(F.split_part(p, F.lit(":"), F.lit(1))))
    hit = F.get(F.filter(parts, lambda p: F.contains(key(p), low) | F.contains(low, key(p))), F.lit(0))
    pattern = F.concat(F.lit("(?is)\\Q"), prompt, F.lit("\\E\\s*:\\s*([^|]+)"))
    return F.coalesce(F.trim(F.substr(hit, F.instr(hit, ":") + 1)), F.nullif(F.trim(F.call_function("regexp_extract", notes, pattern, F.lit(1))), F.lit("")))


def result_status(text: Column, reasoning: Column) -> Column:
    """error, incomplete (the reasoning was cut) or success; an empty text succeeds where the reasoning says that nothing is known."""
    none = F.lower(reasoning).rlike("|".join(NO_INFORMATION))
    cut = reasoning.endswith("...") & (F.length(reasoning) >= 1997)
    empty = F.trim(F.coalesce(text, F.lit(""))) == ""
    return F.when(text.startswith("ERROR:"), "error").when(F.coalesce(cut, F.lit(False)), "incomplete").when(empty, F.when(F.coalesce(none, F.lit(False)), "success").otherwise("error")).otherwise("success")
