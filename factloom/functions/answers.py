"""Column functions over model answers: parsing, absence, placeholders, mappings, chunks, evidence."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: What tells that a value is absent, and how that is written.
ABSENT = "Not applicable"
ABSENCE = "|".join([
    r"\bnot\s+(?:specified|available|applicable|mentioned|present|found)\b",
    r"\bunknown\b",
    r"\bno\s+(?:information|data|result|finding|value)\b",
    r"\binformation\s+not\s+available\b",
    r"\bnot\s+available\s+in\s+the\s+note\b",
    r"\[select\s+(?:result|value|intent|regimen|reason|where|date)\b",
    r"^\[.*\]$",
])
#: Answers that say nothing.
NULL_ANSWERS = [
    "", "unknown", "n/a", "not mentioned", "not found", "not available", "not stated", "not provided", "not specified", "not documented",
    "nessuno", "non specificato", "non disponibile", "non menzionato", "non presente", "non riportato", "non indicato",
]
GENERIC_OPTIONS = ["value", "date", "select", "put", "provide", "choose"]
#: Placeholders that an answer may still hold.
PLACEHOLDER_CHOICE = r"(?i)\s*\(?\[(?:select|put|choose|provide)[^\]]*\]\)?"
PLACEHOLDER_BARE = r"(?i)\[(?:value|date|select)\]"
#: Labels of other languages in example annotations, and placeholders of codes.
TRANSLATIONS = {
    "tipo istologico:": "Histological type:",
    "tipo histologico:": "Histological type:",
    "sito del tumore": "Tumor site",
    "sito tumorale": "Tumor site",
    "margini dopo chirurgia": "Margins after surgery",
    "genere del paziente": "Patient's gender",
    "grading della biopsia": "Biopsy grading",
    "profondità del tumore": "Tumor depth",
    "tipo di recidiva": "Type of recurrence",
    "stato del paziente": "Status of the patient",
    "età alla diagnosi": "Age at diagnosis",
    "stadio alla diagnosi": "Stage at diagnosis",
    "tipo di chirurgia": "Surgery was performed",
    "histologisk typ:": "Histological type:",
    "tumörlokalisation": "Tumor site",
    "tumörplats": "Tumor site",
    "typ histologiczny:": "Histological type:",
    "lokalizacja guza": "Tumor site",
    "miejsce guza": "Tumor site",
}
CODE_PLACEHOLDER = "(?i)" + "|".join([
    r"\(\[seleziona il codice ICD-O-3\]\)",
    r"\(\[select ICD-O-3 code\]\)",
    r"\(\[välj ICD-O-3-kod\]\)",
    r"\(\[wybierz kod ICD-O-3\]\)",
    r"\[seleziona il codice ICD-O-3\]",
    r"\[select ICD-O-3 code\]",
    r"\[välj ICD-O-3-kod\]",
    r"\[wybierz kod ICD-O-3\]",
    r"\(:\s*seleziona il codice ICD-O-3",
    r"\(:\s*select ICD-O-3 code",
    r"\[seleziona[^\]]*\]",
    r"\[välj[^\]]*\]",
    r"\[wybierz[^\]]*\]",
    r"\[select[^\]]*(?:code|tipo|type)[^\]]*\]",
    r"\[please select[^\]]*\]",
])
#: Where a text is cut into sentences for chunks.
SENTENCE_END = re.compile(r"(?<=[.!?])\s+|\n{2,}")
REASONING_CHARS = 2000
ANSWER = "struct<reasoning:string,final_output:string,is_negated:boolean,date:struct<date_value:string,source:string,csv_date:string>>"


def rstrip(text: Column, letters: str) -> Column:
    return F.regexp_replace(text, f"[{letters}]+$", "")


def is_absent(text: Column) -> Column:
    return F.lower(F.trim(text)).rlike(ABSENCE) | (F.trim(text) == "")


def label_of(text: Column) -> Column:
    """The label before a colon, null if there is none or it is an absence itself."""
    label = F.trim(F.regexp_extract(text, r"^(.+?):\s*.+$", 1))
    return F.when((label != "") & ~is_absent(label), label)


def normalized_absence(text: Column) -> Column:
    """Absences as "Label: Not applicable" or "Not applicable"; other texts trimmed."""
    t = F.trim(F.coalesce(text, F.lit("")))
    return F.when(t == "", "").when(~is_absent(t), t).otherwise(F.coalesce(F.concat(label_of(t), F.lit(f": {ABSENT}")), F.lit(ABSENT)))


def format_of(template: Column) -> Column:
    """struct(label, options) of a template whose output format has one placeholder with several options, else null."""
    line = rstrip(F.trim(F.regexp_extract(template, r"(?i)Output format[^:\n]*:\s*(?:Annotation:\s*)?(.+?)(?:\n|$)", 1)), ".")
    found = F.regexp_extract_all(line, F.lit(r"\[([^\[\]]+)\]"), F.lit(1))
    one = F.get(found, F.lit(0))
    options = F.transform(F.when(one.contains("|"), F.split(one, r"\|")).when(one.contains("/"), F.split(one, "/")), lambda o: F.trim(o))
    generic = F.forall(options, lambda o: F.lower(o).isin(GENERIC_OPTIONS))
    label = F.trim(rstrip(F.trim(F.split_part(line, F.lit("["), F.lit(1))), ":"))
    return F.when((F.size(found) == 1) & options.isNotNull() & ~generic & (label != ""), F.struct(label.alias("label"), options.alias("options")))


def re_wrapped(text: Column, form: Column) -> Column:
    """A bare option as "Label: option.", a bare absence with the label; form is format_of the prompt's template."""
    t = F.trim(text)
    option = F.get(F.filter(form["options"], lambda o: F.lower(o) == rstrip(F.lower(t), ".")), F.lit(0))
    absence = F.when(is_absent(t) & label_of(t).isNull(), F.concat(form["label"], F.lit(": "), t))
    new = F.coalesce(F.concat(form["label"], F.lit(": "), option, F.lit(".")), absence, text)
    return F.when(form.isNull() | (F.coalesce(text, F.lit("")) == "") | F.lower(t).contains(F.lower(form["label"])), text).otherwise(new)


def without_placeholders(text: Column) -> Column:
    """An answer without what is left of its template; "Not applicable" where nothing or only a label is left."""
    had = text.rlike(PLACEHOLDER_CHOICE) | text.rlike(PLACEHOLDER_BARE)
    left = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(text, PLACEHOLDER_CHOICE, ""), PLACEHOLDER_BARE, ""), r"\s+\.", "."))
    bare = F.trim(rstrip(left, ".:, ")) == ""
    after = rstrip(F.trim(F.regexp_extract(left, r"(?s)^.*:(.*)$", 1)), "., ")
    return F.when(~had, text).when(bare | (left.contains(":") & (after == "")), ABSENT).otherwise(left)


def capped_reasoning(text: Column) -> Column:
    return F.when(F.length(text) > REASONING_CHARS, F.concat(F.left(text, F.lit(REASONING_CHARS - 3)), F.lit("..."))).otherwise(text)


def mapped_fields(text: Column, rules: list[tuple[str, str, str, str]]) -> Column:
    """field to value by the first pattern of the field that is found. rules: field, pattern, value, flags, in order."""
    pairs = []
    for name in dict.fromkeys(r[0] for r in rules):
        pick = F.lit(None).cast("string")
        for _, pattern, value, flags in reversed([r for r in rules if r[0] == name]):
            marks = ("i" if "IGNORECASE" in flags else "") + ("m" if "MULTILINE" in flags else "")
            pick = F.when(text.rlike(f"(?{marks}){pattern}" if marks else pattern), value).otherwise(pick)
        pairs.append(F.struct(F.lit(name).alias("key"), pick.alias("value")))
    return F.map_from_entries(F.filter(F.array(*pairs), lambda p: p["value"].isNotNull()))


def without_thinking(text: Column) -> Column:
    one = F.trim(F.regexp_replace(text, r"(?is)^(.*?)<unused\d+>.*?<unused\d+>\s*", "$1"))
    return F.trim(F.regexp_replace(one, r"(?is)<unused\d+>\w+.*?</unused\d+>\s*", ""))


def json_parts(text: Column) -> list[Column]:
    """Where an answer's JSON may stand, in the order of trust: fenced, first of an array, objects by their fields."""
    first = F.regexp_extract
    array = first(text, r'(?s)\[\s*\{.*?"reasoning".*?"final_output".*?\}.*?\]', 0)
    return [
        F.trim(first(text, r"(?s)```(?:json)?\s*\n?(.*?)\n?```", 1)),
        F.get_json_object(array, "$[0]"),
        first(text, r'(?s)\{.*?"reasoning".*?"final_output".*?\}', 0),
        first(text, r'(?s)\{[^{}]*"reasoning"[^{}]*"final_output"[^{}]*\}', 0),
        first(text, r'(?s)\{.*?"evidence".*?"final_output".*?\}', 0),
        first(text, r'(?s)\{[^{}]*"final_output"\s*:[^{}]*\}', 0),
    ]


def parsed_answer(raw: Column, note_date: Column) -> Column:
    """struct(final_output, reasoning, is_negated, date_value, date_source, layer) of a model's raw answer.

    Layers: 1 the answer is JSON (after thinking blocks are stripped); 2 JSON or a named output within a thinking block that was
    not closed; 3 JSON within other text; 4 an object that was cut off; 5 fields by patterns. A missing date is the note's.
    """
    plain = without_thinking(raw)
    open_block = F.lower(raw).contains("<unused")
    rest = F.when(open_block, F.trim(F.regexp_replace(raw, r"(?is)<unused\d+>.*$", ""))).otherwise(plain)

    def good(text):
        a = F.from_json(text, ANSWER)
        return F.when(a["final_output"].isNotNull(), a)

    def given(a, layer):
        date = F.coalesce(a["date"]["date_value"], note_date)
        source = F.coalesce(a["date"]["source"], F.when(a["date"].isNull() & note_date.isNotNull(), "derived_from_csv"))
        return F.when(a.isNotNull(), F.struct(a["final_output"].alias("final_output"), F.coalesce(a["reasoning"], F.lit("")).alias("reasoning"), F.coalesce(a["is_negated"], F.lit(False)).alias("is_negated"), F.when(a["date"].isNotNull(), a["date"]["date_value"]).otherwise(date).alias("date_value"), source.alias("date_source"), F.lit(layer).alias("layer")))

    def made(final, reasoning, negated, date, source, layer):
        return F.struct(final.alias("final_output"), reasoning.alias("reasoning"), negated.alias("is_negated"), date.alias("date_value"), source.alias("date_source"), F.lit(layer).alias("layer"))

    none = F.lit(None).cast("string")
    no, noted = F.lit(False), F.when(note_date.isNotNull(), "derived_from_csv")
    fenced = good(F.trim(F.regexp_extract(raw, r"(?s)```(?:json)?\s*\n?(.*?)\n?```", 1)))
    named = F.regexp_extract(raw, r'(?s)\{[^{}]*"final_output"\s*:\s*"([^"]+)"[^{}]*\}', 1)
    said = F.regexp_extract(raw, r'(?i)(?:final_output should be|I should output|output should be|the output is|output:\s*)["\s]*([^\n"]{4,200})', 1)
    said = F.regexp_replace(F.trim(said), "^[\"']+|[\"']+$", "")
    salvage = F.when(F.trim(named) != "", F.trim(named)).when(F.length(said) >= 4, said)
    second = F.coalesce(given(fenced, 2), F.when(salvage.isNotNull(), made(salvage, F.lit("Extracted from model thinking block (token budget was exhausted before JSON output)"), no, none, none, 2)))
    *full, fast = [good(F.when(p != "", p)) for p in json_parts(rest)]
    third = F.coalesce(given(F.coalesce(*full), 3), F.when(fast.isNotNull(), made(fast["final_output"], F.lit("Fast mode: no reasoning captured"), no, note_date, noted, 3)))
    cut = F.regexp_extract(rest, r'"final_output"\s*:\s*"((?:[^"\\]|\\.)*)"', 1)
    why = F.regexp_extract(rest, r'"reasoning"\s*:\s*"((?:[^"\\]|\\.)*)"', 1)
    was_cut = F.ltrim(rest).startswith("{") & rest.rlike(r'"final_output"\s*:\s*"((?:[^"\\]|\\.)*)"')
    fourth = F.when(was_cut, made(cut, F.when(rest.rlike(r'"reasoning"\s*:\s*"((?:[^"\\]|\\.)*)"'), why).otherwise("Truncated JSON — reasoning lost to token budget"), no, note_date, noted, 4))
    first = lambda *patterns: F.coalesce(*[F.when(rest.rlike(p), F.trim(F.regexp_extract(rest, p, 1))) for p in patterns])
    reasoning = first(r"(?is)Reasoning:\s*(.+?)(?:\.|$|Final)", r"(?is)Inference:\s*(.+?)(?:\.|$)")
    final = F.coalesce(first(r"(?is)Annotation:\s*(.+?)(?:\.|$)", r"(?is)Final output:\s*(.+?)(?:\.|$)"), F.trim(rest))
    negated = F.lit(False)
    for word in ("no ", "not ", "absence of", "ruled out", "negative", "none", "no evidence", "without", "excluded"):
        negated = negated | F.lower(rest).contains(word)
    day = first(r"(\d{2}/\d{2}/\d{4})", r"(\d{4}-\d{2}-\d{2})", r"(\d{1,2}/\d{1,2}/\d{4})")
    fifth = made(final, F.when(F.coalesce(reasoning, F.lit("")) != "", reasoning).otherwise("Not extracted"), negated, F.coalesce(day, note_date), F.when(day.isNotNull(), "extracted_from_text").otherwise(noted), 5)
    return F.coalesce(given(good(plain), 1), F.when(open_block, second), third, fourth, fifth)


def is_confident(text: Column) -> Column:
    t = F.lower(F.trim(F.coalesce(text, F.lit(""))))
    return ~t.isin(NULL_ANSWERS) & ~t.startswith("error:")


def tokens(text: Column) -> Column:
    """The estimate of a text's tokens: a quarter of its characters, one at least."""
    return F.greatest(F.lit(1), F.floor(F.length(text) / 4).cast("int"))


def _size(text: str) -> int:
    return max(1, len(text) // 4)


def _by_words(sentence: str, budget: int) -> list[str]:
    """Pieces of a sentence of whole words within the budget."""
    done, now, n = [], [], 0
    for word in sentence.split():
        more = _size(f"{word} ")
        if now and n + more > budget:
            done.append(" ".join(now))
            now, n = [], 0
        now.append(word)
        n += more
    return [*done, " ".join(now)] if now else done


def _pieces(note: str, budget: int, overlap: int) -> list[str]:
    """One note of chunks."""
    done, now, n = [], [], 0
    for sentence in filter(None, map(str.strip, SENTENCE_END.split(note))):
        more = _size(sentence)
        if more > budget:
            if now:
                done.append(" ".join(now))
            done += _by_words(sentence, budget)
            now = [" ".join(done[-1].split()[-20:])]
            n = _size(now[0])
            continue
        if n + more > budget:
            done.append(" ".join(now))
            now = now[max(0, len(now) - overlap) :]
            n = sum(map(_size, now))
        now.append(sentence)
        n += more
    if now:
        done.append(" ".join(now))
    return done or [note]


def chunks(note: Column, budget: Column, overlap: int = 2) -> Column:
    """A note as pieces within a budget of tokens: whole sentences, the last `overlap` of them again at the next piece's start;
    a sentence over the budget in pieces of whole words, of which the last 20 words lead the next piece. One pass over the
    sentences of each note that is over the budget, in Python, as Spark's fold copies its lists at every step."""

    @F.pandas_udf("array<string>")
    def pieces(notes: pd.Series, budgets: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else _pieces(t, int(b), overlap) for t, b in zip(notes, budgets)], dtype=object)

    long = tokens(note) > budget
    return F.when(long, pieces(F.when(long, note), budget)).when(note.isNotNull(), F.array(note))


def _accents() -> tuple[str, str]:
    """Letters that are one letter and marks, and those letters: from the decomposition of all letters of one code unit."""
    pairs = [(c, d[0]) for c in map(chr, range(0xC0, 0x2000)) if len(d := unicodedata.normalize("NFD", c)) > 1 and all(unicodedata.combining(x) for x in d[1:])]
    return "".join(p[0] for p in pairs), "".join(p[1] for p in pairs)


MARKED, BASE = _accents()


def folded(text: Column) -> Column:
    """Lower case and without accents, letter for letter, so places stay."""
    return F.translate(F.lower(text), MARKED, BASE)


def evidence(note: Column, quote: Column, spaces: bool = True) -> Column:
    """struct(start, stop, level) of a quote in a note, from 0, end exclusive: as it is but for case (1), but for accents and the
    number of spaces (2), or from its first word on within 50 characters more (3); null where it is not found.

    Without spaces, other white space than the quote's is no match: there is no level 2, and at level 3 a quote has two words or more.
    """
    low, want = F.lower(note), F.lower(quote)
    at = F.instr(low, want)
    first = F.when((F.coalesce(quote, F.lit("")) != "") & (at > 0), F.struct((at - 1).alias("start"), (at - 1 + F.length(quote)).alias("stop"), F.lit(1).alias("level")))
    quoted = F.concat(F.lit("("), F.array_join(F.transform(F.filter(F.split(folded(quote), r"\s+"), lambda w: w != ""), lambda w: F.concat(F.lit("\\Q"), w, F.lit("\\E"))), "\\s+"), F.lit(")"))
    hit = F.call_function("regexp_extract", folded(note), quoted, F.lit(1))
    at2 = F.instr(folded(note), hit)
    second = F.when((hit != "") & (at2 > 0), F.struct((at2 - 1).alias("start"), (at2 - 1 + F.length(hit)).alias("stop"), F.lit(2).alias("level")))
    words = F.filter(F.split(want, r"\s+"), lambda w: w != "")
    head, tail = F.get(words, F.lit(0)), F.array_join(F.slice(words, 2, 1 << 20), " ")
    at3 = F.instr(low, head)
    after = F.substr(low, at3 + F.length(head), F.length(quote) + 50)
    at4 = F.instr(after, tail)
    begin = at3 - 1 + F.length(head)
    third = F.when((at3 > 0) & (tail != "") & (at4 > 0), F.struct((at3 - 1).alias("start"), (begin + at4 - 1 + F.length(tail)).alias("stop"), F.lit(3).alias("level")))
    if not spaces:
        return F.coalesce(first, third)
    third = third.when((at3 > 0) & (tail == ""), F.struct((at3 - 1).alias("start"), begin.alias("stop"), F.lit(3).alias("level")))
    return F.coalesce(first, second, third)


def clean_example(text: Column) -> Column:
    """An example's annotation with English labels, without placeholders of codes, ending with a full stop."""
    out = text
    for foreign, english in TRANSLATIONS.items():
        out = F.regexp_replace(out, rf"(?isu)^(.*?)\Q{foreign}\E", f"$1{english}")  # the first place only
    for pattern, new in ((CODE_PLACEHOLDER, ""), (r"\(\s*\)", ""), (r"\(\s*:\s*\)", ""), (r"\s+\.", "."), (r"\s{2,}", " ")):
        out = F.regexp_replace(out, pattern, new)
    out = F.trim(rstrip(F.trim(out), ","))
    ended = lambda x: F.when((x != "") & ~x.endswith("."), F.concat(x, F.lit("."))).otherwise(x)
    return F.get(F.transform(F.array(out), ended), F.lit(0))  # bound, so that it is worked out once
