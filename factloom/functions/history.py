"""Whether a note tells a history of several events."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words of report types, marks of past events, dates and families of treatments, in several languages.
REPORT_TYPES = [
    "anamnesis", "history", "epicrisis", "wywiad", "historia", "przebieg", "epikryza", "anamnesi", "storia clinica", "sintesi clinica",
    "evoluzione", "decorso", "anamnes", "sjukhistoria",
]
EVENTS = "(?:" + "|".join([
    r"status\s+post", r"s/p\b", r"condition\s+after",
    r"stan\s+po", r"po\s+leczeniu", r"po\s+operacji", r"po\s+chemioterapii", r"po\s+radioterapii", r"po\s+amputacji", r"po\s+resekcji",
    r"po\s+usuni[eę]ciu", r"po\s+brachyterapii", r"po\s+mastektomii", r"po\s+plastyce", r"po\s+wyci[eę]ciu",
    r"intervento\s+chirurgico", r"trattamento\s+(?:adiuvante|neoadiuvante|chemioterapico|radioterapico)", r"sottoposta?\s+a", r"(?:si\s+)?ricovera",
    r"eseguita?\s+(?:il|in\s+data)", r"(?:esame\s+)?istologic[oa]", r"E\.?\s*I\.?\s*:", r"seguiva\s+", r"avviava\s+", r"operata?\s+in\s+data",
    r"opererad", r"behandlad\s+med", r"status\s+efter", r"genomg[åa]tt",
]) + ")"
DATES = "(?:" + "|".join([
    r"\b\d{1,2}[./]\d{1,2}[./]\d{4}\b", r"\b\d{1,2}[./]\d{1,2}[./]\d{2}\b", r"\b\d{1,2}[./]\d{4}\b", r"\b\d{1,2}[-]\d{4}\b", r"\b\d{1,2}[-]\d{1,2}[-]\d{4}\b",
    r"\(\d{4}\)", r"\b\d{4}-\d{2}-\d{2}\b", r"\b\d{1,2}\.\d{2}\.\d{4}\s*r?\.", r"\b\d{2}-\d{4}\b",
]) + ")"
TREATMENTS = {
    "surgery": r"operacj[aie]|resekcj[aie]|amputacj[aie]|mastektomi[aie]|wyci[eę]ci[eao]|surgery|resection|excision|intervento\s+chirurgico|resezione|asportazione|isteroannessectomia|amputazione|mastectomia|exeresi|escissione|enucleazione|operation|resektion|amputation",
    "chemotherapy": r"chemioterapi[aie]|systemow[eay]|paklitaksel|gemcytabin|docetaksel|ifosfamid|chemotherapy|chth|cht\b|chemioterapia|trattamento\s+(?:adiuvante|neoadiuvante|chemioterapico)|gemcitabina|dacarbazina|adriamicina|doxorubicina|ifosfamide|paclitaxel|cicl[oi]\b|kemoterapi|cytostatika",
    "radiotherapy": r"radioterapii|brachyterapi[aie]|napromienianie|radiotherapy|rth\b|brachytherapy|imrt|radioterapia|brachiterapia|irradiazione|str[åa]lbehandling|str[åa]lterapi",
    "recurrence": r"wznow[aey]|nawrot|progresj[aie]|recurrence|progression|relapse|recidiva|progressione|ripresa\s+di\s+malattia|recidiv|[åa]terfall|progress",
}
YEARS = r"\b((?:19|20)\d{2})\b"
LEAST_DATES, LEAST_MARKERS, LEAST_FAMILIES, MANY_DATES = 3, 3, 2, 5


def explicit(pattern: str) -> str:
    """The pattern with its word boundaries as what they stand for, letters and digits of any script, whatever the engine's own are."""
    return re.sub(r"\\b(?=\\d|\(\(?)", r"(?<![\\p{L}\\p{N}_])", pattern).replace(r"\b", r"(?![\p{L}\p{N}_])")


#: What a letter stands for besides its own cases, wherever case is ignored.
_ALIKE = {"i": "İı", "s": "ſ", "k": "\u212a", "å": "\u212b"}
_ATOM = re.compile(r"((?:\\.|\[[^\]]*\]|\(\?:[^()]*\)|\(\?!.*?\]\)|.)[?*+]?)")


def _letters(atom: str) -> str:
    """An atom of one letter or of a class of letters as the class of these in any case; others as they are."""
    body, times = (atom[:-1], atom[-1]) if len(atom) > 1 and atom[-1] in "?*+" else (atom, "")
    some = body[1:-1] if body.startswith("[") else body
    if not some.isalpha() or body.startswith("\\"):
        return atom
    return f"[{''.join(dict.fromkeys(c for x in some.lower() for c in x + x.upper() + _ALIKE.get(x, '')))}]{times}"


def _joined(alternatives: list[list[str]]) -> str:
    """Alternatives with equal beginnings written once. Those kept apart begin with letters of their own, so the first that fits is the same."""
    if len(alternatives) == 1:
        return "".join(alternatives[0])
    firsts = list(dict.fromkeys(a[0] if a else "" for a in alternatives))
    letters = [x[1:-1] for x in firsts if re.fullmatch(r"\[\w+\]", x)]
    if len(firsts) == 1 and (letters or firsts[0] == r"\s+"):
        return firsts[0] + _joined([a[1:] for a in alternatives])
    if len(letters) < len(firsts) or len(set("".join(letters))) < len("".join(letters)):
        return "(?:" + "|".join("".join(a) for a in alternatives) + ")"
    return f"(?=[{''.join(letters)}])(?:" + "|".join(_joined([a for a in alternatives if a[0] == x]) for x in firsts) + ")"


def any_case(pattern: str) -> str:
    """The pattern, alternatives of letters, in any case and with each beginning tried once: in long texts many times as fast as (?iu)."""
    alternatives: list[list[str]] = [[]]
    for atom in _ATOM.findall(explicit(pattern)):
        if atom == "|":
            alternatives.append([])
        elif atom.startswith("(?:"):
            body, times = atom[3:].rsplit(")", 1)
            alternatives[-1].append(f"(?:{any_case(body)}){times}")
        else:
            alternatives[-1].append(_letters(atom))
    # One that may begin with more is two: with it, then without.
    split = []
    for a in alternatives:
        split += [_ATOM.findall(a[0][3:-2]) + a[1:], a[1:]] if a[0].startswith("(?:") and a[0].endswith(")?") else [a]
    return _joined(split)


def history(text: Column, report_type: Column, least_dates: int = LEAST_DATES, least_markers: int = LEAST_MARKERS, least_families: int = LEAST_FAMILIES) -> Column:
    """What tells that a note is a history of several events, over its whole text (null: empty).

    struct(history, confidence, events, methods, dates, years, markers, families): dates and years are distinct ones, markers the marks of
    events, families the names of the kinds of treatment found; methods names the signs that count, events is the greatest of dates,
    markers and families. A history has a report type that says so, dates and marks, marks and families, or many dates and families.
    """
    by_type = F.coalesce(F.lower(report_type).rlike("|".join(REPORT_TYPES)), F.lit(False))
    families = {name: any_case(p) for name, p in TREATMENTS.items()}
    events = any_case(EVENTS.removeprefix("(?:").removesuffix(")"))

    def found(t: Column) -> Column:
        distinct = lambda p, g: F.size(F.array_distinct(F.regexp_extract_all(t, F.lit(p), F.lit(g)))).cast("long")
        dates, years = distinct(rf"(?=[\d(])({explicit(DATES)})", 1), distinct(rf"(?=\d){explicit(YEARS)}", 1)
        markers = F.size(F.regexp_extract_all(t, F.lit(events), F.lit(0))).cast("long")
        some = F.array_compact(F.array(*[F.when(t.rlike(p), F.lit(name)) for name, p in families.items()]))
        return F.struct(dates.alias("dates"), years.alias("years"), markers.alias("markers"), some.alias("families"), by_type.alias("by_type"))

    def decided(x: Column) -> Column:
        n = F.size(x["families"])
        d, m, f = x["dates"] >= least_dates, x["markers"] >= least_markers, n >= least_families
        zero = F.lit(0.0)
        confidence = F.when(x["by_type"], 0.4).otherwise(zero) + F.when(d, F.least(F.lit(0.3), 0.1 * x["dates"])).otherwise(zero)
        confidence = confidence + F.when(m, F.least(F.lit(0.4), 0.1 * x["markers"])).otherwise(zero) + F.when(f, 0.2).otherwise(zero)
        methods = F.array_compact(F.array(F.when(x["by_type"], "report_type"), F.when(d, "date_count"), F.when(m, "event_markers"), F.when(f, "diverse_treatments")))
        yes = x["by_type"] | (d & m) | (m & f) | ((x["dates"] >= MANY_DATES) & f)
        return F.struct(yes.alias("history"), F.round(F.least(F.lit(1.0), confidence), 4).alias("confidence"), F.greatest(x["dates"], x["markers"], n.cast("long")).alias("events"), methods.alias("methods"), x["dates"].alias("dates"), x["years"].alias("years"), x["markers"].alias("markers"), x["families"].alias("families"))

    # Text and finds bound once, so that no pattern is searched again for each use of what it found.
    return F.get(F.transform(F.transform(F.array(F.coalesce(text, F.lit(""))), found), decided), F.lit(0))
