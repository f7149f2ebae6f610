"""Queries that evaluate predicted annotations, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.functions.text import upper_letters
from factloom.operators import evaluate as ev
from factloom.plans.core import counts
from factloom.sources.bind import table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = counts(sql.strip())
        return f

    return add


#: Expected and predicted texts: turns of a conversation, some replaced by special cases, in words that both engines take.
EXPECTED = "CASE conv_id % 9 WHEN 0 THEN '' WHEN 1 THEN 'Depth: Not specified' WHEN 2 THEN left(u, 40) WHEN 3 THEN 'Dose: 50 Gy, seen 01/02/2020; size 4.5 cm' WHEN 4 THEN 'a, b, c' ELSE u END"
PREDICTED = "CASE conv_id % 9 WHEN 0 THEN CASE WHEN turn % 4 = 0 THEN 'unknown' ELSE left(a, 30) END WHEN 1 THEN a WHEN 2 THEN upper(left(u, 40)) || '.' WHEN 3 THEN CASE WHEN turn % 4 = 0 THEN 'Dose: 50 gy, seen 01/02/2020; size 4.5 cm' ELSE 'Dose: 60 Gy, seen 1/2/2020; Stage [two]' END WHEN 4 THEN 'C, b, a' WHEN 5 THEN 'none' WHEN 6 THEN u || ' more' ELSE a END"
PAIRS = f"pr0 AS (SELECT x.conv_id, CAST(x.turn AS BIGINT) AS turn, x.text AS u, y.text AS a FROM conversations x JOIN conversations y ON y.conv_id = x.conv_id AND y.turn = x.turn + 1 WHERE x.role = 'user' AND y.role = 'assistant'), pr AS (SELECT conv_id, turn, trim(coalesce({EXPECTED}, '')) AS e, trim(coalesce({PREDICTED}, '')) AS p FROM pr0)"


def pairs(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").withColumn("turn", F.col("turn").cast("long"))
    u = c.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("u"))
    a = c.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("a"))
    loud = upper_letters(F.expr("left(u, 40)"))
    rows = u.join(a, ["conv_id", "turn"]).withColumn("loud", F.when(F.col("conv_id") % 9 == 2, loud))
    return rows.select("conv_id", "turn", F.expr(EXPECTED).alias("expected"), F.expr(PREDICTED.replace("upper(left(u, 40))", "loud")).alias("predicted"))


def _nothing(t):
    low = f"lower({t})"
    after = f"trim(regexp_extract({low}, ':\\s*(.+)$', 1))"
    words = f"list_filter(string_split_regex({low}, '\\s+'), lambda w: w != '')"
    last = f"CASE WHEN {after} != '' THEN {after} WHEN len({words}) > 2 THEN array_to_string({words}[-3:], ' ') ELSE {low} END"
    return f"({t} = '' OR regexp_matches({low}, '{ev.NO_ANNOTATION}') OR regexp_matches({last}, '{ev.NO_ANNOTATION}'))"


def _dates(t):
    return "list_sort(list_distinct(list_concat(list_concat({0}, {1}), {2})))".format(*[f"regexp_extract_all({t}, '{d}')" for d in ev.DATES])


def _numbers(t):
    one = lambda g: f"regexp_extract_all({t}, '{ev.UNITS}', {g})"
    return f"list_sort(list_distinct(list_transform(list_zip({one(1)}, {one(2)}), lambda z: z[1] || ' ' || lower(z[2]))))"


def _keyed(t):
    def one(pattern):
        k, v = (f"regexp_extract_all({t}, '{pattern}', {g})" for g in (1, 2))
        clean = lambda z: f"regexp_replace(lower({z}), '^\\s+|\\s+$', '', 'g')"
        return f"list_transform(list_filter(list_zip({k}, {v}), lambda z: {clean('z[1]')} != '' AND {clean('z[2]')} != ''), lambda z: {clean('z[1]')} || '=' || {clean('z[2]')})"

    return "list_sort(list_distinct(list_concat({0}, {1})))".format(one(r"([^:]+):\s*([^\n,;]+)"), one(r"([^\[]+)\[\s*([^\]]+)\]"))


def _listed(t):
    semi = f"list_filter(list_transform(string_split({t}, ';'), lambda x: trim(lower(x))), lambda x: x != '')"
    comma = f"list_transform(string_split({t}, ','), lambda x: trim(lower(x)))"
    return f"list_sort(list_distinct(CASE WHEN len({semi}) > 1 THEN {semi} WHEN len({comma}) > 1 AND len(list_filter({comma}, lambda x: length(x) >= 50)) = 0 THEN {comma} ELSE [] END))"


_KINDS = (_dates, _numbers, _keyed, _listed)
_TOTAL = " + ".join(f"CASE WHEN len({k('e')}) + len({k('p')}) > 0 THEN 1 ELSE 0 END" for k in _KINDS)
_MATCHED = " + ".join(f"CASE WHEN len({k('e')}) + len({k('p')}) > 0 AND {k('e')} = {k('p')} THEN 1 ELSE 0 END" for k in _KINDS)
_FLEX = "trim(regexp_replace(lower({0}), '[.,;:!?]+$', ''))"
EVALUATED = f"""{PAIRS},
tw AS (SELECT conv_id, turn, w, CAST(count(*) FILTER (side = 0) AS DOUBLE) AS tp, CAST(count(*) FILTER (side = 1) AS DOUBLE) AS tq FROM (SELECT conv_id, turn, 0 AS side, unnest(regexp_extract_all(lower(e), '{ev.WORD}')) AS w FROM pr UNION ALL SELECT conv_id, turn, 1, unnest(regexp_extract_all(lower(p), '{ev.WORD}')) FROM pr) GROUP BY 1, 2, 3),
tv AS (SELECT *, CASE WHEN tp > 0 AND tq > 0 THEN 1.0 ELSE ln(1.5) + 1 END AS idf FROM tw),
co AS (SELECT conv_id, turn, coalesce(sum(tp * idf * tq * idf) / nullif(sqrt(sum(tp * idf * tp * idf)) * sqrt(sum(tq * idf * tq * idf)), 0), 0) AS cosine FROM tv GROUP BY 1, 2),
e1 AS (SELECT pr.*, cosine, {_nothing('e')} AS ne, {_nothing('p')} AS np, CASE WHEN e = '' AND p = '' THEN true WHEN e = '' OR p = '' THEN false ELSE lower(e) = lower(p) OR ({_FLEX.format('e')} = {_FLEX.format('p')} AND {_FLEX.format('e')} != '') END AS same, {_TOTAL} AS tot, {_MATCHED} AS mat FROM pr LEFT JOIN co USING (conv_id, turn)),
e2 AS (SELECT conv_id, turn, CASE WHEN ne AND np THEN 'both_empty' WHEN ne THEN 'false_positive' WHEN np THEN 'false_negative' END AS c, same, round(coalesce(cosine, CASE WHEN same THEN 1.0 ELSE 0.0 END), 4) AS sim, tot, mat FROM e1),
e3 AS (SELECT conv_id, turn, c, CASE WHEN c IS NULL THEN same ELSE c = 'both_empty' END AS exact, CASE WHEN c IS NULL THEN sim WHEN c = 'both_empty' THEN 1.0 ELSE 0.0 END AS similarity, CASE WHEN c IS NULL THEN tot ELSE 0 END AS total_values, CASE WHEN c IS NULL THEN mat ELSE 0 END AS values_matched FROM e2),
ed AS (SELECT conv_id, turn, exact, CAST(similarity AS DOUBLE) AS similarity, similarity >= 0.8 AS high, exact OR similarity >= 0.8 AS overall, CAST(total_values AS INTEGER) AS total_values, CAST(values_matched AS INTEGER) AS values_matched, coalesce(c, CASE WHEN exact OR similarity >= 0.8 THEN 'match' ELSE 'mismatch' END) AS match_type FROM e3)"""


def evaluated(spark, sf_dir):
    return ev.evaluated(pairs(spark, sf_dir), ["conv_id", "turn"]).drop("expected", "predicted")


@query(f"WITH {EVALUATED} SELECT * FROM ed")
def t15_evaluation(spark, sf_dir):
    return evaluated(spark, sf_dir)


@query(f"WITH {EVALUATED} SELECT turn, count(*) AS n, count_if(exact) AS exact, count_if(high) AS similar, count_if(overall) AS overall, round(avg(similarity), 4) AS mean_similarity, round(avg(CASE WHEN total_values > 0 THEN round(values_matched / total_values, 4) END), 4) AS mean_value_match FROM ed GROUP BY GROUPING SETS ((turn), ())")
def a36_evaluation_totals(spark, sf_dir):
    return ev.totals(evaluated(spark, sf_dir), "turn")


@query(f"WITH {PAIRS} SELECT conv_id, turn, array_to_string({_numbers('p')}, '|') AS numbers, array_to_string({_keyed('p')}, '|') AS keyed, array_to_string({_listed('p')}, '|') AS listed FROM pr")
def t13_values(spark, sf_dir):
    """Numbers with units, key-value pairs and enumerations of the predicted texts."""
    p = F.trim(F.coalesce("predicted", F.lit("")))
    return pairs(spark, sf_dir).select("conv_id", "turn", F.array_join(ev.numbers(p), "|").alias("numbers"), F.array_join(ev.pairs_of(p), "|").alias("keyed"), F.array_join(ev.enumeration(p), "|").alias("listed"))


#: Templates and annotations of orders in their form.
FIELD_TEMPLATES = {"0": "Surgery on [put date] was [complete/incomplete] ([reason]).", "1": "Grade [select grade] by [value]", "2": "No field here"}
_DAY = "CAST(CAST(o_orderdate AS DATE) AS STRING)"
_DMY = f"substr({_DAY}, 9, 2) || '/' || substr({_DAY}, 6, 2) || '/' || substr({_DAY}, 1, 4)"
GOLD = f"CASE o_orderkey % 3 WHEN 0 THEN CASE WHEN o_orderkey % 15 = 0 THEN '' ELSE 'Surgery on ' || {_DAY} || ' was complete (' || lower(o_orderpriority) || ').' END WHEN 1 THEN 'Grade high by ' || CASE WHEN o_orderkey % 4 = 0 THEN '[value]' ELSE 'Dr ' || o_orderstatus END ELSE 'x' END"
GUESS = f"CASE o_orderkey % 3 WHEN 0 THEN 'surgery on ' || CASE WHEN o_orderkey % 2 = 0 THEN {_DMY} ELSE '01/01/1990' END || ' was ' || CASE o_custkey % 3 WHEN 0 THEN 'incomplete' WHEN 1 THEN 'completed' ELSE '[complete/incomplete]' END || ' (' || lower(o_orderpriority) || ').' WHEN 1 THEN 'Grade ' || CASE WHEN o_custkey % 2 = 0 THEN 'High' ELSE 'low' END || ' by ' || CASE WHEN o_custkey % 5 = 0 THEN 'unknown' ELSE 'Dr ' || o_orderstatus END ELSE 'y' END"


def field_pairs(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("order_id"), (F.col("o_orderkey") % 3).cast("string").alias("prompt"), F.expr(GOLD).alias("expected"), F.expr(GUESS).alias("predicted"))


def _iso(x):
    return f"CASE WHEN regexp_full_match({x}, '\\d{{1,2}}[/-]\\d{{1,2}}[/-]\\d{{4}}') THEN regexp_replace({x}, '^(\\d+)[/-](\\d+)[/-](\\d+)$', '\\3-\\2-\\1') WHEN regexp_full_match({x}, '\\d{{4}}[/-]\\d{{1,2}}[/-]\\d{{1,2}}') THEN {x} END"


def _empty(x):
    return f"(coalesce({x}, '') = '' OR regexp_full_match({x}, '\\[.*\\]') OR regexp_matches(lower(trim({x})), '{ev.FIELD_PLACEHOLDER}'))"


_FIELDS = [(p, i, f, ev.field_pattern(t, f), ev.context_pattern(t, f)) for p, t in FIELD_TEMPLATES.items() for i, f in enumerate(ev.fields_of(t))]
_VALUE = lambda t: f"CASE WHEN regexp_matches({t}, pattern) THEN trim(regexp_extract({t}, pattern, 1)) WHEN context != '' AND regexp_matches({t}, context) THEN trim(regexp_extract({t}, context, 1)) WHEN kind = 'date' AND len({_dates(t)}) > 0 THEN {_dates(t)}[1] WHEN contains({t}, '[' || field || ']') THEN '[' || field || ']' ELSE '' END"
_NEG = " OR ".join(f"'{x}' || lower(ev) = lower(pv) OR '{x}' || lower(pv) = lower(ev)" for x in ("in", "un", "non", "dis", "im", "ir", "il"))
_SAME = f"(lower(trim(ev)) = lower(trim(pv)) OR {_FLEX.format('ev')} = {_FLEX.format('pv')} AND {_FLEX.format('ev')} != '')"
BY_FIELD = f"""fi(prompt, place, field, kind, pattern, context) AS (VALUES {", ".join(f"('{p}', {i}, '{f.name}', '{f.kind}', '{pat}', '{ctx or ''}')" for p, i, f, pat, ctx in _FIELDS)}),
op AS (SELECT o_orderkey AS order_id, CAST(o_orderkey % 3 AS VARCHAR) AS prompt, {GOLD} AS e, {GUESS} AS p FROM orders),
fv AS (SELECT order_id, place, field, kind, (trim(e) = '' OR {_empty('trim(e)')}) AS none, {_VALUE('e')} AS ev, {_VALUE('p')} AS pv FROM op JOIN fi USING (prompt)),
fm AS (SELECT order_id, place, field, kind, ev AS expected_value, pv AS predicted_value, CASE WHEN none THEN CASE WHEN {_empty('pv')} THEN 'both_empty' ELSE 'false_positive' END WHEN {_empty('ev')} AND {_empty('pv')} THEN 'both_placeholder' WHEN {_empty('ev')} THEN 'extraction_success' WHEN {_empty('pv')} THEN 'extraction_failed'
  WHEN kind = 'date' THEN CASE WHEN {_iso('ev')} = {_iso('pv')} THEN 'date_normalized' WHEN {_iso('ev')} IS NOT NULL AND {_iso('pv')} IS NOT NULL THEN 'date_mismatch' WHEN {_SAME} THEN 'exact' ELSE 'date_format_error' END
  WHEN {_SAME} THEN 'exact' WHEN kind = 'categorical' THEN CASE WHEN abs(length(ev) - length(pv)) <= 3 AND NOT ({_NEG}) AND (contains(lower(pv), lower(ev)) OR contains(lower(ev), lower(pv))) THEN 'semantic' ELSE 'mismatch' END ELSE 'low_similarity' END AS method FROM fv),
fr AS (SELECT *, method IN {tuple(ev.METHODS_THAT_MATCH)} AS match FROM fm)"""


@query(f"WITH {BY_FIELD} SELECT order_id, place, field, kind, expected_value, predicted_value, method, match FROM fr")
def t16_fields(spark, sf_dir):
    """Each field of a template on its own. (In these data no two different texts of a field are similar.)"""
    return ev.by_field(field_pairs(spark, sf_dir), ["order_id"], FIELD_TEMPLATES).drop("prompt")


@query(f"""WITH {BY_FIELD}, s AS (SELECT order_id, count(*) AS total, count_if(match) AS matched, count_if(match AND method != 'extraction_success') AS correct, count_if(method = 'extraction_success') AS extracted, count_if(NOT match) AS incorrect,
string_agg(field, ', ' ORDER BY place) FILTER (match AND method != 'extraction_success') AS c, string_agg(field, ', ' ORDER BY place) FILTER (method = 'extraction_success') AS x,
string_agg(CASE WHEN method = 'extraction_failed' THEN 'Failed to extract ''' || field || ''': expected ''' || expected_value || '''' WHEN kind = 'date' THEN 'Date mismatch in ''' || field || ''': expected ''' || expected_value || ''', got ''' || predicted_value || '''' ELSE 'Mismatch in ''' || field || ''': expected ''' || expected_value || ''', got ''' || predicted_value || '''' END, chr(10) ORDER BY place) FILTER (NOT match) AS w FROM fr GROUP BY 1)
SELECT order_id, total, matched, correct, extracted, incorrect, concat_ws(chr(10), 'Correct values: ' || c, 'Successfully extracted: ' || x, w) AS feedback FROM s""")
def t17_field_summary(spark, sf_dir):
    return ev.field_summary(ev.by_field(field_pairs(spark, sf_dir), ["order_id"], FIELD_TEMPLATES), ["order_id"])


#: Dates of a line: expected the order's date, predicted its own, more or none by the key.
E_DATES = "CASE WHEN l_orderkey % 11 = 0 THEN [] WHEN l_orderkey % 3 = 0 THEN [d1, d2] ELSE [d1] END"


@query(f"""WITH b AS (SELECT l_returnflag AS prompt, l_orderkey AS k, l_linenumber AS ln, l_partkey AS pk, l_suppkey AS sk, CAST(o_orderdate AS DATE) AS d1, CAST(l_shipdate AS DATE) AS d2 FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
r AS (SELECT prompt, k, ln, pk, sk, CASE WHEN k % 11 = 0 THEN [] WHEN k % 3 = 0 THEN [d1, d2] ELSE [d1] END AS e, CASE WHEN k % 7 = 0 THEN [] WHEN k % 2 = 0 THEN [d2] ELSE [d2, d1] END AS p FROM b),
m AS (SELECT *, list_distinct(list_filter(e, lambda x: list_contains(p, x))) AS ex, list_distinct(list_filter(e, lambda x: list_contains(list_transform(p, lambda y: year(y) * 12 + month(y)), year(x) * 12 + month(x)))) AS mo, list_distinct(list_filter(e, lambda x: list_contains(list_transform(p, lambda y: year(y)), year(x)))) AS ye FROM r),
c AS (SELECT prompt, k, ln, pk, sk, len(e) AS ne, len(p) AS np, len(ex) AS nex, len(mo) - len(ex) AS nmo, len(ye) - len(mo) AS nye FROM m),
d AS (SELECT *, CASE WHEN np > 0 THEN nex / np ELSE 0 END AS pr, CASE WHEN ne > 0 THEN nex / ne ELSE 0 END AS re FROM c),
f AS (SELECT *, CASE WHEN pr + re > 0 THEN 2 * pr * re / (pr + re) ELSE 0 END AS f1, nex > 0 OR (ne = 0 AND np = 0) AS hit FROM d)
SELECT prompt, count(*) AS n, CAST(sum(nex) AS BIGINT) AS exact, CAST(sum(nmo) AS BIGINT) AS same_month, CAST(sum(nye) AS BIGINT) AS same_year, round(avg(round(pr, 4)), 4) AS "precision", round(avg(round(re, 4)), 4) AS recall, round(avg(round(f1, 4)), 4) AS f1, round(count_if(hit) / nullif(count_if(ne > 0), 0), 4) AS accuracy_of_expected, round(count_if(hit) / count(*), 4) AS accuracy FROM f GROUP BY 1""")
def a37_u4_date_matches(spark, sf_dir):
    """Dates of each row by sets: exact, then month, then year matches; precision, recall and F1 by prompt; both accuracies."""
    b = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    k, d1, d2 = F.col("l_orderkey"), F.to_date("o_orderdate"), F.to_date("l_shipdate")
    none = F.array().cast("array<date>")
    e = F.when(k % 11 == 0, none).when(k % 3 == 0, F.array(d1, d2)).otherwise(F.array(d1))
    p = F.when(k % 7 == 0, none).when(k % 2 == 0, F.array(d2)).otherwise(F.array(d2, d1))
    r = b.select(F.col("l_returnflag").alias("prompt"), e.alias("e"), p.alias("p"))
    month = lambda x: F.year(x) * 12 + F.month(x)
    r = r.withColumns({"ex": F.size(F.array_intersect("e", "p")), "mo": F.size(F.array_distinct(F.filter("e", lambda x: F.array_contains(F.transform("p", month), month(x))))), "ye": F.size(F.array_distinct(F.filter("e", lambda x: F.array_contains(F.transform("p", F.year), F.year(x)))))})
    ne, np_ = F.size("e"), F.size("p")
    pr, re_ = F.coalesce(F.try_divide("ex", np_), F.lit(0.0)), F.coalesce(F.try_divide("ex", ne), F.lit(0.0))
    f1 = F.coalesce(F.try_divide(2 * pr * re_, pr + re_), F.lit(0.0))
    hit = (F.col("ex") > 0) | ((ne == 0) & (np_ == 0))
    return r.groupBy("prompt").agg(
        F.count("*").alias("n"), F.sum("ex").alias("exact"), F.sum(F.col("mo") - F.col("ex")).alias("same_month"), F.sum(F.col("ye") - F.col("mo")).alias("same_year"),
        F.round(F.avg(F.round(pr, 4)), 4).alias("precision"), F.round(F.avg(F.round(re_, 4)), 4).alias("recall"), F.round(F.avg(F.round(f1, 4)), 4).alias("f1"),
        F.round(F.try_divide(F.count_if(hit), F.count_if(ne > 0)), 4).alias("accuracy_of_expected"), F.round(F.count_if(hit) / F.count("*"), 4).alias("accuracy"),
    )


@query("""WITH s AS (SELECT event_type, value, event_id % 3 = 0 AS right_one FROM events WHERE value IS NOT NULL), t(threshold) AS (VALUES (5.0), (20.0), (50.0)),
q AS (SELECT event_type, round(quantile_cont(value, 0.1), 6) AS q10, round(quantile_cont(value, 0.5), 6) AS q50, round(quantile_cont(value, 0.9), 6) AS q90 FROM s WHERE NOT right_one GROUP BY 1)
SELECT event_type, CAST(threshold AS DOUBLE) AS threshold, count_if(value < threshold AND NOT right_one) AS rejected_false, count_if(value < threshold AND right_one) AS rejected_correct, count_if(NOT right_one) AS false_positives, count_if(right_one) AS correct, any_value(q10) AS q10, any_value(q50) AS q50, any_value(q90) AS q90 FROM s JOIN q USING (event_type), t GROUP BY 1, 2""")
def a39_threshold_study(spark, sf_dir):
    """Quantiles of the scores of wrong answers, and what fixed thresholds reject of wrong and right ones, by prompt."""
    s = table(spark, sf_dir, "events").where("value IS NOT NULL").select("event_type", "value", (F.col("event_id") % 3 == 0).alias("right_one"))
    wrong = F.when(~F.col("right_one"), F.col("value"))
    limits = [5.0, 20.0, 50.0]
    counts_of = [F.struct(F.lit(t).alias("threshold"), F.count_if((F.col("value") < t) & ~F.col("right_one")).alias("rejected_false"), F.count_if((F.col("value") < t) & F.col("right_one")).alias("rejected_correct")) for t in limits]
    out = s.groupBy("event_type").agg(F.array(*counts_of).alias("t"), F.count_if(~F.col("right_one")).alias("false_positives"), F.count_if("right_one").alias("correct"), F.percentile(wrong, [0.1, 0.5, 0.9]).alias("q"))
    return out.select("event_type", F.explode("t").alias("t"), "false_positives", "correct", *[F.round(F.col("q")[i], 6).alias(f"q{p}") for i, p in enumerate((10, 50, 90))]).select("event_type", "t.*", "false_positives", "correct", "q10", "q50", "q90")
