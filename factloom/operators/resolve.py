"""Dictionary and code resolution: tiers of equality, containment, shared words and similarity; ranked candidates."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from factloom.functions.text import normal
from factloom.sources.shared import written


def _grams(text: Column, n: int) -> Column:
    """The distinct runs of n characters; for shorter texts none."""
    return F.when(F.length(text) >= n, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(text) - n + 1), lambda i: F.substr(text, i, F.lit(n))))).otherwise(F.array().cast("array<string>"))


#: Lengths of the runs by which a text is looked up in others.
RUNS = (1, 2, 3, 4, 6, 8)


def containments(short: DataFrame, long: DataFrame, least: int = 1) -> DataFrame:
    """(short, long) of the texts of short (column short) that are within texts of long (column long), of `least` characters or more, each pair once.

    A text within another shares all its runs of characters with it, so one of them, of the greatest length of RUNS that the text has
    and the rarest in long, is its key; a common key would bring together texts that have little in common. Runs are many times the
    texts they are of, so they are joined by shuffles only, dealt out before they are multiplied.
    """
    s = short.select("short").distinct().where(F.length("short") >= least)
    keys = F.array("short")
    for n in RUNS:
        keys = F.when(F.length("short") >= n, _grams(F.col("short"), n)).otherwise(keys)
    sizes = [n for n in RUNS if n >= max(m for m in RUNS if m <= max(least, 1))]
    parts = int(s.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    own = s.select("short", F.explode(keys).alias("key"))
    grams = long.select("long").distinct().select("long", F.explode(F.flatten(F.array(*[_grams(F.col("long"), n) for n in sizes]))).alias("key")).repartition(parts, "key")
    often = grams.groupBy("key").agg(F.count("*").alias("n"))
    # A key that no long text has rules the text out.
    own = own.hint("merge").join(often, "key", "left").groupBy("short").agg(F.min_by("key", F.struct(F.coalesce("n", F.lit(0)), "key")).alias("key"))
    return own.repartition(parts, "key").hint("merge").join(grams, "key").where(F.contains("long", "short")).select("short", "long")


def shared_words(queries: DataFrame, entries: DataFrame, least: float) -> DataFrame:
    """(query, entry, score): the shared distinct words over the larger number, of at least `least`.

    Two sets of n and m words can only reach it if the rarest n - ceil(least n) + 1 words of each share one: only those are keys,
    so a word that is everywhere joins nothing.
    """
    def words(rows, c):
        return rows.select(F.col(c)).distinct().select(c, F.array_distinct(F.filter(F.split(c, " "), lambda w: w != "")).alias(f"{c}_words"))

    q, e = words(queries, "query"), words(entries, "entry")
    often = q.select(F.explode("query_words").alias("w")).unionAll(e.select(F.explode("entry_words"))).groupBy("w").agg(F.count("*").alias("n"))

    def keys(rows, c):
        each = rows.select(c, F.explode(f"{c}_words").alias("w")).join(often, "w")
        rare = each.groupBy(c).agg(F.array_sort(F.collect_list(F.struct("n", "w"))).alias("o"))
        most = (F.size("o") - F.ceil(F.size("o") * least) + 1).cast("int")
        return rare.select(c, F.explode(F.slice("o", F.lit(1), most)).alias("k")).select(c, "k.w")

    pairs = keys(q, "query").join(keys(e, "entry"), "w").select("query", "entry").distinct().join(q, "query").join(e, "entry")
    score = F.size(F.array_intersect("query_words", "entry_words")) / F.greatest(F.size("query_words"), F.size("entry_words"))
    return pairs.select("query", "entry", score.alias("score")).where(F.col("score") >= least)


def fuzzy(queries: DataFrame, entries: DataFrame, least: float = 0.6) -> DataFrame:
    """query, entry, score: of each text the best entry of at least `least`, the first by seq of equally good ones.

    queries: text; entries: text, seq. Texts are normalised. Equal 1.0; one within the other 0.7 + 0.3 short / long; else the share of
    words. All candidates come from equality joins on distinct texts, and those that are resolved leave before the next tier.
    """
    q = queries.select(normal(F.col("text")).alias("query")).where("query != ''").distinct()
    e = entries.select(normal(F.col("text")).alias("entry"), "seq").where("entry != ''").groupBy("entry").agg(F.min("seq").alias("seq"))
    same = q.join(e, F.col("query") == F.col("entry")).select("query", "entry", F.lit(1.0).alias("score"))
    rest = q.join(same, "query", "left_anti")
    inside = containments(e.select(F.col("entry").alias("short")), rest.select(F.col("query").alias("long"))).select(F.col("long").alias("query"), F.col("short").alias("entry"))
    around = containments(rest.select(F.col("query").alias("short")), e.select(F.col("entry").alias("long"))).select(F.col("short").alias("query"), F.col("long").alias("entry"))
    a, b = F.length("query"), F.length("entry")
    within = inside.unionByName(around).distinct().withColumn("score", 0.7 + 0.3 * (F.least(a, b) / F.greatest(a, b)))
    words = shared_words(rest, e, least).join(within.select("query", "entry"), ["query", "entry"], "left_anti")
    scored = within.unionByName(words).join(e, "entry")
    best = scored.groupBy("query").agg(F.max_by(F.struct("entry", "score"), F.struct(F.round("score", 9), -F.col("seq"))).alias("b"))
    return same.unionByName(best.select("query", "b.entry", "b.score"))


@F.pandas_udf(DoubleType())
def _ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b)], dtype="float64")


#: Texts of this length or more are looked up by pairs of letters.
LONG = 10


def _matched(least: float, both: Column) -> Column:
    """The letters that two texts of so many together must match for a ratio of `least`."""
    return F.ceil(both * (least / 2) - 1e-9)


def _tokens(texts: DataFrame, size: int) -> DataFrame:
    """text, n (its length), token of every run of `size` letters, where a run that comes again has a number of its own."""
    t = texts.select("text", F.length("text").alias("n")).where(F.col("n") >= size)
    runs = t.select("text", "n", F.explode(F.expr(f"transform(sequence(1, n - {size - 1}), i -> struct(i AS i, substring(text, i, {size}) AS run))")).alias("r")).select("text", "n", "r.*")
    nth = F.row_number().over(Window.partitionBy("text", "run").orderBy("i"))
    return runs.select("text", "n", F.concat_ws("#", nth, "run").alias("token"))


def _rarest(tokens: DataFrame, frequency: DataFrame, kept: Column) -> DataFrame:
    """The first `kept` tokens of each text, rare ones first."""
    t = tokens.join(frequency, "token", "left").withColumn("df", F.coalesce("df", F.lit(0)))
    t = t.withColumn("at", F.row_number().over(Window.partitionBy("text").orderBy("df", "token"))).where(F.col("at") <= kept)
    return t.select("text", "token")


def similar_pairs(values: DataFrame, labels: DataFrame, least: float) -> DataFrame:
    """category, value, label: every pair of a category whose SequenceMatcher ratio may be `least` (over 2/3), and few others.

    values: category, value; labels: category, label, both distinct. For a ratio of r, texts of a and b letters match M >= r (a + b) / 2 of them, in
    blocks that are one more than the letters left over at most (between two blocks one side has one). So they have M letters in common, and
    3 M - a - b - 1 pairs of letters. Texts that have so many of their tokens in common have one in common among the rarest of each, all but so
    many: pairs come from equality joins on these, by pairs of letters if both texts are long and else by letters. Then both numbers are checked.
    """
    v, d = values.select(F.col("value").alias("text")).distinct(), labels.select(F.col("label").alias("text")).distinct()
    share = least / (2 - least)  # of the longer text, the shorter has this at least
    found = []
    for size in (1, 2):
        near = LONG / share + 1
        some = F.col("n") < near if size == 1 else F.col("n") >= LONG
        x, y = (_tokens(t, size).where(some) for t in (v, d))
        frequency = y.groupBy("token").agg(F.count("*").alias("df"))
        least_both = F.col("n") + F.ceil(F.col("n") * share - 1e-9)
        need = _matched(least, least_both) if size == 1 else 3 * _matched(least, least_both) - least_both - 1
        # Rounding up makes it fall at places, by two at most.
        kept = F.col("n") - size + 1 - F.greatest(need - (0 if size == 1 else 2), F.lit(1)) + 1
        left = _rarest(x, frequency, kept).join(values.withColumnRenamed("value", "text"), "text").select("category", "token", F.col("text").alias("value"))
        right = _rarest(y, frequency, kept).join(labels.select("category", F.col("label").alias("text")), "text").select("category", "token", F.col("text").alias("label"))
        a, b = F.length("value"), F.length("label")
        found.append(left.join(right, ["category", "token"]).where(2 * F.least(a, b) >= least * (a + b) - 1e-9).select("category", "value", "label").distinct())
    pairs = found[0].unionByName(found[1]).distinct()
    for size in (1, 2):
        for side, texts in (("value", v), ("label", d)):
            lists = _tokens(texts, size).groupBy("text").agg(F.collect_list("token").alias(f"{side}_{size}")).withColumnRenamed("text", side)
            pairs = pairs.join(lists, side, "left").withColumn(f"{side}_{size}", F.coalesce(f"{side}_{size}", F.array().cast("array<string>")))
    common = lambda size: F.size(F.array_intersect(f"value_{size}", f"label_{size}"))
    both = F.length("value") + F.length("label")
    m = _matched(least, both)
    return pairs.where((common(1) >= m) & (common(2) >= 3 * m - both - 1)).select("category", "value", "label")


def by_tier(values: DataFrame, dictionary: DataFrame, least: float = 0.75) -> DataFrame:
    """value, category, code, tier, method of each distinct value: the exact label 1.0; the longest label of the category that contains the
    value or is within it 0.9; the most similar label from `least` on; else unresolved (no code, 0).

    dictionary: category, label, code, seq (of equal labels the last stays, of equally good ones the first). Each tier sees
    what the one before left; similarity is computed, in Arrow batches, for pairs that an index of letters leaves (see similar_pairs).
    """
    v = values.select("category", normal(F.col("value")).alias("value")).distinct()
    d = dictionary.select("category", normal(F.col("label")).alias("label"), "code", "seq").groupBy("category", "label").agg(F.max_by("code", "seq").alias("code"), F.min("seq").alias("seq"))
    exact = v.join(d, (v["category"] == d["category"]) & (v["value"] == d["label"]), "left").select(v["category"], v["value"], "code")
    done = exact.where("code IS NOT NULL").select("category", "value", "code", F.lit(1.0).alias("tier"), F.lit("exact").alias("method"))
    rest = exact.where("code IS NULL AND value != ''").drop("code")
    inside = containments(d.select(F.col("label").alias("short")), rest.select(F.col("value").alias("long"))).select(F.col("long").alias("value"), F.col("short").alias("label"))
    around = containments(rest.select(F.col("value").alias("short")), d.select(F.col("label").alias("long"))).select(F.col("short").alias("value"), F.col("long").alias("label"))
    near = rest.join(inside.unionByName(around).distinct(), "value").join(d, ["category", "label"])
    near = near.groupBy("category", "value").agg(F.min_by("code", F.struct(-F.length("label"), "seq")).alias("code"))
    left = rest.join(near, ["category", "value"], "left_anti")
    left = written(left, "unresolved-values")
    pairs = written(similar_pairs(left, d, least), "similar-pairs")
    like = pairs.join(d, ["category", "label"]).withColumn("ratio", _ratio("value", "label")).where(F.col("ratio") >= least)
    like = like.groupBy("category", "value").agg(F.max_by(F.struct("code", "ratio"), F.struct("ratio", -F.col("seq"))).alias("b")).select("category", "value", "b.code", F.round("b.ratio", 3).alias("tier"), F.lit("fuzzy").alias("method"))
    none = exact.where("code IS NULL").join(near, ["category", "value"], "left_anti").join(like, ["category", "value"], "left_anti").select("category", "value", "code", F.lit(0.0).alias("tier"), F.lit("unresolved").alias("method"))
    return done.unionByName(near.withColumns({"tier": F.lit(0.9), "method": F.lit("contains")})).unionByName(like).unionByName(none)


def _text_score(text: Column, name: Column) -> Column:
    """The text in the name 0.85 + 0.1 short / long, the name in the text 0.75 + 0.1 short / long, else 0.7 times their similarity;
    0 where either is empty."""
    a, b = F.length(text), F.length(name)
    inside, around, none = F.contains(name, text), F.contains(text, name), (a == 0) | (b == 0)
    odd = ~inside & ~around & ~none
    ratio = _ratio(F.when(odd, text).otherwise(""), F.when(odd, name).otherwise(""))
    return F.when(none, 0.0).when(inside, 0.85 + 0.1 * a / b).when(around, 0.75 + 0.1 * b / a).otherwise(ratio * 0.7)


def near_names(texts: DataFrame, names: DataFrame, least: float = 0.3) -> DataFrame:
    """(text, name_norm, s) of texts (column text) and names (column name_norm) whose _text_score is at least `least`.

    Either one is within the other, or they are similar: then the shorter has a share of the letters that the score asks for, so
    pairs come from bands of like length, by equality joins.
    """
    t, n = texts.select("text").distinct().where("text != ''"), names.select("name_norm").distinct().where("name_norm != ''")
    inside = containments(t.select(F.col("text").alias("short")), n.select(F.col("name_norm").alias("long"))).toDF("text", "name_norm")
    around = containments(n.select(F.col("name_norm").alias("short")), t.select(F.col("text").alias("long"))).select(F.col("long").alias("text"), F.col("short").alias("name_norm"))
    ratio = least / 0.7
    base = (2 - ratio) / ratio  # the longer is at most so many times the shorter
    band = lambda c: F.floor(F.log(F.length(c).cast("double")) / F.log(F.lit(base))).cast("int")
    like = t.withColumn("band", F.explode(F.sequence(band("text") - 1, band("text") + 1))).join(n.withColumn("band", band("name_norm")), "band").drop("band")
    a, b = F.length("text"), F.length("name_norm")
    like = like.where(2 * F.least(a, b) >= ratio * (a + b))
    return inside.unionByName(around).unionByName(like).distinct().withColumn("s", _text_score(F.col("text"), F.col("name_norm"))).where(F.col("s") >= least)


def top_candidates(queries: DataFrame, combinations: DataFrame, n: int) -> DataFrame:
    """Of each query (id, morphology, topography, query, histology_text, topography_text) the n best combinations with rank.

    combinations: code, morphology, topography, name, seq. A code counts by the first tier that reaches it: its own code 1.0; both parts
    0.9; its morphology 0.6 or up to 0.75 by the site's text; its topography 0.5 or up to 0.65 by the histology's text; its name
    0.3 + 0.3 s from s = 0.3 on (0.6 at most). Ids that ask the same are resolved as one, so only its n best rows are multiplied by them.
    """
    own = F.struct("morphology", "topography", "query", normal(F.coalesce("histology_text", F.lit(""))).alias("ht"), normal(F.coalesce("topography_text", F.lit(""))).alias("tt"))
    ids = queries.groupBy("id").agg(F.array_sort(F.collect_set(own)).alias("asked"))  # one, but for ids that come with several queries
    alike = ids.groupBy("asked").agg(F.min("id").alias("first"))
    best = _candidates(alike.select(F.col("first").alias("id"), F.explode("asked").alias("a")).select("id", "a.*"), combinations, n)
    found = alike.join(best, alike["first"].eqNullSafe(best["id"])).drop("id", "first")
    return ids.join(found, "asked").select("id", "code", "score", "method", "seq", "rank")


def _candidates(q: DataFrame, combinations: DataFrame, n: int) -> DataFrame:
    """The rows of top_candidates for queries whose texts are normalised (ht, tt).

    The best of each distinct key and text are taken within the dictionary before queries join them, so a query meets a few times n
    rows, not a whole part's codes.
    """
    c = combinations.withColumn("name_norm", normal(F.col("name")))
    out = ["id", "code", "score", "method", "seq"]

    def of(rows, score, method, tier):
        return rows.select("id", "code", score.cast("double").alias("score"), F.lit(method).alias("method"), "seq", F.lit(tier).alias("tier"))

    tiers = [of(q.join(c, q["query"] == c["code"]), F.lit(1.0), "exact", 1), of(q.join(c, ["morphology", "topography"]), F.lit(0.9), "combined", 2)]
    for part, text, base, most, method, tier in (("morphology", "tt", 0.6, 0.75, "morphology", 3), ("topography", "ht", 0.5, 0.65, "topography", 4)):
        keys = q.select(part, text).where(F.col(part).isNotNull()).distinct().join(c.select(part, "code", "seq", "name_norm"), part)
        score = F.least(F.lit(most), F.greatest(F.lit(base), base + _text_score(F.col(text), F.col("name_norm")) * 0.15))
        # The exact and combined codes may be among a part's best, so there is room for them.
        best = keys.withColumn("score", score).withColumn("r", F.row_number().over(Window.partitionBy(part, text).orderBy(F.desc("score"), "seq"))).where(F.col("r") <= 2 * n + 2)
        tiers.append(of(q.select("id", part, text).join(best.select(part, text, "code", "seq", "score"), [part, text]), F.col("score"), method, tier))
    texts = q.select("id", F.explode(F.array_distinct(F.array("ht", "tt"))).alias("text")).where("text != ''")
    named = near_names(texts, c).join(c.select("name_norm", "code", "seq"), "name_norm")
    best = named.withColumn("score", F.least(F.lit(0.6), 0.3 + F.col("s") * 0.3)).withColumn("r", F.row_number().over(Window.partitionBy("text").orderBy(F.desc("score"), "seq"))).where(F.col("r") <= 4 * n + 4)
    tiers.append(of(texts.join(best.select("text", "code", "seq", "score"), "text"), F.col("score"), "text", 5))
    every = tiers[0]
    for t in tiers[1:]:
        every = every.unionByName(t)
    first = every.groupBy("id", "code").agg(F.min_by(F.struct("score", "method", "seq"), F.struct("tier", -F.col("score"))).alias("f")).select("id", "code", "f.*")
    rank = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("score"), F.when(F.col("method") == "exact", 1).when(F.col("method") == "combined", 2).when(F.col("method") == "morphology", 3).when(F.col("method") == "topography", 4).otherwise(5), "seq"))
    return first.withColumn("rank", rank).where(F.col("rank") <= n).select(*out, "rank")


def best_match(queries: DataFrame, combinations: DataFrame) -> DataFrame:
    """id, code, score, method of each query: the first step of the cascade that finds one: its own code 1.0, both parts 0.9, a name that
    holds a text or is in it 0.5 (histology first), its morphology 0.3, its topography 0.3; null and 0 if none does.

    Steps are joins against the least row (by seq) of each key; resolved queries leave before the texts are compared. A step by
    morphology and the site's text (0.7) has no column to compare in a code list, so it finds nothing.
    """
    c = combinations.withColumn("name_norm", normal(F.col("name")))
    q = queries.withColumns({"ht": normal(F.coalesce("histology_text", F.lit(""))), "tt": normal(F.coalesce("topography_text", F.lit("")))})

    def least(*keys):
        return c.groupBy(*keys).agg(F.min_by("code", "seq").alias("found"))

    exact = q.join(c.select(F.col("code").alias("query")).distinct(), "query", "left_semi").select("id", F.col("query").alias("code"), F.lit(1.0).alias("score"), F.lit("exact").alias("method"))
    both = q.join(least("morphology", "topography"), ["morphology", "topography"]).select("id", F.col("found").alias("code"), F.lit(0.9).alias("score"), F.lit("combined").alias("method"))
    both = both.join(exact, "id", "left_anti")
    rest = q.join(exact.select("id").union(both.select("id")), "id", "left_anti")
    names = least("name_norm").join(c.groupBy("name_norm").agg(F.min("seq").alias("seq")), "name_norm")
    texts = rest.select(F.explode(F.array("ht", "tt")).alias("t")).where("t != ''").distinct()
    inside = containments(texts.select(F.col("t").alias("short")), names.select(F.col("name_norm").alias("long"))).select(F.col("short").alias("t"), F.col("long").alias("name_norm"))
    around = containments(names.select(F.col("name_norm").alias("short")), texts.select(F.col("t").alias("long"))).select(F.col("long").alias("t"), F.col("short").alias("name_norm"))
    hit = inside.unionByName(around).distinct().join(names, "name_norm").groupBy("t").agg(F.min_by("found", "seq").alias("found"))
    h, t = hit.toDF("ht", "by_h"), hit.toDF("tt", "by_t")
    rest = rest.join(h, "ht", "left").join(t, "tt", "left").join(least("morphology").withColumnRenamed("found", "by_m"), "morphology", "left").join(least("topography").withColumnRenamed("found", "by_p"), "topography", "left")
    text = F.coalesce("by_h", "by_t")
    code = F.coalesce(text, "by_m", "by_p")
    method = F.when(text.isNotNull(), "text").when(F.col("by_m").isNotNull(), "partial_morphology").when(F.col("by_p").isNotNull(), "partial_topography").otherwise("no_match")
    score = F.when(text.isNotNull(), 0.5).when(code.isNotNull(), 0.3).otherwise(0.0)
    return exact.unionByName(both).unionByName(rest.select("id", code.alias("code"), score.alias("score"), method.alias("method")))


def searched(combinations: DataFrame, query: str, n: int, morphology: str = "", topography: str = "") -> DataFrame:
    """The n combinations that fit a search text best, by ten scores from the same code (1.0) down to shared words (0.3 at most)."""
    text = query.strip()
    low = text.lower()
    code, m, t, name = (F.lower(F.trim(c)) for c in ("code", "morphology", "topography", "name"))
    norm, name_norm = normal(F.lit(text)), normal(F.col("name"))
    words = sorted(set(low.split()))
    shared = F.size(F.array_intersect(F.array(*[F.lit(w) for w in words]), F.split(name, r"\s+")))
    score = F.when(code == low, 1.0).when((m == low) | (t == low), 0.95).when(code.contains(low), 0.85).when(m.contains(low) | t.contains(low), 0.8)
    score = score.when(name == low, 0.9).when(name.startswith(low), 0.75).when(name.contains(low), 0.5 + 0.2 * len(text) / F.length("name"))
    score = score.when((norm != "") & F.contains(name_norm, norm), 0.45 + 0.15 * F.length(norm) / F.length(name_norm)).otherwise(0.3 * shared / len(words))
    rows = combinations.where(F.col("morphology").startswith(morphology) & F.col("topography").startswith(topography))
    return rows.withColumn("score", score).where("score > 0").orderBy(F.desc("score"), "seq").limit(n)


def coded(annotations: DataFrame, combinations: DataFrame, dictionary: DataFrame, pattern: str, n: int) -> DataFrame:
    """id, code, morphology, topography, score, method, low_confidence, candidates of annotations (id, kind, text).

    An explicit code (pattern with both parts) stands; else the text after its label is looked up in the dictionary (text, morphology,
    topography, seq), of which the part of the annotation's kind counts. Candidates are those of the codes found; the annotation's own
    parts stay, and the first candidate that has them is the chosen one. Without candidates the explicit code stands alone.
    """
    a = annotations.withColumns({"m": F.nullif(F.regexp_extract("text", pattern, 1), F.lit("")), "t": F.nullif(F.regexp_extract("text", pattern, 2), F.lit(""))})
    a = a.withColumns({"m": F.concat(F.lit("M"), "m"), "said": normal(F.regexp_replace("text", r"^[^:]*:\s*", ""))})
    looked = a.where("m IS NULL").select(F.col("said").alias("text"))
    hits = fuzzy(looked, dictionary).select(F.col("query").alias("said"), "entry")
    parts = dictionary.withColumn("entry", normal(F.col("text"))).groupBy("entry").agg(F.min_by("morphology", "seq").alias("dm"), F.min_by("topography", "seq").alias("dt"))
    a = a.join(hits.join(parts, "entry").drop("entry"), "said", "left")
    a = a.withColumns({"morphology": F.coalesce("m", F.when(F.col("kind") == "histology", F.col("dm"))), "topography": F.coalesce("t", F.when(F.col("kind") == "site", F.col("dt")))})
    q = a.select("id", "morphology", "topography", F.concat("m", F.lit("-"), "t").alias("query"), F.lit(None).cast("string").alias("histology_text"), F.lit(None).cast("string").alias("topography_text"))
    best = top_candidates(q.where("morphology IS NOT NULL OR topography IS NOT NULL"), combinations, n).join(combinations.select("code", F.col("morphology").alias("cm"), F.col("topography").alias("ct")), "code")
    lists = best.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("rank", "code", "score", "method", "cm", "ct"))).alias("candidates"))
    out = a.join(lists, "id", "left")
    first = F.get("candidates", F.lit(0))
    own = F.get(F.filter("candidates", lambda c: c["cm"].eqNullSafe(F.col("morphology")) | c["ct"].eqNullSafe(F.col("topography"))), F.lit(0))
    pick = F.coalesce(own, first)
    joint = F.concat("m", F.lit("-"), "t")
    score = F.coalesce(pick["score"], F.when(joint.isNotNull(), 1.0))
    return out.select("id", F.coalesce(pick["code"], joint).alias("code"), F.coalesce("morphology", pick["cm"]).alias("morphology"), F.coalesce("topography", pick["ct"]).alias("topography"), score.alias("score"), F.coalesce(pick["method"], F.when(joint.isNotNull(), "exact_no_list")).alias("method"), (score < 0.7).alias("low_confidence"), F.transform("candidates", lambda c: c["code"]).alias("candidates"))
