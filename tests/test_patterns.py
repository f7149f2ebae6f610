"""The automaton before patterns: nothing that matches is left out, and many sentences and prompts cost little."""

import re
import time

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from factloom.functions import prompts
from factloom.operators import extract
from factloom.operators.patterns import Finder, folded, needed

PATTERNS = [r"ab+c", r"(?:a|b)c", r"x(yz)?", r"k[0-9]+s", r"^is", r"a.*b", r"(ab){2}c", r"\bcab\b", r"i+s?", r"", r"é(?=a)", r"(?:abc)+?x"]


def test_needed_letters():
    assert [needed(p) for p in (r"weight: ([0-9.]+) kg", r"(?:a|b)", r"re-?excision", r"^tumor site")] == ["weight: ", "", "excision", "tumor site"]


@settings(max_examples=2000, deadline=None)
@given(st.text(alphabet="abcxyzkis019 éſKıİ\n", max_size=14))
def test_no_match_is_left_out(text):
    candidates = Finder([needed(p) for p in PATTERNS]).candidates(text)
    for i, p in enumerate(PATTERNS):
        if re.search(p, text, re.IGNORECASE):
            assert i in candidates, (p, text, folded(text))


def test_prompts_of_the_pattern_lists():
    finder = prompts.PromptFinder(prompts.PROMPT_PATTERNS)
    for text in ("patient's gender male", "pre-operative chemotherapy ended on x", "unknown stage at last follow-up", "re-excision", "no", "", "icd-o-3 necrosis in biopsy"):
        want = [k for k, ps in prompts.PROMPT_PATTERNS.items() if any(re.search(p, text, re.IGNORECASE) for p in ps)]
        assert finder.find(text) == want


def test_hundreds_of_sentences_and_prompts(spark):
    """The plan does not grow with the dictionary."""
    sentences = [extract.Sentence(str(1000 + i), "", rf"finding {i}x: ([a-z]+)", [extract.Parameter(f"E.v{i}", "ENUM", [("low", "1"), ("high", "2")]), extract.Parameter(f"E.w{i}", "TEXT")]) for i in range(300)]
    rules = {f"p{i}": [rf"^finding {i}x", rf"number {i}\b.*seen"] for i in range(300)}
    rows = spark.range(2000).select(F.col("id").alias("seq"), F.lit("t").alias("prompt_type"), F.to_date(F.lit("2020-01-01")).alias("day"), F.format_string("Finding %sx: high; finding %sx: other", F.col("id") % 300, F.col("id") % 300).alias("text"))
    began = time.time()
    found = extract.default_rows(extract.matches(rows, sentences), sentences).groupBy("core_variable", "value").count().collect()
    assert len(found) == 600 and sum(r["count"] for r in found) == 4000
    assert rows.select(F.get(prompts.prompts_of(F.col("text"), rules), F.lit(0)).alias("p")).distinct().count() == 300
    assert time.time() - began < 60
