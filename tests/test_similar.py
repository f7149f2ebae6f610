"""The index of letters behind the similarity tier: no similar pair is lost, and few others are compared."""

import random
from difflib import SequenceMatcher

from factloom.operators import resolve


def test_no_similar_pair_is_lost(spark):
    rng = random.Random(4)
    alphabet = "abcde "
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 24))) for _ in range(120)]
    other = []
    for t in texts:
        for _ in range(2):
            s = list(t)
            for _ in range(rng.randrange(0, 4)):
                at = rng.randrange(len(s) + 1)
                s[at : at + rng.randrange(2)] = rng.choice(["", "x", "ab"])
            other.append("".join(s) or "q")
    values = sorted({(rng.choice("cd"), t) for t in texts} | {("c", "aa"), ("c", "a" * 40)})
    labels = sorted({(c, t) for t in other for c in "cd"} | {("c", "aaa"), ("c", "a" * 30)})
    found = resolve.similar_pairs(spark.createDataFrame(values, "category string, value string"), spark.createDataFrame(labels, "category string, label string"), 0.75)
    found = [tuple(r) for r in found.select("category", "value", "label").collect()]
    want = {(c, v, x) for c, v in values for d, x in labels if c == d and SequenceMatcher(None, v, x).ratio() >= 0.75}
    assert len(found) == len(set(found)) and want <= set(found)
    assert len(found) < 0.2 * sum(c == d for c, _ in values for d, _ in labels)


def test_pairs_grow_with_the_matches(spark):
    """Names of random words: of all pairs of like length few are compared, and twice the names have about twice the pairs."""
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(4, 9)))
    names = [" ".join(word() for _ in range(4)) for _ in range(400)]
    counts = []
    for n in (200, 400):
        labels = spark.createDataFrame([("c", x) for x in names[:n]], "category string, label string")
        values = spark.createDataFrame([("c", x[:3] + x[5:]) for x in names[:n]], "category string, value string")
        counts.append(resolve.similar_pairs(values, labels, 0.75).count())
    assert counts[0] >= 200 and counts[1] >= 400
    assert counts[1] <= 1.2 * 400
