"""Redundant comments: long texts and names, and what a word's place in the name may be."""

import re
import time

from pyspark.sql import functions as F

from loomgraph.operators import quality

CASES = [
    ("Function to get User User", "getUserFunctionTo", False), ("function to user user user user user", "a FUNCTION of the user", True), ("function to user user user user user", "userfunction", True),
    ("function to abc abc abc abc abc abc xyz", "function abc", False), ("function to\tabc\nabc  abc abc abc", " function\tabc ", True), ("function to ab ab ab ab ab", "function to ab", False),
    ("function to éé éé éé éé éé éé", "FUNCTION ÉÉ", True), ("no phrase here", "no phrase here", False), ("", "", False), ("function to", None, False), (None, "x", None),
    ("function to bcd bcd bcd bcd bcd", "function abcd e", True), ("function to bcde bcde bcde bcde", "function abcd e", False),
]


def told(text, name):
    """The rule word by word."""
    if text is None:
        return None
    words = [w for w in re.split(r"\s+", text.lower(), flags=re.A) if w]
    inside = sum(len(w.encode()) > 2 and w in (name or "").lower() for w in words)
    return any(p in text.lower() for p in quality.STRUCTURAL) and inside / max(len(words), 1) > 0.8


def test_redundant_word_by_word(spark):
    rows = spark.createDataFrame([(i, t, n) for i, (t, n, _) in enumerate(CASES)], "id int, text string, name string")
    got = {r.id: r.redundant for r in rows.select("id", quality.redundant(F.col("text"), F.col("name")).alias("redundant")).collect()}
    assert [got[i] for i in range(len(CASES))] == [w for _, _, w in CASES] == [told(t, n) for t, n, _ in CASES]


def test_redundant_takes_long_names(spark):
    words = [f"word{i * 7919 % 60_013}x" for i in range(60_000)]
    text = "function to " + " ".join(words)
    rows = spark.createDataFrame([(1, text, text), (2, text, " ".join(sorted(words)))], "id int, text string, name string")
    start = time.monotonic()
    got = {r.id: r.redundant for r in rows.select("id", quality.redundant(F.col("text"), F.col("name")).alias("redundant")).collect()}
    assert got == {1: True, 2: True}
    assert time.monotonic() - start < 10
