"""Comment, naming and size rules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomgraph.functions.patterns import glob_regex

VERBOSE_WORDS = 50
TRIVIAL = (r"^//\s*$", r"(?i)^//\s*(todo|fixme|hack)\s*$", r"^//\s*\w+\s*$", r"(?i)^//\s*(get|set|return|create|delete|update|add|remove)s?\s+\w+\s*$")
STRUCTURAL = ("function to", "method to", "variable for", "struct for", "class for", "this function", "this method")
#: In list order; the upper-case ones can't occur in lower-cased text, unless `fixed`.
OUTDATED = ("TODO", "FIXME", "HACK", "XXX", "deprecated", "temporary", "quick fix")


def word_count(text: Column) -> Column:
    """Words between Unicode blanks."""
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), r"(?U)\s+"), lambda w: w != ""))


def trivial(text: Column) -> Column:
    hit = F.lit(False)
    for p in TRIVIAL:
        hit = hit | F.trim(text).rlike(p)
    for p in STRUCTURAL:
        hit = hit | F.lower(text).contains(p)
    return hit


def verbose(words: Column) -> Column:
    """The confidence that a comment is too long; null if it isn't."""
    return F.when(words > VERBOSE_WORDS, (words - VERBOSE_WORDS) / F.lit(float(VERBOSE_WORDS)))


def outdated(text: Column, fixed: bool = False) -> Column:
    """The first keyword found, or null."""
    low, out = F.lower(text), F.lit(None).cast("string")
    for word in reversed(OUTDATED):
        out = F.when(low.contains(word.lower() if fixed else word), F.lit(word)).otherwise(out)
    return out


def redundant(text: Column, name: Column) -> Column:
    """A structural phrase, and over 0.8 of the words are longer than two bytes and part of the name. Words that
    are whole words of the name are found by hash; only the other ones, each once, are searched for inside it."""
    low, low_name = F.lower(text), F.coalesce(F.lower(name), F.lit(""))

    def share(words: Column) -> Column:
        return _once(F.filter(words, lambda w: F.octet_length(w) > 2), lambda long: _inside(long, low_name)) / F.greatest(F.size(words), F.lit(1))

    phrase = F.lit(False)
    for p in STRUCTURAL:
        phrase = phrase | low.contains(p)
    return phrase & (_once(F.filter(F.split(low, r"\s+"), lambda w: w != ""), share) > 0.8)


def _once(column: Column, f: Callable[[Column], Column]) -> Column:
    """f(column), with the column evaluated once however often f names it."""
    return F.transform(F.array(column), f)[0]


def _inside(words: Column, name: Column) -> Column:
    """How many of the words are part of the name, repeated ones counted each time."""
    other = F.array_except(words, F.split(name, r"\s+"))
    missing = _once(name, lambda n: F.filter(other, lambda w: ~n.contains(w)))
    return F.size(words) - _once(missing, lambda m: F.when(F.size(m) == 0, 0).otherwise(F.size(F.filter(words, lambda w: F.array_contains(m, w)))))


def missing_documentation(private: Column, lines: Column, parameters: Column, comments: Column) -> Column:
    """Exported, of ten lines or over two parameters, and no documentation or comment of over five words."""
    documented = F.exists(comments, lambda c: (c["type"] == "documentation") | (c["word_count"] > 5))
    return ~private & ((lines >= 10) | (parameters > 2)) & ~documented


def summarize(text: Column) -> Column:
    """The first sentence if its dot is in the first half."""
    dot = F.instr(text, ".")
    return F.when((dot > 1) & (dot <= F.length(text) / 2), F.substring(text, F.lit(1), dot)).otherwise(text)


def score(text: Column, limit: int = 10, enabled: bool = True) -> Column:
    return F.when(word_count(text) <= limit, 0.8).otherwise(0.5) if enabled else F.lit(1.0)


def too_long(name: Column, most: int, what: str) -> Column:
    """A message if the name has more bytes than that."""
    size = F.octet_length(name)
    return F.when(size > most, F.format_string(f"{what} name '%s' is too long (%d > {most})", name, size))


def disallowed(name: Column, patterns: list[tuple[str, str]]) -> Column:
    """The reason of the first pattern that the name matches, or null."""
    out = F.lit(None).cast("string")
    for glob, reason in reversed(patterns):
        out = F.when(name.rlike(glob_regex(glob, doublestar=False, braces=False)), F.lit(reason)).otherwise(out)
    return out


def is_private(name: Column) -> Column:
    """Go's rule: the first letter isn't a capital; only underscores are private."""
    return ~F.regexp_extract(name, r"^_*(.)", 1).rlike(r"^\p{Lu}")
