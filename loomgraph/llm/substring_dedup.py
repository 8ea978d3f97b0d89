r"""Substring dedup by factoring documents against an index of every document's phrases.

Words are `[^\x20\x09-\x0D]+`, unchanged. A window is WINDOW words in a row. Its anchor is the least
hash of its ANCHOR-word phrases (ties: the leftmost), so equal windows have equal anchors at equal
places. Windows in a row with one anchor form a run, and the words that a run's windows cover are its
phrase: the unit that documents are parsed into and that the index holds.

1. Every document is parsed into runs, one row for about twelve words: anchor hash, phrase hash and place.
2. The index adds up runs by anchor. A run whose anchor occurs once holds no repeated window. If all
   runs of an anchor have one phrase, all of their windows are repeated: a factor goes through here.
3. Where an anchor has several phrases, factors begin or end within these. Their windows are checked
   one by one: one occurrence of each phrase gives its windows' hashes, weighted with the phrase's
   count, and those of weight two or more are repeated.
4. Each document takes its runs' repeated windows from left to right; as far as the next one starts
   within or right after the last one's words, they are one factor. Factors, of WINDOW words at least,
   are the duplicate spans.

This stands for a relative Lempel-Ziv parse against all blocks. It keeps the greedy factors, their least
length and the check at their boundaries. It gives up the longest match against one source: which words
go depends on repeated windows only, whose factors may change source from word to word, and to factor
every document against every block would take blocks times documents, where this takes shuffles of the
corpus's size. Phrases and windows are compared by two independent 64-bit hashes (of the anchor and of the
whole), not word by word: among n windows two different ones fall together with a chance of n * n / 2**129.

Texts of any length are hashed whole, some megabytes of them at a time. Null and empty texts have no words;
documents under WINDOW words lose none; repeated rows are each other's duplicates and all lose their
words; an empty table gives none. No column but doc_id and text is read, so extra columns may have
any name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.blocks import arrow, hash_words, mix
from loomgraph.llm.common import STEP_BYTES, materialize, steps

#: A window has WINDOW - ANCHOR + 1 phrases, at most 31, as a run's windows are the bits of an int.
WINDOW, ANCHOR = 35, 8
BASES = np.array([0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93], np.uint64)  # odd, and not near one modulo a power of two
INVERSES = np.array([pow(int(b), -1, 1 << 64) for b in BASES], np.uint64)
HIGH = np.uint64(0xFFFFFFFF00000000)
SCHEMA = "doc_id long, n_words long, n_removed long, kept_sha256 string, spans array<struct<start: int, end: int>>"
#: Two hashes of a row name it.
DOC = ["doc", "more"]
RUNS = "doc long, more long, anchor long, phrase long, start int, n int"
WINDOWS = "anchor long, hash long, phrase long, place int, weight long"


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


class Hashes:
    """Of texts laid end to end: hashes of any stretch of words, by one of two bases."""

    def __init__(self, texts: list[str | None]) -> None:
        words = [hash_words((t or "").encode().split()) for t in texts]
        self.sizes = np.array([len(w) for w in words], np.int64)
        self.first = np.cumsum(self.sizes) - self.sizes
        joined = mix(np.concatenate([*words, np.zeros(0, np.uint64)]))
        self.n = len(joined)
        self.sums = []
        for k, base in enumerate(BASES):
            sums = np.zeros(self.n + 1, np.uint64)
            np.cumsum((mix(joined + np.uint64(k)) if k else joined) * powers(base, self.n), out=sums[1:])
            self.sums.append(sums)

    def of(self, start: np.ndarray, end: np.ndarray, k: int) -> np.ndarray:
        """Hashes of the words from start to end, wherever they lie."""
        if not len(start):
            return np.zeros(0, np.uint64)
        low = start.min()  # powers as far as they are needed
        return mix((self.sums[k][end] - self.sums[k][start]) * powers(INVERSES[k], int(start.max() - low) + 1)[start - low] * powers(INVERSES[k], int(low) + 1)[-1])


def sliding_min(x: np.ndarray, m: int) -> np.ndarray:
    """The least of each m values in a row."""
    n = len(x) - m + 1
    rows = np.concatenate([x, np.full(-len(x) % m, np.iinfo(x.dtype).max, x.dtype)]).reshape(-1, m)
    after = np.minimum.accumulate(rows, axis=1).ravel()
    before = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(before[:n], after[m - 1 : m - 1 + n])


def runs_of(texts: list[str | None], window: int) -> dict[str, np.ndarray]:
    """The runs of the texts: number of the text, anchor, phrase, first window, number of windows."""
    h = Hashes(texts)
    width = min(ANCHOR, window)
    m = window - width + 1
    none = np.zeros(0, np.int64)
    if h.n < window:
        return dict.fromkeys(("text", "anchor", "phrase", "start", "n"), none)
    start = np.arange(h.n - width + 1)
    phrase = h.of(start, start + width, 0)
    # the order of phrases: the upper half of their hash, then their place
    at = (sliding_min((phrase & HIGH) | start.astype(np.uint64), m) & ~HIGH).astype(np.int64)
    long = h.sizes >= window
    counts = np.where(long, h.sizes - window + 1, 0)
    text = np.repeat(np.arange(len(h.sizes)), counts)
    inside = np.arange(len(text)) - np.repeat(np.cumsum(counts) - counts, counts)
    begins = h.first[text] + inside  # windows that lie within one text
    new = np.ones(len(begins), bool)
    new[1:] = (at[begins[1:]] != at[begins[:-1]]) | (text[1:] != text[:-1])
    first = np.flatnonzero(new)
    n = np.diff(np.append(first, len(begins)))
    low = begins[first]
    return {"text": text[first], "anchor": phrase[at[low]].view(np.int64), "phrase": h.of(low, low + n + window - 1, 1).view(np.int64), "start": inside[first], "n": n}


def mapped(df: DataFrame, schema: str, apply: Callable[[pa.RecordBatch], dict[str, Any]], limit: int) -> DataFrame:
    """mapInArrow over slices of about `limit` bytes of text; apply may give any number of rows."""
    out = arrow(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in steps(batch, "text", limit):
                columns = apply(part)
                yield pa.RecordBatch.from_arrays([pa.array(columns[f.name], type=f.type) for f in out], schema=out)

    return df.mapInArrow(run, schema)


def factors(starts: np.ndarray, window: int) -> list[tuple[int, int]]:
    """Greedy factors over the ascending starts of repeated windows: a factor goes on while the next one
    starts no later than right after the last one's end."""
    new = np.flatnonzero(np.diff(starts) > window) + 1
    first, last = starts[np.append(0, new)], starts[np.append(new, len(starts)) - 1]
    return list(zip(first.tolist(), (last + window).tolist()))


def repeated(docs: DataFrame, window: int, limit: int) -> DataFrame:
    """doc, more, runs (start, bits): each document's runs with repeated windows. docs: doc_id, text, doc, more."""

    def parse(part: pa.RecordBatch) -> dict[str, Any]:
        found = runs_of(part.column("text").to_pylist(), window)
        return found | {c: part.column(c).to_numpy(zero_copy_only=False)[found["text"]] for c in DOC}

    runs = materialize(mapped(docs, RUNS, parse, limit), "runs")
    index = runs.groupBy("anchor").agg(F.count("*").alias("n_runs"), F.min("phrase").alias("least"), F.max("phrase").alias("most")).where("n_runs > 1")
    met = materialize(runs.join(index.select("anchor", (F.col("least") != F.col("most")).alias("several")), "anchor"), "met")
    # factors' boundaries: one occurrence of each phrase, in its document
    phrases = met.where("several").groupBy("anchor", "phrase").agg(F.count("*").alias("weight"), F.min(F.struct(*DOC, "start", "n")).alias("at"))
    asked = phrases.groupBy(*[F.col(f"at.{c}").alias(c) for c in DOC]).agg(F.collect_list(F.struct("anchor", "phrase", "weight", "at.start", "at.n")).alias("asked"))

    def check(part: pa.RecordBatch) -> dict[str, Any]:
        h = Hashes(part.column("text").to_pylist())
        asked = part.column("asked")
        of_text = np.repeat(np.arange(part.num_rows), asked.value_lengths().to_numpy(zero_copy_only=False))
        rows = asked.flatten()
        get = lambda name: rows.field(name).to_numpy(zero_copy_only=False)
        n = get("n").astype(np.int64)
        place = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        start = np.repeat(h.first[of_text] + get("start"), n) + place
        return {"anchor": np.repeat(get("anchor"), n), "hash": h.of(start, start + window, 1).view(np.int64), "phrase": np.repeat(get("phrase"), n), "place": place, "weight": np.repeat(get("weight"), n)}

    # a repeated row gives its windows again, whose phrases have a weight of two or more anyway
    windows = materialize(mapped(docs.join(asked, DOC).select("doc_id", "text", *DOC, "asked"), WINDOWS, check, limit), "windows")
    twice = windows.groupBy("anchor", "hash").agg(F.sum("weight").alias("w")).where("w > 1").select("anchor", "hash")
    bits = windows.join(twice, ["anchor", "hash"], "left_semi").groupBy("anchor", "phrase").agg(F.bit_or(F.expr("shiftleft(1, place)")).alias("bits"))
    every = met.where("not several").select(*DOC, "start", F.expr("shiftleft(1, n) - 1").alias("bits"))
    some = met.where("several").join(bits, ["anchor", "phrase"]).select(*DOC, "start", "bits")
    return every.unionByName(some).distinct().groupBy(*DOC).agg(F.array_sort(F.collect_list(F.struct("start", "bits"))).alias("runs"))


def remove_duplicates(docs: DataFrame, window: int = WINDOW, block_bytes: int = STEP_BYTES) -> DataFrame:
    """One row per document; spans are word positions, end exclusive. block_bytes: texts hashed at a time."""
    # equal rows share their runs, so they need no ids of their own
    texts = docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("doc"), F.xxhash64(F.lit(1), "text", "doc_id").alias("more"))

    def finish(part: pa.RecordBatch) -> dict[str, Any]:
        rows: dict[str, Any] = {"doc_id": part.column("doc_id"), "n_words": [], "n_removed": [], "kept_sha256": [], "spans": []}
        runs = part.column("runs")
        flat = runs.flatten()
        bits = flat.field("bits").to_numpy(zero_copy_only=False).astype("<u4")
        run, place = np.nonzero(np.unpackbits(bits.view(np.uint8).reshape(-1, 4), axis=1, bitorder="little"))
        starts = flat.field("start").to_numpy(zero_copy_only=False)[run] + place
        ends = np.searchsorted(run, np.cumsum(runs.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))).tolist()
        for text, low, high in zip(part.column("text").to_pylist(), [0, *ends], ends):
            words = (text or "").encode().split()
            spans = factors(starts[low:high], window) if high > low else []
            rows["n_words"].append(len(words))
            rows["n_removed"].append(sum(b - a for a, b in spans))
            if spans:
                words = [w for a, b in zip([0, *[b for _, b in spans]], [*[a for a, _ in spans], len(words)]) for w in words[a:b]]
            rows["kept_sha256"].append(hashlib.sha256(b" ".join(words)).hexdigest())
            rows["spans"].append([{"start": a, "end": b} for a, b in spans])
        return rows

    found = repeated(texts, window, block_bytes)
    return mapped(texts.join(found, DOC, "left").select("doc_id", "text", "runs"), SCHEMA, finish, block_bytes)
