r"""Quality rules: document statistics, two hard rules, and gradient-boosted trees for the rest.

Statistics are exact over each whole text (words are `[^\x20\x09-\x0D]+`; a null text has none).
A document with fewer than 50 words, or with more than half of its words in repeated 3-word
windows, fails outright. For the others boosted trees give the probability that the document is
good; below THRESHOLD it isn't kept. The trees are grown on histograms, with monotonic
constraints: more symbols, repeated lines, repeated words, capitals or separators never raise the
probability. Fitted trees are flattened into numpy arrays of split features, thresholds and leaf
values, in heap order, and whole batches are scored at once.

The fit uses at most MAX_FIT labelled documents (those of least id hash whose crc32 mod 5 is not
0, so that a fold stays unseen), one row of each id (of several the one of least label and features);
without labels of both kinds only the hard rules judge. Each text, however long, is counted whole;
an empty text has zero statistics and fails. Repeated rows each give their row, an empty table none,
and no column but doc_id and text is read, so extra columns may have any name.
"""

from __future__ import annotations

import math
from collections import Counter
from typing import Any

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import bounded_sample, map_text, remainder

MAX_FIT = 20_000
#: Low, as a document that is lost here is lost for good.
THRESHOLD = 0.3
#: The features that the trees split on, each with its monotonic direction (0: none).
FEATURES = {
    "n_words": 0, "mean_word": 0, "symbols_per_word": -1, "dup_lines": -1, "repeat_words": -1, "capitals": -1,
    "bars": -1, "bangs": -1, "digits": -1, "distinct_words": 0, "line_words": 0, "stops": 0,
}
SYMBOLS = "#*$%&|<>"
BLANK = " \t\n\x0b\x0c\r"
BASE_SCHEMA = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
SCHEMA = f"doc_id long, {BASE_SCHEMA}, base_failed boolean, kept boolean, score double"


def statistics(text: str) -> tuple[list[int], list[float]]:
    """The base statistics, in the order of BASE_SCHEMA, and the features."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()  # bytes split at exactly these six blanks
    n = len(words)
    chars = len(text) - sum(map(text.count, BLANK))
    symbols = sum(map(raw.count, SYMBOL_BYTES))
    lines = raw.split(b"\n")
    filled = [x for x in lines if x and not x.isspace()]
    dup_lines = len(filled) - len(set(filled))
    repeated = 0
    windows = list(zip(words, words[1:], words[2:]))
    if len(windows) > 1 and len(seen := Counter(windows)) < len(windows):
        covered = bytearray(n)
        for i, w in enumerate(windows):
            if seen[w] > 1:
                covered[i : i + 3] = b"\1\1\1"
        repeated = sum(covered)
    some = max(n, 1)
    size = max(chars, 1)
    features = [
        math.log1p(n), chars / some, symbols / some, dup_lines / max(len(filled), 1), repeated / some,
        left_over(raw, OTHERS) / size, raw.count(b"|") / some, raw.count(b"!") / some,
        left_over(raw, NOT_DIGITS) / size, len(set(words)) / some, n / max(len(filled), 1), (raw.count(b".") + raw.count(b",")) / some,
    ]
    return [n, chars, symbols, dup_lines, repeated], features


SYMBOL_BYTES = [c.encode() for c in SYMBOLS]
OTHERS = bytes(set(range(256)) - set(range(65, 91)))
NOT_DIGITS = bytes(set(range(256)) - set(range(48, 58)))


def left_over(raw: bytes, without: bytes) -> int:
    """How many bytes are left without the given ones."""
    return len(raw.translate(None, without))


class Trees:
    """Boosted trees of one depth, flattened: node k of a tree has the children 2k+1 and 2k+2."""

    def __init__(self, prior: float, feature: np.ndarray, threshold: np.ndarray, leaf: np.ndarray) -> None:
        self.prior, self.feature, self.threshold, self.leaf = prior, feature, threshold, leaf

    def margin(self, x: np.ndarray) -> np.ndarray:
        inner = self.feature.shape[1]
        at = np.zeros((len(x), len(self.feature)), np.int64)
        tree, row = np.arange(len(self.feature))[None, :], np.arange(len(x))[:, None]
        for _ in range(int(math.log2(inner + 1))):
            at = 2 * at + 1 + (x[row, self.feature[tree, at]] > self.threshold[tree, at])
        return self.prior + self.leaf[tree, at - inner].sum(axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([1 / (1 + np.exp(-self.margin(x[i : i + 4096]))) for i in range(0, len(x), 4096)]) if len(x) else np.zeros(0)


def fit(x: np.ndarray, y: np.ndarray, directions: list[int], rounds: int = 60, depth: int = 3, rate: float = 0.15, bins: int = 48, ridge: float = 1.0) -> Trees | None:
    """Newton boosting on binned features; None if y has one kind of label only."""
    if len(y) == 0 or y.min() == y.max():
        return None
    n, d = x.shape
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(d)]
    binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1)
    inner = 2**depth - 1
    prior = math.log(y.mean() / (1 - y.mean()))
    margin = np.full(n, prior)
    features, thresholds, leaves = [], [], []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        feature, threshold, cut = np.zeros(inner, np.int64), np.full(inner, np.inf), np.full(inner, bins)
        low, high = np.full(2 * inner + 1, -np.inf), np.full(2 * inner + 1, np.inf)
        at = np.zeros(n, np.int64)
        for k in range(inner):
            mine = np.flatnonzero(at == k)
            low[2 * k + 1], low[2 * k + 2], high[2 * k + 1], high[2 * k + 2] = low[k], low[k], high[k], high[k]
            best, chosen = 1e-6, None
            G, H = g[mine].sum(), h[mine].sum()
            for j in range(d if len(mine) > 1 else 0):
                size = len(edges[j])
                gl = np.cumsum(np.bincount(binned[mine, j], g[mine], size + 1))[:-1]
                hl = np.cumsum(np.bincount(binned[mine, j], h[mine], size + 1))[:-1]
                left, right = (np.clip(-a / (b + ridge), low[k], high[k]) for a, b in ((gl, hl), (G - gl, H - hl)))
                gain = -(gl * left + 0.5 * (hl + ridge) * left**2) - ((G - gl) * right + 0.5 * (H - hl + ridge) * right**2)
                gain += np.clip(-G / (H + ridge), low[k], high[k]) * G + 0.5 * (H + ridge) * np.clip(-G / (H + ridge), low[k], high[k]) ** 2
                gain[(hl < 1e-2) | (H - hl < 1e-2) | (directions[j] * (right - left) < 0)] = -1
                if len(gain) and gain.max() > best:
                    c = int(gain.argmax())
                    best, feature[k], threshold[k], cut[k], chosen = gain[c], j, edges[j][c], c, None
                    if directions[j]:  # the child that must stay below, the one above, and the value between
                        below, above = (2 * k + 1, 2 * k + 2) if directions[j] > 0 else (2 * k + 2, 2 * k + 1)
                        chosen = below, above, (left[c] + right[c]) / 2
            if chosen:
                high[chosen[0]], low[chosen[1]] = min(high[k], chosen[2]), max(low[k], chosen[2])
            at[mine] = 2 * k + 1 + (binned[mine, feature[k]] > cut[k])
        leaf = np.zeros(inner + 1)
        for m in range(inner + 1):
            mine = at == inner + m
            leaf[m] = rate * np.clip(-g[mine].sum() / (h[mine].sum() + ridge), low[inner + m], high[inner + m]) if mine.any() else 0.0
        margin += leaf[at - inner]
        features.append(feature), thresholds.append(threshold), leaves.append(leaf)
    return Trees(prior, np.array(features), np.array(thresholds), np.array(leaves))


def train(docs: DataFrame, labels: DataFrame, most: int = MAX_FIT) -> Trees | None:
    """Fits the trees on at most `most` labelled documents."""
    fold = labels.select("doc_id", "quality").where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & (remainder(F.col("doc_id"), 5) != 0))
    sample = bounded_sample(fold, "doc_id", most)  # at most `most` rows of 16 bytes: broadcast
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")

    def make() -> Any:
        return lambda columns: {"doc_id": columns["doc_id"], "quality": columns["quality"], "x": [statistics(t or "")[1] for t in columns["text"]]}

    # one row per id, however often it is repeated, so that the driver gets `most` rows at most
    one = map_text(rows, "doc_id long, quality int, x array<double>", make).groupBy("doc_id").agg(F.min(F.struct("quality", "x")).alias("s"))
    got = one.select("doc_id", "s.*").toPandas().sort_values("doc_id", kind="stable")
    if not len(got):
        return None
    return fit(np.array(got["x"].tolist()), got["quality"].to_numpy(float), list(FEATURES.values()))


def judge(docs: DataFrame, trees: Trees | None, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: the base statistics, base_failed, kept and the trees' score."""

    def make() -> Any:
        def apply(columns: dict[str, list]) -> dict[str, Any]:
            made = [statistics(t or "") for t in columns["text"]]
            base = np.array([m[0] for m in made], np.int64).reshape(-1, 5)
            score = trees.score(np.array([m[1] for m in made])) if trees else np.ones(len(made))
            failed = (base[:, 0] < 50) | (100 * base[:, 4] > 50 * base[:, 0])
            names = [x.split()[0] for x in BASE_SCHEMA.split(", ")]
            return {"doc_id": columns["doc_id"], **dict(zip(names, base.T)), "base_failed": failed, "kept": ~failed & (score >= threshold), "score": score}

        return apply

    return map_text(docs.select("doc_id", "text"), SCHEMA, make)


def keep(docs: DataFrame, trees: Trees | None, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that judge() keeps, unchanged, without a shuffle."""

    def run(batches: Any) -> Any:
        import pyarrow as pa

        from loomgraph.llm.common import steps

        for batch in batches:
            for part in steps(batch, "text"):
                made = [statistics(t or "") for t in part.column("text").to_pylist()]
                base = np.array([m[0] for m in made], np.int64).reshape(-1, 5)
                score = trees.score(np.array([m[1] for m in made])) if trees else np.ones(len(made))
                kept = (base[:, 0] >= 50) & (100 * base[:, 4] <= 50 * base[:, 0]) & (score >= threshold)
                yield part.filter(pa.array(kept))

    return docs.mapInArrow(run, docs.schema)
