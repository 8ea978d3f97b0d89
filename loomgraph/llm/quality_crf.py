r"""Quality classifier: a linear-chain conditional random field over a document's lines.

Every \n-split line is a node with the label good or bad. Its scores are linear in its features,
those of the lines before and after it, and its being first or last; two neighbouring labels add
a transition score. A forward-backward pass gives each line's marginal probability of good, and
the document's score is their mean, weighted with the lines' lengths (plus one, so that empty
lines, and empty or null texts, have a weight).

Lines of labelled documents take the document's quality as their label. The fit, by gradient
steps on the penalised likelihood, uses at most MAX_FIT labelled documents of the training fold
(crc32 of the id modulo 5 not 0), those of least id hash; labels, lang, source and ids are no
features. Of a document it reads MAX_FIT_LINES lines at most, and of rows with one id the one of least
label and features. Without labels the score is a half. Scores read every line of each whole text;
a slice of texts is held as features, 56 bytes a line. Repeated rows each give their row, an empty
table none, and no column but doc_id and text is read, so extra columns may have any name.
"""

from __future__ import annotations

import math
from typing import Any

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import bounded_sample, map_text, remainder

MAX_FIT, FOLDS = 8_000, 5
#: Lines of a document that the fit reads; scores read them all.
MAX_FIT_LINES = 300
PREDICTED = 0.3
STEPS, RATE, PENALTY = 120, 0.1, 0.02
OWN = 14
SCHEMA = "doc_id long, held_out boolean, score double, predicted int"
NOT = {name: bytes(set(range(256)) - set(chars)) for name, chars in {"capital": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digit": b"0123456789", "symbol": b"#*$%&<>"}.items()}


def line_features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Features and lengths in bytes of the text's lines."""
    lines = text.encode("utf-8", "surrogatepass").split(b"\n")
    rows, seen_lines, seen_words = [], set(), set()
    for line in lines:
        words = line.split()
        n, size = len(words), len(line)
        some, full = max(n, 1), max(size, 1)
        kinds = set(words)
        rows.append((
            math.log1p(size), math.log1p(n), size / some / 10 if n else 0.0,
            len(line.translate(None, NOT["capital"])) / full, len(line.translate(None, NOT["digit"])) / full, len(line.translate(None, NOT["symbol"])) / full,
            line.count(b"!") / some, line.count(b"|") / some, len(kinds) / some, len(kinds & seen_words) / some,
            float(line.rstrip()[-1:] in (b".", b"?", b'"')), float(line[:1].isupper()), float(n > 0 and line in seen_lines), float(n == 0),
        ))
        seen_lines.add(line)
        seen_words |= kinds
    return np.array(rows, np.float32), np.array([len(x) for x in lines], np.int64)


def with_neighbours(x: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Own features, those of the line before and after (zero where there is none), first, last, one."""
    out = np.zeros((len(x), 3 * OWN + 3))
    out[:, :OWN] = x
    out[1:, OWN : 2 * OWN] = x[:-1]
    out[:-1, 2 * OWN : 3 * OWN] = x[1:]
    out[first, OWN : 2 * OWN] = 0
    out[last, 2 * OWN : 3 * OWN] = 0
    out[first, -3] = out[last, -2] = out[:, -1] = 1
    return out


def forward_backward(unary: np.ndarray, transition: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Marginals (line, label), expected transitions (2 x 2) and the summed log partition of
    chains laid end to end. All chains advance together, the longest first, so that those still
    running are a leading slice."""
    order = np.argsort(-sizes, kind="stable")
    begin = (np.cumsum(sizes) - sizes)[order]
    length = sizes[order]
    longest = int(length[0])
    running = np.searchsorted(-length, -np.arange(longest), side="left")  # chains longer than t
    alpha, beta = np.empty_like(unary), np.zeros_like(unary)
    for t in range(longest):
        at = begin[: running[t]] + t
        alpha[at] = unary[at] if t == 0 else unary[at] + np.logaddexp(*(alpha[at - 1][:, k, None] + transition[k] for k in (0, 1)))
    for t in range(longest - 2, -1, -1):
        at = begin[: running[t + 1]] + t
        after = unary[at + 1] + beta[at + 1]
        beta[at] = np.logaddexp(*(transition[:, k] + after[:, k, None] for k in (0, 1)))
    end = begin + length - 1
    log_z = np.logaddexp(alpha[end, 0], alpha[end, 1])
    by_line = np.empty(len(unary))
    by_line[np.repeat(begin - np.concatenate([[0], np.cumsum(length)[:-1]]), length) + np.arange(len(unary))] = np.repeat(log_z, length)
    marginal = np.exp(alpha + beta - by_line[:, None])
    inner = np.ones(len(unary), bool)
    inner[begin] = False
    i = np.flatnonzero(inner)
    both = np.exp(alpha[i - 1][:, :, None] + transition + (unary[i] + beta[i])[:, None, :] - by_line[i, None, None])
    return marginal, both.sum(axis=0), float(log_z.sum())


class Chain:
    def __init__(self, mean: np.ndarray, scale: np.ndarray, weights: np.ndarray, transition: np.ndarray) -> None:
        self.mean, self.scale, self.weights, self.transition = mean, scale, weights, transition

    def unary(self, x: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        last = np.cumsum(sizes) - 1
        good = with_neighbours((x - self.mean) / self.scale, last + 1 - sizes, last) @ self.weights
        return np.stack([np.zeros_like(good), good], axis=1)

    def score(self, texts: list[str]) -> np.ndarray:
        made = [line_features(t) for t in texts]
        if not made:
            return np.zeros(0)
        sizes = np.array([len(m[1]) for m in made])
        marginal, _, _ = forward_backward(self.unary(np.concatenate([m[0] for m in made]), sizes), self.transition, sizes)
        weight = np.concatenate([m[1] for m in made]) + 1.0
        first = np.cumsum(sizes) - sizes
        return np.clip(np.add.reduceat(marginal[:, 1] * weight, first) / np.add.reduceat(weight, first), 0.0, 1.0)


def fit(x: np.ndarray, sizes: np.ndarray, labels: np.ndarray) -> Chain:
    """Adam on the mean log-likelihood of the documents' label sequences."""
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-3
    last = np.cumsum(sizes) - 1
    full = with_neighbours((x - mean) / scale, last + 1 - sizes, last)
    y = np.repeat(labels, sizes)
    observed = np.zeros((2, 2))
    for k in (0, 1):
        observed[k, k] = (sizes[labels == k] - 1).sum()
    d = full.shape[1]
    theta, m, v = np.zeros(d + 4), np.zeros(d + 4), np.zeros(d + 4)
    for t in range(1, STEPS + 1):
        good = full @ theta[:d]
        transition = theta[d:].reshape(2, 2)
        marginal, pairs, _ = forward_backward(np.stack([np.zeros_like(good), good], axis=1), transition, sizes)
        gradient = np.concatenate([full.T @ (marginal[:, 1] - y), (pairs - observed).ravel()]) / len(sizes) + PENALTY * theta
        m, v = 0.9 * m + 0.1 * gradient, 0.99 * v + 0.01 * gradient**2
        theta -= RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return Chain(mean, scale, theta[:d], theta[d:].reshape(2, 2))


def train(docs: DataFrame, labels: DataFrame, most: int = MAX_FIT) -> Chain | None:
    fold = labels.select("doc_id", "quality").where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & (remainder(F.col("doc_id"), FOLDS) != 0))
    sample = bounded_sample(fold, "doc_id", most)  # at most `most` rows of 16 bytes: broadcast
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")

    def make() -> Any:
        return lambda columns: {"doc_id": columns["doc_id"], "quality": columns["quality"], "x": [line_features(t or "")[0][:MAX_FIT_LINES].tobytes() for t in columns["text"]]}

    # one row per id, however often it is repeated: the driver gets `most` rows of MAX_FIT_LINES * 56 bytes at most
    one = map_text(rows, "doc_id long, quality int, x binary", make).groupBy("doc_id").agg(F.min(F.struct("quality", "x")).alias("s"))
    got = one.select("doc_id", "s.*").toPandas().sort_values("doc_id", kind="stable")
    if not len(got):
        return None
    parts = [np.frombuffer(b, np.float32).reshape(-1, OWN) for b in got["x"]]
    return fit(np.concatenate(parts), np.array([len(p) for p in parts]), (got["quality"] == 1).to_numpy(np.int64))


def classify(docs: DataFrame, chain: Chain | None) -> DataFrame:
    """doc_id, held_out, score, predicted: one row per document."""

    def make() -> Any:
        def apply(columns: dict[str, list]) -> dict[str, Any]:
            texts = [t or "" for t in columns["text"]]
            score = chain.score(texts) if chain else np.full(len(texts), 0.5)
            return {"doc_id": columns["doc_id"], "held_out": columns["held_out"], "score": score, "predicted": (score >= PREDICTED).astype(int)}

        return apply

    return map_text(docs.select("doc_id", "text", (remainder(F.col("doc_id"), FOLDS) == 0).alias("held_out")), SCHEMA, make)
