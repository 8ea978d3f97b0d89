r"""Language-model scoring with a weighted backoff automaton.

Tokens are the words `[^\x20\x09-\x0D]+` of the lower-cased (A-Z) text and one end token; a null
text is empty. States are the empty history and every one-word history seen in training. From
state u an arc on word w exists for each trained pair, with log10 of
(c(u w) + MU * p(w)) / (c(u) + MU); it leads to the state of w. The failure arc, taken for any other
word, costs log10(MU / (c(u) + MU)) and leads to the empty history, whose arc on w costs log10 p(w), with
p(w) = (c(w) + 1) / (N + V + 1), and leads to the state of w, or back to the empty history if w was never
seen in training. The weights of a state's words sum to one.

Counts cover every n-gram of every training document (crc32 of the id modulo HOLD_OUT isn't HELD; a
null id counts as remainder 0). They aren't gathered in one table: blocks of documents send their
n-grams' keys with their own training counts and get the totals over all blocks back (see blocks), so
neither a frequent word nor the vocabulary has to fit anywhere. From its totals a block builds the part
of the automaton that its own texts can reach, and traverses it once from left to right, all its texts
side by side, each with the state that it carries. Keys have 64 bits.

Each text is scored whole: a very long one is a block of its own, or most of one. An empty text is the end
token alone; repeated rows count in training as often as they occur and each give their row; an empty
table gives none. No column but doc_id and text is read, so extra columns may have any name.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from loomgraph.llm.blocks import BLOCK_BYTES, FANOUT, Totals, count_blocks, entries, exchange, hash_words, into_blocks, mix, texts_of

HOLD_OUT, HELD = 7, 2
#: Of 30 to 4000 the best for training documents (remainder 3) with the model of the others (remainders
#: 0, 1, 4, 5, 6) at 2.8 million tokens; no document that is held out was looked at.
MU = 300.0
END = np.uint64(xxhash.xxh64_intdigest(b"", 1))
BEGIN = np.uint64(xxhash.xxh64_intdigest(b"", 2))
SCHEMA = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def tokens_of(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a block: word fingerprints, those of the pairs that end in them, the documents' token counts, and which are held out."""
    hashes = []
    for text in texts_of(table):
        h = hash_words((text or "").encode().lower().split())
        hashes.append(np.append(h, END))
    sizes = np.array([len(h) for h in hashes], np.int64)
    words = np.concatenate([*hashes, np.zeros(0, np.uint64)])
    del hashes
    before = np.empty_like(words)
    before[1:] = words[:-1]
    before[np.cumsum(sizes) - sizes] = BEGIN
    before *= np.uint64(0x9E3779B97F4A7C15)
    before += words
    held = np.array([zlib.crc32(b"" if i is None else str(i).encode()) % HOLD_OUT == HELD for i in table.column("doc_id").to_pylist()], bool)
    return words, mix(before), sizes, held


class Automaton:
    """States are numbered: zero is the empty history, 1 + i that of word i. Arcs are sorted by state and word."""

    def __init__(self, word: np.ndarray, state: np.ndarray, arcs: np.ndarray, arc: np.ndarray, failure: np.ndarray) -> None:
        self.word, self.state = word, state  # of the empty history's arcs: weight and target, by word
        self.arcs, self.arc = arcs, arc  # state << 32 | word, and weight
        self.failure = failure  # weight of each state's failure arc; all lead to the empty history

    def traverse(self, tokens: np.ndarray, sizes: np.ndarray, start: int) -> np.ndarray:
        """The texts' summed weights. The texts lie end to end in tokens and advance together, the longest
        first, so that those still running are a leading slice."""
        order = np.argsort(-sizes, kind="stable")
        begin, length = (np.cumsum(sizes) - sizes)[order], sizes[order]
        running = np.searchsorted(-length, -np.arange(int(length[0])), side="left")
        state, total = np.full(len(sizes), start, np.int64), np.zeros(len(sizes))
        for t, k in enumerate(running):
            word = tokens[begin[:k] + t]
            key = state[:k] << 32 | word
            at = np.searchsorted(self.arcs, key)
            at[at == len(self.arcs)] = 0
            found = self.arcs[at] == key
            fails = ~found & (state[:k] > 0)
            total[:k] += np.where(found, self.arc[at], self.word[word])
            total[:k][fails] += self.failure[state[:k][fails]]
            state[:k] = self.state[word]
        out = np.empty(len(sizes))
        out[order] = total
        return out


def automaton(count: np.ndarray, texts: int, pairs: tuple[np.ndarray, np.ndarray, np.ndarray], tokens: int, kinds: int, mu: float) -> Automaton:
    """From words' training counts and pairs (state before, word, training count); the last state is
    that before a text's first word, seen `texts` times."""
    p = (count + 1) / (tokens + kinds + 1)
    seen = np.concatenate([[0.0], count, [texts]])  # how often training left each state
    state, word, times = (x[pairs[2] > 0] for x in pairs)
    keys = state.astype(np.int64) << 32 | word
    order = np.argsort(keys)
    arc = np.log10((times + mu * p[word]) / (seen[state] + mu))
    # an arc that is never asked for keeps the search simple where a block has no trained pair
    return Automaton(np.log10(p), np.where(count > 0, np.arange(len(count)) + 1, 0), np.append(keys[order], 1 << 62), np.append(arc[order], 0.0), np.log10(mu / (seen + mu)))


def score(docs: DataFrame, mu: float = MU, block_bytes: int = BLOCK_BYTES, fanout: int = FANOUT) -> DataFrame:
    """One row per document."""
    n = count_blocks(docs, block_bytes)

    def send(table: pa.Table) -> tuple[int, list[tuple[np.ndarray, np.ndarray]]]:
        words, pairs, sizes, held = tokens_of(table)
        train, made = np.repeat(~held, sizes), []
        for hashes in (words, pairs):
            values, place = entries(hashes)
            made.append((values, np.bincount(place, train, len(values)).astype(np.uint64)))
        return int((~held).sum()), made

    def finish(docs: pa.Table, got: Totals) -> dict[str, object]:
        words, pairs, sizes, held = tokens_of(docs)
        count, pair = (c.astype(np.float64) for c in got.counts)
        word, place = entries(words)[1].astype(np.int64), entries(pairs)[1]
        del words, pairs
        first = np.cumsum(sizes) - sizes
        begin = len(count) + 1
        before = np.empty_like(word)
        before[1:] = word[:-1] + 1
        before[first] = begin
        one = np.empty(len(pair), np.int64)  # some token that ends each distinct pair
        one[place] = np.arange(len(place))
        model = automaton(count, got.texts, (before[one], word[one], pair), got.tokens, got.kinds, mu)
        by_text = lambda x: np.add.reduceat(x, first)
        return {
            "doc_id": docs.column("doc_id"), "held_out": held, "n_tokens": sizes, "n_known": by_text((count > 0).astype(np.int64)[word]), "train_tokens": np.full(len(sizes), got.tokens),
            "base_score": by_text(model.word[word]), "score": model.traverse(word, sizes, begin),
        }

    return exchange(into_blocks(docs, n), n, send, finish, SCHEMA, fanout)
