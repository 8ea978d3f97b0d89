"""Byte-level BPE encoding and decoding.

Each pre-token becomes a doubly linked list of symbols. A priority queue holds the ranks of the
adjacent pairs; the least rank (ties: the leftmost) is merged first, and an entry is skipped as
stale when the symbols at its place are no longer the pair it was made for. Decoding concatenates
the vocabulary's byte strings. A null text encodes as the empty one; a special token's string in
the text becomes its id, as the tokenizers library has it by default. The short pre-tokens that a
slice of texts brings anew are merged in step, each with its own list and queue, held as rows of
arrays; long ones one by one with a heap. Results of pre-tokens are kept in a table of bounded
size per worker; it only saves time. encode() keeps them as packed integers and takes smaller slices
than digests(), which needs no ids. Texts of any length are encoded whole, one slice of them at a time;
repeated rows each give their row, an empty table none. No column but doc_id and text (ids, to decode) is
read, so extra columns may have any name.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from array import array
from functools import lru_cache
from typing import Any

import numpy as np
import regex
from pyspark.sql import DataFrame

from loomgraph.llm.common import map_text

PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Pre-tokens whose encoding a worker keeps, at least those of one slice.
CACHE_SIZE = 400_000
#: The same, and the bytes of text in a slice, where ids are returned: two workers share an executor with its heap.
PACKED_CACHE_SIZE = 250_000
PACKED_STEP_BYTES = 1 << 20
#: Bytes of the pre-tokens that are merged in step; longer ones get a queue of their own.
WIDTH = 48
NONE = np.int32(2**31 - 1)
SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in the vocabulary's strings."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(plain)]
    return [chr(b if b in set(plain) else 256 + other.index(b)) for b in range(256)]


class Tokenizer:
    cache_size = CACHE_SIZE

    def __init__(self, path: str) -> None:
        spec = json.load(open(path, encoding="utf-8"))
        vocab: dict[str, int] = spec["model"]["vocab"]
        back = {c: b for b, c in enumerate(byte_alphabet())}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.strings = {i: bytes(back[c] for c in s) for s, i in vocab.items()}
        self.strings |= {i: s.encode() for s, i in self.special.items()}
        self.symbol = [vocab[c] for c in byte_alphabet()]
        # rank, and by rank the pair and what it becomes; a pair's key holds both ids
        self.rank: dict[int, int] = {}
        self.merged: list[int] = []
        self.pair: list[int] = []
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            key = vocab[a] << 20 | vocab[b]
            self.rank.setdefault(key, rank)
            self.pair.append(key)
            self.merged.append(vocab[a + b])
        self.split = regex.compile(PATTERN).findall
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")").split if self.special else lambda s: [s]
        pairs = np.array(list(self.rank), np.int64)
        order = np.argsort(pairs)
        self.sorted_pairs, self.sorted_ranks = pairs[order], np.array(list(self.rank.values()), np.int32)[order]
        self.forget()

    def merge(self, piece: bytes) -> list[int]:
        symbols = [self.symbol[b] for b in piece]
        n = len(symbols)
        rank, pair, merged = self.rank.get, self.pair, self.merged
        queue = [r << 32 | i for i in range(n - 1) if (r := rank(symbols[i] << 20 | symbols[i + 1])) is not None]
        if not queue:
            return symbols
        heapq.heapify(queue)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while queue:
            top = heapq.heappop(queue)
            r, i = top >> 32, top & 0xFFFFFFFF
            j = after[i]
            if j >= n or symbols[i] << 20 | symbols[j] != pair[r]:
                continue  # stale
            symbols[i], symbols[j] = merged[r], -1 << 50
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (r := rank(symbols[i] << 20 | symbols[k])) is not None:
                    heapq.heappush(queue, r << 32 | i)
            h = before[i]
            if h >= 0 and (r := rank(symbols[h] << 20 | symbols[i])) is not None:
                heapq.heappush(queue, r << 32 | h)
        return [s for s in symbols if s >= 0]

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs; NONE for a pair that isn't merged."""
        keys = left.astype(np.int64) << 20 | right
        at = np.minimum(np.searchsorted(self.sorted_pairs, keys), len(self.sorted_pairs) - 1)
        return np.where(self.sorted_pairs[at] == keys, self.sorted_ranks[at], NONE)

    def merge_all(self, pieces: list[bytes], width: int) -> list[list[int]]:
        """merge() for many short pieces in step: row p of `rank` is the queue of piece p, and each
        round pops the least rank (ties: leftmost) of every row. Entries are overwritten in place
        when a merge changes their pair, which is where the single queue skips stale ones."""
        n = len(pieces)
        sizes = np.fromiter(map(len, pieces), np.int64, n)
        raw = np.frombuffer(b"".join([p.ljust(width, b"\0") for p in pieces]), np.uint8).reshape(n, width)
        at = np.arange(width)
        inside = at < sizes[:, None]
        symbol = np.where(inside, np.array(self.symbol, np.int32)[raw], -1).astype(np.int32)
        rank = np.full((n, width), NONE, np.int32)
        rank[:, :-1] = np.where(inside[:, 1:], self.ranks(symbol[:, :-1].ravel(), symbol[:, 1:].ravel()).reshape(n, width - 1), NONE)
        after, before = (np.broadcast_to(at + d, (n, width)).astype(np.int32).ravel() for d in (1, -1))
        flat_symbol, flat_rank = symbol.ravel(), rank.ravel()
        merged = np.array(self.merged, np.int32)
        rows = np.flatnonzero(sizes > 1)
        while len(rows):
            queue = rank[rows]
            j = queue.argmin(axis=1)
            r = queue[np.arange(len(rows)), j]
            left = r < NONE
            rows, j, r = rows[left], j[left], r[left]
            base = rows * width
            i = base + j
            k = base + after[i]
            became = merged[r]
            flat_symbol[i], flat_symbol[k], flat_rank[k] = became, -1, NONE
            m = after[k]
            after[i] = m
            some = m < sizes[rows]
            flat_rank[i] = NONE
            i_next = (base + m)[some]
            before[i_next] = j[some]
            flat_rank[i[some]] = self.ranks(became[some], flat_symbol[i_next])
            h = before[i]
            some = h >= 0
            i_before = (base + h)[some]
            flat_rank[i_before] = self.ranks(flat_symbol[i_before], became[some])
        kept = symbol >= 0
        ids, ends = symbol[kept].tolist(), np.cumsum(kept.sum(axis=1)).tolist()
        return [ids[a:b] for a, b in zip([0, *ends], ends)]

    def learn(self, texts: set[str]) -> None:
        """Encodes pre-tokens: keeps the ids as decimals and the bytes that they decode to."""
        raw = [(t, t.encode()) for t in texts]
        short = [x for x in raw if len(x[1]) <= WIDTH]
        found = [(t, self.merge(b)) for t, b in raw if len(b) > WIDTH]
        for low in range(0, WIDTH, WIDTH // 4):  # narrow rows for short pieces
            part = [x for x in short if low < len(x[1]) <= low + WIDTH // 4]
            for start in range(0, len(part), 50_000):
                block = part[start : start + 50_000]
                found += zip([t for t, _ in block], self.merge_all([b for _, b in block], low + WIDTH // 4))
        self.keep(found)

    def keep(self, found: list[tuple[str, list[int]]]) -> None:
        strings = self.strings
        for text, ids in found:
            self.ids[text] = ",".join(map(str, ids))
            self.bytes[text] = b"".join([strings[i] for i in ids])

    def pieces(self, texts: list[str]) -> list[list[str]]:
        """The pre-tokens of each text, all of them encoded in self.ids and self.bytes."""
        split, special = self.split, self.special
        out = [split(t) if not any(s in t for s in special) else [p for part in self.cut(t) for p in ([part] if part in special else split(part))] for t in texts]
        new = set().union(*out) - self.ids.keys()
        if len(self.ids) + len(new) > self.cache_size:
            self.forget()
            new = set().union(*out) - self.ids.keys()
        self.learn(new)
        return out

    def forget(self) -> None:
        self.ids = {s: str(i) for s, i in self.special.items()}
        self.bytes = {s: s.encode() for s in self.special}

    def encode_batch(self, texts: list[str]) -> list[list[int]]:
        return [[int(i) for p in parts for i in self.ids[p].split(",")] for parts in self.pieces(texts)]

    def decode(self, ids: list[int]) -> str:
        return b"".join([self.strings[i] for i in ids]).decode("utf-8", "replace")


class PackedTokenizer(Tokenizer):
    """Keeps a pre-token's ids as 32-bit integers, without what they decode to, and fewer of them:
    a worker that returns ids takes a fraction of the memory that lists of Python's integers take."""

    cache_size = PACKED_CACHE_SIZE

    def keep(self, found: list[tuple[str, list[int]]]) -> None:
        self.ids.update((text, array("i", ids).tobytes()) for text, ids in found)

    def forget(self) -> None:
        self.ids = {s: array("i", [i]).tobytes() for s, i in self.special.items()}

    def encode_batch(self, texts: list[str]) -> list[np.ndarray]:
        return [np.frombuffer(b"".join(map(self.ids.__getitem__, parts)), np.int32) for parts in self.pieces(texts)]


@lru_cache(maxsize=2)
def load(path: str) -> Tokenizer:
    return Tokenizer(path)


@lru_cache(maxsize=1)
def load_packed(path: str) -> PackedTokenizer:
    return PackedTokenizer(path)


def digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, and the digests of the ids and of the text decoded from them."""

    def make() -> Any:
        tokenizer = load(path)

        def apply(columns: dict[str, list]) -> dict[str, Any]:
            counts, ids, decoded = [], [], []
            for parts in tokenizer.pieces([t or "" for t in columns["text"]]):
                joined = ",".join(map(tokenizer.ids.__getitem__, parts))
                counts.append(joined.count(",") + 1 if joined else 0)
                ids.append(hashlib.sha256(joined.encode()).hexdigest())
                back = b"".join(map(tokenizer.bytes.__getitem__, parts)).decode("utf-8", "replace")
                decoded.append(hashlib.sha256(back.encode()).hexdigest())
            return {"doc_id": columns["doc_id"], "n_tokens": counts, "ids_sha256": ids, "decoded_sha256": decoded}

        return apply

    return map_text(docs.select("doc_id", "text"), SCHEMA, make)


def encode(docs: DataFrame, path: str, decoded: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids: the encoding itself; with decoded also decoded_sha256, the digest of the
    text decoded from the ids."""

    def make() -> Any:
        tokenizer = load_packed(path)

        def apply(columns: dict[str, list]) -> dict[str, Any]:
            ids = tokenizer.encode_batch([t or "" for t in columns["text"]])
            digests = {"decoded_sha256": [hashlib.sha256(tokenizer.decode(i.tolist()).encode()).hexdigest() for i in ids]} if decoded else {}
            return {"doc_id": columns["doc_id"], "n_tokens": list(map(len, ids)), "ids": ids} | digests

        return apply

    return map_text(docs.select("doc_id", "text"), "doc_id long, n_tokens long, ids array<int>" + (", decoded_sha256 string" if decoded else ""), make, limit=PACKED_STEP_BYTES)


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id, text: decoded from ids; null ids decode to the empty text."""

    def make() -> Any:
        tokenizer = load(path)
        return lambda columns: {"doc_id": columns["doc_id"], "text": [tokenizer.decode(i or []) for i in columns["ids"]]}

    return map_text(encoded.select("doc_id", "ids"), "doc_id long, text string", make, text=None)
