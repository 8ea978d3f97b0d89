"""Blocks of documents that add up counts of 64-bit keys through a tree of nodes.

A block is a set of documents of about BLOCK_BYTES of text. Rows are dealt to blocks by their place in
the input, so equal rows spread like others, and a row counts ROW_BYTES besides its text, so that many
short texts make many blocks. A block sorts its distinct keys and sends each of `parts` equal ranges
of the key space, packed, to a node that serves this range for FANOUT blocks at most. A node adds up
the counts of equal keys and, unless it serves all blocks, passes the sums on in the same way, as if
it were a block, to the next level; there ranges are narrower and more blocks are served. The last
level knows the totals; answers go back the way that keys came, one value per key sent, in order. So a
block or node sends FANOUT rows at most whatever the number of blocks, the levels grow with its
logarithm, and a key, however hot, is one entry per child. A block derives the same sorted keys anew
when it reads the answers: neither positions nor document ids travel, and repeated rows or null ids
need no care. Texts are shuffled once: both reads of a block are the same exchange.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK_BYTES = 16 << 20
ROW_BYTES = 200
FANOUT = 256
M1, M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)


def mix(x: np.ndarray) -> np.ndarray:
    """The finishing step of a 64-bit hash, in place."""
    for m in (M1, M2):
        x ^= x >> np.uint64(33)
        x *= m
    x ^= x >> np.uint64(33)
    return x


def hash_words(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def count_blocks(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> int:
    total = docs.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + F.lit(ROW_BYTES).cast("long"))).first()[0] or 0
    return max(1, -(-total // block_bytes))


def into_blocks(docs: DataFrame, n: int) -> DataFrame:
    """doc_id, text, block: a partition for each block. docs should be read from storage, where a row's
    place is the same whenever a task is repeated."""
    return docs.select("doc_id", "text", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(n)).cast("int").alias("block")).repartitionById(n, F.col("block"))


def pack(values: np.ndarray) -> bytes:
    """Unsigned integers as byte planes, without the high planes that are zero throughout."""
    values = np.ascontiguousarray(values, "<u8")
    width = max(1, (int(values.max()).bit_length() + 7) // 8) if len(values) else 1
    return bytes([width]) + np.ascontiguousarray(values.view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def unpack(data: bytes) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8, offset=1).reshape(data[0], -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, : data[0]] = planes.T
    return out.view("<u8").ravel()


def pack_sorted(values: np.ndarray) -> bytes:
    """Ascending values as their differences; the first one is kept apart."""
    if not len(values):
        return b""
    return int(values[0]).to_bytes(8, "little") + pack(np.diff(values))


def unpack_sorted(data: bytes) -> np.ndarray:
    if not data:
        return np.zeros(0, np.uint64)
    steps = unpack(data[8:])
    return np.cumsum(np.concatenate([np.frombuffer(data, "<u8", 1), steps]), dtype=np.uint64)


def cuts(values: np.ndarray, buckets: int, path: int = 0, paths: int = 1) -> np.ndarray:
    """Where each bucket's slice of ascending values begins, and the last one's end. The buckets are
    equal parts of range `path` of `paths`."""
    bounds = np.array([((path * buckets + b) << 64) // (paths * buckets) for b in range(1, buckets)], np.uint64)
    return np.concatenate([[0], np.searchsorted(values, bounds), [len(values)]]).astype(np.int64)


def texts_of(table: pa.Table, limit: int = 1 << 20) -> Iterator[str | None]:
    """The texts of a block, few of them as objects at a time."""
    from loomgraph.llm.common import steps

    for batch in table.select(["text"]).to_batches():
        for part in steps(batch, "text", limit):
            yield from part.column(0).to_pylist()


class Level(NamedTuple):
    group: int  # children that a node serves
    parts: int  # ranges that a child sends to
    paths: int  # ranges of a child's own level
    nodes: int  # nodes of the level


def levels(n: int, fanout: int = FANOUT) -> list[Level]:
    """From the blocks upwards. All nodes of the last level serve all blocks."""
    depth = 1
    while fanout**depth < n:
        depth += 1
    group = next(g for g in range(1, n + 1) if g**depth >= n)
    parts = [group] * (depth - 1) + [max(1, group // 2)]
    return [Level(group, p, math.prod(parts[:i]), -(-n // group ** (i + 1)) * math.prod(parts[: i + 1])) for i, p in enumerate(parts)]


def entries(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct hashes, ascending, and for each hash its place among them."""
    order = np.argsort(hashes)  # the order of equal ones doesn't matter
    values = hashes[order]
    new = np.ones(len(values), bool)
    new[1:] = values[1:] != values[:-1]
    place = np.empty(len(values), np.int32)
    place[order] = np.cumsum(new) - 1
    return values[new], place


#: What a child (a block, or a node by its group and path) sends to a node: packed keys and counts of
#: each kind, and how many texts it stands for; and what it gets back.
SENT = pa.schema({"node": pa.int32(), "to_group": pa.int64(), "to_path": pa.int64(), "child": pa.int32(), "group": pa.int64(), "path": pa.int64(), "texts": pa.int64(), **{f"{k}_{x}": pa.binary() for k in ("word", "pair") for x in ("keys", "counts")}})
GOT = pa.schema({"child": pa.int32(), "part": pa.int64(), "texts": pa.int64(), "tokens": pa.int64(), "kinds": pa.int64(), "word_counts": pa.binary(), "pair_counts": pa.binary()})
KINDS = ("word", "pair")


def sent_rows(level: Level, group: int, path: int, texts: int, held: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[dict[str, object]]:
    at = [cuts(keys, level.parts, path, level.paths) for keys, _ in held]
    for p in range(level.parts):
        to_group, to_path = group // level.group, path * level.parts + p
        row: dict[str, object] = {"node": to_group * level.paths * level.parts + to_path, "to_group": to_group, "to_path": to_path, "child": group * level.paths + path, "group": group, "path": path, "texts": texts}
        for kind, (keys, counts), cut in zip(KINDS, held, at):
            row |= {f"{kind}_keys": pack_sorted(keys[cut[p] : cut[p + 1]]), f"{kind}_counts": pack(counts[cut[p] : cut[p + 1]])}
        yield row


class Node:
    """What a node holds of its children."""

    def __init__(self, rows: pa.Table) -> None:
        self.rows = rows
        self.texts = sum(rows.column("texts").to_pylist())
        self.path, self.group = rows.column("to_path")[0].as_py(), rows.column("to_group")[0].as_py()
        self.keys, self.places, self.sums = [], [], []
        for kind in KINDS:
            keys = [unpack_sorted(x.as_py()) for x in rows.column(f"{kind}_keys")]
            values, place = entries(np.concatenate(keys))
            total = np.zeros(len(values), np.uint64)
            np.add.at(total, place, np.concatenate([unpack(x.as_py()) for x in rows.column(f"{kind}_counts")]))
            ends = np.cumsum([len(k) for k in keys])
            self.keys.append(values), self.sums.append(total), self.places.append([place[e - len(k) : e] for k, e in zip(keys, ends)])

    def answer(self, texts: int, tokens: int, kinds: int, totals: list[np.ndarray], parts: int) -> pa.Table:
        n = self.rows.num_rows
        counts = {f"{kind}_counts": [pack(total[p]) for p in places] for kind, total, places in zip(KINDS, totals, self.places)}
        part = [self.path % parts] * n
        return pa.table({"child": self.rows.column("child"), "part": part, "texts": [texts] * n, "tokens": [tokens] * n, "kinds": [kinds] * n, **counts}, schema=GOT)


class Totals(NamedTuple):
    """A child's answers: training texts, tokens and kinds of words in its range, and its keys' counts."""

    texts: int
    tokens: int
    kinds: int
    counts: list[np.ndarray]


def read_answers(rows: pa.Table) -> Totals:
    rows = rows.sort_by("part")
    counts = [np.concatenate([unpack(x.as_py()) for x in rows.column(f"{k}_counts")]) for k in KINDS]
    return Totals(rows.column("texts")[0].as_py(), sum(rows.column("tokens").to_pylist()), sum(rows.column("kinds").to_pylist()), counts)


def add_up(sent: DataFrame, steps: list[Level]) -> DataFrame:
    """Answers to the rows that the children of a level sent. steps: that level and those above."""
    level = steps[0]
    to = sent.repartitionById(level.nodes, F.col("node")).groupBy("node")
    if len(steps) == 1:

        def last(rows: pa.Table) -> pa.Table:
            node = Node(rows)
            words = node.sums[0]
            return node.answer(node.texts, int(words.sum()), int((words > 0).sum()), node.sums, level.parts)

        return to.applyInArrow(last, ddl(GOT))
    above = steps[1]

    def merge(rows: pa.Table) -> pa.Table:
        node = Node(rows)
        return pa.Table.from_pylist(list(sent_rows(above, node.group, node.path, node.texts, list(zip(node.keys, node.sums)))), schema=SENT)

    def respond(rows: pa.Table, answers: pa.Table) -> pa.Table:
        got = read_answers(answers)
        return Node(rows).answer(got.texts, got.tokens, got.kinds, got.counts, level.parts)

    answers = add_up(to.applyInArrow(merge, ddl(SENT)), steps[1:])
    return to.cogroup(answers.repartitionById(level.nodes, F.col("child")).groupBy("child")).applyInArrow(respond, ddl(GOT))


def exchange(blocks: DataFrame, n: int, send: Callable[[pa.Table], tuple[int, list[tuple[np.ndarray, np.ndarray]]]], finish: Callable[[pa.Table, Totals], dict[str, object]], out: str, fanout: int = FANOUT) -> DataFrame:
    """`send` gives a block's number of texts and, for each kind, its ascending distinct keys with their
    counts; `finish` a block's result from its documents and the totals of the keys that it sent."""
    steps, schema = levels(n, fanout), arrow(out)

    def first(table: pa.Table) -> pa.Table:
        texts, held = send(table)
        return pa.Table.from_pylist(list(sent_rows(steps[0], table.column("block")[0].as_py(), 0, texts, held)), schema=SENT)

    def third(docs: pa.Table, answers: pa.Table) -> pa.Table:
        return pa.table(finish(docs, read_answers(answers)), schema=schema)

    answers = add_up(blocks.groupBy("block").applyInArrow(first, ddl(SENT)), steps)
    return blocks.groupBy("block").cogroup(answers.repartitionById(n, F.col("child")).groupBy("child")).applyInArrow(third, out)


DDL = {pa.int32(): "int", pa.int64(): "long", pa.binary(): "binary"}


def ddl(schema: pa.Schema) -> str:
    return ", ".join(f"{f.name} {DDL[f.type]}" for f in schema)


def arrow(schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    return to_arrow_schema(_parse_datatype_string(schema))
