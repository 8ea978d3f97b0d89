r"""SimHash near-duplicates through vantage-point trees.

Fingerprints: the text's A-Z are lower-cased, words are `[^\x20\x09-\x0D]+`, shingles three words
joined by spaces (fewer words: all of them; none, or a null text: fingerprint zero). A bit is set
if it is set in over half the shingles' XXH64 (seed 42). Fingerprints link at RADIUS or fewer
differing bits; documents of one fingerprint link to each other.

Pairs are sought among distinct fingerprints. Of up to three differing bits one half of the
fingerprint holds one at most, so there is a tree for each half, searched with radius one. A level
of a tree splits by the Hamming distance between one block of the half's bits and the vantage
point's. Blocks are disjoint, so the triangle bounds of the levels add up: a query may stray from
its own distances by one, at one level. A leaf is a shard; a fingerprint lives in its own and also
visits those within the bound that come after it, so each pair meets exactly once per tree, and
the second tree leaves out pairs that the first one finds. Blocks get smaller as there are more
fingerprints. A shard above CELL fingerprints is cut into parts that meet pairwise. Inside a cell
all meetings are compared.

Components come from stars of the least fingerprint (large-star and small-star steps), each step
written to the shared folder. component_id is the least non-null doc_id. Repeated rows are
documents like others. A text of any length is hashed whole, STEP shingles at a time; an empty table
gives no rows. No column but doc_id and text is read, so extra columns may have any name (keep_one hands
them on).
"""

from __future__ import annotations

from itertools import repeat
from typing import Any

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import map_text, materialize

SHINGLE, SEED, RADIUS = 3, 42, 3
CELL = 20_000
#: Shingles of a text that are hashed at a time.
STEP = 1 << 14
#: Placed fingerprints per task of the comparison, whose time goes by cells rather than bytes.
PER_TASK = 50_000
#: The vantage point: any fixed fingerprint serves.
VANTAGE = 0x5A3C96E1B47D28F0
#: Distinct fingerprints up to which a half has so many blocks.
BLOCKS = ((2_000_000, 4), (200_000_000, 8), (1 << 62, 16))


def fingerprint(text: str | None) -> int:
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) > SHINGLE:
        ends = np.cumsum([len(w) + 1 for w in words])
        starts, ends = np.concatenate([[0], ends[:-SHINGLE]]), ends[SHINGLE - 1 :] - 1
    else:
        starts, ends = np.array([0]), np.array([len(line)])
    n = len(starts)
    counts = np.zeros(64, np.int64)
    for i in range(0, n, STEP):  # few shingles as objects at a time, however long the text
        parts = [line[a:b] for a, b in zip(starts[i : i + STEP].tolist(), ends[i : i + STEP].tolist())]
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, parts, repeat(SEED)), np.uint64, len(parts))
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * counts > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, fp (as a signed long): one row per document."""

    def make() -> Any:
        def apply(columns: dict[str, list]) -> dict[str, Any]:
            found = np.array([fingerprint(t) for t in columns["text"]], np.uint64)
            return {"doc_id": columns["doc_id"], "text_hash": columns["text_hash"], "fp": found.view(np.int64)}

        return apply

    return map_text(docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash")), "doc_id long, text_hash long, fp long", make)


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def blocks_of(n: int) -> int:
    """How many blocks a half has for n distinct fingerprints."""
    return next(b for most, b in BLOCKS if n <= most)


def placed(classes: DataFrame, n: int) -> DataFrame:
    """fp, n, tree, shard, home: every fingerprint at its own shard and at those that it visits."""
    blocks = blocks_of(n)
    bits = 32 // blocks
    rows = []
    for tree in (0, 1):
        distances = []
        for k in range(blocks):
            mask = ((1 << bits) - 1) << (32 * (1 - tree) + bits * k)
            distances.append(F.bit_count(F.col("fp").bitwiseXOR(F.lit(signed(VANTAGE))).bitwiseAND(F.lit(signed(mask)))).cast("long"))
        places = [(bits + 1) ** k for k in range(blocks)]
        own = sum((d * p for d, p in zip(distances[1:], places[1:])), distances[0])
        rows.append(F.struct(F.lit(tree).alias("tree"), own.alias("shard"), F.lit(True).alias("home")))
        rows += [F.when(d < bits, F.struct(F.lit(tree).alias("tree"), (own + p).alias("shard"), F.lit(False).alias("home"))) for d, p in zip(distances, places)]
    return classes.select("fp", "n", F.explode(F.array_compact(F.array(*rows))).alias("at")).select("fp", "n", "at.*")


def cells(rows: DataFrame, most: int = CELL) -> DataFrame:
    """Adds part, a and b: a cell is a shard's parts a and b; only crowded shards have several."""
    crowded = rows.groupBy("tree", "shard").agg(F.ceil(F.count("*") / F.lit(most)).cast("int").alias("parts")).where(F.col("parts") > 1)
    joined = rows.join(crowded, ["tree", "shard"], "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    part = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    met = joined.withColumn("part", part).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return met.select("tree", "shard", F.least("part", "other").alias("a"), F.greatest("part", "other").alias("b"), "part", "fp", "n", "home")


def compare(table: pa.Table) -> dict[str, Any]:
    """For each fingerprint of a cell with links there: how many documents they are, and the least
    fingerprint that the cell's links lead to."""
    first = lambda name: table.column(name)[0].as_py()
    tree, a, b = first("tree"), first("a"), first("b")
    fp = table.column("fp").to_numpy().view(np.uint64)
    n, home, part = (table.column(c).to_numpy() for c in ("n", "home", "part"))
    order = np.argsort(fp.view(np.int64), kind="stable")
    fp, n, home, part = fp[order], n[order], home[order], part[order]
    left = np.flatnonzero(part == a)
    right = np.flatnonzero(part == b)
    near = np.zeros(len(fp), np.int64)
    root = np.arange(len(fp))
    step = max(1, (1 << 21) // max(1, len(right)))
    for start in range(0, len(left), step):
        rows = left[start : start + step]
        differ = fp[rows, None] ^ fp[None, right]
        hit = np.bitwise_count(differ) <= RADIUS
        hit &= home[rows, None] | home[None, right]
        half = np.bitwise_count(differ >> np.uint64(32))
        hit &= half <= 1 if tree == 0 else half >= 2
        if a == b:  # each pair once
            hit &= rows[:, None] < right[None, :]
        if not hit.any():
            continue
        near[rows] += hit @ n[right]
        near[right] += n[rows] @ hit
        for i in np.flatnonzero(hit.any(axis=1)):
            group = np.append(right[hit[i]], rows[i])
            while (up := root[group]).tolist() != group.tolist():
                group = np.unique(up)
            root[group] = group.min()
    while (up := root[root]).tolist() != root.tolist():
        root = up
    linked = near > 0
    return {"fp": fp.view(np.int64)[linked], "n_near": near[linked], "root": fp.view(np.int64)[root[linked]]}


def stars(edges: DataFrame) -> DataFrame:
    """Edges (u, v) with v < u become (u, v) with v the least of u's component."""
    edges = materialize(edges.distinct(), "edges")
    both = lambda e: e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    state = lambda e: e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
    before = state(edges)
    while before[0]:
        around = both(edges)
        least = around.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = around.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = materialize(large.where("u <> v").distinct(), "large")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        edges = materialize(small.where("u <> v").distinct(), "small")
        after = state(edges)
        if after == before:
            break
        before = after
    return edges


def link(docs: DataFrame, cell: int = CELL) -> tuple[DataFrame, DataFrame]:
    """The documents' fingerprints, and per fingerprint: fp, n, n_near (of other fingerprints), component."""
    prints = materialize(fingerprints(docs), "prints")
    classes = materialize(prints.groupBy("fp").agg(F.count("*").alias("n"), F.min("doc_id").alias("least")), "classes")
    n = classes.count()
    rows = cells(placed(classes, n), cell)
    tasks = max(1, 2 * (1 + blocks_of(n)) * n // PER_TASK)

    def run(table: pa.Table) -> pa.Table:
        return pa.table(compare(table))

    found = materialize(rows.repartition(tasks, "tree", "shard", "a", "b").groupBy("tree", "shard", "a", "b").applyInArrow(run, "fp long, n_near long, root long"), "links")
    roots = stars(found.where("root < fp").select(F.col("fp").alias("u"), F.col("root").alias("v")))
    near = found.groupBy("fp").agg(F.sum("n_near").alias("n_near"))
    linked = classes.join(near, "fp", "left").join(roots.select(F.col("u").alias("fp"), F.col("v").alias("component")), "fp", "left")
    return prints, linked.select("fp", "n", "least", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.coalesce("component", "fp").alias("component"))


def near_duplicates(docs: DataFrame, cell: int = CELL) -> DataFrame:
    """doc_id, fingerprint, n_near, component_id: one row per document."""
    prints, classes = link(docs, cell)
    ids = classes.groupBy("component").agg(F.min("least").alias("component_id"))
    named = classes.join(ids, "component").select("fp", (F.col("n") - 1 + F.col("n_near")).alias("n_near"), "component_id")
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return prints.join(named, "fp").select("doc_id", hexed.alias("fingerprint"), "n_near", "component_id")


def keep_one(docs: DataFrame, cell: int = CELL) -> DataFrame:
    """The rows of docs that stay: of each component the one of least doc_id (null ids come last)."""
    prints, classes = link(docs, cell)
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash")
    # partial minima per fingerprint first, so that a large component is no large group
    best = prints.groupBy("fp").agg(F.min(order).alias("best")).join(classes.select("fp", "component"), "fp").groupBy("component").agg(F.min("best").alias("best"))
    stay = materialize(best.select(F.col("best.doc_id").alias("_id"), F.col("best.text_hash").alias("_hash")).distinct(), "stay")
    kept = docs.join(stay, docs["doc_id"].eqNullSafe(stay["_id"]) & (F.xxhash64(docs["text"]) == stay["_hash"]), "left_semi")
    n, ids = prints.agg(F.count("*"), F.count_distinct("doc_id")).first()
    # repeated rows are left only where ids repeat
    return kept.dropDuplicates(["doc_id", "text"]) if n > ids else kept


