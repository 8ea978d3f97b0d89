"""Decontamination against a comparison of every position with every other, without masks."""

import random
from itertools import combinations

from loomgraph.llm import decontam

TOKENS = [f"t{i}" for i in range(40)]


def overlaps(doc, item):
    """Some 13 tokens in a row of both differ in 3 positions at most; items have 13 tokens at least."""
    return any(sum(doc[p + k] != item[q + k] for k in range(13)) <= 3 for p in range(len(doc) - 12) for q in range(len(item) - 12))


def test_every_overlap_within_tolerance_is_found(spark):
    """All patterns of up to 4 substitutions in 13 tokens and of 3 in 15, and random ones in longer items."""
    made = random.Random(5)
    items = {0: TOKENS[:13], 1: TOKENS[20:35], 2: [made.choice("abcdefgh") for _ in range(30)]}
    patterns = [(0, c) for n in range(5) for c in combinations(range(13), n)] + [(1, c) for c in combinations(range(15), 3)]
    patterns += [(2, [k for k in range(30) if made.random() < made.choice((0.1, 0.2, 0.3))]) for _ in range(200)]
    docs = {}
    for i, (item, changed) in enumerate(patterns):
        around = [f"n{i}w{k}" for k in range(9)]
        docs[i] = [*around, *[f"s{i}w{k}" if k in changed else w for k, w in enumerate(items[item])], *around]
    table = spark.createDataFrame([(i, " ".join(t)) for i, t in docs.items()], "doc_id long, text string")
    benchmark = spark.createDataFrame([(i, " ".join(t)) for i, t in items.items()], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontam.contaminated(table, benchmark).collect()}
    want = {(d, i) for d, doc in docs.items() for i, item in items.items() if overlaps(doc, item)}
    assert got == want and 0 < len(want) < len(docs)


def test_null_item_ids_are_one_item(spark):
    text = " ".join(TOKENS[:20])
    docs = spark.createDataFrame([(1, text), (2, " ".join(TOKENS[20:])), (None, text)], "doc_id long, text string")
    benchmark = spark.createDataFrame([(None, text), (None, " ".join(TOKENS[3:20])), (7, text)], "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontam.contaminated(docs, benchmark).collect()} == {(1, None), (1, 7), (None, None), (None, 7)}
    assert [r.doc_id for r in decontam.drop_contaminated(docs, benchmark.where("item_id IS NULL")).collect()] == [2]
