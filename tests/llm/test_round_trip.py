import hashlib
import random
import tracemalloc

import pyarrow as pa

import corpus_pipeline
from loomgraph.llm import bpe, common, queries


def test_last_stage_decodes_its_ids(spark):
    texts = ["a plain line", "", None, "é ß 日本 🙂\n\n  x", "same", "same"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.decoded_sha256 for r in corpus_pipeline.STAGES[-1][1](spark, docs, "").collect()}
    assert got == {i: hashlib.sha256((t or "").encode()).hexdigest() for i, t in enumerate(texts)}


def test_encoding_holds_little_memory(none, monkeypatch):
    """Two workers and the heap share an executor: 3 MB of words that all differ took 201 MB of Python's objects in each."""
    made = {}
    monkeypatch.setattr(bpe, "map_text", lambda docs, schema, make, **options: made.update(options, apply=make()))
    bpe.encode(none, f"{queries.TOKENIZERS}/{queries.BPE_FILE}", decoded=True)
    rng = random.Random(1)
    texts = [" ".join("".join(rng.choices("abcdefghij", k=rng.randint(3, 12))) for _ in range(400)) for _ in range(900)]
    batch = pa.record_batch({"doc_id": list(range(len(texts))), "text": texts})
    counts = []
    tracemalloc.start()
    for part in common.steps(batch, "text", made.get("limit", common.STEP_BYTES)):
        out = made["apply"]({n: part.column(n).to_pylist() for n in part.schema.names})
        counts += map(len, out["ids"])
        assert out["decoded_sha256"] == [hashlib.sha256(t.encode()).hexdigest() for t in part.column("text").to_pylist()]
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(counts) == len(texts) and most < 100e6, most
