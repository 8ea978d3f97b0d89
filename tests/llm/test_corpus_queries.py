import os

import duckdb
import pytest

import __spark_entry__
import corpus_pipeline
from loomgraph.llm import bpe, decontam, pii, quality_gbt, queries, simhash

SMALL = "/root/testdata/sf0.001"


def rows_of(frame, columns):
    return sorted(repr([None if v is None or v != v else float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else v for v in r]) for r in frame[columns].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_its_sql(spark, name):
    got = queries.queries()[name](spark, SMALL).toPandas()
    db = duckdb.connect()
    for f in os.listdir(SMALL):
        db.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SMALL}/{f}'")
    want = db.execute(queries.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows_of(got, sorted(got.columns)) == rows_of(want, sorted(got.columns))


def test_all_ten_are_registered():
    found = __spark_entry__.queries()
    assert [sum(n.startswith(f"op{i}_") for n in found) for i in range(1, 11)] == [1] * 10 and "pipeline" in found


def test_pipeline_against_its_parts(spark):
    """The stages on whole tables equal the operators' own decisions, made one after another on the driver."""
    got = {r.doc_id: r.ids for r in corpus_pipeline.run(spark, SMALL).collect()}
    docs, labels, benchmark = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "labels", "benchmark"))
    judged = {r.doc_id for r in quality_gbt.judge(docs, quality_gbt.train(docs, labels)).collect() if r.kept}
    good = [(r.doc_id, r.text) for r in docs.collect() if r.doc_id in judged]
    prints = [simhash.fingerprint(t) for _, t in good]
    group = list(range(len(good)))
    for _ in good:
        group = [min([group[j] for j in range(len(good)) if (prints[i] ^ prints[j]).bit_count() <= 3]) for i in range(len(good))]
    first = {}
    for (i, t), g in zip(good, group):
        first[g] = min(first.get(g, (i, t)), (i, t))
    left = dict(first.values())
    leaked = {r.doc_id for r in decontam.contaminated(docs, benchmark).collect()}
    tokenizer, anchors = bpe.load(f"{queries.TOKENIZERS}/{queries.BPE_FILE}"), pii.automaton()
    want = {i: tokenizer.encode_batch([pii.redacted(t, pii.spans(t, anchors))])[0] for i, t in left.items() if i not in leaked}
    assert got == want and 0 < len(want) < docs.count()


def test_stages_keep_the_columns(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SMALL)
        assert docs.columns == corpus_pipeline.COLUMNS
