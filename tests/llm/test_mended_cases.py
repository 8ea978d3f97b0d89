"""Cases that went wrong once, and edge cases that the other tests leave out."""

import os

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from loomgraph.llm import blocks, bpe, decontam, lm, pii, quality_crf, quality_gbt, queries, simhash, substring_dedup, token_rollup, url_filter
from loomgraph.llm.common import clean, materialize, shared_dir

ADDRESSES = [".".join([*["1"] * k, digits, *["1"] * (3 - k)]) for k in range(4) for digits in ("0" * 5000, "0" * 5000 + "7", "9" * 5000)]


def test_long_digit_runs():
    """Python refuses to read numbers of over 4,300 digits."""
    anchors = pii.automaton()
    for text in ADDRESSES:
        valid = "9" * 300 not in text
        assert pii.spans(text, anchors)["ip"] == ([(0, len(text))] if valid else [])


def test_long_digit_runs_in_documents_and_in_the_pipeline(spark):
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(ADDRESSES)], "doc_id long, text string, lang string, source string, n_chars long")
    assert pii.find(docs).where("n_ip = 1").count() == 8
    assert corpus_pipeline.redact_pii(spark, docs, "").where("text = '<ip>' or text like '%<ip>%'").count() == 8


@pytest.mark.parametrize(
    "text, kind, want",
    [
        ("the token: whatever is said here", "secret", []), ("account holders2 x", "account", []), ("account number 12345678", "account", ["12345678"]),
        ('"password": "abc_def!x"', "secret", ["abc_def!x"]), ("secret: understanding-of", "secret", []), ("a ghp_abcdefghij0123456789 b", "secret", ["ghp_abcdefghij0123456789"]),
        ("xghp_abcdefghij0123456789", "secret", []), ("-----BEGIN RSA PRIVATE KEY-----\nMIIabc+/=\n-----END RSA PRIVATE KEY----- x", "secret", ["-----BEGIN RSA PRIVATE KEY-----\nMIIabc+/=\n-----END RSA PRIVATE KEY-----"]),
        ("-----BEGIN CERTIFICATE-----", "secret", []), ("see http://a.example.com/~bob/x. and https://h.example/page", "login", ["bob"]), ("(https://h.example.com/users/jo?session=ab1)", "login", ["jo", "ab1"]),
        ("ssh://me@host/x", "login", ["me"]), ("http://-bad-/~bob", "login", []), ("http://a@b@c.example/", "login", ["a@b"]),
    ],
)
def test_added_kinds(text, kind, want):
    assert [text[a:b] for a, b in pii.spans(text, pii.automaton())[kind]] == want


def test_url_tokens_fold_ascii_letters_only(spark, tmp_path):
    """The Kelvin sign and a dotted capital I aren't letters of a rule's token."""
    urls = ["http://a.example/Kcasino/x", "http://a.example/İcasino/x", "http://a.example/casİno/x", "http://Knet/", "http://A.EXAMPLE/x/casino?" + "k=v&" * 20_000, "http://a.example/page=1?q=page=1", None, ""]
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)], "page_id long, url string, token string")
    pages.coalesce(1).write.parquet(str(tmp_path / "p"))
    db = duckdb.connect()
    db.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/p/*.parquet'")
    got = url_filter.judge(pages)
    want = db.execute(url_filter.oracle())
    columns = [c[0] for c in want.description]
    assert sorted(map(repr, want.fetchall())) == sorted(repr(tuple(r)) for r in got.select(columns).collect())
    assert [r.verdict for r in got.orderBy("page_id").collect()][:5] == ["block", "block", "allow", "allow", "block"]


def test_equal_patterns_are_ranked_by_verdict_length_and_name(spark):
    pages = spark.createDataFrame([(1, "http://h.example/aa/bb/")], "page_id long, url string")
    judged = lambda *p: url_filter.judge(pages, rules=url_filter.rules_frame(spark, (), p)).first()
    assert (judged(("block", "^aa^"), ("block", "^bb^")).pattern, judged(("block", "^aa^bb^"), ("allow", "^bb^")).verdict, judged(("block", "^aa^bb^"), ("block", "^bb^")).pattern) == ("^bb^", "allow", "^aa^bb^")


def test_decontamination_of_long_texts_and_hot_passages(spark):
    """A passage that all items and documents share, a text of 100,000 tokens, and clashing names."""
    shared = " ".join(f"common{i}" for i in range(60))
    items = [(i, f"{shared} own{i} " + " ".join(f"q{i}x{k}" for k in range(20)), "x") for i in range(30)]
    docs = [(i, f"d{i} {shared} e{i}", 1, "n") for i in range(40)] + [(99, "w " * 100_000 + " ".join(f"q7x{k}" for k in range(15)), 1, "n"), (100, "v " * 1000, 1, "n")]
    table = spark.createDataFrame(docs, "doc_id long, text string, mask int, near string")
    benchmark = spark.createDataFrame(items, "item_id long, text string, back string")
    got = {(r.doc_id, r.item_id) for r in decontam.contaminated(table, benchmark).collect()}
    assert got == {(d, i) for d in range(40) for i in range(30)} | {(99, 7)}
    left = decontam.drop_contaminated(table, benchmark)
    assert left.columns == table.columns and [r.doc_id for r in left.collect()] == [100]


def test_tokens_are_compared_as_strings(spark):
    """A comparison of tokens whose hashes agree (both texts hash to 0 in 32 bits only by chance) finds a difference."""
    met = spark.createDataFrame([(0, 1, 0, ["a"] * 13, 13, 0, ["a"] * 9 + ["b"] * 4), (0, 1, 0, ["a"] * 13, 13, 0, ["a"] * 10 + ["b"] * 3)], "mask int, h long, lead int, near array<string>, width int, back int, item array<string>")
    assert [r.matched for r in decontam.verified(met).collect()] == [10]


def test_fits_take_one_row_of_an_id(spark):
    """Rows that repeat a labelled id don't multiply what the driver gets, and the fit doesn't depend on their order."""
    rows = [(i, f"good words here {i}. " * 20 if i % 2 else "#$% 99 | !! " * 30) for i in range(1, 60)]
    labels = spark.createDataFrame([(i, i % 2, 0) for i, _ in rows], "doc_id long, quality int, toxic int")
    one, many = (spark.createDataFrame(r, "doc_id long, text string") for r in (rows, rows[::-1] * 5))
    a, b = (quality_gbt.train(d, labels) for d in (one, many))
    assert (a.leaf == b.leaf).all() and (a.threshold == b.threshold).all()
    a, b = (quality_crf.train(d, labels) for d in (one, many))
    assert (a.weights == b.weights).all()


def test_pipeline_over_edge_cases(spark, docs, tmp_path):
    """Nulls in all columns, empty and very long texts, repeated rows, clashing extra columns, and no rows."""
    labels, benchmark = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("labels", "benchmark"))
    for name, table in (("full", docs.unionByName(spark.createDataFrame([(None,) * 8], docs.schema))), ("empty", docs.where("false"))):
        table.write.parquet(str(tmp_path / name / "documents.parquet"))
        labels.write.parquet(str(tmp_path / name / "labels.parquet"))
        benchmark.write.parquet(str(tmp_path / name / "benchmark.parquet"))
        out = corpus_pipeline.run(spark, str(tmp_path / name))
        assert out.columns == ["doc_id", "n_tokens", "ids", "decoded_sha256"]
        assert (out.count() > 0) == (name == "full")
        assert out.groupBy("doc_id").count().where("count > 1").count() == 0


def test_a_shared_folder_is_needed_on_a_cluster():
    class Fake:
        class conf:  # noqa: N801
            get = staticmethod(lambda key, default: None)

        class sparkContext:  # noqa: N801
            master = "spark://h:7077"

    with pytest.raises(ValueError, match="share"):
        shared_dir(Fake, "x")


def test_the_shared_folder_can_be_cleaned(spark):
    import pathlib

    kept = materialize(spark.range(3).toDF("n"), "kept")
    folder = pathlib.Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://")) / f"loomgraph-{spark.sparkContext.applicationId}"
    assert kept.count() == 3 and any(folder.iterdir())
    clean(spark)
    assert not folder.exists()


def test_clashing_names_and_empty_tables(spark, docs, none):
    path = f"{queries.TOKENIZERS}/{queries.BPE_FILE}"
    odd = docs.withColumns({"held_out": docs.bits, "n_tokens": docs.bits, "ids": docs.bits, "x": docs.bits, "kept": docs.bits, "op": docs.bits, "version": docs.bits})
    for f in (lambda d: bpe.digests(d, path), lambda d: pii.find(d), lambda d: quality_crf.classify(d, None), lambda d: quality_gbt.judge(d, None), lambda d: substring_dedup.remove_duplicates(d)):
        assert f(odd).count() == docs.count() and f(none).count() == 0
    for f in (simhash.keep_one, pii.redact, lambda d: quality_gbt.keep(d, None)):
        assert f(odd).columns == odd.columns and f(none).count() == 0 and f(none).columns == none.columns
    assert bpe.encode(odd, path).count() == docs.count() and bpe.decode(bpe.encode(none, path), path).count() == 0
    assert simhash.near_duplicates(odd).count() == docs.count() and lm.score(odd).count() == docs.count()
    assert token_rollup.documents_history(odd, spark.createDataFrame([], "doc_id long, quality int, toxic int")).count() > 0
    assert os.path.exists(path)


def test_tree_of_nodes_adds_up_like_one_node(spark, docs):
    """Several levels of nodes give the same counts; equal rows and many short texts make many blocks."""
    rows = spark.createDataFrame([(i, t) for i, t in [(5, "same row every time")] * 300 + [(k, f"w{k % 7} w{k % 5}") for k in range(300)]], "doc_id long, text string")
    for table in (rows, docs.select("doc_id", "text")):
        one = sorted(map(repr, lm.score(table).collect()))
        many = lm.score(table, block_bytes=6000, fanout=3).collect()
        assert len(blocks.levels(blocks.count_blocks(table, 6000), 3)) > 2
        assert [r.split("base")[0] for r in sorted(map(repr, many))] == [r.split("base")[0] for r in one]
        assert abs(sum(r.score for r in many) - sum(r.score for r in lm.score(table).collect())) < 1e-6
    dealt = blocks.into_blocks(rows, 20).groupBy("block").count().collect()
    assert len(dealt) == 20 and max(r["count"] for r in dealt) < 100
    assert blocks.count_blocks(rows.withColumn("text", lm_empty()), 6000) == 20


def lm_empty():
    from pyspark.sql import functions as F

    return F.lit("")


def test_automaton_carries_its_state_and_fails_to_the_empty_history():
    """Against a walk arc by arc over dictionaries."""
    rng = np.random.default_rng(3)
    count = np.array([5.0, 3.0, 0.0, 2.0, 4.0])
    pairs = {(s, w): float(rng.integers(0, 3)) for s in (*range(1, 6), 6) for w in range(5) if count[w] and (s == 6 or count[s - 1])}
    state, word = (np.array(x) for x in zip(*pairs))
    model = lm.automaton(count, 3, (state, word, np.array(list(pairs.values()))), 14, 4, 10.0)
    sizes = np.array([4, 1, 7, 3])
    tokens = rng.integers(0, 5, sizes.sum())
    p = lambda w: (count[w] + 1) / 19
    want, at = [], 0
    for n in sizes:
        total, state = 0.0, 6
        for w in tokens[at : at + n]:
            seen = [0.0, *count, 3.0][state]
            if pairs.get((state, w), 0) > 0:
                total += np.log10((pairs[state, w] + 10 * p(w)) / (seen + 10))
            else:
                total += np.log10(p(w)) + (np.log10(10 / (seen + 10)) if state else 0)
            state = w + 1 if count[w] else 0
        want.append(total)
        at += n
    assert np.allclose(model.traverse(tokens, sizes, 6), want)
