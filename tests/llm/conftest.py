import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, block string, bits int, fp string"
#: Extra columns have names that operators use inside.
EDGES = [
    (9001, None), (9002, ""), (None, "one two"), (None, "one two"), (9003, "ONE two"), (9004, " ".join(map(str, range(35)))), (9005, "x " + " ".join(map(str, range(35)))), (9006, "w " * 50),
    (9007, "\n\n a line\n a line\n\x1c\x85 é ß 日本 🙂"), (9008, "mail a.b@c.example +1 (555) 010-9999 and 10.0.0.1, card 4111 1111 1111 1111\n" * 2), (9009, "long " * 30_000), (9008, "same id, other text"), (9010, "x" * 70_000),
]


@pytest.fixture(scope="session")
def docs(spark):
    """Some documents of the smallest table, copies among them, and the edge cases."""
    base = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("doc_id < 120")
    rows = [(r.doc_id, r.text) for r in base.collect()]
    rows += [(1000 + i, t) for i, t in rows[:10]] + EDGES
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "b", 1, "f") for i, t in rows], SCHEMA).cache()


@pytest.fixture(scope="session")
def rows(docs):
    return [(r.doc_id, r.text) for r in docs.collect()]


@pytest.fixture(scope="session")
def none(docs):
    """A table without rows."""
    return docs.where("false")
