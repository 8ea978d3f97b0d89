r"""Token counts as delta-maintained rollups.

Totals (documents, tokens) by source, language and tokenizer version are additive. A batch of
changes is reduced to signed partial sums per key: an insert adds a document and its tokens, a
delete takes them away, a revision adds the difference of the counts and no document. A batch is
committed by one rename of its written sums to `batch=<id>` in the store's folder; a batch whose id
is there already is skipped, so a retried or replayed batch counts once. Totals are the sums over
committed batches; compact() folds them into one, under the same rule, and keeps the ids that it
holds.

Change rows: op (insert, delete or revise), source, lang, version, n_tokens, and was (the former
count, for revise). Null sources or languages are keys like others; null counts are zero; unknown
ops are an error. Keys whose sums are all zero are left out. Repeated change rows count as often as
they occur; an empty batch is committed without sums, and an empty store has no totals. Sums are
written by as many tasks as they need, however many keys there are; the driver holds the batches' ids.
Texts are counted by one regular expression in one pass, so a very long one is one row of two numbers.
Nothing is read by the name of an extra column.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm.common import materialize, shared_dir

KEYS = ("source", "lang", "version")
SCHEMA = "source string, lang string, version string, n_docs long, n_tokens long"
#: Tokenizer versions: what each counts as a token.
VERSIONS = {"words_v1": r"[^\x20\x09-\x0D]+", "pieces_v2": r"[\p{L}\p{N}]+|[^\p{L}\p{N}\x20\x09-\x0D]"}


def count_tokens(text: Column, version: str) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(VERSIONS[version])).cast("long"), F.lit(0).cast("long"))


def deltas(changes: DataFrame) -> DataFrame:
    """Signed partial sums of a batch's changes."""
    sign = F.when(F.col("op") == "insert", 1).when(F.col("op") == "delete", -1).when(F.col("op") == "revise", 0).otherwise(F.raise_error(F.concat(F.lit("unknown op: "), F.coalesce("op", F.lit("null")))))
    n, was = F.coalesce("n_tokens", F.lit(0)), F.coalesce("was", F.lit(0))
    tokens = F.when(F.col("op") == "revise", n - was).otherwise(sign * n)
    summed = changes.select(*KEYS, sign.cast("long").alias("d"), tokens.cast("long").alias("t")).groupBy(*KEYS).agg(F.sum("d").alias("n_docs"), F.sum("t").alias("n_tokens"))
    return summed.where((F.col("n_docs") != 0) | (F.col("n_tokens") != 0))


class RollupStore:
    """A folder of committed batches. One committer at a time; readers see whole batches only."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")
        jvm = spark._jvm
        self.path = jvm.org.apache.hadoop.fs.Path
        self.fs = self.path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())
        self.fs.mkdirs(self.path(self.folder))

    def batches(self) -> dict[str, str]:
        """The folder that holds each committed batch."""
        found: dict[str, str] = {}
        names = [s.getPath().getName() for s in self.fs.listStatus(self.path(self.folder))]
        for name in sorted(n for n in names if n.startswith("batch=")):
            found[name[6:]] = name
        for name in sorted(n for n in names if n.startswith("compact=")):  # a later one holds all that an earlier one does
            listed = self.spark.read.text(f"{self.folder}/{name}/ids")
            found |= dict.fromkeys((json.loads(r[0]) for r in listed.toLocalIterator()), f"{name}/sums")
        return found

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Adds a batch; False if it is there already."""
        if batch in self.batches():
            return False
        part = f"_part-{uuid.uuid4().hex}"
        deltas(changes).write.parquet(f"{self.folder}/{part}")
        return self._rename(part, f"batch={batch}")

    def _rename(self, part: str, name: str) -> bool:
        target = self.path(f"{self.folder}/{name}")
        if self.fs.exists(target) or not self.fs.rename(self.path(f"{self.folder}/{part}"), target):
            self.fs.delete(self.path(f"{self.folder}/{part}"), True)
            return False
        return True

    def totals(self) -> DataFrame:
        held = sorted(set(self.batches().values()))
        if not held:
            return self.spark.createDataFrame([], SCHEMA)
        rows = self.spark.read.schema(SCHEMA).parquet(*[f"{self.folder}/{h}" for h in held])
        summed = rows.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
        return summed.where((F.col("n_docs") != 0) | (F.col("n_tokens") != 0))

    def compact(self) -> None:
        """Folds all batches into one. Its rename commits it: from then on it stands for the ids
        that it lists, and what it folded, no longer read, is deleted."""
        held = self.batches()
        if len(set(held.values())) < 2:
            return
        last = max([int(h[8:16]) for h in held.values() if h.startswith("compact=")], default=0)
        part = f"_part-{uuid.uuid4().hex}"
        self.totals().write.parquet(f"{self.folder}/{part}/sums")
        ids = self.spark.createDataFrame([(json.dumps(i),) for i in sorted(held)], "ids string")
        ids.write.text(f"{self.folder}/{part}/ids")
        if self._rename(part, f"compact={last + 1:08d}"):
            for h in {h.split("/")[0] for h in held.values()}:
                self.fs.delete(self.path(f"{self.folder}/{h}"), True)


def documents_history(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Totals after four batches over all documents, one of them sent twice: `load` inserts the
    counts of words_v1, `retokenize` those of pieces_v2, `revise` replaces words_v1 by the count
    over each text's distinct lines, and `clean` deletes documents labelled as of low quality."""
    spark = docs.sparkSession
    distinct_lines = F.array_join(F.array_distinct(F.split("text", "\n")), "\n")
    counted = docs.select(
        "doc_id", "source", "lang",
        count_tokens(F.col("text"), "words_v1").alias("v1"), count_tokens(F.col("text"), "pieces_v2").alias("v2"), count_tokens(distinct_lines, "words_v1").alias("revised"),
    )
    bad = labels.where(F.col("quality") == 0).select("doc_id").distinct().withColumn("bad", F.lit(True))
    counts = materialize(counted.join(bad, "doc_id", "left").drop("doc_id"), "token-counts")

    def changes(op: str, version: str, n: str, was: Column | None = None, rows: DataFrame = counts) -> DataFrame:
        return rows.select(F.lit(op).alias("op"), "source", "lang", F.lit(version).alias("version"), F.col(n).alias("n_tokens"), (F.lit(None).cast("long") if was is None else was).alias("was"))

    store = RollupStore(spark, shared_dir(spark, "token-rollup"))
    gone = counts.where("bad")
    store.commit("load", changes("insert", "words_v1", "v1"))
    store.commit("retokenize", changes("insert", "pieces_v2", "v2"))
    store.commit("revise", changes("revise", "words_v1", "revised", F.col("v1")))
    store.commit("clean", changes("delete", "words_v1", "revised", rows=gone).union(changes("delete", "pieces_v2", "v2", rows=gone)))
    store.commit("load", changes("insert", "words_v1", "v1"))
    return store.totals()


def oracle() -> str:
    count = lambda text, version: f"coalesce(len(regexp_extract_all({text}, '{VERSIONS[version]}')), 0)"
    return f"""
WITH c AS (SELECT source, lang, {count('text', 'words_v1')} AS v1, {count('text', 'pieces_v2')} AS v2,
    coalesce(list_sum(list_transform(list_distinct(string_split(text, chr(10))), lambda x: {count('x', 'words_v1')})), 0) AS revised,
    coalesce(doc_id IN (SELECT doc_id FROM labels WHERE quality = 0), false) AS bad FROM documents),
d AS (SELECT source, lang, 'words_v1' AS version, 1 AS n, v1 AS t FROM c
  UNION ALL SELECT source, lang, 'pieces_v2', 1, v2 FROM c
  UNION ALL SELECT source, lang, 'words_v1', 0, revised - v1 FROM c
  UNION ALL SELECT source, lang, 'words_v1', -1, -revised FROM c WHERE bad
  UNION ALL SELECT source, lang, 'pieces_v2', -1, -v2 FROM c WHERE bad)
SELECT source, lang, version, sum(n)::BIGINT AS n_docs, sum(t)::BIGINT AS n_tokens FROM d GROUP BY ALL HAVING sum(n) <> 0 OR sum(t) <> 0"""
