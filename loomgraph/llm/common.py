"""Helpers shared by the corpus operators."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.functions.batches import STEP_BYTES, steps  # noqa: F401

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder name under the cluster's shared folder. Where none is configured a local master gets
    one of its own; on a cluster that is an error, as executors would each write to their own disk."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = "file://" + os.path.join(tempfile.gettempdir(), "loomgraph-shared")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/loomgraph-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def clean(spark: SparkSession) -> None:
    """Deletes what this application has in the shared folder. Results are read from there when they are
    used, so it is to be called once they are written or no longer needed."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/loomgraph-{spark.sparkContext.applicationId}")
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = shared_dir(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def map_text(df: DataFrame, schema: str, make: Callable[[], Callable[[dict[str, list]], dict[str, Any]]], text: str | None = "text", limit: int = STEP_BYTES) -> DataFrame:
    """mapInArrow in slices of about `limit` bytes of text. `make` runs once per task and returns the function that turns
    a slice's columns (lists by name) into the output columns (lists or arrays by name)."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    out = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        apply = make()
        for batch in batches:
            for part in steps(batch, text, limit):
                columns = apply({n: part.column(n).to_pylist() for n in part.schema.names})
                yield pa.RecordBatch.from_arrays([pa.array(columns[f.name], type=f.type) for f in out], schema=out)

    return df.mapInArrow(run, schema)


def remainder(doc_id, modulus: int):
    """crc32 of the id as text, modulo; a null id counts as the empty text (remainder 0)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")), F.lit(0)) % modulus


def ascii_lower(column):
    return F.translate(column, UPPER, LOWER)


def bounded_sample(labels: DataFrame, key: str, most: int) -> DataFrame:
    """At most `most` rows, the same ones at every run: those of least key hash."""
    return labels.orderBy(F.xxhash64(key), key).limit(most)
