"""Shared helpers of the training-data operators.

Row identity: an operator's verdict is a function of a row's id and text, so
rows are keyed by a 128-bit hash of both (``row_key``), in which a null is a
value like any other. Repeated rows share a key and get the same verdict. Only
the id and text columns enter an operator, under private names, so extra
columns of any name cannot clash.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postlens.session import checkpoint_root

TABLES_SUFFIX = ".parquet"
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables, read by Spark only."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}{TABLES_SUFFIX}")


def row_key(doc_id: Column, text: Column) -> list[Column]:
    """128-bit key of an id and a text as ``_h1``, ``_h2``; nulls are values like any other, so it is never null."""
    parts = [doc_id.isNull(), doc_id, text.isNull(), text]
    return [F.xxhash64(*parts).alias("_h1"), F.xxhash64(F.lit(7), *parts).alias("_h2")]


def id_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the id and the text, as ``doc_id`` and ``text``."""
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def cut(df: DataFrame) -> DataFrame:
    """The frame written to ``spark.checkpoint.dir`` and read back: lineage ends there."""
    checkpoint_root(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """The frame written as a Parquet table below the shared checkpoint folder and read back.

    Like ``cut``, for larger frames: compressed, and read by column. What the
    write shuffled leaves the disk as it ends, not when the driver collects garbage.
    """
    spark, path = df.sparkSession, scratch(df.sparkSession, name)
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared checkpoint folder."""
    return f"{checkpoint_root(spark)}/llm/{name}-{uuid.uuid4().hex}"


def text_bytes(docs: DataFrame, text_col: str = "text") -> int:
    """Bytes of all texts (one aggregate over the whole table)."""
    return int(docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0)


def slices(batches: Iterator[pa.RecordBatch], column: str, target: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Each Arrow batch cut between rows into pieces of about ``target`` bytes of ``column``."""
    import numpy as np
    import pyarrow.compute as pc

    for batch in batches:
        n = batch.num_rows
        if n == 0:
            continue
        arr = batch.column(batch.schema.get_field_index(column))
        size = np.asarray(pc.fill_null(pc.binary_length(arr), 0)).astype(np.int64)
        ends = np.cumsum(size)
        lo = 0
        while lo < n:
            base = ends[lo - 1] if lo else 0
            hi = max(lo + 1, int(np.searchsorted(ends, base + target, "right")))
            yield batch.slice(lo, hi - lo)
            lo = hi


def _state(edges: DataFrame) -> tuple:
    """Count and two sums of hashes of distinct edges ``u, v``: equal for the same edges."""
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")),
                           F.bit_xor(F.xxhash64(F.lit(7), "u", "v"))).first())


def components(edges: DataFrame, a: str, b: str, max_rounds: int = 60) -> DataFrame:
    """Connected components of an undirected edge list, as ``(node, root)``.

    Alternating large-star and small-star steps: every round is a few aggregations
    and equi-joins on node ids, written to the shared checkpoint folder, so
    lineage stays short. ``root`` is the smallest node
    of the component. Nodes without an edge are not listed. Only the count of
    changed rows reaches the driver.
    """
    cur = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    cur = cut(cur)
    state = _state(cur)
    for _ in range(max_rounds):
        both = cur.unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (both.join(low, "u").where("v > u")
                 .select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct())
        low2 = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(low2, "u")
        small = (joined.select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionByName(low2.select("u", F.col("m").alias("v")))
                 .where("u <> v").distinct())
        nxt = cut(small)
        cur, before, state = nxt, state, _state(nxt)
        if state == before:
            break
    else:
        raise RuntimeError("components did not settle")
    roots = cur.groupBy("u").agg(F.min("v").alias("root"))
    return (roots.select(F.col("u").alias("node"), "root")
            .unionByName(cur.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
            .groupBy("node").agg(F.min("root").alias("root")))
