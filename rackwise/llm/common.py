"""Shared pieces of the text operators: reading, scratch tables, text blocks, connected components."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are the runs of bytes outside \x20 and \x09-\x0D; bytes.split() splits at exactly those.
BLOCK_BYTES = 8 << 20

#: Lower-case A-Z; every other byte of ASCII that isn't a letter or digit is a space.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 or 48 <= b <= 57 else 32 for b in range(256))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names in spark.checkpoint.dir; one of our own only where it is unset and all runs on this machine."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="spark-checkpoints-", dir="/tmp")
        spark.sparkContext.setCheckpointDir(root)
    return root


def stored(df: DataFrame) -> DataFrame:
    """df written as a Parquet table in the shared folder and read back: cuts lineage, is computed once."""
    path = f"{scratch_dir(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def checkpointed(df: DataFrame) -> DataFrame:
    scratch_dir(df.sparkSession)
    return df.checkpoint()


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def id_text(docs: DataFrame) -> DataFrame:
    """Only (doc_id long, text string, null text as empty): columns with other names never matter."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def give_back() -> None:
    """Returns freed memory of Arrow and the C library to the system: workers live on between tasks of all kinds."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def blocks(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = BLOCK_BYTES, as_bytes: bool = True) -> Iterator[tuple[pa.RecordBatch, list]]:
    """Slices of the batches with about `most` bytes in `column` (one row at least), with that column as a list. Only one
    slice at a time is held as Python objects."""

    def listed(values: pa.Array) -> list:
        return (values.cast(pa.binary()) if as_bytes and not pa.types.is_binary(values.type) else values).to_pylist()

    for batch in batches:
        values = batch.column(column)
        start = held = 0
        for i, size in enumerate(pc.fill_null(pc.binary_length(values), 0).to_pylist()):
            if held and held + size > most:
                yield batch.slice(start, i - start), listed(values[start:i])
                start, held = i, 0
            held += size
        if start < batch.num_rows:
            yield batch.slice(start), listed(values[start:])
        del batch, values
    give_back()


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for each node of links, root the smallest node reachable.

    Alternating large-star and small-star rounds; each is grouped minima and equi-joins, so hubs are aggregated
    before they move and joins with a hub can be split by AQE. Lineage is cut by checkpoint() in each round.
    """
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct()
    edges = checkpointed(edges)
    last = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        edges = checkpointed(small)
        now = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("h")).first()
        if now == last or not now.n:
            break
        last = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
