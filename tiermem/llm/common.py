"""Shared pieces: the cluster's shared folder, written intermediate tables, packed text, components of a graph."""

from __future__ import annotations

import gc
import time
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that are turned into arrays at once; bounds a Python worker's memory, not what is processed.
CHUNK_BYTES = 4 << 20
#: Whitespace: U+0020 and U+0009 to U+000D.
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
MIX = np.uint64(0x9E3779B97F4A7C15)
BASE = np.uint64(0x5851F42D4C957F2D)


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; one of our own only where it is unset, as in local tests."""
    set_to = spark.conf.get("spark.checkpoint.dir", None)
    if not set_to:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        set_to = "file:///tmp/checkpoints/tiermem"
        spark.conf.set("spark.checkpoint.dir", set_to)
    return set_to.rstrip("/")


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner delete the shuffle files of plans that nothing refers to any more, such as those of tables already written."""
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.2)


def materialize(df: DataFrame, tag: str, by: str | None = None) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: cuts the lineage, survives lost executors. by: a column that names folders."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    out = df.write.option("compression", "zstd")
    (out.partitionBy(by) if by else out).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._tm_path = path
    return out


def drop_materialized(*frames: DataFrame) -> None:
    """Delete tables that materialize() wrote, once nothing reads them any more."""
    for df in frames:
        spark, path = df.sparkSession, df._tm_path
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def utf8(col: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts of a string column, and where each begins (one more at the end). Null: empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("" if pa.types.is_string(col.type) or pa.types.is_large_string(col.type) else b"")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    offsets = np.frombuffer(col.buffers()[1], dtype=np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    data = col.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(batch: pa.RecordBatch, text: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Split a batch at row borders into pieces of about limit bytes of text."""
    if not batch.num_rows:
        return
    _, at = utf8(batch.column(batch.schema.get_field_index(text)))
    start = 0
    while start < batch.num_rows:
        end = max(start + 1, int(np.searchsorted(at, at[start] + limit, side="right")) - 1)
        yield batch.slice(start, end - start)
        start = end


def runs(ink: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First byte, end and row of each run of marked bytes; runs never cross rows."""
    n = len(ink)
    if not n:
        return (np.zeros(0, np.int64),) * 3
    wide = np.zeros(n + 2, dtype=bool)
    wide[1:-1] = ink
    first = wide[1:-1] & ~wide[:-2]
    last = wide[1:-1] & ~wide[2:]
    cuts = at[(at > 0) & (at < n)]
    first[cuts] |= wide[1 + cuts]
    last[cuts - 1] |= wide[cuts]
    s = np.flatnonzero(first)
    return s, np.flatnonzero(last) + 1, np.searchsorted(at, s, side="right") - 1


def words(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First byte, end and row of each word (run of bytes that are no whitespace); words never cross rows."""
    return runs(~SPACE[raw], at)


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i below n at least."""
    size = 1 << max(16, (n - 1).bit_length())
    if size not in _POWERS:
        inv = np.uint64(pow(int(BASE), -1, 1 << 64))
        with np.errstate(over="ignore"):
            _POWERS.clear()
            _POWERS[size] = tuple(np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, b, np.uint64)]), dtype=np.uint64) for b in (BASE, inv))
    return _POWERS[size]


def mixed(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply), so that all bits depend on all bits."""
    with np.errstate(over="ignore"):
        h = h ^ (h >> np.uint64(32))
        h = h * MIX
        h = h ^ (h >> np.uint64(29))
        h = h * np.uint64(0xBF58476D1CE4E5B9)
        return h ^ (h >> np.uint64(32))


def word_hashes(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of each word's bytes and length."""
    if not len(start):
        return np.zeros(0, np.uint64)
    up, down = powers(len(raw) + 1)
    with np.errstate(over="ignore"):
        total = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[: len(raw)], out=total[1:])
        return mixed((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64) * MIX)


def components(edges: DataFrame, tag: str = "cc") -> DataFrame:
    """(node, component): the smallest node that undirected edges (a, b) lead to, for every node of an edge.

    Alternating large-star and small-star steps; every step is written to the shared folder. Nulls and loops are left out."""
    e = edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    e = materialize(e, tag)
    nodes = e.select(F.col("a").alias("node")).union(e.select("b")).distinct()
    first = e
    while True:
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        new = materialize(small, tag)
        # a star forest: no node is both a child and a parent, and each child has one parent
        left = new.groupBy("a").count().where("count > 1").limit(1).count() + new.select("a").join(new.select(F.col("b").alias("a")).distinct(), "a", "left_semi").limit(1).count()
        if e is not first:
            drop_materialized(e)
        e = new
        if not left:
            break
    return nodes.join(e.select(F.col("a").alias("node"), F.col("b").alias("component")), "node", "left").select("node", F.coalesce("component", "node").alias("component"))
