"""Packed blocks of whole documents, and counting of keys over all of them by exchanged sorted runs.

A block is one row: its documents' ids, where each text begins, and the bytes of all, compressed. Blocks are written once, so every later pass sees
the same documents in the same order. What passes between tasks is packed too: a sorted run of 48-bit keys takes about four bytes a key."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, utf8

BLOCK_BYTES, BLOCK_DOCS = 4 << 20, 1 << 16
#: A bucket of keys for so many bytes of text.
BUCKET_BYTES = 16 << 20
KEY_BITS, COUNT_BITS = np.uint64(48), np.uint64(16)
MOST = (1 << 16) - 1
BLOCKS = "block long, ids binary, starts binary, data binary, n_bytes long, n_docs long"
PARTS = "block long, kind int, bucket long, data binary"
_PARTS = pa.schema([("block", pa.int64()), ("kind", pa.int32()), ("bucket", pa.int64()), ("data", pa.binary())])
#: kinds of rows that meet at a block, in the order in which they are read
TEXT, REPLY, EXTRA = 2, 0, 1
NO_ID = np.iinfo(np.int64).max


def zip_(data: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(data)


def unzip(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def parts(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _PARTS, strict=True)], schema=_PARTS)


def pack(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """The blocks of docs, written. A null id is NO_ID inside; a null text is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, sizes, data, held, seq = [], [], [], 0, 0
        task = TaskContext.get().partitionId()

        def block() -> pa.RecordBatch:
            raw = b"".join(data)
            starts = np.zeros(sum(map(len, sizes)) + 1, np.int64)
            np.cumsum(np.concatenate(sizes), out=starts[1:])
            whole = [[(task << 20) | seq], [np.concatenate(ids).tobytes()], [zip_(starts.tobytes())], [zstandard.ZstdCompressor(level=3).compress(raw)], [len(raw)], [len(starts) - 1]]
            kinds = [pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(whole, kinds, strict=True)], names=["block", "ids", "starts", "data", "n_bytes", "n_docs"])

        for batch in batches:
            id_col = batch.column(0).fill_null(NO_ID).to_numpy(zero_copy_only=False).astype(np.int64)
            raw, at = utf8(batch.column(1))
            a = 0
            while a < batch.num_rows:
                room = BLOCK_BYTES - held
                b = min(max(a + 1, int(np.searchsorted(at, at[a] + room, side="right")) - 1), a + BLOCK_DOCS - sum(map(len, ids)), batch.num_rows)
                ids.append(id_col[a:b])
                sizes.append(np.diff(at[a : b + 1]))
                data.append(raw[at[a] : at[b]].tobytes())
                held += int(at[b] - at[a])
                a = b
                if held >= BLOCK_BYTES - 4096 or sum(map(len, ids)) >= BLOCK_DOCS:
                    yield block()
                    ids, sizes, data, held, seq = [], [], [], 0, seq + 1
        if ids:
            yield block()

    return materialize(docs.select(docs[doc_id].cast("long"), docs[text]).mapInArrow(run, BLOCKS), "blocks")


def n_buckets(blocks: DataFrame) -> int:
    total = blocks.agg(F.sum("n_bytes")).first()[0] or 0
    return max(8, int(total // BUCKET_BYTES))


def opened(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """ids, starts and bytes of a block."""
    return np.frombuffer(row["ids"], np.int64), np.frombuffer(unzip(row["starts"]), np.int64), np.frombuffer(unzip(row["data"]), np.uint8)


def packed_run(values: np.ndarray) -> bytes:
    """A sorted array of unsigned 64-bit numbers: differences, byte plane by byte plane, compressed."""
    step = np.diff(values, prepend=np.uint64(0)).astype(np.uint64)
    return zip_(step.view(np.uint8).reshape(-1, 8).T.tobytes())


def unpacked_run(data: bytes) -> np.ndarray:
    planes = np.frombuffer(unzip(data), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).ravel(), dtype=np.uint64)


def bucket_cuts(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket's part of sorted 48-bit keys begins, and the end."""
    edges = np.array([(i << 48) // buckets for i in range(buckets)], np.uint64)
    return np.append(np.searchsorted(keys, edges), len(keys))


def count_rows(block: int, keys: np.ndarray, counts: np.ndarray, buckets: int) -> Iterator[tuple]:
    """The run of a block's sorted distinct keys with counts, a row for each bucket that has any."""
    cuts = bucket_cuts(keys, buckets)
    for i in np.flatnonzero(np.diff(cuts)):
        k, c = keys[cuts[i] : cuts[i + 1]], np.minimum(counts[cuts[i] : cuts[i + 1]], 255).astype(np.uint8)
        yield block, REPLY, int(i), len(z := packed_run(k)).to_bytes(4, "little") + z + zip_(c.tobytes())


def _read(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    size = int.from_bytes(data[:4], "little")
    return unpacked_run(data[4 : 4 + size]), np.frombuffer(unzip(data[4 + size :]), np.uint8)


def _summed(table: pa.Table) -> pa.Table:
    """For one bucket: over how many documents of all blocks each key of each run is found (at most MOST, 255 a block)."""
    runs = [_read(d) for d in table.column("data").to_pylist()]
    both = np.sort(np.concatenate([(k << COUNT_BITS) | c.astype(np.uint64) for k, c in runs]))
    key = both >> COUNT_BITS
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    total = np.minimum(np.add.reduceat((both & np.uint64(MOST)).astype(np.int64), first), MOST).astype(np.uint16)
    many = total > 1
    key, total = key[first][many], total[many]
    rows = []
    for (k, _), block, bucket in zip(runs, table.column("block").to_pylist(), table.column("bucket").to_pylist(), strict=True):
        out = np.ones(len(k), np.uint16)
        if len(key):
            at = np.minimum(np.searchsorted(key, k), len(key) - 1)
            out = np.where(key[at] == k, total[at], 1).astype(np.uint16)
        rows.append((block, REPLY, bucket, zip_(out.tobytes())))
    return pa.Table.from_batches([parts(rows)])


def counted(runs: DataFrame) -> DataFrame:
    """The replies to count_rows: for each run, the number of documents in which each of its keys is found."""
    return runs.groupBy("bucket").applyInArrow(_summed, PARTS)


def with_blocks(blocks: DataFrame, others: DataFrame, work: Callable[[int, dict, list[tuple[int, int, bytes]]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """Bring each block together with the rows (PARTS) that concern it: work(block, row, [(kind, bucket, data)] sorted) yields batches.
    A block and its replies are bounded by the block's size."""
    text = blocks.select("block", F.lit(TEXT).alias("kind"), F.lit(-1).cast("long").alias("bucket"), "data", "ids", "starts")
    rest = others.select("block", "kind", "bucket", "data", F.lit(None).cast("binary").alias("ids"), F.lit(None).cast("binary").alias("starts"))
    both = text.union(rest).repartition("block").sortWithinPartitions("block", "kind", "bucket")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got: list[tuple[int, int, bytes]] = []
        for batch in batches:
            for i in range(batch.num_rows):
                block, kind, bucket, data = (batch.column(j)[i].as_py() for j in range(4))
                if kind == TEXT:
                    yield from work(block, {"data": data, "ids": batch.column(4)[i].as_py(), "starts": batch.column(5)[i].as_py()}, got)
                    got = []
                else:
                    got.append((kind, bucket, data))

    return both.mapInArrow(run, schema)


def each_block(blocks: DataFrame, work: Callable[[int, dict], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """work(block, row) over every block, without a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                block, ids, starts, data = (batch.column(j)[i].as_py() for j in range(4))
                yield from work(block, {"data": data, "ids": ids, "starts": starts})

    return blocks.select("block", "ids", "starts", "data").mapInArrow(run, schema)
