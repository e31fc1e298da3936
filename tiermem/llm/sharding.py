"""Sharding by sampled splitters: size-weighted key samples give quantile boundaries, records are range-partitioned, overfull ranges subdivided.

Key of a record: (order, doc_id, tie), where order is the md5 of its text unless given, and tie a number that rows get once when they are written. So
equal texts lie side by side, and yet any number of copies, even of wholly equal rows, can be cut between two of them.
The law held is "bytes": every shard's size differs from the mean by less than the largest record. A group of equal texts lies in one shard but where
a shard's border must fall inside it for that law: 39 borders, so at most 39 groups are cut.

1. A sample of SAMPLES rows for each range, drawn by size, gives the ranges' boundaries. There is a range for each RANGE_ROWS rows, but MAX_RANGES at most.
2. A range of more than twice the mean of rows or bytes is overfull: a second sample, of its rows only and in proportion to what it holds, subdivides it.
3. Each range is put in order by itself; the running size of the ranges before it gives each row's place, and so its shard and slot.

Defined cases: a null text counts as empty (size 16, CRC of no bytes); a null doc_id sorts first; rows that are wholly equal may
swap slots; an empty table gives no rows; columns of the input that the operator does not name are ignored."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize

#: Bytes that a record takes besides its text.
OVERHEAD = 16
#: Hex digits of the key by which a row finds the few boundaries that it must be compared with.
CELL_DIGITS = 3
#: Rows of a range, sampled rows for each range, and the most ranges there are before overfull ones are subdivided.
RANGE_ROWS, SAMPLES, MAX_RANGES = 1_000_000, 24, 1 << 15
#: A range with more than this many times the mean of rows or bytes is subdivided into as many parts as it holds means.
OVERFULL = 2.0


def _key() -> Column:
    return F.struct("key", "doc_id", "tie")


def _u(salt: int) -> Column:
    """A number in (0, 1) that a row's key decides."""
    return (F.xxhash64(F.lit(salt), "key", "doc_id", "tie").bitwiseAND(F.lit((1 << 52) - 1)) + F.lit(0.5)) / F.lit(float(1 << 52))


def boundaries(rows: DataFrame, n_ranges: int, per_range: int) -> DataFrame:
    """One row, an array of at most n_ranges - 1 keys. The sample has n_ranges * per_range rows:
    those of smallest -ln(u) / size, which draws without replacement in proportion to size."""
    sample = rows.select("key", "doc_id", "tie", (-F.log(_u(1)) / F.col("size")).alias("e")).orderBy("e", "key", "doc_id", "tie").limit(n_ranges * per_range)
    keys = sample.agg(F.sort_array(F.collect_list(_key())).alias("k"))
    return keys.select(F.expr(f"transform(filter(sequence(1, {n_ranges - 1}), i -> size(k) >= {n_ranges}), i -> k[cast(cast(i as bigint) * size(k) div {n_ranges} as int)])").alias("cut"), F.size("k").alias("sampled"))


def cells(cuts: DataFrame) -> DataFrame:
    """For each of the 16**CELL_DIGITS cells of keys: how many boundaries lie in lower cells, and those within. So many rows at any scale."""
    spark = cuts.sparkSession
    each = cuts.select(F.explode("cut").alias("c")).select(F.conv(F.substring("c.key", 1, CELL_DIGITS), 16, 10).cast("int").alias("cell"), "c")
    inside = each.groupBy("cell").agg(F.sort_array(F.collect_list("c")).alias("inside"))
    whole = spark.range(16**CELL_DIGITS).select(F.col("id").cast("int").alias("cell")).join(inside, "cell", "left")
    w = Window.orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    return whole.select("cell", "inside", F.coalesce(F.sum(F.when(F.col("inside").isNull(), 0).otherwise(F.size("inside"))).over(w), F.lit(0)).alias("below"))


def subdivisions(ranged: DataFrame, per_part: int) -> DataFrame:
    """range and cuts (sorted keys) of each overfull range. Rows are drawn one by one with a chance in proportion to their size, about per_part for each
    part that the range is cut into, so all samples together grow with the number of ranges and no range is gathered whole."""
    by = ranged.groupBy("range").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
    mean = by.agg(F.avg("bytes").alias("mean_bytes"), F.avg("n").alias("mean_n"))
    parts = F.ceil(F.greatest(F.col("bytes") / F.col("mean_bytes"), F.col("n") / F.col("mean_n"))).cast("int")
    full = by.crossJoin(F.broadcast(mean)).withColumn("parts", parts).where(F.greatest(F.col("bytes") / F.col("mean_bytes"), F.col("n") / F.col("mean_n")) > OVERFULL)
    # a part of both measures, so that neither many small rows nor a few large ones go unseen
    chance = F.col("parts") * F.lit(per_part) * (F.col("size") / F.col("bytes") + F.lit(1.0) / F.col("n")) / 2
    drawn = ranged.join(F.broadcast(full.select("range", "bytes", "n", "parts")), "range").where(_u(2) < chance)
    keys = drawn.groupBy("range", "parts").agg(F.sort_array(F.collect_list(_key())).alias("k"))
    return keys.select("range", F.expr("array_distinct(transform(filter(sequence(1, parts - 1), i -> size(k) > 0), i -> k[cast(cast(i as bigint) * size(k) div parts as int)]))").alias("cuts"))


def assigned(rows: DataFrame, n_ranges: int, per_range: int) -> DataFrame:
    """rows (key, doc_id, tie, size, ...) with range and part, both in order of the keys."""
    found = materialize(cells(boundaries(rows, n_ranges, per_range)), "shard-cells")
    ranged = rows.withColumn("cell", F.conv(F.substring("key", 1, CELL_DIGITS), 16, 10).cast("int")).join(F.broadcast(found), "cell")  # 4096 rows at any scale, MAX_RANGES boundaries at most
    ranged = ranged.withColumn("range", F.col("below") + F.when(F.col("inside").isNull(), 0).otherwise(F.expr("size(filter(inside, b -> b <= struct(key, doc_id, tie)))"))).drop("cell", "inside", "below")
    cuts = materialize(subdivisions(ranged, per_range), "shard-cuts")
    # at most MAX_RANGES ranges, whose parts are as many as ranges' means fit into them
    out = ranged.join(F.broadcast(cuts.withColumnRenamed("range", "cut_range")), F.col("range") == F.col("cut_range"), "left")
    return out.withColumn("part", F.when(F.col("cuts").isNull(), 0).otherwise(F.expr("size(filter(cuts, b -> b <= struct(key, doc_id, tie)))"))).drop("cuts", "cut_range")


def shard(docs: DataFrame, n_shards: int = 40, ranges_per_shard: int | None = None, samples_per_range: int = SAMPLES, text: str = "text", doc_id: str = "doc_id", carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row, then the columns named in carry, in order of the texts' md5.
    ranges_per_shard: ranges before overfull ones are subdivided; by the number of rows unless given."""
    t = F.coalesce(F.col(text), F.lit(""))
    return shard_sized(docs, F.md5(t.cast("binary")), F.octet_length(t), F.crc32(t.cast("binary")), n_shards, ranges_per_shard, samples_per_range, doc_id, carry)


def shard_sized(docs: DataFrame, order: Column, n_bytes: Column, crc: Column, n_shards: int = 40, ranges_per_shard: int | None = None, samples_per_range: int = SAMPLES, doc_id: str = "doc_id", carry: tuple[str, ...] = ()) -> DataFrame:
    """shard() of rows whose order (hex digits, as evenly spread as a hash), text bytes and CRC are given."""
    rows = docs.select(
        F.col(doc_id).cast("long").alias("doc_id"), order.alias("key"), F.monotonically_increasing_id().alias("tie"), (n_bytes + F.lit(OVERHEAD)).cast("long").alias("size"), crc.cast("long").alias("text_crc32"),
        *[F.col(c).alias(f"carry_{i}") for i, c in enumerate(carry)],
    )
    rows = materialize(rows, "shard-rows")
    n_ranges = n_shards * ranges_per_shard if ranges_per_shard else min(MAX_RANGES, max(4 * n_shards, rows.count() // RANGE_ROWS))
    ranged = assigned(rows, n_ranges, samples_per_range)
    by_range = ranged.groupBy("range", "part").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
    before = Window.orderBy("range", "part").rowsBetween(Window.unboundedPreceding, -1)
    by_range = by_range.select(
        "range", "part", F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("bytes_before"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n_before"), F.sum("bytes").over(Window.partitionBy()).alias("bytes_all")
    )
    within = Window.partitionBy("range", "part").orderBy("key", "doc_id", "tie")
    placed = ranged.withColumn("run", F.sum("size").over(within.rowsBetween(Window.unboundedPreceding, 0))).withColumn("rn", F.row_number().over(within))
    # a shard ends where the running size passes its share of the bytes
    placed = placed.join(F.broadcast(by_range), ["range", "part"]).select(  # about 2 * MAX_RANGES rows at most
        "doc_id", "size", "text_crc32", *[f"carry_{i}" for i in range(len(carry))], (F.col("n_before") + F.col("rn") - 1).alias("place"),
        F.expr(f"cast(least({n_shards - 1}, ((2 * (bytes_before + run) - size) * {n_shards}) div (2 * bytes_all)) as int)").alias("shard"),
    )
    placed = materialize(placed, "shard-placed")
    first = placed.groupBy("shard").agg(F.min("place").alias("first"))
    return placed.join(F.broadcast(first), "shard").select(  # a row for each shard
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("place") - F.col("first")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
        *[F.col(f"carry_{i}").alias(c) for i, c in enumerate(carry)],
    )
