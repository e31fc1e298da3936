"""Merkle fixity audit of record archives: record hashes in trees over ordered ranges, roots compared, only mismatching branches descended.

A tree stands on the space of record keys: the node of level L and number k covers the keys from k * FANOUT**L on, so that two replicas have the
same shape whatever one of them lacks, and no record has to be counted off. A node holds the hash over its children's keys, hashes and sizes, and the
bytes below it, and so, going down, the offset at which each child begins. An archive is the subtree of level DEPTH; a table has as many levels above
as it takes to have one root for each half of the key space, and the root of all is the hash over those.

Equal roots end the audit. Else the descent reads of each level the children of nodes found bad only: levels are written in folders by key range, of
which the bad ones alone are opened.

Records under one key are hashed together by sums of parts of their hashes, so that any number of them is never gathered in one array.

Records whose key is null get a negative key from their content's hash. Records that wholly repeat are one leaf with a count. A record that one
replica lacks is "missing" (the second has none) or "extra". A null payload counts as empty. Equal keys with unlike contents are leaves side by
side, ordered by hash. Empty tables give no rows. Other columns are ignored."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import drop_materialized, materialize

BITS = 4
FANOUT = 1 << BITS
#: Levels between keys and archive roots: an archive covers FANOUT**DEPTH keys.
DEPTH = 3
#: Bytes of a record's header in its archive.
HEADER = 32
#: Folders of a level, at most; archives are spread over them by number.
FOLDERS = 64
#: Hex digits of a hash by which the records of one key are split to sum their sizes.
SPLIT = 3


@dataclass
class Tree:
    """records: node (key), hash, bytes, copies. levels: node, hash, bytes of keys, of archives, and of DEPTH levels more each time. root: one hash."""

    records: DataFrame
    levels: list[DataFrame]
    root: str

    def drop(self) -> None:
        """Delete the written tables, once nothing reads the audit's rows any more."""
        drop_materialized(self.records, *self.levels)


def _above(node: str, levels: int) -> Column:
    """The node so many levels up: an arithmetic shift, so exact for any key."""
    return F.shiftright(F.col(node), BITS * levels)


def _in_folders(rows: DataFrame, tag: str) -> DataFrame:
    """Rows of keys written in folders by archive, in order of keys: few files, however many tasks write."""
    return materialize(rows.withColumn("folder", F.pmod(_above("node", DEPTH), F.lit(FOLDERS)).cast("int")).repartitionByRange("folder", "node").sortWithinPartitions("folder", "node"), tag, by="folder")


def leaves(records: DataFrame, key: str, payload: Column) -> DataFrame:
    """node (the key), hash, bytes and copies of each distinct record."""
    body = F.coalesce(payload.cast("binary"), F.lit(b""))
    hashed = F.sha2(body, 256)
    node = F.coalesce(F.col(key).cast("long"), -F.conv(F.substring(hashed, 1, 12), 16, 10).cast("long") - 1)
    rows = records.select(node.alias("node"), hashed.alias("hash"), (F.octet_length(body) + F.lit(HEADER)).cast("long").alias("bytes"))
    return rows.groupBy("node", "hash", "bytes").agg(F.count("*").alias("copies"))


def keys(records: DataFrame) -> DataFrame:
    """node, hash and bytes of each key: over the sums of four parts of its records' hashes, each taken with its copies. No order, so no array."""
    one = F.sha2(F.concat_ws(":", "hash", "bytes", "copies"), 256)
    part = lambda i: F.sum(F.conv(F.substring(one, 1 + 15 * i, 15), 16, 10).cast("decimal(38,0)"))
    by = records.groupBy("node").agg(*[part(i).alias(f"p{i}") for i in range(4)], F.sum(F.col("bytes") * F.col("copies")).alias("bytes"), F.sum("copies").alias("n"))
    return by.select("node", F.sha2(F.concat_ws(":", "node", *[F.col(f"p{i}").cast("string") for i in range(4)], "n"), 256).alias("hash"), "bytes")


def level_up(below: DataFrame) -> DataFrame:
    """The nodes over the given ones: hash of the ordered children, FANOUT at most, and their bytes."""
    up = below.groupBy(_above("node", 1).alias("up")).agg(F.sort_array(F.collect_list(F.struct("node", "hash", "bytes"))).alias("children"), F.sum("bytes").alias("bytes"))
    return up.select(F.col("up").alias("node"), F.sha2(F.expr("array_join(transform(children, c -> concat_ws(':', c.node, c.hash, c.bytes)), '\\n')"), 256).alias("hash"), "bytes")


def archives(below: DataFrame) -> DataFrame:
    """The nodes DEPTH levels up."""
    for _ in range(DEPTH):
        below = level_up(below)
    return below


def tree(records: DataFrame, key: str, payload: Column) -> Tree:
    """Records, keys, archives and every DEPTH-th level above are written; the levels between are worked out on the way."""
    written = _in_folders(leaves(records, key, payload), "merkle-leaves")
    levels = [_in_folders(keys(written), "merkle-keys")]
    reach = (0, 2)
    while reach[0] is not None and reach[1] - reach[0] > 1:
        levels.append(materialize(archives(levels[-1]), "merkle-level"))
        reach = levels[-1].agg(F.min("node"), F.max("node")).first()
    ends = levels[-1].orderBy("node").collect()  # two nodes at most
    return Tree(written, levels, "|".join(f"{r.node}:{r.hash}:{r.bytes}" for r in ends))


def _unlike(a: DataFrame, b: DataFrame) -> DataFrame:
    """node of those whose hash the other side lacks."""
    both = a.select("node", F.col("hash").alias("hash_a")).join(b.select("node", F.col("hash").alias("hash_b")), "node", "full")
    return both.where(~F.col("hash_a").eqNullSafe(F.col("hash_b"))).select("node")


def _under(level: DataFrame, bad: DataFrame, levels: int) -> DataFrame:
    """The nodes that lie so many levels under the bad ones; of a level written in folders, those of bad nodes alone are read."""
    on = [F.col("up") == F.col("_up")]
    named = bad.select(F.col("node").alias("_up"))
    if "folder" in level.columns:
        named = named.withColumn("_folder", F.pmod(_above("_up", DEPTH - levels), F.lit(FOLDERS)).cast("int"))
        on.append(F.col("folder") == F.col("_folder"))
    return level.withColumn("up", _above("node", levels)).join(named, on, "left_semi").drop("folder", "up")


def audit(first: Tree, second: Tree) -> DataFrame:
    """One row for each record that differs: archive, key, verdict, replica that has it, offset in the first replica's archive (null for extra ones), bytes, hash, n_a, n_b."""
    schema = "archive long, key long, verdict string, replica string, start long, bytes long, hash string, n_a long, n_b long"
    if first.root == second.root:
        return first.records.sparkSession.createDataFrame([], schema)
    # from the highest level that both have down to archives, then to keys
    level = min(len(first.levels), len(second.levels)) - 1
    bad = _unlike(first.levels[level], second.levels[level])
    for level in range(level - 1, 0, -1):
        bad = _unlike(*(_under(t.levels[level], bad, DEPTH) for t in (first, second)))
    bad = materialize(bad, "merkle-bad")
    near, other = (_under(t.levels[0], bad, DEPTH) for t in (first, second))
    # offsets of keys within their archive: groups of FANOUT keys first, so that no window holds more than FANOUT**(DEPTH - 1) rows
    archive, group = _above("node", DEPTH), _above("node", 1)
    groups = near.groupBy(archive.alias("archive"), group.alias("group")).agg(F.sum("bytes").alias("bytes"))
    before = lambda *by: Window.partitionBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    groups = groups.select("group", F.coalesce(F.sum("bytes").over(before("archive").orderBy("group")), F.lit(0)).alias("group_start"))
    at = near.withColumn("group", group).join(groups, "group").withColumn("start", F.col("group_start") + F.coalesce(F.sum("bytes").over(before("group").orderBy("node")), F.lit(0)))
    wrong = _unlike(near, other).join(at.select("node", "start"), "node", "left")
    wrong = materialize(wrong, "merkle-wrong")
    # records of bad keys, placed within their key by the leading digits of their hashes
    rows = lambda t: _under(t.records, wrong, 0)
    mine = rows(first).withColumn("split", F.substring("hash", 1, SPLIT))
    size = F.col("bytes") * F.col("copies")
    splits = mine.groupBy("node", "split").agg(F.sum(size).alias("held")).select("node", "split", F.coalesce(F.sum("held").over(before("node").orderBy("split")), F.lit(0)).alias("split_start"))
    mine = mine.join(splits, ["node", "split"]).withColumn("inside", F.col("split_start") + F.coalesce(F.sum(size).over(before("node", "split").orderBy("hash")), F.lit(0)))
    both = mine.select("node", "hash", "inside", "bytes", F.col("copies").alias("n_a")).join(rows(second).select("node", "hash", F.col("bytes").alias("other_bytes"), F.col("copies").alias("n_b")), ["node", "hash"], "full").where(~F.col("n_a").eqNullSafe(F.col("n_b")))
    both = both.join(wrong.select("node", "start"), "node")
    # changed: under one key each side has a record that the other lacks
    sides = both.groupBy("node").agg(F.max(F.col("n_a").isNotNull()).alias("in_a"), F.max(F.col("n_b").isNotNull()).alias("in_b"))
    both = both.join(sides, "node")
    verdict = F.when(F.col("n_a").isNotNull() & F.col("n_b").isNotNull(), "copies").when(F.col("in_a") & F.col("in_b"), "changed").when(F.col("n_b").isNull(), "missing").otherwise("extra")
    return both.select(
        _above("node", DEPTH).alias("archive"), F.col("node").alias("key"), verdict.alias("verdict"), F.when(F.col("n_a").isNull(), "b").otherwise("a").alias("replica"),
        (F.col("start") + F.col("inside")).alias("start"), F.coalesce("bytes", "other_bytes").alias("bytes"), "hash", F.coalesce("n_a", F.lit(0)).alias("n_a"), F.coalesce("n_b", F.lit(0)).alias("n_b"),
    )
