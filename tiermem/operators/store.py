"""Stored tables: upserts from a log, bridges, counts, integrity, and restoring a memory."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FIXED = ("stream_id", "window_ord", "start_time", "end_time", "visual_embedding")
CHANGING = ("tier", "summary_text", "summary_embedding", "frame")


def upsert_windows(log: DataFrame, key: str = "window_id", order: str = "seq") -> DataFrame:
    """The table after writing the log in order: first write wins for the fixed columns, last for those that change."""
    has = set(log.columns)
    keep = lambda f, names: [f(F.struct(F.col(order), F.col(c).alias("v")))["v"].alias(c) for c in names if c in has]
    return log.groupBy(key).agg(*keep(F.min, [c for c in FIXED if c not in ("visual_embedding",)]), *keep(F.max, [c for c in CHANGING if c not in ("summary_embedding", "frame")]), *[F.min_by(c, order).alias(c) for c in ("visual_embedding",) if c in has], *[F.max_by(c, order).alias(c) for c in ("summary_embedding", "frame") if c in has])


def replace_rows(log: DataFrame, key: str, order: str = "seq") -> DataFrame:
    """The last row of each key."""
    return log.groupBy(key).agg(F.max_by(F.struct(*[c for c in log.columns if c != key]), order).alias("r")).select(key, "r.*")


def episode_bridge(eps: DataFrame) -> DataFrame:
    """episode_id, window_id, position, is_representative."""
    rows = eps.select("episode_id", "representative_window_ids", F.posexplode("member_window_ids").alias("position", "window_id"))
    return rows.select("episode_id", "window_id", "position", F.array_contains("representative_window_ids", F.col("window_id")).alias("is_representative"))


def event_bridge(evs: DataFrame) -> DataFrame:
    return evs.select("event_id", F.posexplode("member_episode_ids").alias("position", "episode_id")).select("event_id", "episode_id", "position")


def event_rep_bridge(evs: DataFrame) -> DataFrame:
    """Each representative of an event once, at its first position."""
    rows = evs.select("event_id", F.posexplode("representative_window_ids").alias("position", "window_id"))
    return rows.groupBy("event_id", "window_id").agg(F.min("position").alias("position"))


def counts(windows: DataFrame, eps: DataFrame, evs: DataFrame) -> DataFrame:
    one = lambda df, name: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("table_name"), "n")
    return one(windows, "window").union(one(eps, "episode")).union(one(evs, "event"))


def orphans(windows: DataFrame, eps: DataFrame, evs: DataFrame) -> DataFrame:
    """Bridge rows that point to nothing, counted: the foreign keys' check."""
    a = episode_bridge(eps).join(windows.select("window_id"), "window_id", "left_anti")
    b = event_bridge(evs).join(eps.select("episode_id"), "episode_id", "left_anti")
    c = event_rep_bridge(evs).join(windows.select("window_id"), "window_id", "left_anti")
    one = lambda df, name: df.agg(F.count("*").alias("n_orphans")).select(F.lit(name).alias("bridge"), "n_orphans")
    return one(a, "episode_window").union(one(b, "event_episode")).union(one(c, "event_rep_window"))


def save(path: str, windows: DataFrame, eps: DataFrame, evs: DataFrame) -> None:
    """The three tables and their bridges as Parquet under path."""
    for name, df in (("window", windows), ("episode", eps), ("event", evs), ("episode_window", episode_bridge(eps)), ("event_episode", event_bridge(evs)), ("event_rep_window", event_rep_bridge(evs))):
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def restore(spark, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return tuple(spark.read.parquet(f"{path}/{n}") for n in ("window", "episode", "event"))


def deleted(windows: DataFrame, eps: DataFrame, evs: DataFrame, window_ids: DataFrame | None = None, episode_ids: DataFrame | None = None, event_ids: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The tables without the named rows. A row's own bridge rows go with it; a row that a bridge of one that stays still points to is not deleted."""
    if event_ids is not None:
        evs = evs.join(event_ids.select("event_id"), "event_id", "left_anti")
    if episode_ids is not None:
        free = episode_ids.select("episode_id").join(event_bridge(evs), "episode_id", "left_anti")
        eps = eps.join(free, "episode_id", "left_anti")
    if window_ids is not None:
        free = window_ids.select("window_id").join(episode_bridge(eps), "window_id", "left_anti").join(event_rep_bridge(evs), "window_id", "left_anti")
        windows = windows.join(free, "window_id", "left_anti")
    return windows, eps, evs


#: Folders that the rows of a merged table are spread over by their key; a batch rewrites those it touches.
BUCKETS = 16


def _folders(spark, path: str) -> list[tuple[int, int, str]]:
    """(bucket, version, path) of what a merged table holds, sorted."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(where):
        return []
    found = []
    for version in fs.listStatus(where):
        name = version.getPath().getName()
        if name[:1] == "v" and name[1:].isdigit():
            parts = [p.getPath() for p in fs.listStatus(version.getPath())]
            found += [(int(p.getName()[len("bucket=") :]), int(name[1:]), p.toString()) for p in parts if p.getName().startswith("bucket=")]
    return sorted(found)


def current(spark, path: str, before: int | None = None) -> DataFrame:
    """A merged table as it stands: of each bucket the newest version (before the given one)."""
    newest = {b: p for b, v, p in _folders(spark, path) if before is None or v < before}
    return spark.read.parquet(*newest.values())


def merge_batch(path: str, key: str, order: str = "seq", buckets: int = BUCKETS):
    """A foreachBatch sink that keeps one table by the rule of upsert_windows: stored rows come before the batch's, these by order; the first write wins for
    the fixed columns, the last for all others.

    A batch rewrites the buckets that it touches, as a version of its own, so that one that is run again changes nothing; versions that neither the
    table nor a repeated batch needs are deleted. A batch without rows writes nothing."""

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        new = batch.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))
        touched = [r.bucket for r in new.select("bucket").distinct().collect()]  # at most as many as there are buckets
        if not touched:
            return
        before = {b: p for b, v, p in _folders(spark, path) if v < batch_id and b in touched}
        at = F.struct("_new", order)
        rows = new.withColumn("_new", F.lit(True))
        for b, p in before.items():
            rows = rows.unionByName(spark.read.schema(batch.schema).parquet(p).withColumn("bucket", F.lit(b)).withColumn("_new", F.lit(False)))
        pick = [(F.min_by if c in FIXED else F.max_by)(c, at).alias(c) for c in batch.columns if c != key]
        rows.groupBy(key, "bucket").agg(*pick).write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/v{batch_id:08d}")
        kept: dict[int, list[str]] = {}
        for b, v, p in _folders(spark, path):
            if v < batch_id:
                kept.setdefault(b, []).append(p)
        fs_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        for p in [p for ps in kept.values() for p in ps[:-1]]:
            old = fs_path(p)
            old.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(old, True)

    return write
