"""Canonical streams built from the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import PRESETS
from ..functions.vector import mean, normalised
from ..operators.retrieval import Retrieval
from ..sources.staging import exists, staged, stamp

CONFIG = PRESETS["fixture"]
PER_STREAM = 100
#: The ordinal that a canonical stream ends with, also one that the table holds only the beginning of.
LAST_ORD = PER_STREAM - 1
_KEPT: dict[tuple, object] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Smoothed window streams of 100 windows each: per-position mean of a vector and the seven before it, normalised."""
    e = table(spark, sf_dir, "embeddings").select(
        F.floor(F.col("vec_id") / PER_STREAM).cast("string").alias("stream_id"), (F.col("vec_id") % PER_STREAM).alias("window_ord"), "vec_id", "label", F.col("embedding").cast("array<double>").alias("raw")
    )
    w = Window.partitionBy("stream_id").orderBy("window_ord").rowsBetween(-7, 0)
    e = e.withColumn("near", F.collect_list("raw").over(w)).withColumn("smooth", mean(F.col("near")))
    start = F.col("window_ord") * 3.0
    return e.select(
        "stream_id", "window_ord", F.concat(F.lit("w-"), F.col("vec_id").cast("string")).alias("window_id"), start.alias("start_time"), (start + 3.0).alias("end_time"), normalised(F.col("smooth")).alias("visual_embedding"),
        F.concat(F.lit("label "), F.col("label").cast("string"), F.lit(" window "), F.col("window_ord").cast("string")).alias("summary_text"), F.when(F.col("vec_id") % 7 != 0, F.col("raw")).alias("summary_embedding"), F.concat(F.lit("label_"), F.col("label").cast("string")).alias("task_type"), "raw",
    )


def questions(streams: DataFrame) -> DataFrame:
    """Six questions a stream, the last after its end, each made of one window. So they are read off the windows, without a join."""
    at = {(k * 17 + 5) % PER_STREAM: k for k in range(6)}
    number = F.element_at(F.create_map(*[F.lit(x) for o, k in at.items() for x in (o, k)]), F.col("window_ord").cast("int"))
    q = streams.where(F.col("window_ord").isin(*at)).withColumn("k", number)
    letter = F.element_at(F.array(*map(F.lit, "ABCD")), ((F.col("stream_id").cast("int") + F.col("k")) % 4) + 1)
    return q.select(
        "stream_id", F.concat_ws("-", "stream_id", F.col("k").cast("string")).alias("question_id"), ((F.col("k") + 1) * 57.0 + 0.5).alias("t_seconds"), F.col("visual_embedding").alias("query_vis_emb"), F.col("raw").alias("query_txt_emb"),
        letter.alias("answer"), F.array(*[F.concat(F.lit(f"{x}. choice "), F.col("k").cast("string")) for x in "ABCD"]).alias("options"), "task_type", F.concat(F.lit("What happens at "), F.col("k").cast("string"), F.lit("?")).alias("question"),
    )


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One frame stream for each user of events."""
    rn = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("stream_id"), rn.cast("long").alias("frame_idx"), (rn / 2.0).alias("ts"))


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evaluation records from labels and documents."""
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    return rows.select(
        F.col("doc_id").cast("string").alias("question_id"), F.when(F.col("doc_id") % 11 != 0, F.col("lang")).alias("task_type"), F.struct((F.col("quality") == 1).alias("correct")).alias("hierarchical"), F.struct((F.col("toxic") == 0).alias("correct")).alias("baseline"), "doc_id"
    )


def retrieval(spark: SparkSession, sf_dir: str, config=CONFIG) -> Retrieval:
    """The pipeline over the canonical stream. Its queries share it, as long as the table is the same and what was staged is still there."""
    key = (spark.sparkContext.applicationId, sf_dir, config)
    now = stamp(spark, f"{sf_dir}/embeddings.parquet")
    before, kept = _KEPT.get(key, (None, None))
    if before != now or not all(exists(spark, p) for p in kept.written()):
        base = staged(windows(spark, sf_dir), "stream")
        _KEPT[key] = now, Retrieval(questions(base), base, config)
    return _KEPT[key][1]


def persistence_log(r: Retrieval) -> DataFrame:
    """Each window written as recent; promoted ones again as episodic, with a new summary and a start time that must not count."""
    first = r.windows.select("window_id", "stream_id", "window_ord", F.lit(0).alias("seq"), "start_time", "end_time", F.lit("recent").alias("tier"), "summary_text")
    second = r.gate.where("promoted").select("window_id", "stream_id", "window_ord", F.lit(1).alias("seq"), (F.col("start_time") + 999).alias("start_time"), "end_time", F.lit("episodic").alias("tier"), F.concat(F.lit("kept "), "summary_text").alias("summary_text"))
    return first.unionByName(second)
