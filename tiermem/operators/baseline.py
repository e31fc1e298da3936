"""The recent-window baseline: the last n windows, exact cosine, no decay and no text."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import Config
from ..functions.vector import cosine
from . import memory
from .retrieval import Q, ranked


def context(fired: DataFrame, windows: DataFrame, config: Config, last_ord: int | None = None) -> DataFrame:
    """The retained windows at each question, by their ordinals. The buffer is never drained: after the stream's end it holds the last ones, that is those
    up to last_ord where all streams are of one given length, else up to each stream's own last window."""
    if last_ord is not None:
        open_ = fired.withColumn("fired_ord", F.coalesce("fired_ord", F.lit(last_ord).cast("long")))
    else:
        last = windows.groupBy("stream_id").agg(F.max("window_ord").alias("last_ord"))
        open_ = fired.join(last, "stream_id").withColumn("fired_ord", F.coalesce("fired_ord", "last_ord")).drop("last_ord")
    return memory.recent_at(open_, windows, config.baseline_windows)


def top_k(fired: DataFrame, windows: DataFrame, config: Config, last_ord: int | None = None) -> DataFrame:
    rows = context(fired, windows, config, last_ord).withColumn("score", cosine(F.col("query_vis_emb"), F.col("visual_embedding")))
    return ranked(rows, config.baseline_k, "window_ord")


def described(fired: DataFrame, windows: DataFrame, config: Config, last_ord: int | None = None) -> DataFrame:
    """The baseline's evidence, as evidence.described() has it: the newest pin_n windows as pinned, in order of time, and the top hits as grounded,
    also those that are pinned."""
    cols = [*Q, "rank", F.col("window_id").alias("entry_id"), "start_time", "end_time", "summary_text", "visual_embedding"]
    newest = Window.partitionBy(*Q).orderBy(F.col("window_ord").desc())
    pins = context(fired, windows, config, last_ord).withColumn("back", F.row_number().over(newest)).where(F.col("back") <= max(config.pin_n, 0))
    pins = pins.withColumn("rank", F.row_number().over(Window.partitionBy(*Q).orderBy("window_ord"))).select(F.lit("pinned").alias("stage"), *cols, F.lit(None).cast("double").alias("score"))
    return pins.unionByName(top_k(fired, windows, config, last_ord).select(F.lit("grounded").alias("stage"), *cols, "score"))


def stats(fired: DataFrame, windows: DataFrame, config: Config, last_ord: int | None = None) -> DataFrame:
    return context(fired, windows, config, last_ord).groupBy(*Q).agg(F.count("*").alias("recent"), F.lit(config.baseline_windows).alias("capacity"))
