"""Count-based windows over ordered frames."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KEY, ORD = "stream_id", "frame_idx"


def frame_step(video_fps: float, fps: float) -> int:
    """Every how many-th frame is kept; unknown video_fps counts as 30."""
    return max(1, int(round((video_fps or 30.0) / fps)))


def subsample(frames: DataFrame, video_fps: float, fps: float) -> DataFrame:
    return frames.where(F.col(ORD) % frame_step(video_fps, fps) == 0)


def frames_per_window(fps: float, duration: float) -> int:
    return max(1, int(fps * duration))


def count_windows(frames: DataFrame, video_fps: float, fps: float, duration: float) -> DataFrame:
    """stream_id, window_ord, window_id, start_time, end_time, n_frames, partial, frame_ids, rep_frame_id.

    The sampled frames of a stream have places idx / step, so the window of a frame needs no ranking: one aggregation by (stream, window), and
    streams of any length are spread over tasks. Needs frame_idx to be gapless from 0, as a decoder gives it."""
    step, k, rate = frame_step(video_fps, fps), frames_per_window(fps, duration), float(video_fps or 30.0)
    ends = frames.groupBy(KEY).agg(F.max(ORD).alias("last_idx"))
    kept = frames.where(F.col(ORD) % step == 0).withColumn("window_ord", F.floor(F.col(ORD) / (step * k)).cast("long"))
    rows = kept.groupBy(KEY, "window_ord").agg(F.count("*").alias("n_frames"), F.max(ORD).alias("last_sampled"), F.sort_array(F.collect_list(ORD)).alias("frame_ids"))
    full = F.col("n_frames") == k
    end = F.when(full, (F.col("last_sampled") + 1) / rate).otherwise((F.col("last_idx") + 1) / rate)
    start = F.when(F.col("window_ord") == 0, F.lit(0.0)).otherwise(((F.col("window_ord") * k - 1) * step + 1) / rate)
    return rows.join(ends, KEY).select(
        KEY, "window_ord", F.concat(F.lit("w-"), F.col(KEY).cast("string"), F.lit("-"), F.col("window_ord").cast("string")).alias("window_id"),
        F.bround(start, 2).alias("start_time"), F.bround(end, 2).alias("end_time"), "n_frames", (~full).alias("partial"), "frame_ids", F.get("frame_ids", F.floor(F.col("n_frames") / 2).cast("int")).alias("rep_frame_id"),
    )


def with_duration(windows: DataFrame) -> DataFrame:
    return windows.withColumn("duration", F.col("end_time") - F.col("start_time"))


def entries(windows: DataFrame, tier: str = "recent") -> DataFrame:
    """Raw windows as entries: ids and times, an embedding and a caption where the input has them, the tier; the frame list is dropped."""
    has = set(windows.columns)
    pick = lambda c, kind: F.col(c) if c in has else F.lit(None).cast(kind).alias(c)
    return windows.select(KEY, "window_ord", "window_id", "start_time", "end_time", pick("visual_embedding", "array<double>"), pick("summary_text", "string"), pick("summary_embedding", "array<double>"), pick("frame", "binary"), F.lit(tier).alias("tier"))


def ranked_windows(frames: DataFrame, video_fps: float, fps: float, duration: float) -> DataFrame:
    """The window number of each sampled frame where frame_idx may have gaps: by rank in the stream."""
    k = frames_per_window(fps, duration)
    rn = F.row_number().over(Window.partitionBy(KEY).orderBy(ORD))
    return subsample(frames, video_fps, fps).withColumn("window_ord", F.floor((rn - 1) / k).cast("long"))
