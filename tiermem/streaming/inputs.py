"""Input rows of the streaming memory."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def input_rows(windows: DataFrame, questions: DataFrame) -> DataFrame:
    """Windows, questions and one end row for each stream, as the processor takes them."""
    w = windows.select("stream_id", F.lit("window").alias("kind"), F.col("end_time").alias("time"), F.col("window_id").alias("id"), "window_ord", "start_time", "end_time", F.col("visual_embedding").alias("vector"), F.col("summary_embedding").alias("text_vector"))
    none = F.lit(None)
    q = questions.select("stream_id", F.lit("question"), F.col("t_seconds"), "question_id", none.cast("long"), none.cast("double"), none.cast("double"), "query_vis_emb", "query_txt_emb")
    e = windows.groupBy("stream_id").agg(F.lit("end"), F.lit(1e18), F.lit("end"), none.cast("long"), none.cast("double"), none.cast("double"), none.cast("array<double>"), none.cast("array<double>"))
    return w.union(q).union(e)
