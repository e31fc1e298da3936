"""Scoring of answers: correctness, accuracy, paired outcomes, groups; choice of runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import first_letter

#: SQL conditions of a correct answer by either system.
H, B = "hierarchical.correct", "baseline.correct"


def judged(prediction: Column, answer: Column) -> Column:
    letter = first_letter(prediction)
    return F.struct(prediction.alias("prediction"), letter.alias("pred_letter"), answer.alias("ground_truth"), (letter == answer).alias("correct"))


def _ratio(part: Column, n: Column) -> Column:
    """Rounded to four places; null for no records."""
    return F.when(n > 0, F.bround(part / n, 4))


def accuracy(records: DataFrame) -> DataFrame:
    """One row, also for no records at all."""
    rows = records.agg(F.count("*").alias("n_qas"), F.count_if(F.col(H)).alias("hier_correct"), F.count_if(F.col(B)).alias("base_correct"))
    n = F.col("n_qas")
    return rows.select("n_qas", "hier_correct", "base_correct", _ratio(F.col("hier_correct"), n).alias("hier_accuracy"), _ratio(F.col("base_correct"), n).alias("base_accuracy"), _ratio(F.col("hier_correct") - F.col("base_correct"), n).alias("delta_accuracy"))


def paired(records: DataFrame) -> DataFrame:
    return records.agg(F.count_if(F.expr(f"{H} and not {B}")).alias("hierarchical_only"), F.count_if(F.expr(f"{B} and not {H}")).alias("baseline_only"), F.count_if(F.expr(f"{H} and {B}")).alias("both_correct"), F.count_if(F.expr(f"not {H} and not {B}")).alias("both_wrong"))


def by_task(records: DataFrame) -> DataFrame:
    task = F.coalesce(F.nullif(F.col("task_type"), F.lit("")), F.lit("unknown"))
    rows = records.groupBy(task.alias("task_type")).agg(F.count("*").alias("n"), F.count_if(F.col(H)).alias("h"), F.count_if(F.col(B)).alias("b"))
    return rows.select("task_type", "n", _ratio(F.col("h"), F.col("n")).alias("hierarchical_accuracy"), _ratio(F.col("b"), F.col("n")).alias("baseline_accuracy")).orderBy("task_type")


def flat(records: DataFrame, videos: int | Column) -> DataFrame:
    """The seven scalar figures of a run."""
    return accuracy(records).withColumn("videos_completed", videos if isinstance(videos, Column) else F.lit(videos))


def selected(manifest: DataFrame, order: str, sample_ids: list[int] | None = None, keys: list[str] | None = None, limit: int | None = None) -> DataFrame:
    """Manifest rows by sample id and key, then the first limit of them in order."""
    if sample_ids is not None:
        manifest = manifest.where(F.col("sample_id").isin(sample_ids))
    if keys is not None:
        manifest = manifest.where(F.col("video_key").isin(keys))
    return manifest if limit is None else manifest.orderBy(order).limit(limit)


def unfinished(manifest: DataFrame, done: DataFrame, key: str) -> DataFrame:
    return manifest.join(done.select(key).distinct(), key, "left_anti")


def sampled(rows: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """n rows by a seeded hash of their key; all if there are no more."""
    return rows.orderBy(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string")).cast("binary")), key).limit(n)
