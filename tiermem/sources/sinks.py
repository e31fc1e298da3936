"""Writers of results, run logs, summaries, traces and clip bundles."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import fixed
from ..operators import evaluation


def per_clip(records: DataFrame, path: str, key: str = "clip_id") -> None:
    """JSON lines in one folder for each clip; clips written again are replaced, others stay."""
    records.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).json(path)


def run_log(records: DataFrame, path: str, key: str = "clip_id") -> None:
    """One JSON row for each clip, appended."""
    rows = records.groupBy(key).agg(F.count("*").alias("n_qas"), F.count_if(F.col("hierarchical.correct")).alias("hier_correct"), F.count_if(F.col("baseline.correct")).alias("base_correct"))
    rows.withColumn("logged_at", F.current_timestamp()).write.mode("append").json(path)


def write_text(spark: SparkSession, path: str, content: str) -> None:
    """One small driver-side file, by Hadoop's file systems, so that any path Spark knows will do."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(p, True)
    try:
        out.write(bytearray(content.encode()))
    finally:
        out.close()


def write_json(spark: SparkSession, path: str, value) -> None:
    write_text(spark, path, json.dumps(value, indent=2, ensure_ascii=False, default=str) + "\n")


def summary(records: DataFrame) -> dict:
    """Totals, paired outcomes and task types as a dictionary: aggregates of a few rows. No records give zero counts."""
    tasks = {r["task_type"]: {k: r[k] for k in ("n", "hierarchical_accuracy", "baseline_accuracy")} for r in evaluation.by_task(records).collect()}
    return {**evaluation.accuracy(records).first().asDict(), "paired": evaluation.paired(records).first().asDict(), "by_task_type": tasks}


def summary_markdown(found: dict) -> str:
    share = lambda x: "n/a" if x is None else f"{100 * x:.1f} %"
    rows = [f"# Results over {found['n_qas']} questions", "", "| system | correct | accuracy |", "|---|---|---|", f"| hierarchical | {found['hier_correct']} | {share(found['hier_accuracy'])} |", f"| recent windows | {found['base_correct']} | {share(found['base_accuracy'])} |", "", "| paired outcome | questions |", "|---|---|"]
    rows += [f"| {k.replace('_', ' ')} | {v} |" for k, v in found["paired"].items()]
    rows += ["", "| task type | n | hierarchical | recent windows |", "|---|---|---|---|"] + [f"| {k} | {v['n']} | {share(v['hierarchical_accuracy'])} | {share(v['baseline_accuracy'])} |" for k, v in found["by_task_type"].items()]
    return "\n".join(rows) + "\n"


def save_summary(spark: SparkSession, records: DataFrame, path: str) -> dict:
    found = summary(records)
    write_json(spark, f"{path}/summary.json", found)
    write_text(spark, f"{path}/summary.md", summary_markdown(found))
    return found


def trace(blocks: DataFrame, fired: DataFrame, path: str) -> None:
    """One Markdown block for each question, in order of stream time."""
    keys = ["stream_id", "question_id"]
    rows = blocks.join(fired.select(*keys, "t_seconds"), keys).orderBy("stream_id", "t_seconds", "question_id")
    rows.select(F.concat(F.lit("## "), F.col("question_id"), F.lit(" at "), fixed(F.col("t_seconds"), 1), F.lit("s\n\n```\n"), F.col("text"), F.lit("\n```\n")).alias("value")).write.mode("overwrite").text(path)


def clip_bundles(annotations: DataFrame, path: str) -> None:
    """qas rows and manifest rows of each sample (sample_id, qas) as JSON under path."""
    annotations.write.mode("overwrite").partitionBy("sample_id").json(f"{path}/qas")
    manifest = annotations.select("sample_id", F.concat(F.lit("clip_"), F.col("sample_id").cast("string")).alias("video_key"), F.size("qas").alias("n_qas"))
    manifest.write.mode("overwrite").json(f"{path}/manifest")
