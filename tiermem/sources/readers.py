"""Readers of question files, manifests, results and frames, with fixed schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions import text


def binary_frames(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Frame files stream/000123.jpg as frames: the folder names the stream, the digits of the file its place. A missing path is an error."""
    rows = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return rows.select(F.element_at(F.split("path", "/"), -2).alias("stream_id"), F.regexp_extract("path", r"(\d+)\.[A-Za-z]+$", 1).try_cast("long").alias("frame_idx"), F.lit(None).cast("double").alias("ts"), F.col("content").alias("payload"))


def qa_json(spark: SparkSession, path: str) -> DataFrame:
    """Questions of JSON files {"sample_id", "video", "qas": [...]}, with t_seconds, in order of it (column place)."""
    rows = spark.read.schema(schemas.QA_FILE).option("multiLine", True).json(path).select(F.col("sample_id").cast("string").alias("stream_id"), F.posexplode("qas").alias("i", "q"))
    return _timed(rows.select("stream_id", "i", "q.*"))


def qa_lines(spark: SparkSession, path: str, stream: str) -> DataFrame:
    """Questions of JSON lines in the long-video flavour."""
    rows = spark.read.schema(schemas.QA_LINES).json(path).where("uid is not null")
    rows = rows.select(F.lit(stream).alias("stream_id"), F.monotonically_increasing_id().alias("i"), F.col("uid").alias("question_id"), text.task_name(F.col("question_type")).alias("task_type"), "question", "time_stamp", "answer", "options")
    return _timed(rows)


def _timed(rows: DataFrame) -> DataFrame:
    from pyspark.sql import Window

    rows = rows.withColumn("time_stamp", F.coalesce("time_stamp", F.lit("00:00:00"))).withColumn("t_seconds", text.hms_seconds(F.col("time_stamp")))
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("stream_id").orderBy("t_seconds", "i"))).drop("i")


def raw_qa(spark: SparkSession, path: str) -> DataFrame:
    """Raw long-video questions converted: stem and options split, the end of the time range, joined types."""
    rows = spark.read.schema(schemas.QA_LINES).json(path).where("uid is not null")
    return rows.select(
        F.col("uid").alias("question_id"), text.task_name(F.col("question_type")).alias("task_type"), text.question_stem(F.col("question")).alias("question"), text.range_end(F.coalesce("time_reference", F.lit("00:00:00"))).alias("time_stamp"), "answer", text.question_options(F.col("question")).alias("options")
    )


def meta_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines of the given schema; blank lines are skipped."""
    rows = spark.read.text(path).where("trim(value) <> ''")
    return rows.select(F.from_json("value", schema).alias("r")).select("r.*")


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of entries, in file order for one file (column place)."""
    rows = spark.read.text(path, wholetext=True).select(F.posexplode(F.from_json("value", f"array<struct<{', '.join(f'{a}: {b}' for a, b in (x.split() for x in schemas.MANIFEST.split(', ')))}>>")).alias("place", "r"))
    return rows.select("place", "r.*")


def results(spark: SparkSession, glob: str) -> DataFrame:
    """Prediction records of all result files, with clip_id from the folder that names it, as the sink writes it, else from the file's name."""
    rows = spark.read.schema(schemas.RECORD).json(glob)
    return rows.withColumn("clip_id", F.coalesce(F.nullif(F.regexp_extract(F.input_file_name(), r"/clip_id=([^/]+)/", 1), F.lit("")), F.regexp_extract(F.input_file_name(), r"([^/]+)\.jsonl?$", 1)))


def completed(records: DataFrame) -> DataFrame:
    return records.agg(F.count_distinct("clip_id").alias("videos_completed"))


def grouped_annotations(rows: DataFrame, first: int = 1, last: int = 50) -> DataFrame:
    """Annotation rows by sample id, first to last: sample_id and qas (array of structs in order of question_id)."""
    rows = rows.withColumn("sample_id", text.sample_id(F.col("question_id"))).where(F.col("sample_id").between(first, last))
    q = F.struct("question_id", "task_type", "question", "time_stamp", "answer", text.literal_list(F.col("options")).alias("options"))
    return rows.groupBy("sample_id").agg(F.sort_array(F.collect_list(q)).alias("qas"))


def parquet_stream(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)
