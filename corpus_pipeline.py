"""The corpus pipeline: five stages over documents, each a function (spark, docs, sf_dir) whose result is written and read again as the next one's docs.

All but the last return the columns of documents; the last returns the shard manifest. Repeated rows, nulls and empty texts are treated as the
operators' docstrings say, of any length, and other columns do no harm; what a stage drops is a document that its rule rejects, never a row to save work."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tiermem.llm import decontaminate, jaccard, mixing, quality, sharding
from tiermem.llm.common import materialize, release, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rule, or whose host is rejected, go."""
    return quality.judged(docs).where("_q_kept").select(*docs.columns)


#: Words of a shingle, and the least Jaccard similarity of near-duplicates in percent.
NEAR_NGRAM, NEAR_PERCENT = 5, 80


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group that links lead through, one document stays, once: that of the smallest id, or any one where none has an id.

    Decisions go by a hash of id and text, so unlike rows of one id are judged each (a group may lose one and another group keep the other), wholly
    repeated rows stay once, and rows without an id take part. Rows without an id and without words link with nothing and all stay.
    Repeated rows are dropped within each task before texts are exchanged, so that no number of copies meets in one."""
    keyed = docs.withColumn("_p_key", F.xxhash64("doc_id", "text", F.col("doc_id").isNull(), F.col("text").isNull()))
    bare = F.col("doc_id").isNull() & ~F.coalesce("text", F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    linked = jaccard.join(keyed, "_p_key", ngram=NEAR_NGRAM, percent=NEAR_PERCENT).select(F.col("doc_id").alias("_p_key"), F.col("component_id").alias("_p_group"))
    rows = linked.distinct().join(keyed.select("_p_key", F.col("doc_id").alias("_p_id")).distinct(), "_p_key")
    first = rows.groupBy("_p_group").agg(F.min(F.struct(F.col("_p_id").isNull().alias("none"), "_p_id", "_p_key")).alias("_p_first"))
    once = keyed.where(~bare).dropDuplicates(["_p_key"]).join(first.select("_p_first._p_key"), "_p_key", "left_semi")
    return once.select(*docs.columns).union(docs.where(bare))


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item within its error budget go."""
    return decontaminate.matched(docs, table(spark, sf_dir, "benchmark")).where("size(_d_hits) = 0").select(*docs.columns)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix reads it, once at least. The rows of one document are alike: which is of which pass follows from their number."""
    return mixing.mix(docs).select(*docs.columns)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each row of the mix goes: shard and slot, in the order of the mix (its blocks permuted over all sources and passes), with the document's
    columns but its text. Passes are told apart by numbering alike rows, of which there are no more than the mix's repetition limit."""
    alike = Window.partitionBy("doc_id", "source", "_p_text").orderBy("_p_row")
    rows = docs.withColumn("_p_text", F.xxhash64("text")).withColumn("_p_row", F.monotonically_increasing_id())
    rows = rows.select("doc_id", "source", "_p_text", "lang", "n_chars", "_p_row", F.octet_length("text").alias("_p_bytes"), F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("_p_crc"))
    placed = mixing.placed(rows.withColumn("_p_pass", F.row_number().over(alike) - 1), F.col("_p_pass"))
    return sharding.shard_sized(placed, F.concat("_m_key", "_m_order"), F.coalesce("_p_bytes", F.lit(0)), F.col("_p_crc"), carry=("lang", "source", "n_chars"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("benchmark_decontamination", benchmark_decontamination),
    ("source_mixing", source_mixing),
    ("shards", shards),
]

#: Models of edit distance and sampled splitters have no SQL form; the pipeline is tested against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, every result but the last written to the shared folder in between."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
        release(spark)
    return STAGES[-1][1](spark, docs, sf_dir)
