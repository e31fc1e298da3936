"""A whole run: retrieve, format, answer and judge with the memory and with the baseline."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import baseline, evaluation, evidence
from .models import Answerer, answerer
from .retrieval import Q, Retrieval


def _asked(fired: DataFrame, rows: DataFrame, answer: Answerer) -> DataFrame:
    """Every question with its evidence, also one without any, answered."""
    return answer(fired.select(*Q, "question", "options", "answer").join(evidence.text_block(rows, fired), Q))


def hierarchical(r: Retrieval, answer: Answerer) -> DataFrame:
    return _asked(r.fired, evidence.described(r), answer)


def recent_only(r: Retrieval, answer: Answerer, last_ord: int | None = None) -> DataFrame:
    return _asked(r.fired, evidence.shown(baseline.described(r.fired, r.windows, r.config, last_ord), r.config), answer)


def records(r: Retrieval, answer: Answerer | None = None, last_ord: int | None = None) -> DataFrame:
    """One prediction record for each question. last_ord: see baseline.context()."""
    answer = answer or answerer()
    judge = lambda rows, name: rows.select(*Q, evaluation.judged(F.col("prediction"), F.col("answer")).alias(name))
    both = judge(hierarchical(r, answer), "hierarchical").join(judge(recent_only(r, answer, last_ord), "baseline"), Q)
    return r.fired.select(*Q, "task_type", "question", "t_seconds", "stream_time", "options").join(both, Q).withColumn("clip_id", F.col("stream_id"))
