"""Evidence of a question's hits: text lines, the structured input of an answering model, frames."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import Config
from ..functions.text import fixed
from .retrieval import Q, Retrieval

RULE = "=" * 64
# our own section headings
SECTIONS = {"pinned": "[Pinned: newest windows of the stream]", "coarse": "[Coarse: events]", "episodic": "[Fine: episodes]", "grounded": "[Grounding: windows]"}
ORDER = ("pinned", "coarse", "episodic", "grounded")


def described(r: Retrieval) -> DataFrame:
    """The hits of all sections with times, summary, vector and score, and whether the configuration shows their section."""
    windows = r.windows.select("stream_id", "window_id", "start_time", "end_time", "summary_text", "visual_embedding")
    recent = r.recent_hits.select(*Q, "window_id", "score")
    ground = r.grounded.join(recent, [*Q, "window_id"], "left").join(windows, ["stream_id", "window_id"])
    cols = lambda stage, i: [*Q, F.lit(stage).alias("stage"), "rank", F.col(i).alias("entry_id"), "start_time", "end_time", "summary_text", "visual_embedding"]
    parts = [r.pinned.select(*cols("pinned", "window_id"), F.lit(None).cast("double").alias("score"))]
    parts.append(r.coarse_hits.select(*cols("coarse", "event_id"), "score"))
    parts.append(r.episodic_hits.select(*cols("episodic", "episode_id"), "score"))
    parts.append(ground.select(*cols("grounded", "window_id"), "score"))
    return shown(reduce(DataFrame.union, parts), r.config)


def shown(rows: DataFrame, config: Config) -> DataFrame:
    hidden = [s for s, on in (("coarse", config.include_coarse), ("episodic", config.include_episodic)) if not on]
    return rows.withColumn("shown", ~F.col("stage").isin(*hidden) if hidden else F.lit(True))


def line() -> Column:
    note = F.coalesce(F.concat(F.lit("  "), F.nullif(F.col("summary_text"), F.lit(""))), F.lit(""))
    score = F.when(F.col("stage").isin("coarse", "episodic"), F.concat(F.lit(" sim="), F.coalesce(fixed(F.col("score"), 3), F.lit("—")))).when(F.col("stage") == "grounded", F.coalesce(F.concat(F.lit(" sim="), fixed(F.col("score"), 3)), F.lit(""))).otherwise(F.lit(""))
    return F.concat(F.lit("  ["), fixed(F.col("start_time"), 1), F.lit("–"), fixed(F.col("end_time"), 1), F.lit("s]"), score, note)


def lines(rows: DataFrame) -> DataFrame:
    return rows.where("shown").select(*Q, "stage", "rank", line().alias("line"))


def text_block(rows: DataFrame, questions: DataFrame) -> DataFrame:
    """Q and text for every question (columns Q, question): the question, then a heading and the lines of each shown section that has any, in order of
    sections and ranks. A question without hits has a block too."""
    place = F.array_position(F.array(*map(F.lit, ORDER)), F.col("stage"))
    heading = F.element_at(F.create_map(*[F.lit(x) for k in ORDER for x in (k, SECTIONS[k])]), F.col("stage"))
    body = rows.where("shown").groupBy(*Q, "stage").agg(F.sort_array(F.collect_list(F.struct("rank", line().alias("line")))).alias("x")).select(*Q, F.struct(place.alias("p"), F.concat(F.lit("\n"), heading, F.lit("\n"), F.array_join(F.col("x.line"), "\n")).alias("t")).alias("s"))
    whole = body.groupBy(*Q).agg(F.array_join(F.sort_array(F.collect_list("s"))["t"], "\n").alias("body"))
    head = F.concat(F.lit(RULE + "\nQUERY: "), F.coalesce("question", F.lit("")), F.lit("\n" + RULE + "\n"))
    return questions.select(*Q, "question").join(whole, Q, "left").select(*Q, F.concat(head, F.coalesce(F.concat("body", F.lit("\n")), F.lit("")), F.lit(RULE)).alias("text"))


# fixed values: what the structured input calls its sources
SOURCES = {"pinned": "pinned_recent", "episodic": "episodic", "grounded": "grounding_window"}


def llm_input(rows: DataFrame, questions: DataFrame) -> DataFrame:
    """For every question: query, query_embedding, visual_context (pinned, episodic if shown, grounded; coarse hits are text only), text_context, the
    number of visual tokens, and how many coarse and episodic hits there are, shown or not."""
    place = F.array_position(F.array(*map(F.lit, SOURCES)), F.col("stage"))
    source = F.element_at(F.create_map(*[F.lit(x) for kv in SOURCES.items() for x in kv]), F.col("stage"))
    token = F.struct(place.alias("place"), "rank", source.alias("source"), F.array(F.bround("start_time", 2), F.bround("end_time", 2)).alias("time_range"), F.size("visual_embedding").alias("embedding_dim"), F.col("visual_embedding").alias("embedding"), F.col("summary_text").alias("summary"), "score")
    seen = (F.col("stage") != "coarse") & F.col("shown")
    made = rows.groupBy(*Q).agg(
        F.sort_array(F.collect_list(F.when(seen, token))).alias("visual_context"), F.count_if(seen).alias("n_visual_tokens"),
        F.count_if(F.col("stage") == "coarse").alias("coarse_event_count"), F.count_if(F.col("stage") == "episodic").alias("episodic_hit_count"),
    )
    named = questions.select(*Q, F.col("question").alias("query"), F.coalesce("query_txt_emb", "query_vis_emb").alias("query_embedding"))
    none = F.expr(f"cast(array() as {made.schema['visual_context'].dataType.simpleString()})")
    out = named.join(made, Q, "left").join(text_block(rows, questions).withColumnRenamed("text", "text_context"), Q)
    zero = F.lit(0).cast("long")
    return out.select(*Q, "query", "query_embedding", F.coalesce("visual_context", none).alias("visual_context"), "text_context", *[F.coalesce(c, zero).alias(c) for c in ("n_visual_tokens", "coarse_event_count", "episodic_hit_count")])


def frames(grounded: DataFrame, pinned: DataFrame, max_frames: int) -> DataFrame:
    """Q, slot, window_id, source: windows that have a frame, grounded ones first, then the newest pinned ones, these in order of time.
    Both sides need rank and has_frame."""
    most = max(1, int(max_frames))
    rows = grounded.where("has_frame").select(*Q, "window_id", F.lit(0).alias("g"), F.col("rank").alias("r"), "rank").unionByName(pinned.where("has_frame").select(*Q, "window_id", F.lit(1).alias("g"), (-F.col("rank")).alias("r"), "rank"))
    once = rows.groupBy(*Q, "window_id").agg(F.min(F.struct("g", "r", "rank")).alias("at"))
    w = Window.partitionBy(*Q)
    picked = once.withColumn("n", F.row_number().over(w.orderBy("at"))).where(F.col("n") <= most)
    return picked.withColumn("slot", F.row_number().over(w.orderBy("at.g", "at.rank"))).select(*Q, "slot", "window_id", F.when(F.col("at.g") == 0, "grounding_window").otherwise("pinned_recent").alias("source"))


def image_lines(slots: DataFrame, windows: DataFrame) -> DataFrame:
    rows = slots.join(windows.select("stream_id", "window_id", "start_time", "end_time"), ["stream_id", "window_id"])
    one = F.concat(F.lit("  Image "), F.col("slot").cast("string"), F.lit(": ["), fixed(F.col("start_time"), 1), F.lit("–"), fixed(F.col("end_time"), 1), F.lit("s] ("), F.col("source"), F.lit(")"))
    return rows.select(*Q, "slot", one.alias("line"))


def prompt(text: Column, question: Column, options: Column) -> Column:
    """The evidence, the question, its options and how to answer, in our own words."""
    choices = F.when(F.size(options) > 0, F.concat(F.lit("\nChoices:\n"), F.array_join(options, "\n"), F.lit("\nReply with one letter."))).otherwise(F.lit(""))
    return F.concat(F.lit("Evidence:\n"), text, F.lit("\n\nQuestion: "), question, choices)
