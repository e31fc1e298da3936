"""Coarse-to-fine retrieval over the memory's state at each question: recent, events, episodes, grounding, pins."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import Config
from ..deploy import ship
from ..functions.vector import cosine, max_similarity
from ..sources.staging import drop_staged, staged
from . import memory

Q = ["stream_id", "question_id"]
#: What the memory keeps of a window.
WINDOW = ["stream_id", "window_ord", "window_id", "start_time", "end_time", "visual_embedding", "summary_text", "summary_embedding"]


def query_time(config: Config) -> Column:
    """Infinite for questions after the stream's end, or their own time where late ones are to be clamped."""
    late = F.lit(float("inf")) if config.late_query_time == "inf" else F.col("t_seconds")
    return F.when(F.col("fired_ord").isNull(), late).otherwise(F.col("stream_time"))


def decay(start: Column, end: Column, at: Column, span: Column, tau_fraction: float) -> Column:
    gap = F.least(F.abs(at - start), F.abs(at - end))
    return F.when(at.isNull() | ((start <= at) & (at <= end)), F.lit(1.0)).otherwise(F.exp(-gap / F.greatest(span * F.lit(tau_fraction), F.lit(1.0))))


def blended(visual: Column, query_text: Column, summary: Column, fade: Column, config: Config) -> Column:
    """(alpha * visual + beta * cos(text, summary)) * decay; without a summary the visual part alone, not weighted."""
    both = F.lit(config.alpha) * visual + F.lit(config.beta) * cosine(query_text, summary)
    score = F.when(summary.isNull(), visual).otherwise(both) * fade
    return F.when(score == 0, F.lit(0.0)).otherwise(score)


def spans(*tiers: DataFrame) -> DataFrame:
    """Q and span: from the first start to the last end over all tiers, 1 at least."""
    every = reduce(DataFrame.unionByName, [t.select(*Q, "start_time", "end_time") for t in tiers])
    return every.groupBy(*Q).agg(F.greatest(F.max("end_time") - F.min("start_time"), F.lit(1.0)).alias("span"))


def scored(rows: DataFrame, span: DataFrame, vectors: Column, config: Config) -> DataFrame:
    """rows with score; vectors is an array of vectors, of which the most similar counts. What only the score needs is left out of the result, so that
    ranking does not exchange it."""
    rows = rows.join(span, Q)
    fade = decay(F.col("start_time"), F.col("end_time"), query_time(config), F.col("span"), config.tau_fraction)
    score = blended(max_similarity(F.col("query_vis_emb"), vectors), F.coalesce("query_txt_emb", "query_vis_emb"), F.col("summary_embedding"), F.col("decay"), config)
    return rows.withColumn("decay", fade).withColumn("score", score).drop("query_vis_emb", "query_txt_emb", "summary_embedding", "rep_vectors")


def ranked(rows: DataFrame, k: int, *ties: str) -> DataFrame:
    """The first k of each question by score, ties in the given order; rank from 1."""
    w = Window.partitionBy(*Q).orderBy(F.col("score").desc(), *ties)
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def coarse(rows: DataFrame, top_m: int) -> DataFrame:
    """Events scored: the top_m, of which the last gives way to the newest event where that is not among them."""
    if top_m <= 0:
        return rows.withColumn("rank", F.lit(0)).where("false")
    w = Window.partitionBy(*Q)
    rows = rows.withColumn("rank", F.row_number().over(w.orderBy(F.col("score").desc(), "event_ord"))).withColumn("newest", F.row_number().over(w.orderBy(F.col("end_time").desc(), "event_ord")) == 1)
    rows = rows.withColumn("newest_in", F.max(F.col("newest") & (F.col("rank") <= top_m)).over(w))
    kept = rows.where((F.col("rank") < top_m) | F.col("newest") | ((F.col("rank") == top_m) & F.col("newest_in")))
    return kept.withColumn("rank", F.least("rank", F.lit(top_m)))


def gated(eps: DataFrame, ranges: DataFrame, recent_n: int) -> DataFrame:
    """Episodes that touch a range of their question, then its last recent_n episodes, with place (order of candidates) and via.
    Where there is no range, or no candidate at all, all episodes."""
    near = ranges.select(*Q, F.col("start_time").alias("from"), F.col("end_time").alias("to"))
    hit = eps.join(near, (eps["stream_id"] == near["stream_id"]) & (eps["question_id"] == near["question_id"]) & (eps["start_time"] <= near["to"]) & (eps["end_time"] >= near["from"]), "left_semi").select(*Q, "episode_ord", F.lit(True).alias("in_range"))
    any_range = ranges.select(*Q).distinct().withColumn("has_range", F.lit(True))
    w = Window.partitionBy(*Q)
    rows = eps.join(hit, [*Q, "episode_ord"], "left").join(any_range, Q, "left")
    rows = rows.withColumn("in_range", F.coalesce("in_range", F.lit(False))).withColumn("in_tail", F.row_number().over(w.orderBy(F.col("episode_ord").desc())) <= recent_n)
    rows = rows.withColumn("none", F.col("has_range").isNull() | ~F.max(F.col("in_range") | F.col("in_tail")).over(w))
    via = F.when(F.col("none"), "all").when(F.col("in_range"), "range").otherwise("tail")
    place = F.when(F.col("none") | F.col("in_range"), 0).otherwise(1)
    return rows.where(F.col("none") | F.col("in_range") | F.col("in_tail")).withColumn("via", via).withColumn("place", place).drop("has_range", "none", "in_range", "in_tail")


def grounded(recent_hits: DataFrame, archive: DataFrame, pinned: DataFrame) -> DataFrame:
    """Recent hits by rank, then archive windows by (rank of the episode, seq), but pinned ones; each once, where first named; rank from 1."""
    rows = recent_hits.select(*Q, "window_id", F.lit(0).alias("a"), F.col("rank").alias("b"), F.lit(0).alias("c")).unionByName(archive.select(*Q, "window_id", F.lit(1).alias("a"), F.col("rank").alias("b"), F.col("seq").alias("c")))
    once = rows.groupBy(*Q, "window_id").agg(F.min(F.struct("a", "b", "c")).alias("at")).join(pinned.select(*Q, "window_id"), [*Q, "window_id"], "left_anti")
    return once.withColumn("rank", F.row_number().over(Window.partitionBy(*Q).orderBy("at"))).select(*Q, "window_id", "rank", F.col("at.a").alias("from_archive"))


class Retrieval:
    """All stages of one configuration, each worked out on first use. What several stages read is staged as a table, so that plans stay small; the rest
    are lazy DataFrames. drop() deletes what was staged.

    summarise (rows to rows with another summary_text) and encode (a UDF from text to vector) take the place of the built-in templates of episodes and
    events; where encode gives nothing, the built-in summary embedding stays. A summary that is null or empty leaves the template's."""

    def __init__(self, questions: DataFrame, windows: DataFrame, config: Config, summarise: Callable[[DataFrame], DataFrame] | None = None, encode: Callable[[Column], Column] | None = None) -> None:
        self.config, self.questions, self._windows, self.summarise, self.encode = config, questions, windows, summarise, encode
        self._written: list[DataFrame] = []
        ship(windows.sparkSession)  # the workers compare vectors with the package's own functions

    def _staged(self, df: DataFrame, tag: str) -> DataFrame:
        out = staged(df, tag)
        if out is not df:  # what the caller staged is the caller's to delete
            self._written.append(out)
        return out

    def written(self) -> list[str]:
        """The paths that the stages worked out so far are read from."""
        return [d._tm_staged for d in (self._windows, *self._written) if hasattr(d, "_tm_staged")]

    def drop(self) -> None:
        """Delete the staged tables; the stages are worked out anew when they are next used."""
        drop_staged(*self._written)
        self._written = []
        for name in [n for n in vars(self) if isinstance(getattr(type(self), n, None), cached_property)]:
            delattr(self, name)

    def _told(self, rows: DataFrame) -> DataFrame:
        """Rows with summaries and their embeddings by the given functions, where there are any."""
        if self.summarise is not None:
            made = self.summarise(rows.withColumn("_template", F.col("summary_text")))
            rows = made.withColumn("summary_text", F.coalesce(F.nullif("summary_text", F.lit("")), F.col("_template"))).drop("_template")
        if self.encode is not None:
            rows = rows.withColumn("summary_embedding", F.coalesce(self.encode(F.col("summary_text")), F.col("summary_embedding")))
        return rows

    @cached_property
    def windows(self) -> DataFrame:
        return self._staged(self._windows, "windows")

    @cached_property
    def fired(self) -> DataFrame:
        return memory.firing(self.questions, self.windows)

    @cached_property
    def gate(self) -> DataFrame:
        return self._staged(memory.novelty(self.windows.select(*WINDOW), self.config), "gate")

    @cached_property
    def segmented(self) -> DataFrame:
        promoted, cut = self.gate.where("promoted"), None
        if self.config.cut_on_query:
            promoted, cut = memory.forced_cuts(promoted, self.fired, self.config), "cut"
        return self._staged(memory.segment(promoted, self.config, cut), "segmented")

    @cached_property
    def episodes(self) -> DataFrame:
        return self._staged(self._told(memory.episodes(self.segmented, self.config)), "episodes")

    @cached_property
    def clustered(self) -> DataFrame:
        return self._staged(memory.cluster(self.episodes, self.config), "clustered")

    @cached_property
    def events(self) -> DataFrame:
        return self._staged(self._told(memory.events(self.clustered, self.config)), "events")

    @cached_property
    def state(self) -> DataFrame:
        return self._staged(memory.state_at(self.fired, self.segmented, self.episodes, self.clustered.select("stream_id", "episode_ord", "event_ord"), self.events, self.config), "state")

    @cached_property
    def recent(self) -> DataFrame:
        return memory.recent_at(self.state, self.windows, self.config.recent_capacity)

    @cached_property
    def episodic(self) -> DataFrame:
        closed = memory.episodes_at(self.state, self.episodes)
        return closed if self.config.cut_on_query else closed.unionByName(self._staged(memory.open_at(self.state, self.segmented, self.config), "open"))

    @cached_property
    def long_term(self) -> DataFrame:
        return memory.events_at(self.state, self.events)

    @cached_property
    def span(self) -> DataFrame:
        return self._staged(spans(self.recent, self.episodic, self.long_term), "span")

    @cached_property
    def recent_scored(self) -> DataFrame:
        return scored(self.recent, self.span, F.array("visual_embedding"), self.config)

    @cached_property
    def recent_hits(self) -> DataFrame:
        return self._staged(ranked(self.recent_scored, self.config.top_k, "window_ord"), "recent-hits")

    @cached_property
    def events_scored(self) -> DataFrame:
        vectors = F.when(F.size("rep_vectors") > 0, F.col("rep_vectors")).otherwise(F.array("visual_embedding"))
        return scored(self.long_term, self.span, vectors, self.config)

    @cached_property
    def coarse_hits(self) -> DataFrame:
        return self._staged(coarse(self.events_scored, self.config.top_m), "coarse-hits")

    @cached_property
    def candidates(self) -> DataFrame:
        return gated(self.episodic, self.coarse_hits, self.config.recent_episodes)

    @cached_property
    def episodic_scored(self) -> DataFrame:
        return scored(self.candidates, self.span, F.array("visual_embedding"), self.config)

    @cached_property
    def episodic_hits(self) -> DataFrame:
        return self._staged(ranked(self.episodic_scored, self.config.top_k, "place", "episode_ord"), "episodic-hits")

    @cached_property
    def archive(self) -> DataFrame:
        near = memory.rep_neighbours(self.episodic_hits, self.config.neighbor_radius, (*Q, "rank"))
        return near if self.config.ground_archive else near.where("false")

    @cached_property
    def pinned(self) -> DataFrame:
        return self.recent.where(F.col("window_ord") > F.col("fired_ord") - self.config.pin_n).withColumn("rank", F.row_number().over(Window.partitionBy(*Q).orderBy("window_ord")))

    @cached_property
    def grounded(self) -> DataFrame:
        return grounded(self.recent_hits, self.archive, self.pinned)

    def hits(self) -> DataFrame:
        """stream_id, question_id, stage, rank, entry_id, score of all stages; pinned windows and grounded ones that were not recent hits have no score."""
        recent = self.recent_hits.select(*Q, "window_id", F.col("score").alias("s"))
        ground = self.grounded.join(recent, [*Q, "window_id"], "left")
        parts = [
            self.pinned.select(*Q, F.lit("pinned").alias("stage"), "rank", F.col("window_id").alias("entry_id"), F.lit(None).cast("double").alias("score")),
            self.recent_hits.select(*Q, F.lit("recent"), "rank", "window_id", "score"),
            self.coarse_hits.select(*Q, F.lit("coarse"), "rank", "event_id", "score"),
            self.episodic_hits.select(*Q, F.lit("episodic"), "rank", "episode_id", "score"),
            ground.select(*Q, F.lit("grounded"), "rank", "window_id", "s"),
        ]
        return reduce(DataFrame.union, parts)

    def scores(self) -> DataFrame:
        """Q, entry_id, score: what any scored stage gave; ids of tiers never clash."""
        return reduce(DataFrame.union, [h.select(*Q, F.col(i).alias("entry_id"), "score") for h, i in ((self.coarse_hits, "event_id"), (self.episodic_hits, "episode_id"), (self.recent_hits, "window_id"))])
