"""The memory's write path as plans: novelty gate, episode and event folds, pooling, state at a question.

A window i of a stream is evicted once i + capacity has come, and is then compared with the windows i + 1 to i + capacity. So everything but two
greedy folds is joins and aggregates, and the state at any question follows from ordinals."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import Config
from ..functions import text
from ..functions.vector import EPS, centroid, cosine, dot, dots, let, matrix, norm, normalised, softmax, total, weighted

KEY = "stream_id"


def _differs(keys: pa.ChunkedArray, blocks: np.ndarray) -> np.ndarray:
    """Whether each row but the first is of another key or block than the one before it."""
    return pc.not_equal(keys.slice(1), keys.slice(0, max(0, len(keys) - 1))).to_numpy() | (blocks[1:] != blocks[:-1])


def novelty(windows: DataFrame, config: Config) -> DataFrame:
    """windows with max_sim (null: no neighbour) and promoted.

    The band is cut into blocks of capacity ordinals: a window is sought for in its own block, and is sent to the block before as well, where it only
    meets earlier ones. So a long stream is spread over many keys. Rows are streamed in order, and all pairs that lie equally far apart in a batch are
    compared at once; only the last block of a batch is held until the next."""
    c = config.recent_capacity

    def compare(rows: pa.Table) -> pa.RecordBatch:
        ords, blocks, own = (rows.column(n).to_numpy() for n in ("window_ord", "block", "own"))
        vectors, sizes = matrix(rows.column("visual_embedding").combine_chunks())
        vectors = np.asfortranarray(vectors)
        lengths = np.sqrt(dots(vectors, vectors))
        group = np.concatenate([[0], np.cumsum(_differs(rows.column(KEY), blocks))])
        best, met = np.full(len(ords), -np.inf), np.zeros(len(ords), dtype=bool)
        for s in range(1, len(ords)):
            same = group[s:] == group[:-s]
            if not same.any():
                break
            ahead = ords[s:] - ords[:-s]
            at = np.flatnonzero(same & own[:-s] & (ahead > 0) & (ahead <= c) & (sizes[:-s] >= 0) & (sizes[s:] == sizes[:-s]))
            sims = dots(vectors[:-s], vectors[s:]) / (lengths[:-s] * lengths[s:] + EPS)
            best[at] = np.maximum(best[at], sims[at])
            met[at] = True
        found = pa.RecordBatch.from_arrays([rows.column(KEY).combine_chunks(), pa.array(ords), pa.array(best, mask=~met)], names=[KEY, "window_ord", "max_sim"])
        return found.filter(pa.array(met))

    def band(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            rows = rows if held is None else pa.concat_tables([held, rows]).combine_chunks()
            ends = np.flatnonzero(_differs(rows.column(KEY), rows.column("block").to_numpy()))
            cut = int(ends[-1]) + 1 if len(ends) else 0
            held = rows.slice(cut)
            if cut:
                yield compare(rows.slice(0, cut))
        if held is not None and held.num_rows:
            yield compare(held)

    at = F.floor(F.col("window_ord") / c)
    rows = windows.where(F.col(KEY).isNotNull() & F.col("window_ord").isNotNull()).select(KEY, F.col("window_ord").cast("long").alias("window_ord"), "visual_embedding", F.explode(F.array(at, at - 1)).alias("block")).withColumn("own", F.col("block") == at)
    sims = rows.repartition(KEY, "block").sortWithinPartitions(KEY, "block", "window_ord").mapInArrow(band, f"{KEY} {windows.schema[KEY].dataType.simpleString()}, window_ord long, max_sim double")
    best = sims.groupBy(KEY, "window_ord").agg(F.max("max_sim").alias("max_sim"))
    return windows.join(best, [KEY, "window_ord"], "left").withColumn("promoted", F.col("max_sim").isNull() | (1 - F.col("max_sim") > config.novelty_threshold))


def novelty_stats(gated: DataFrame) -> DataFrame:
    return gated.groupBy(KEY).agg(F.count("*").alias("n_windows"), F.sum(F.col("promoted").cast("long")).alias("n_promoted"), F.sum((~F.col("promoted")).cast("long")).alias("n_discarded"))


def runs(rows: DataFrame, order: str, max_gap: float, min_sim: float, max_len: int | None, cut: str | None = None) -> DataFrame:
    """stream_id, the order column and run_ord: the greedy fold over (start_time, end_time, visual_embedding) of each stream in that order.

    A row joins the open run if that is shorter than max_len, the gap to its last row is at most max_gap, and the row's cosine with its centroid is
    at least min_sim; else, or where cut is true, it opens the next. Rows are streamed in order, the state is one vector: a stream of any length
    takes a bounded memory, though one task."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream, run, size, total, last = None, -1, 0, None, 0.0
        for batch in batches:
            keys, starts, ends, cuts = (batch.column(i).to_pylist() for i in (0, 2, 3, 5))
            vectors, sizes = matrix(batch.column(4))
            if len(sizes) and ((sizes < 0).any() or (sizes != sizes[0]).any()):
                vectors = [np.asarray(v, dtype=np.float64) for v in batch.column(4).to_pylist()]
            out = []
            for k, s, e, v, c in zip(keys, starts, ends, vectors, cuts, strict=True):
                if k != stream or run < 0:
                    stream, run, join = k, 0, False
                else:
                    join = False
                    if not c and (max_len is None or size < max_len) and s - last <= max_gap:
                        mean = total / size
                        mean = mean / (np.linalg.norm(mean) + EPS)
                        join = float(v @ mean) / (np.linalg.norm(v) * np.linalg.norm(mean) + EPS) >= min_sim
                    run += not join
                size, total = (size + 1, total + v) if join else (1, v)
                last = e
                out.append(run)
            if out:
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.int64())], names=[KEY, order, "run_ord"])

    flagged = rows.select(KEY, order, "start_time", "end_time", "visual_embedding", (F.col(cut) if cut else F.lit(False)).alias("cut"))
    return flagged.repartition(KEY).sortWithinPartitions(KEY, order).mapInArrow(fold, f"{KEY} {rows.schema[KEY].dataType.simpleString()}, {order} long, run_ord long")


def forced_cuts(promoted: DataFrame, firings: DataFrame, config: Config) -> DataFrame:
    """promoted with cut: whether a question came when the windows up to the one before had been evicted, but this had not."""
    points = firings.where("fired_ord is not null").select(KEY, (F.col("fired_ord") - config.recent_capacity).alias("window_ord"), F.lit(0).alias("kind")).distinct()
    both = promoted.select(KEY, "window_ord", F.lit(1).alias("kind")).unionByName(points)
    w = Window.partitionBy(KEY).orderBy("window_ord", F.col("kind").desc())
    point = F.max(F.when(F.col("kind") == 0, F.col("window_ord"))).over(w)
    before = F.max(F.when(F.col("kind") == 1, F.col("window_ord"))).over(w.rowsBetween(Window.unboundedPreceding, -1))
    flags = both.withColumn("cut", F.coalesce(point >= before, F.lit(False))).where("kind = 1").select(KEY, "window_ord", "cut")
    return promoted.join(flags, [KEY, "window_ord"])


def segment(promoted: DataFrame, config: Config, cut: str | None = None) -> DataFrame:
    """promoted windows with episode_ord."""
    folded = runs(promoted, "window_ord", config.episode_max_gap, config.episode_min_sim, config.episode_max_len, cut)
    return promoted.join(folded.withColumnRenamed("run_ord", "episode_ord"), [KEY, "window_ord"])


def pooled(segmented: DataFrame, config: Config) -> DataFrame:
    """One row for each episode: members (ordered structs), weights, pooled vector (self-centrality) and representatives (ordered structs).

    score_i = lambda * -((t_i - middle)^2) / (2 sigma_c^2 + EPS) + mu * sum_{j<>i} exp(-|t_i - t_j| / (sigma_t + EPS)) cos(i, j), over start times;
    weights are its softmax; the vector is the normalised weighted sum, or a single member's own. n_rep_windows = 0 makes every member a representative."""
    member = F.struct("window_ord", "window_id", "start_time", "end_time", "visual_embedding", "summary_text", "summary_embedding", norm(F.col("visual_embedding")).alias("length"))
    rows = segmented.groupBy(KEY, "episode_ord").agg(F.sort_array(F.collect_list(member)).alias("m"))
    rows = rows.withColumn("mid", (F.col("m")[0]["start_time"] + F.element_at("m", -1)["start_time"]) / 2)
    m = F.col("m")

    def consistency(a, i):
        one = lambda b, j: F.when(i == j, F.lit(0.0)).otherwise(F.exp(-F.abs(a["start_time"] - b["start_time"]) / F.lit(config.sigma_time + EPS)) * dot(a["visual_embedding"], b["visual_embedding"]) / (a["length"] * b["length"] + F.lit(EPS)))
        return total(F.transform(m, one))

    center = lambda a: -F.pow(a["start_time"] - F.col("mid"), 2) / F.lit(2 * config.sigma_center**2 + EPS)
    score = F.transform(m, lambda a, i: F.lit(config.lambda_center) * center(a) + F.lit(config.mu_consistency) * consistency(a, i))
    vector = lambda w: F.when(F.size("m") == 1, m[0]["visual_embedding"]).otherwise(normalised(weighted(F.col("m.visual_embedding"), w)))
    rows = rows.withColumn("p", let(softmax(score), lambda w: F.struct(w.alias("weights"), vector(w).alias("vector"))))
    best = F.slice(F.sort_array(F.transform(F.arrays_zip(F.col("p.weights").alias("w"), m.alias("a")), lambda x, i: F.struct(x["w"].alias("w"), x["a"]["window_ord"].alias("o"), i.alias("i"))), False), F.lit(1), F.lit(config.n_rep_windows) if config.n_rep_windows > 0 else F.size("m"))
    rows = rows.withColumn("reps", F.transform(F.sort_array(F.transform(best, lambda b: F.struct(b["o"].alias("o"), b["i"].alias("i")))), lambda b: m[b["i"]]))
    return rows.select(KEY, "episode_ord", "m", F.col("p.weights").alias("weights"), "reps", F.col("p.vector").alias("visual_embedding"))


def episode_id(stream: str = KEY, place: str = "episode_ord"):
    return F.concat(F.lit("ep-"), F.col(stream).cast("string"), F.lit("-"), F.col(place).cast("string"))


def episodes(segmented: DataFrame, config: Config) -> DataFrame:
    """Closed episodes. The summary's embedding is the first representative's, where it has one: the built-in stand-in for an encoder."""
    rows = pooled(segmented, config)
    start, end = F.col("m")[0]["start_time"], F.element_at("m", -1)["end_time"]
    return rows.select(
        KEY, "episode_ord", episode_id().alias("episode_id"), start.alias("start_time"), end.alias("end_time"), "visual_embedding", F.col("m.window_ord").alias("member_ords"), F.col("m.window_id").alias("member_window_ids"),
        F.col("reps.window_id").alias("representative_window_ids"), F.col("reps.visual_embedding").alias("rep_vectors"), text.episode_default(start, end, F.size("m")).alias("summary_text"), F.get("reps", F.lit(0))["summary_embedding"].alias("summary_embedding"), "weights",
    )


def pending_snapshot(segmented: DataFrame, config: Config) -> DataFrame:
    """The open episode of each stream as a searchable one, without closing it."""
    last = Window.partitionBy(KEY)
    still = segmented.withColumn("last_ord", F.max("episode_ord").over(last)).where("episode_ord = last_ord").drop("last_ord")
    rows = episodes(still, config)
    return rows.withColumn("episode_id", F.concat(F.lit("ep-pending-"), F.col("member_window_ids")[0], F.lit("-"), F.element_at("member_window_ids", -1)))


def rep_fallback(members: DataFrame, vector: str, n: int = 2) -> DataFrame:
    """stream_id, episode_ord, window_ord of the n members most like their episode's vector (column vector), for episodes that name none."""
    w = Window.partitionBy(KEY, "episode_ord").orderBy(cosine(F.col("visual_embedding"), F.col(vector)).desc(), "window_ord")
    return members.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= n).select(KEY, "episode_ord", "window_ord")


def represented(eps: DataFrame, windows: DataFrame) -> DataFrame:
    """eps in which episodes that name no representatives get those of rep_fallback, in order of members, with their vectors. Others are left as they are."""
    bare = F.coalesce(F.size("representative_window_ids"), F.lit(0)) == 0
    some = eps.where(bare).select(KEY, "episode_ord", F.col("visual_embedding").alias("pool"), F.posexplode("member_window_ids").alias("position", "window_id"))
    rows = some.join(windows.select(KEY, "window_id", "window_ord", "visual_embedding"), [KEY, "window_id"])
    best = rep_fallback(rows, "pool").join(rows, [KEY, "episode_ord", "window_ord"]).groupBy(KEY, "episode_ord").agg(F.sort_array(F.collect_list(F.struct("position", "window_id", "visual_embedding"))).alias("b"))
    made = eps.where(bare).drop("representative_window_ids", "rep_vectors").join(best.select(KEY, "episode_ord", F.col("b.window_id").alias("representative_window_ids"), F.col("b.visual_embedding").alias("rep_vectors")), [KEY, "episode_ord"], "left")
    none = lambda c, kind: F.coalesce(c, F.expr(f"cast(array() as {kind})")).alias(c)
    made = made.select(*[c for c in made.columns if c not in ("representative_window_ids", "rep_vectors")], none("representative_window_ids", "array<string>"), none("rep_vectors", "array<array<double>>"))
    return eps.where(~bare).unionByName(made)


def cluster(eps: DataFrame, config: Config) -> DataFrame:
    """episodes with event_ord. Independent of when capacity forces it, as long as episodic_capacity + 1 >= episodic_merge_batch."""
    if config.episodic_capacity + 1 < config.episodic_merge_batch:
        raise ValueError("events depend on timing when episodic_capacity + 1 < episodic_merge_batch: use the streaming processor")
    folded = runs(eps, "episode_ord", config.event_max_gap, config.event_min_episode_sim, max(1, config.episodic_merge_batch))
    return eps.join(folded.withColumnRenamed("run_ord", "event_ord"), [KEY, "episode_ord"])


def events(clustered: DataFrame, config: Config, windows: DataFrame | None = None) -> DataFrame:
    """Events of clustered episodes. windows: where representatives of episodes that name none are sought; what episodes() makes always names some."""
    if windows is not None:
        clustered = represented(clustered, windows)
    one = F.struct("episode_ord", "episode_id", "start_time", "end_time", "visual_embedding", "representative_window_ids", "rep_vectors", "summary_text", "summary_embedding")
    rows = clustered.groupBy(KEY, "event_ord").agg(F.sort_array(F.collect_list(one)).alias("c"))
    start, end = F.col("c")[0]["start_time"], F.element_at("c", -1)["end_time"]
    return rows.select(
        KEY, "event_ord", F.concat(F.lit("ev-"), F.col(KEY).cast("string"), F.lit("-"), F.col("event_ord").cast("string")).alias("event_id"), start.alias("start_time"), end.alias("end_time"), centroid(F.col("c.visual_embedding")).alias("visual_embedding"),
        F.size("c").cast("long").alias("n_episodes"), F.col("c.episode_id").alias("member_episode_ids"), F.flatten("c.representative_window_ids").alias("representative_window_ids"), F.flatten("c.rep_vectors").alias("rep_vectors"),
        text.event_default(F.col("c.summary_text"), start, end).alias("summary_text"), F.col("c")[0]["summary_embedding"].alias("summary_embedding"), (F.element_at("c", -1)["episode_ord"] + 1).alias("episodes_to"),
    )


def firing(questions: DataFrame, windows: DataFrame) -> DataFrame:
    """questions with fired_ord and stream_time: the first window whose end is at or after t_seconds; null and infinite after the stream's end.

    Both sides are sorted together by time, latest first: no pair of question and window is ever made."""
    w = Window.partitionBy(KEY).orderBy(F.col("t").desc(), F.col("kind"), F.col("window_ord").desc()).rowsBetween(Window.unboundedPreceding, 0)
    both = windows.select(KEY, F.col("end_time").alias("t"), F.lit(0).alias("kind"), "window_ord", F.lit(None).cast("string").alias("question_id")).unionByName(
        questions.select(KEY, F.col("t_seconds").alias("t"), F.lit(1).alias("kind"), F.lit(None).cast("long").alias("window_ord"), "question_id")
    )
    met = both.withColumn("hit", F.min(F.when(F.col("kind") == 0, F.struct("t", "window_ord"))).over(w)).where("kind = 1").select(KEY, "question_id", F.col("hit.window_ord").alias("fired_ord"), F.coalesce("hit.t", F.lit(float("inf"))).alias("stream_time"))
    return questions.join(met, [KEY, "question_id"])


def state_at(fired: DataFrame, promoted: DataFrame, eps: DataFrame, evs_of: DataFrame, evs: DataFrame, config: Config) -> DataFrame:
    """fired with evicted_to, n_episodes (begun by then), n_closed, n_events and first_episode (the tier's closed part is first_episode .. n_closed - 1).

    With cut_on_query every question closes the open episode, after capacity was last looked at: so that one does not count for consolidation,
    if windows were promoted since the question before. Without, the last episode is still open, and searchable as open_at() gives it."""
    c = config.recent_capacity
    q = fired.withColumn("evicted_to", F.col("fired_ord") - c)
    points = q.select(KEY, "fired_ord", "evicted_to").where("fired_ord is not null").distinct()
    points = points.withColumn("evicted_before", F.lag("evicted_to", 1, -(1 << 60)).over(Window.partitionBy(KEY).orderBy("evicted_to")))
    both = points.select(KEY, F.col("evicted_to").alias("at"), F.lit(1).alias("kind"), "fired_ord", "evicted_before", F.lit(None).cast("long").alias("episode_ord")).unionByName(
        promoted.select(KEY, F.col("window_ord").alias("at"), F.lit(0).alias("kind"), F.lit(None).cast("long").alias("fired_ord"), F.lit(None).cast("long").alias("evicted_before"), "episode_ord")
    )
    w = Window.partitionBy(KEY).orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0)
    seen = both.withColumn("last_promoted", F.max(F.when(F.col("kind") == 0, F.col("at"))).over(w)).withColumn("n_episodes", F.coalesce(F.max("episode_ord").over(w) + 1, F.lit(0).cast("long"))).where("kind = 1")
    pending = F.coalesce(F.col("last_promoted") > F.col("evicted_before"), F.lit(False)) if config.cut_on_query else F.col("n_episodes") > 0
    seen = seen.withColumn("closed", F.col("n_episodes") - pending.cast("long")).withColumn("n_closed", F.col("n_episodes") if config.cut_on_query else F.col("closed"))
    over = F.col("closed") - config.episodic_capacity - 1
    due = evs_of.select(KEY, F.col("episode_ord").alias("over"), "event_ord")
    ends = evs.select(KEY, "event_ord", "episodes_to")
    seen = seen.withColumn("over", over).join(due, [KEY, "over"], "left").join(ends, [KEY, "event_ord"], "left")
    seen = seen.select(KEY, "fired_ord", "n_episodes", "n_closed", F.coalesce(F.col("event_ord") + 1, F.lit(0).cast("long")).alias("n_events"), F.coalesce("episodes_to", F.lit(0).cast("long")).alias("first_episode"))
    return q.join(seen, [KEY, "fired_ord"], "left")


def recent_at(state: DataFrame, windows: DataFrame, n: int) -> DataFrame:
    """The last n windows at each question, by their ordinals."""
    ords = F.explode(F.sequence(F.greatest(F.lit(0).cast("long"), F.col("fired_ord") - n + 1), F.col("fired_ord")))
    seen = windows.select(KEY, "window_ord", "window_id", "start_time", "end_time", "visual_embedding", "summary_text", "summary_embedding")
    return state.where("fired_ord is not null").withColumn("window_ord", ords).join(seen, [KEY, "window_ord"])


def episodes_at(state: DataFrame, eps: DataFrame) -> DataFrame:
    """The closed searchable episodes at each question: at most capacity and one, or a cluster, so they are named by ordinal."""
    some = state.where("n_closed > first_episode")
    return some.withColumn("episode_ord", F.explode(F.sequence("first_episode", F.col("n_closed") - 1))).join(eps, [KEY, "episode_ord"])


def open_at(state: DataFrame, segmented: DataFrame, config: Config) -> DataFrame:
    """The open episode at each question that does not cut it: what of it had been evicted by then, pooled anew."""
    some = state.where("n_episodes > n_closed").withColumn("episode_ord", F.col("n_episodes") - 1).withColumn("asked", F.concat_ws("|", KEY, "question_id"))
    parts = some.select(KEY, "asked", "evicted_to", "episode_ord").join(segmented, [KEY, "episode_ord"]).where("window_ord <= evicted_to")
    made = episodes(parts.drop(KEY).withColumnRenamed("asked", KEY), config).withColumn("episode_id", F.concat(F.lit("ep-pending-"), F.col("member_window_ids")[0], F.lit("-"), F.element_at("member_window_ids", -1)))
    return some.join(made.withColumnRenamed(KEY, "asked").drop("episode_ord"), "asked").drop("asked")


def events_at(state: DataFrame, evs: DataFrame) -> DataFrame:
    """The long-term events at each question; all of them after the end of the stream."""
    return state.join(evs.withColumnRenamed("n_episodes", "n_members"), KEY).where("fired_ord is null or event_ord < n_events")


def members(eps: DataFrame) -> DataFrame:
    """stream_id, episode_ord, position, window_ord, window_id of the members."""
    pairs = F.posexplode(F.arrays_zip("member_ords", "member_window_ids")).alias("position", "p")
    return eps.select(KEY, "episode_ord", pairs).select(KEY, "episode_ord", "position", F.col("p.member_ords").alias("window_ord"), F.col("p.member_window_ids").alias("window_id"))


def rep_neighbours(eps: DataFrame, radius: int, keys: tuple[str, ...] = (KEY, "episode_ord")) -> DataFrame:
    """The representatives with radius members to either side, once each, in order of first mention: seq, position, window_id. Array expressions only."""
    spots = "transform(representative_window_ids, r -> cast(array_position(member_window_ids, r) as int))"
    picked = f"array_distinct(flatten(transform(filter({spots}, p -> p > 0), p -> sequence(greatest(1, p - {max(radius, 0)}), least(size(member_window_ids), p + {max(radius, 0)})))))"
    center = f"if({radius} < 0 or size(member_window_ids) <= {2 * radius + 1}, sequence(1, size(member_window_ids)), sequence(greatest(1, size(member_window_ids) div 2 + 1 - {radius}), least(cast(size(member_window_ids) as bigint), size(member_window_ids) div 2 + 1 + {radius})))"
    picked = f"if(size(representative_window_ids) > 0, {picked}, transform({center}, p -> cast(p as int)))"
    rows = eps.select(*keys, "member_window_ids", F.posexplode(F.expr(picked)).alias("seq", "place"))
    return rows.select(*keys, "seq", (F.col("place") - 1).alias("position"), F.element_at("member_window_ids", F.col("place")).alias("window_id"))


def center_grounding(eps: DataFrame, radius: int) -> DataFrame:
    """Members about the middle one: radius to either side, all of a short episode or for a negative radius."""
    n, width = F.size("member_window_ids"), 2 * radius + 1
    low = F.greatest(F.lit(0), F.floor(n / 2).cast("int") - radius)
    high = F.least(n, F.floor(n / 2).cast("int") + radius + 1)
    part = F.when((n <= width) | F.lit(radius < 0), F.col("member_window_ids")).otherwise(F.slice("member_window_ids", low + 1, high - low))
    return eps.select(KEY, "episode_ord", part.alias("window_ids"))


COUNTERS = ("recent", "pending_episode", "episodic", "long_term", "n_promoted", "n_discarded", "n_episodes_flushed", "n_consolidated")


def stats(gated: DataFrame, eps: DataFrame, evs: DataFrame, config: Config) -> DataFrame:
    """The counters of each stream once it is finalised, when everything has been flushed and consolidated; and the sizes of its episodes and events."""
    a = novelty_stats(gated)
    b = eps.groupBy(KEY).agg(F.count("*").alias("n_episodes_flushed"), F.sum(F.size("member_window_ids")).alias("n_members"), F.max(F.size("member_window_ids")).cast("long").alias("longest_episode"))
    c = evs.groupBy(KEY).agg(F.count("*").alias("n_consolidated"), F.max("n_episodes").alias("largest_event"))
    rows = a.join(b, KEY, "left").join(c, KEY, "left")
    zero = F.lit(0).cast("long")
    counts = {"recent": zero, "pending_episode": zero, "episodic": zero, "long_term": F.coalesce("n_consolidated", zero), "n_episodes_flushed": F.coalesce("n_episodes_flushed", zero), "n_consolidated": F.coalesce("n_consolidated", zero)}
    return rows.select(KEY, *[counts.get(n, F.col(n)).alias(n) for n in COUNTERS], "n_members", "longest_episode", "largest_event")


def stats_at(state: DataFrame, gated: DataFrame, segmented: DataFrame, config: Config) -> DataFrame:
    """The counters at each question that comes before its stream's end, once that question has closed what it closes."""
    run = Window.partitionBy(KEY).orderBy("window_ord").rowsBetween(Window.unboundedPreceding, 0)
    seen = gated.select(KEY, F.col("window_ord").alias("evicted_to"), F.sum(F.col("promoted").cast("long")).over(run).alias("n_promoted"), F.sum((~F.col("promoted")).cast("long")).over(run).alias("n_discarded"))
    inside = Window.partitionBy(KEY, "episode_ord").orderBy("window_ord")
    places = segmented.select(KEY, F.col("window_ord").alias("last_ord"), F.row_number().over(inside).cast("long").alias("place"))
    rows = state.where("fired_ord is not null").join(seen, [KEY, "evicted_to"], "left")
    # the open episode's size is the place of the last promoted window in it
    last = segmented.select(KEY, "window_ord").join(rows.select(KEY, "question_id", "evicted_to"), KEY).where("window_ord <= evicted_to").groupBy(KEY, "question_id").agg(F.max("window_ord").alias("last_ord")) if not config.cut_on_query else None
    zero = F.lit(0).cast("long")
    if last is None:
        rows = rows.withColumn("place", zero)
    else:
        rows = rows.join(last, [KEY, "question_id"], "left").join(places, [KEY, "last_ord"], "left")
    counts = {
        "recent": F.least(F.col("fired_ord") + 1, F.lit(config.recent_capacity).cast("long")), "pending_episode": F.when(F.col("n_episodes") > F.col("n_closed"), F.coalesce("place", zero)).otherwise(zero), "episodic": F.col("n_closed") - F.col("first_episode"),
        "long_term": F.col("n_events"), "n_promoted": F.coalesce("n_promoted", zero), "n_discarded": F.coalesce("n_discarded", zero), "n_episodes_flushed": F.col("n_closed"), "n_consolidated": F.col("n_events"),
    }
    return rows.select(KEY, "question_id", *[counts[n].alias(n) for n in COUNTERS])
