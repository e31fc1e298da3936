"""Operators on small inputs worked out by hand."""

import pytest
from pyspark.sql import functions as F

from tiermem.config import PRESETS, Config, merged
from tiermem.functions import text, vector
from tiermem.operators import evaluation, evidence, memory, models, retrieval, runs, store, windowing
from tiermem.plans import fixtures
from tiermem.sources import readers, sinks

SF = "/root/testdata/sf0.001"


def one(spark, column, **values):
    names, vals = zip(*values.items(), strict=True) if values else (("x",), (1,))
    kinds = {str: "string", int: "int", float: "double"}

    def kind(v):
        return f"array<{kind(v[0])}>" if isinstance(v, list) and v else "array<int>" if isinstance(v, list) else "string" if v is None else kinds[type(v)]

    return spark.createDataFrame([vals], ", ".join(f"{n} {kind(v)}" for n, v in zip(names, vals, strict=True))).select(column).first()[0]


@pytest.mark.parametrize(("stamp", "want"), [("01:02:03", 3723.0), ("02:03", 123.0), ("7", 7.0), (None, 0.0)])
def test_hms(spark, stamp, want):
    assert one(spark, text.hms_seconds(F.col("s")), s=stamp) == want


@pytest.mark.parametrize(("said", "want"), [("D\nbecause", "D"), ("The Answer", "A"), ("none", "?"), ("", "?"), ("b or C", "C")])
def test_first_letter(spark, said, want):
    assert one(spark, text.first_letter(F.col("s")), s=said) == want


def test_question_split(spark):
    raw = " What?\n(A) one\n(B)  two words\n(C) x (D) y "
    assert one(spark, text.question_stem(F.col("s")), s=raw) == "What?"
    assert one(spark, text.question_options(F.col("s")), s=raw) == ["A. one", "B. two words", "C. x", "D. y"]
    assert one(spark, text.question_options(F.col("s")), s="no options ") == []


@pytest.mark.parametrize(("ref", "want"), [("00:10-00:20", "00:20"), (" 00:10 ", "00:10"), ("a-b-c", "b-c")])
def test_range_end(spark, ref, want):
    assert one(spark, text.range_end(F.col("s")), s=ref) == want


@pytest.mark.parametrize(("n", "want"), [(0, [[]]), (3, [[1, 2, 3]]), (5, [[1, 2, 3, 4, 5]]), (6, [[1, 2, 3, 4, 5], [6]]), (13, [[1, 2, 3, 4, 5], [6, 7, 8, 9, 10], [11, 12, 13]])])
def test_chunks(spark, n, want):
    got = one(spark, text.chunked(F.col("a"), 5), a=list(range(1, n + 1)))
    assert got == want


def test_chunk_size_must_be_positive():
    with pytest.raises(ValueError):
        text.chunked(None, 0)


@pytest.mark.parametrize(("url", "want"), [("https://youtu.be/abcdefghijk", "abcdefghijk"), ("https://x.com/watch?v=abcdefghij_", "abcdefghij_"), ("abcdefghijk", "abcdefghijk"), ("nothing", None)])
def test_video_id(spark, url, want):
    assert one(spark, text.video_id(F.col("s")), s=url) == want


def test_vectors(spark):
    assert one(spark, vector.cosine(F.col("a"), F.col("b")), a=[1.0, 0.0], b=[1.0, 1.0]) == pytest.approx(0.70710678, abs=1e-7)
    assert one(spark, vector.normalised(F.col("a")), a=[3.0, 4.0]) == pytest.approx([0.6, 0.8], abs=1e-7)
    assert one(spark, vector.softmax(F.col("a")), a=[0.0, 0.0]) == pytest.approx([0.5, 0.5], abs=1e-7)
    assert one(spark, vector.softmax(F.col("a")), a=[1000.0, 0.0]) == pytest.approx([1.0, 0.0], abs=1e-7)


def test_vector_bytes(spark):
    df = spark.createDataFrame([([1.0, 2.5],), (None,)], "v array<float>")
    back = df.select(vector.from_bytes(2)(vector.to_bytes(2)("v")).alias("v")).collect()
    assert [r.v for r in back] == [[1.0, 2.5], None]
    with pytest.raises(Exception, match="declared"):
        df.select(vector.from_bytes(3)(vector.to_bytes(2)("v"))).collect()


def test_summary_dispatch(spark):
    f = lambda kind, notes: one(spark, text.summary_of(F.lit(kind), F.col("a"), F.lit(0.0), F.lit(6.0)), a=notes)
    assert f("window", ["x"]) == "x" and f("window", ["x", "y"]) == "Episode 0.0–6.0s: x; y"
    assert f("episode", ["p: q", "r"]) == "Event 0.0–6.0s: p → r" and f("other", ["x"]) == "Memory 0.0–6.0s"
    assert one(spark, text.tagged_notes(F.col("a")), a=["x", "y"]) == "[1/2] x\n\n[2/2] y"


def test_sampling(spark):
    assert one(spark, text.uniform_sample(F.col("a"), 4), a=[1, 2, 3, 4, 5, 6, 7]) == [1, 3, 5, 7]
    assert one(spark, text.uniform_sample(F.col("a"), 4), a=[1, 2]) == [1, 1, 1, 2]
    assert one(spark, text.stride_sample(F.col("a"), 3), a=[0, 1, 2, 3, 4, 5, 6]) == [0, 2, 4]


@pytest.mark.parametrize(("rate", "fps", "want"), [(30.0, 1.0, 30), (0.0, 1.0, 30), (2.0, 1.0, 2), (1.0, 4.0, 1), (2.5, 1.0, 2)])
def test_frame_step(rate, fps, want):
    assert windowing.frame_step(rate, fps) == want


def test_windows_of_frames(spark):
    frames = spark.createDataFrame([("s", i) for i in range(11)], "stream_id string, frame_idx long")
    rows = sorted(windowing.count_windows(frames, 2.0, 1.0, 2.0).collect(), key=lambda r: r.window_ord)
    assert [(r.start_time, r.end_time, r.frame_ids, r.rep_frame_id, r.partial) for r in rows] == [(0.0, 1.5, [0, 2], 2, False), (1.5, 3.5, [4, 6], 6, False), (3.5, 5.5, [8, 10], 10, False)]
    short = windowing.count_windows(frames.where("frame_idx < 10"), 2.0, 1.0, 2.0).orderBy("window_ord").collect()[-1]
    assert (short.start_time, short.end_time, short.partial) == (3.5, 5.0, True)
    ranked = windowing.ranked_windows(frames, 2.0, 1.0, 2.0).orderBy("frame_idx").collect()
    assert [r.window_ord for r in ranked] == [0, 0, 1, 1, 2, 2]


def _windows(spark, vectors, gap=0.0):
    rows = [("s", i, f"w{i}", i * (1 + gap), i * (1 + gap) + 1.0, v, f"n{i}", None) for i, v in enumerate(vectors)]
    return spark.createDataFrame(rows, "stream_id string, window_ord long, window_id string, start_time double, end_time double, visual_embedding array<double>, summary_text string, summary_embedding array<double>")


def test_novelty_is_strict_and_the_last_is_new(spark):
    a, b = [1.0, 0.0], [0.0, 1.0]
    rows = memory.novelty(_windows(spark, [a, a, b, a]), Config(recent_capacity=2, novelty_threshold=0.05)).orderBy("window_ord").collect()
    assert [r.promoted for r in rows] == [False, False, True, True] and rows[-1].max_sim is None


def test_segments_by_gap_length_and_similarity(spark):
    a, b = [1.0, 0.0], [0.0, 1.0]
    config = Config(episode_max_len=2, episode_min_sim=0.7, episode_max_gap=1.0)
    got = memory.segment(_windows(spark, [a, a, a, b, b]), config).orderBy("window_ord").collect()
    assert [r.episode_ord for r in got] == [0, 0, 1, 2, 2]
    apart = memory.segment(_windows(spark, [a, a], gap=3.0), config).collect()
    assert {r.episode_ord for r in apart} == {0, 1}


def test_pooling(spark):
    config = Config(episode_max_len=8, episode_min_sim=0.0)
    got = memory.episodes(memory.segment(_windows(spark, [[1.0, 0.0], [1.0, 0.0], [0.6, 0.8]]), config), config).first()
    assert sum(got.weights) == pytest.approx(1.0) and max(got.weights) == got.weights[1]
    assert got.representative_window_ids == ["w0", "w1"] and sum(x * x for x in got.visual_embedding) == pytest.approx(1.0)
    single = memory.episodes(memory.segment(_windows(spark, [[3.0, 4.0]]), config), config).first()
    assert single.visual_embedding == [3.0, 4.0]


def test_rep_neighbours_and_centre(spark):
    eps = spark.createDataFrame([("s", 0, list("abcdefg"), ["b", "c"]), ("s", 1, list("abcdefg"), []), ("s", 2, ["x"], ["x"])], "stream_id string, episode_ord long, member_window_ids array<string>, representative_window_ids array<string>")
    got = {k: [r.window_id for r in sorted(memory.rep_neighbours(eps, 1).where(f"episode_ord = {k}").collect(), key=lambda r: r.seq)] for k in range(3)}
    assert got == {0: list("abcd"), 1: list("cde"), 2: ["x"]}
    assert [r.window_ids for r in memory.center_grounding(eps, 0).orderBy("episode_ord").collect()] == [["d"], ["d"], ["x"]]
    assert memory.center_grounding(eps, -1).orderBy("episode_ord").first().window_ids == list("abcdefg")


SCORED = "stream_id string, question_id string, event_ord long, start_time double, end_time double, score double"


def test_newest_event_takes_the_last_place(spark):
    rows = spark.createDataFrame([("s", "q", 0, 0.0, 10.0, 0.9), ("s", "q", 1, 20.0, 30.0, 0.8), ("s", "q", 2, 100.0, 110.0, 0.1)], SCORED)
    assert sorted((r["rank"], r.event_ord) for r in retrieval.coarse(rows, 2).collect()) == [(1, 0), (2, 2)]
    assert sorted((r["rank"], r.event_ord) for r in retrieval.coarse(rows, 1).collect()) == [(1, 2)]
    assert sorted((r["rank"], r.event_ord) for r in retrieval.coarse(rows, 3).collect()) == [(1, 0), (2, 1), (3, 2)]
    assert retrieval.coarse(rows, 0).count() == 0


def test_gate_tail_and_fallback(spark):
    eps = spark.createDataFrame([("s", "q", i, 100.0 * i, 100.0 * i + 3) for i in range(3)], "stream_id string, question_id string, episode_ord long, start_time double, end_time double")
    ranges = spark.createDataFrame([("s", "q", 3.0, 50.0)], "stream_id string, question_id string, start_time double, end_time double")
    via = lambda r, n: {x.episode_ord: x.via for x in retrieval.gated(eps, r, n).collect()}
    assert via(ranges, 1) == {0: "range", 2: "tail"}
    far = ranges.withColumn("start_time", F.lit(50.0))
    assert via(far, 0) == {0: "all", 1: "all", 2: "all"}
    assert via(ranges.where("false"), 1) == {0: "all", 1: "all", 2: "all"}


def test_decay_and_blend(spark):
    f = lambda at: one(spark, retrieval.decay(F.lit(0.0), F.lit(10.0), F.lit(at), F.lit(100.0), 0.1))
    assert f(5.0) == 1.0 and f(20.0) == pytest.approx(0.36787944) and f(float("inf")) == 0.0
    assert one(spark, retrieval.decay(F.lit(0.0), F.lit(10.0), F.lit(None).cast("double"), F.lit(100.0), 0.1)) == 1.0
    blend = retrieval.blended(F.lit(0.5), F.col("a"), F.lit(None).cast("array<double>"), F.lit(0.5), Config())
    assert one(spark, blend, a=[1.0, 0.0]) == 0.25
    both = retrieval.blended(F.lit(0.5), F.col("a"), F.col("b"), F.lit(1.0), Config())
    assert one(spark, both, a=[1.0, 0.0], b=[1.0, 0.0]) == pytest.approx(0.65)


def test_clamped_late_questions(spark):
    from dataclasses import replace

    r = fixtures.retrieval(spark, SF, replace(fixtures.CONFIG, late_query_time="clamp"))
    late = r.coarse_hits.where("fired_ord is null")
    assert late.where("score <> 0").count() > 0


def test_dropped_stages_are_made_anew(spark):
    """drop() deletes what the stages wrote, and not the caller's own table; nothing is worked out before it is used."""
    from tiermem.sources import staging

    base = staging.staged(fixtures.windows(spark, SF), "stream")
    r = retrieval.Retrieval(fixtures.questions(base), base, fixtures.CONFIG)
    assert r.written() == [base._tm_staged]
    before = sorted(map(str, r.events.select("event_id", "start_time").collect()))
    paths = r.written()
    assert len(paths) > 1 and "state" not in vars(r)
    r.drop()
    assert [staging.exists(spark, p) for p in paths] == [p == base._tm_staged for p in paths]
    assert sorted(map(str, r.events.select("event_id", "start_time").collect())) == before


def test_empty_records(spark):
    none = spark.createDataFrame([], "task_type string, hierarchical struct<correct:boolean>, baseline struct<correct:boolean>")
    assert evaluation.accuracy(none).first().n_qas == 0 and evaluation.accuracy(none).first().hier_accuracy is None
    assert sinks.summary(none)["by_task_type"] == {}


def test_configs():
    got = merged({"memory": {"recent_capacity": 7, "nonsense": 1}, "retrieval": {"top_k": 9}, "reasoner": {"max_frames": 4}})
    assert (got.recent_capacity, got.top_k, got.max_frames) == (7, 9, 4)
    assert merged({}) == Config()
    tuned = PRESETS["streamingbench_tuned"]
    assert (tuned.baseline_windows, tuned.baseline_k, tuned.pin_n) == (20, 5, 20)
    assert PRESETS["vlm_streaming"].baseline_k == 3 and Config().pin_n == 20


def test_run_and_sinks(spark, tmp_path):
    r = fixtures.retrieval(spark, SF)
    records = runs.records(r).cache()
    assert records.count() == r.fired.count()
    sinks.per_clip(records, str(tmp_path / "clips"))
    sinks.run_log(records, str(tmp_path / "log"))
    found = sinks.save_summary(spark, records, str(tmp_path))
    assert found["n_qas"] == records.count() and "paired" in (tmp_path / "summary.md").read_text()
    blocks = evidence.text_block(evidence.described(r), r.fired)
    sinks.trace(blocks, r.fired, str(tmp_path / "trace"))
    assert spark.read.text(str(tmp_path / "trace")).where("value like '## %'").count() == r.fired.count()
    assert "[Coarse: events]" in blocks.where("question_id = '1-4'").first().text
    records.unpersist()


def test_models(spark):
    enc = models.hashed_text_encoder()
    rows = spark.createDataFrame([(1, "a b", None), (2, "", None), (3, "c", [9.0])], "id int, summary_text string, summary_embedding array<double>")
    got = {r.id: r.summary_embedding for r in models.with_summary_embedding(rows, enc).collect()}
    assert got[1] is not None and got[2] is None and got[3] == [9.0]
    assert models.with_summary_embedding(rows).where("summary_embedding is null").count() == 2
    cap = models.captioned(spark.createDataFrame([(0.0, 3.0)], "start_time double, end_time double").withColumn("frame", F.lit(None).cast("binary")))
    assert cap.first().summary_text == "Scene at 0.0–3.0s"
    model = models.answerer("model", load=lambda: lambda prompts: ["B" for _ in prompts])
    seen = spark.createDataFrame([("s", "q", "text", "why?", ["A. x", "B. y"])], "stream_id string, question_id string, text string, question string, options array<string>")
    assert model(seen).first().prediction == "B"


def test_readers(spark, tmp_path):
    (tmp_path / "qas.json").write_text('{"sample_id": 3, "video": "v", "qas": [{"question_id": "b", "time_stamp": "00:00:09", "answer": "A", "options": ["A. x"]}, {"question_id": "a", "answer": "B", "question": "q"}]}')
    got = readers.qa_json(spark, str(tmp_path / "qas.json")).orderBy("place").collect()
    assert [(r.question_id, r.t_seconds) for r in got] == [("a", 0.0), ("b", 9.0)]
    (tmp_path / "raw.jsonl").write_text('{"uid": "7", "question": "Q?\\n(A) x\\n(B) y", "question_type": ["t", "u"], "time_reference": "00:01-00:02", "answer": "A"}\n\n')
    raw = readers.raw_qa(spark, str(tmp_path / "raw.jsonl")).first()
    assert (raw.question, raw.options, raw.task_type, raw.time_stamp) == ("Q?", ["A. x", "B. y"], "t, u", "00:02")
    (tmp_path / "m.json").write_text('[{"sample_id": 2, "video": "b"}, {"sample_id": 1, "video": "a"}]')
    assert [r.sample_id for r in readers.manifest(spark, str(tmp_path / "m.json")).orderBy("place").collect()] == [2, 1]
    assert readers.meta_lines(spark, str(tmp_path / "raw.jsonl"), "uid string").count() == 1
    (tmp_path / "frames" / "s1").mkdir(parents=True)
    for i in range(3):
        (tmp_path / "frames" / "s1" / f"{i:06d}.jpg").write_bytes(b"x")
    assert sorted((r.stream_id, r.frame_idx) for r in readers.binary_frames(spark, str(tmp_path / "frames")).collect()) == [("s1", 0), ("s1", 1), ("s1", 2)]
    ann = spark.createDataFrame([("x_sample_1_2", "t", "q", "1", "A", "['a']"), ("x_sample_99_2", "t", "q", "1", "A", "")], "question_id string, task_type string, question string, time_stamp string, answer string, options string")
    grouped = readers.grouped_annotations(ann)
    assert [(r.sample_id, r.qas[0].options) for r in grouped.collect()] == [(1, ["a"])]
    sinks.clip_bundles(grouped, str(tmp_path / "bundle"))
    assert spark.read.json(str(tmp_path / "bundle" / "manifest")).first().n_qas == 1


def test_store(spark, tmp_path):
    r = fixtures.retrieval(spark, SF)
    store.save(str(tmp_path / "db"), r.windows, r.episodes, r.events)
    w, e, v = store.restore(spark, str(tmp_path / "db"))
    assert {x.table_name: x.n for x in store.counts(w, e, v).collect()} == {x.table_name: x.n for x in store.counts(r.windows, r.episodes, r.events).collect()}
    gone = e.select(F.explode("member_window_ids").alias("window_id")).first().window_id
    assert {x.bridge: x.n_orphans for x in store.orphans(w.where(F.col("window_id") != gone), e, v).collect()}["episode_window"] == 1
    assert store.orphans(w, e, v).agg(F.sum("n_orphans")).first()[0] == 0
    merge = store.merge_batch(str(tmp_path / "t"), "k")
    a = spark.createDataFrame([("x", 1, "old"), ("y", 1, "y")], "k string, seq int, v string")
    b = spark.createDataFrame([("x", 2, "new")], "k string, seq int, v string")
    merge(a, 0), merge(b, 1), merge(b, 1)
    assert {(r.k, r.v) for r in store.current(spark, str(tmp_path / "t")).collect()} == {("x", "new"), ("y", "y")}
