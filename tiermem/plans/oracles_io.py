"""SQL for the queries of readers, writers, runs, hooks and stored tables, from the driver's tables alone."""

from __future__ import annotations

from . import oracles as o
from .fixtures import CONFIG as C
from .oracles import BAS, EVENTS, DESC, HITS, POOL, R, SEG, STATE, _cos, sql

ASKED = """a AS (SELECT (event_id // 500)::INT AS sample_id, event_id, 'q' || event_id AS question_id, event_type AS task_type, 'What of ' || event_type || '?' AS question, CASE WHEN event_id % 5 <> 0 THEN strftime(ts, '%H:%M:%S') END AS time_stamp, 'A. x,B. it''s' AS options FROM events),
t AS (SELECT *, coalesce(time_stamp, '00:00:00') AS stamp, list_reduce(list_transform(string_split(coalesce(time_stamp, '00:00:00'), ':'), lambda x: x::DOUBLE), lambda x, y: x * 60 + y) AS t_seconds FROM a)"""
sql("src_qa_json", ASKED, "SELECT sample_id::VARCHAR AS stream_id, question_id, task_type, stamp AS time_stamp, t_seconds, (row_number() OVER (PARTITION BY sample_id ORDER BY t_seconds, event_id))::INT AS place, options FROM t")
sql("src_qa_lines", ASKED, "SELECT 'clip' AS stream_id, question_id, task_type || ', u' AS task_type, stamp AS time_stamp, t_seconds, options FROM t")
sql("src_raw_qa", ASKED, "SELECT question_id, task_type || ', u' AS task_type, question, '01:00:00' AS time_stamp, 'B' AS answer, options FROM (SELECT * REPLACE ('A. x,B. it''s' AS options) FROM t)")
sql("src_meta_lines", "", "SELECT o_orderkey AS key, length(o_orderpriority)::INT AS n_note FROM orders")
sql("src_manifest", "", "SELECT (row_number() OVER (ORDER BY n_nationkey) - 1)::INT AS place, n_nationkey::INT AS sample_id, 'clip-' || n_nationkey AS video_key, lower(n_name) AS video, 3::INT AS n_qas FROM nation")
RECS = "recs AS (SELECT doc_id, CASE WHEN doc_id % 11 <> 0 THEN lang END AS task_type, quality = 1 AS h, toxic = 0 AS b FROM labels JOIN documents USING (doc_id))"
sql("src_results", RECS, "SELECT doc_id::VARCHAR AS question_id, 'clip-' || (doc_id % 7) AS clip_id, task_type, h, b FROM recs")
sql("evl_completed", RECS, "SELECT count(DISTINCT doc_id % 7) AS videos_completed FROM recs")
sql("src_annotations", ASKED, """SELECT sample_id, 'v_sample_' || sample_id || '_' || event_id AS question_id, CASE event_id % 4 WHEN 0 THEN 2 WHEN 2 THEN 1 ELSE 0 END::INT AS n_options, CASE event_id % 4 WHEN 0 THEN 'A. x,B. it''s' WHEN 2 THEN 'no list' ELSE '' END AS options FROM t WHERE sample_id BETWEEN 1 AND 50""")
sql("snk_per_clip", RECS, "SELECT 'clip-' || (doc_id % 7) AS clip_id, count(*) AS n, min(doc_id::VARCHAR) AS first_id FROM recs GROUP BY 1")
sql("snk_run_log", RECS, "SELECT 'clip-' || (doc_id % 7) AS clip_id, count(*) AS n_qas, count(*) FILTER (h) AS hier_correct, count(*) FILTER (b) AS base_correct FROM recs GROUP BY 1")
sql("snk_clip_bundles", ASKED, "SELECT sample_id::BIGINT AS sample_id, 'clip_' || sample_id AS video_key, count(*) AS n_qas FROM t GROUP BY sample_id")
sql("snk_summary", RECS, "SELECT count(*) AS n_qas, count(*) FILTER (h) AS hier_correct, count(*) FILTER (b) AS base_correct, count(*) FILTER (h AND b) AS both_correct, count(*) FILTER (NOT h AND NOT b) AS both_wrong, count(DISTINCT coalesce(task_type, 'unknown'))::INT AS n_tasks FROM recs")
sql("snk_trace", f"{o.F1}, {o.QUESTIONS}", "SELECT 'What happens at ' || k || '?' AS question, count(*) AS n FROM q GROUP BY k")

sql("win_entries", o.F2, "SELECT stream_id, window_ord, 'w-' || stream_id || '-' || window_ord AS window_id, start_time, end_time, 'recent' AS tier, true AS bare FROM bounded")
sql("vec_codec", "", f"SELECT vec_id, (4 * len(embedding))::INT AS n_bytes, {R('embedding[1]::FLOAT::DOUBLE')} AS first, {R('list_sum(list_transform(embedding, lambda x: abs(x::FLOAT)::DOUBLE))')} AS v_abs FROM embeddings")
sql("sum_dispatch", "n AS (SELECT l_orderkey, list('line: ' || l_linenumber ORDER BY l_linenumber) AS notes, list('[' || rn || '/' || m || '] line: ' || l_linenumber ORDER BY rn) AS tags, count(*)::DOUBLE AS c FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS rn, count(*) OVER (PARTITION BY l_orderkey) AS m FROM lineitem) GROUP BY l_orderkey)", """SELECT l_orderkey, CASE l_orderkey % 3 WHEN 0 THEN CASE WHEN c = 1 THEN notes[1] ELSE format('Episode 0.0–{:.1f}s: ', c) || array_to_string(notes, '; ') END
WHEN 1 THEN format('Event 0.0–{:.1f}s: ', c) || array_to_string(list_transform(notes[1:5], lambda x: 'line'), ' → ') ELSE format('Memory 0.0–{:.1f}s', c) END AS summary, array_to_string(tags, chr(10) || chr(10)) AS tagged FROM n""")
sql("sum_fusion_lines", EVENTS, "SELECT stream_id, event_ord, string_agg(format('- Scene {} [{:.1f}s–{:.1f}s]: ', rn, start_time, end_time) || summary_text, chr(10) ORDER BY rn) AS lines FROM (SELECT *, row_number() OVER (PARTITION BY stream_id, event_ord ORDER BY episode_ord) AS rn FROM (SELECT stream_id, event_ord, episode_ord, start_time, end_time, summary_text FROM clu)) WHERE rn <= 8 GROUP BY ALL")
sql("sum_written", POOL, "SELECT stream_id, episode_ord, CASE WHEN start_time % 2 = 0 THEN format('at {:.1f}', start_time) ELSE summary_text END AS summary_text, CASE WHEN start_time % 2 = 0 THEN length(format('at {:.1f}', start_time))::DOUBLE END AS encoded FROM eps")
sql("enc_chunk_pool", "t AS (SELECT doc_id, (doc_id % 14 + 1)::INT AS n FROM documents), p AS (SELECT doc_id, n, unnest(range((n + 4) // 5)) AS place FROM t), c AS (SELECT doc_id, least(5, n - place * 5) + 2.0::DOUBLE AS x, 203.0 + list_sum(range(place * 5 + 1, least(n, place * 5 + 5) + 1))::DOUBLE AS y FROM p), m AS (SELECT doc_id, avg(x / sqrt(x * x + y * y)) AS a, avg(y / sqrt(x * x + y * y)) AS b FROM c GROUP BY doc_id)", f"SELECT doc_id, {R('a / (sqrt(a * a + b * b) + 1e-8)')} AS v0, {R('b / (sqrt(a * a + b * b) + 1e-8)')} AS v1 FROM m")

sql("mem_event_rep_fallback", EVENTS, f"""SELECT stream_id, event_ord, array_to_string(flatten(list(ids ORDER BY episode_ord)), ',') AS reps, sum(len(ids))::INT AS n_vectors FROM (SELECT stream_id, event_ord, episode_ord, CASE WHEN episode_ord % 2 = 1 THEN f.ids ELSE rep_ids END AS ids FROM clu JOIN
  (SELECT stream_id, episode_ord, list(window_id ORDER BY window_ord) AS ids FROM (SELECT s.*, row_number() OVER (PARTITION BY s.stream_id, s.episode_ord ORDER BY {_cos('s.v', 'e.v')} DESC, s.window_ord) AS k FROM seg s JOIN eps e USING (stream_id, episode_ord)) WHERE k <= 2 GROUP BY ALL) f USING (stream_id, episode_ord)) GROUP BY ALL""")
sql("mem_stats_at", STATE, f"""SELECT st.stream_id, question_id, least(st.fired_ord + 1, {C.recent_capacity})::BIGINT AS recent, 0::BIGINT AS pending_episode, n_episodes - first_episode AS episodic, n_events::BIGINT AS long_term,
(SELECT count(*) FROM prom p WHERE p.stream_id = st.stream_id AND p.window_ord <= st.fired_ord - {C.recent_capacity}) AS n_promoted,
(SELECT count(*) FROM gate g WHERE g.stream_id = st.stream_id AND g.window_ord <= st.fired_ord - {C.recent_capacity} AND NOT EXISTS (SELECT 1 FROM prom p WHERE p.stream_id = g.stream_id AND p.window_ord = g.window_ord)) AS n_discarded,
n_episodes AS n_episodes_flushed, n_events::BIGINT AS n_consolidated FROM st WHERE fired_ord IS NOT NULL""")
sql("ret_decay_all", HITS, f"SELECT question_id, window_id AS entry_id, {R('decay')} AS decay FROM rs UNION ALL SELECT question_id, episode_id, {R('decay')} FROM es")

BDES = f"""{BAS},
bt AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, window_ord) AS rank FROM (SELECT bc.*, {_cos('qv', 'v')} AS score FROM bc) QUALIFY rank <= {C.baseline_k}),
bp AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY window_ord) AS rank FROM (SELECT * FROM bc QUALIFY row_number() OVER (PARTITION BY question_id ORDER BY window_ord DESC) <= {C.pin_n})),
bd AS (SELECT question_id, 'pinned' AS stage, rank, window_id AS entry_id, NULL::DOUBLE AS score FROM bp UNION ALL SELECT question_id, 'grounded', rank, window_id, score FROM bt)"""
sql("bas_answer", BDES, f"SELECT question_id, stage, rank, entry_id, {R('score')} AS score FROM bd")

RULE = "repeat('=', 64)"
#: grounding without the archive: recent hits that are not pinned, in order
NO_ARCHIVE = "gr0 AS (SELECT question_id, window_id, row_number() OVER (PARTITION BY question_id ORDER BY rank) AS rank FROM rh WHERE NOT EXISTS (SELECT 1 FROM pin WHERE pin.question_id = rh.question_id AND pin.window_id = rh.window_id))"
_WHOLE = DESC
_HIDDEN = f"""{DESC}, {NO_ARCHIVE},
des0 AS (SELECT * FROM des WHERE stage <> 'grounded' UNION ALL SELECT g.question_id, 'grounded', g.rank, g.window_id, w.start_time, w.end_time, w.summary_text, rh.score FROM gr0 g JOIN win w USING (window_id) JOIN rh ON rh.question_id = g.question_id AND rh.window_id = g.window_id)"""


def _blocks(rows: str, shown: str) -> str:
    head = "CASE stage WHEN 'pinned' THEN '[Pinned: newest windows of the stream]' WHEN 'coarse' THEN '[Coarse: events]' WHEN 'episodic' THEN '[Fine: episodes]' ELSE '[Grounding: windows]' END"
    place = "CASE stage WHEN 'pinned' THEN 0 WHEN 'coarse' THEN 1 WHEN 'episodic' THEN 2 ELSE 3 END"
    return f"""told AS (SELECT *, {shown} AS shown FROM {rows}),
sections AS (SELECT question_id, {place} AS place, chr(10) || any_value({head}) || chr(10) || string_agg({o._LINE}, chr(10) ORDER BY rank) AS t, count(*) AS n FROM told WHERE shown GROUP BY question_id, stage),
bodies AS (SELECT question_id, string_agg(t, chr(10) ORDER BY place) || chr(10) AS body, sum(n + 2)::BIGINT AS n_lines FROM sections GROUP BY question_id),
blocks AS (SELECT q.question_id, q.k, {RULE} || chr(10) || 'QUERY: What happens at ' || q.k || '?' || chr(10) || {RULE} || chr(10) || coalesce(body, '') || {RULE} AS block, 4 + coalesce(n_lines, 0) AS n_lines FROM q LEFT JOIN bodies USING (question_id))"""


def _inputs(name: str, with_: str, rows: str, shown: str) -> None:
    sql(name, f"{with_}, {_blocks(rows, shown)}", f"""SELECT b.question_id, 'What happens at ' || b.k || '?' AS query, 64::INT AS dim, count(*) FILTER (stage <> 'coarse' AND shown) AS n_visual_tokens, count(*) FILTER (stage = 'coarse') AS coarse_event_count, count(*) FILTER (stage = 'episodic') AS episodic_hit_count, {o._SOURCES} AS sources, block AS text_context
FROM blocks b LEFT JOIN told ON told.question_id = b.question_id GROUP BY b.question_id, b.k, block""")


def _runs(name: str, with_: str, rows: str, shown: str) -> None:
    """The option by the number of lines, for both systems; the baseline's evidence has two sections at most, none of them ever hidden."""
    tail = BDES[len(BAS) :].replace("bt AS", "bc AS (SELECT f.question_id, f.qv, w.window_id, w.window_ord, w.v FROM fired f JOIN win w ON w.stream_id = f.stream_id AND w.window_ord > coalesce(f.fired_ord, 99) - %d AND w.window_ord <= coalesce(f.fired_ord, 99)), bt AS" % C.baseline_windows, 1)
    body = "SELECT question_id, sum(n + 2)::BIGINT AS n FROM (SELECT question_id, stage, count(*) AS n FROM bd GROUP BY ALL) GROUP BY ALL"
    letter = lambda n: f"substr('ABCD', ({n} % 4)::INT + 1, 1)"
    sql(name, f"{with_}, {_blocks(rows, shown)}{tail}, bl AS ({body})", f"""SELECT q.question_id, w.task_type, q.t_seconds, {letter('b.n_lines')} AS hierarchical_letter, {letter('b.n_lines')} = q.answer AS hierarchical_correct, {letter('(4 + coalesce(bl.n, 0))')} AS baseline_letter, {letter('(4 + coalesce(bl.n, 0))')} = q.answer AS baseline_correct
FROM q JOIN blocks b USING (question_id) LEFT JOIN bl ON bl.question_id = q.question_id JOIN win w ON w.stream_id = q.stream_id AND w.window_ord = (q.k * 17 + 5) % 100""")


_inputs("fmt_llm_input", _WHOLE, "des", "true")
_inputs("fmt_llm_input_plain", _HIDDEN, "des0", "stage NOT IN ('coarse', 'episodic')")
_runs("run_records", _WHOLE, "des", "true")
_runs("run_records_plain", _HIDDEN, "des0", "stage NOT IN ('coarse', 'episodic')")
sql("fmt_prompt", f"{o.F1}, {o.QUESTIONS}", "SELECT question_id, chr(10) || chr(10) || 'Question: What happens at ' || k || '?' || chr(10) || 'Choices:' || chr(10) || format('A. choice {0}\nB. choice {0}\nC. choice {0}\nD. choice {0}', k) || chr(10) || 'Reply with one letter.' AS tail FROM q")
sql("run_frames", HITS, f"""SELECT q.question_id, least({C.max_frames}, (SELECT count(DISTINCT x.window_id) FROM (SELECT question_id, window_id FROM gr UNION ALL SELECT question_id, window_id FROM pin) x JOIN win w ON w.window_id = x.window_id WHERE x.question_id = q.question_id AND w.window_ord % 5 <> 0))::INT AS n_frames FROM q""")

# fixed values: the presets as they are published
sql("cfg_presets", "", """SELECT * FROM (VALUES ('notebook', 20, 20, 5, 20, 5, 8, true, true), ('streamingbench_tuned', 30, 20, 5, 20, 6, 8, true, true), ('lvbench_tuned', 30, 20, 5, 20, 8, 8, true, true), ('vlm_full', 20, 20, 5, 20, 5, 10, true, true),
('vlm_streaming', 20, 20, 3, 10, 3, 6, false, false), ('class_defaults', 20, 10, 5, 0, 5, 8, true, true)) t(preset, recent, baseline, baseline_k, pins, top_k, frames, coarse, archive)""")
sql("cfg_merged", "", "SELECT 30 AS recent, 6 AS top_k, 10 AS frames, false AS coarse, false AS episodic, false AS archive")

sql("pst_restore", EVENTS, o.ORACLES["pst_counts"].split(chr(10))[-1])
_BRIDGES = f"{EVENTS}, ew AS (SELECT 'ep-' || stream_id || '-' || episode_ord AS episode_id, episode_ord, window_id FROM seg), ee AS (SELECT event_id, event_ord, unnest(ids) AS episode_id FROM evs), er AS (SELECT DISTINCT event_id, event_ord, unnest(rep_ids) AS window_id FROM evs)"
sql("pst_orphans", _BRIDGES, """SELECT 'episode_window' AS bridge, count(*) AS n_orphans FROM ew JOIN win USING (window_id) WHERE episode_ord % 3 <> 1 AND window_ord % 10 = 3
UNION ALL SELECT 'event_episode', count(*) FROM ee JOIN eps USING (episode_id) WHERE episode_ord % 3 = 1 UNION ALL SELECT 'event_rep_window', count(*) FROM er JOIN win USING (window_id) WHERE window_ord % 10 = 3""")
sql("pst_cascade", f"""{_BRIDGES}, v2 AS (SELECT * FROM evs WHERE event_ord % 2 <> 0), e2 AS (SELECT * FROM eps WHERE NOT (episode_ord % 3 = 1 AND episode_id NOT IN (SELECT episode_id FROM ee WHERE event_ord % 2 <> 0))),
w2 AS (SELECT * FROM win WHERE NOT (window_ord % 10 = 3 AND window_id NOT IN (SELECT window_id FROM ew WHERE episode_id IN (SELECT episode_id FROM e2)) AND window_id NOT IN (SELECT window_id FROM er WHERE event_ord % 2 <> 0)))""",
    "SELECT 'window' AS table_name, count(*) AS n FROM w2 UNION ALL SELECT 'episode', count(*) FROM e2 UNION ALL SELECT 'event', count(*) FROM v2 UNION ALL SELECT * FROM (VALUES ('episode_window', 0), ('event_episode', 0), ('event_rep_window', 0))")
sql("pst_merged_batches", o.GATE, o.ORACLES["pst_window_upsert"].split(chr(10))[-1])
