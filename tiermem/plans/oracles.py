"""SQL (DuckDB dialect) for the registered queries, written from the operators' definitions and not from their plans."""

from __future__ import annotations

from .fixtures import CONFIG as C

ORACLES: dict[str, str] = {}

LEN = "sqrt(list_dot_product({0}, {0}))"


def _norm(v: str) -> str:
    return LEN.format(v)


def _cos(a: str, b: str) -> str:
    return f"(list_dot_product({a}, {b}) / ({_norm(a)} * {_norm(b)} + 1e-8))"


def _unit(v: str) -> str:
    return f"list_transform({v}, lambda y: y / ({_norm(v)} + 1e-8))"


def _mean_by(source: str, keys: str, vector: str) -> str:
    """Per-position mean of vectors by keys."""
    return f"(SELECT {keys}, list(x ORDER BY pos) AS v FROM (SELECT {keys}, pos, avg(x) AS x FROM (SELECT {keys}, unnest({vector}) AS x, generate_subscripts({vector}, 1) AS pos FROM {source}) GROUP BY ALL) GROUP BY ALL)"


F2 = """frames AS (SELECT user_id AS stream_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS frame_idx FROM events),
kept AS (SELECT *, row_number() OVER (PARTITION BY stream_id ORDER BY frame_idx) - 1 AS rn FROM frames WHERE frame_idx % 2 = 0),
fw AS (SELECT stream_id, rn // 3 AS window_ord, count(*) AS n_frames, max(frame_idx) AS last_sampled, list(frame_idx ORDER BY frame_idx) AS ids FROM kept GROUP BY ALL),
wins AS (SELECT stream_id, window_ord, n_frames, ids, CASE WHEN n_frames = 3 THEN (last_sampled + 1) / 2.0 ELSE (last_idx + 1) / 2.0 END AS raw_end
  FROM fw JOIN (SELECT stream_id, max(frame_idx) AS last_idx FROM frames GROUP BY ALL) USING (stream_id)),
bounded AS (SELECT *, round_even(coalesce(lag(raw_end) OVER (PARTITION BY stream_id ORDER BY window_ord), 0.0), 2)::DOUBLE AS start_time, round_even(raw_end, 2)::DOUBLE AS end_time FROM wins)"""

F1 = f"""emb AS (SELECT vec_id, (vec_id // 100)::VARCHAR AS stream_id, vec_id % 100 AS window_ord, label, embedding::DOUBLE[] AS raw FROM embeddings),
pos AS (SELECT vec_id, stream_id, window_ord, unnest(raw) AS x, generate_subscripts(raw, 1) AS pos FROM emb),
smooth AS (SELECT vec_id, list(a ORDER BY pos) AS a FROM (SELECT vec_id, pos, avg(x) OVER (PARTITION BY stream_id, pos ORDER BY window_ord ROWS BETWEEN 7 PRECEDING AND CURRENT ROW) AS a FROM pos) GROUP BY ALL),
win AS (SELECT stream_id, window_ord, 'w-' || vec_id AS window_id, window_ord * 3.0::DOUBLE AS start_time, window_ord * 3.0::DOUBLE + 3.0 AS end_time, {_unit('a')} AS v, 'label ' || label || ' window ' || window_ord AS summary_text,
  CASE WHEN vec_id % 7 <> 0 THEN raw END AS sv, 'label_' || label AS task_type, raw FROM emb JOIN smooth USING (vec_id))"""
GATE = f"""{F1},
gate AS (SELECT w.stream_id, w.window_ord, any_value(w.window_id) AS window_id, any_value(w.start_time) AS start_time, any_value(w.end_time) AS end_time, any_value(w.v) AS v, any_value(w.sv) AS sv, max({_cos('w.v', 'n.v')}) AS max_sim
  FROM win w LEFT JOIN win n ON n.stream_id = w.stream_id AND n.window_ord > w.window_ord AND n.window_ord <= w.window_ord + {C.recent_capacity} GROUP BY w.stream_id, w.window_ord),
prom AS (SELECT *, row_number() OVER (PARTITION BY stream_id ORDER BY window_ord) AS rn FROM gate WHERE max_sim IS NULL OR 1 - max_sim > {C.novelty_threshold})"""
QUESTIONS = f"""q AS (SELECT s.stream_id, s.stream_id || '-' || k AS question_id, (k + 1) * 57.0::DOUBLE + 0.5 AS t_seconds, w.v AS qv, w.raw AS qt, substr('ABCD', ((s.stream_id::INT + k) % 4 + 1)::INT, 1) AS answer, k
  FROM (SELECT DISTINCT stream_id FROM win) s CROSS JOIN range(6) r(k) JOIN win w ON w.stream_id = s.stream_id AND w.window_ord = (k * 17 + 5) % 100),
fired AS (SELECT q.*, f.window_ord AS fired_ord, coalesce(f.end_time, 'inf'::DOUBLE) AS stream_time FROM q LEFT JOIN LATERAL (SELECT min(window_ord) AS window_ord, min(end_time) AS end_time FROM win WHERE win.stream_id = q.stream_id AND win.end_time >= q.t_seconds) f ON true)"""


def _fold(source: str, out: str, key: str, gap: float, sim: float, most: int) -> str:
    """The greedy fold as a recursive query over rows numbered rn from 1."""
    joins = f"f.n < {most} AND NOT p.cut AND p.start_time - f.last_end <= {gap} AND {_cos('p.v', _unit('f.acc'))} >= {sim}"
    return f"""{out} AS (
  SELECT stream_id, rn, {key}, v AS acc, 1 AS n, end_time AS last_end, 0 AS run FROM {source} WHERE rn = 1
  UNION ALL
  SELECT stream_id, rn, {key}, CASE WHEN j THEN list_transform(list_zip(acc, v), lambda z: z[1] + z[2]) ELSE v END, CASE WHEN j THEN n + 1 ELSE 1 END, end_time, run + CASE WHEN j THEN 0 ELSE 1 END
  FROM (SELECT p.stream_id, p.rn, p.{key}, p.v, p.end_time, f.acc, f.n, f.run, ({joins}) AS j FROM {out} f JOIN {source} p ON p.stream_id = f.stream_id AND p.rn = f.rn + 1))"""


def _segments(cut: bool) -> str:
    flag = (
        f"EXISTS (SELECT 1 FROM fired WHERE fired.stream_id = p.stream_id AND fired.fired_ord - {C.recent_capacity} < p.window_ord AND fired.fired_ord - {C.recent_capacity} >= p.before)" if cut else "false"
    )
    return f"""{GATE}, {QUESTIONS},
flagged AS (SELECT p.*, coalesce({flag}, false) AS cut FROM (SELECT *, lag(window_ord) OVER (PARTITION BY stream_id ORDER BY rn) AS before FROM prom) p),
{_fold('flagged', 'fold', 'window_ord', C.episode_max_gap, C.episode_min_sim, C.episode_max_len)},
seg AS (SELECT p.*, f.run AS episode_ord FROM flagged p JOIN fold f USING (stream_id, window_ord))"""


SEG, SEG_PLAIN = _segments(True), _segments(False)
POOL = f"""{SEG},
mids AS (SELECT stream_id, episode_ord, (arg_min(start_time, window_ord) + arg_max(start_time, window_ord)) / 2 AS mid, count(*) AS n FROM seg GROUP BY ALL),
cons AS (SELECT a.stream_id, a.window_ord, sum(CASE WHEN a.window_ord = b.window_ord THEN 0 ELSE exp(-abs(a.start_time - b.start_time) / ({C.sigma_time} + 1e-8)) * {_cos('a.v', 'b.v')} END) AS c FROM seg a JOIN seg b ON a.stream_id = b.stream_id AND a.episode_ord = b.episode_ord GROUP BY ALL),
sco AS (SELECT seg.*, m.n, {C.lambda_center} * -((start_time - mid) ** 2) / (2 * {C.sigma_center} ** 2 + 1e-8) + {C.mu_consistency} * c AS s FROM seg JOIN mids m USING (stream_id, episode_ord) JOIN cons USING (stream_id, window_ord)),
ex AS (SELECT *, exp(s - max(s) OVER (PARTITION BY stream_id, episode_ord)) AS e FROM sco),
wei AS (SELECT *, e / (sum(e) OVER (PARTITION BY stream_id, episode_ord) + 1e-8) AS w FROM ex),
tot AS (SELECT stream_id, episode_ord, list(x ORDER BY pos) AS t FROM (SELECT stream_id, episode_ord, pos, sum(x * w) AS x FROM (SELECT stream_id, episode_ord, w, unnest(v) AS x, generate_subscripts(v, 1) AS pos FROM wei) GROUP BY ALL) GROUP BY ALL),
rep AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY stream_id, episode_ord ORDER BY w DESC, window_ord DESC) AS r FROM wei) WHERE r <= {C.n_rep_windows}),
reps AS (SELECT stream_id, episode_ord, list(window_id ORDER BY window_ord) AS rep_ids, list(v ORDER BY window_ord) AS rep_vs, arg_min({{'s': sv}}, window_ord).s AS sv FROM rep GROUP BY ALL),
eps AS (SELECT g.*, 'ep-' || stream_id || '-' || episode_ord AS episode_id, CASE WHEN g.n = 1 THEN g.one ELSE {_unit('tot.t')} END AS v, reps.rep_ids, reps.rep_vs, reps.sv,
    format('Episode {{:.1f}}–{{:.1f}}s ({{}} windows)', g.start_time, g.end_time, g.n) AS summary_text
  FROM (SELECT stream_id, episode_ord, min(start_time) AS start_time, max(end_time) AS end_time, count(*) AS n, list(window_id ORDER BY window_ord) AS ids, any_value(v) AS one, min(window_ord) AS first_ord, max(window_ord) AS last_ord FROM seg GROUP BY ALL) g
  JOIN tot USING (stream_id, episode_ord) JOIN reps USING (stream_id, episode_ord))"""
EVENTS = f"""{POOL},
numbered AS (SELECT *, episode_ord + 1 AS rn, false AS cut FROM eps),
{_fold('numbered', 'efold', 'episode_ord', C.event_max_gap, C.event_min_episode_sim, C.episodic_merge_batch)},
clu AS (SELECT n.*, f.run AS event_ord FROM numbered n JOIN efold f USING (stream_id, episode_ord)),
cent AS {_mean_by('clu', 'stream_id, event_ord', 'v')},
evs AS (SELECT g.*, 'ev-' || stream_id || '-' || event_ord AS event_id, {_unit('cent.v')} AS v, format('Event {{:.1f}}–{{:.1f}}s: ', start_time, end_time) || array_to_string(texts[1:3], ' | ') AS summary_text
  FROM (SELECT stream_id, event_ord, min(start_time) AS start_time, max(end_time) AS end_time, count(*) AS n_episodes, list(episode_id ORDER BY episode_ord) AS ids, flatten(list(rep_ids ORDER BY episode_ord)) AS rep_ids, flatten(list(rep_vs ORDER BY episode_ord)) AS rep_vs, list(summary_text ORDER BY episode_ord) AS texts, arg_min({{'s': sv}}, episode_ord).s AS sv, max(episode_ord) + 1 AS episodes_to FROM clu GROUP BY ALL) g
  JOIN cent USING (stream_id, event_ord))"""
STATE = f"""{EVENTS},
pts AS (SELECT stream_id, fired_ord, fired_ord - {C.recent_capacity} AS up_to, lag(fired_ord - {C.recent_capacity}, 1, -1000000) OVER (PARTITION BY stream_id ORDER BY fired_ord) AS up_to_before FROM (SELECT DISTINCT stream_id, fired_ord FROM fired WHERE fired_ord IS NOT NULL)),
formed AS (SELECT p.*, (SELECT count(*) FROM eps e WHERE e.stream_id = p.stream_id AND e.first_ord <= p.up_to) AS n_episodes, (SELECT count(*) > 0 FROM prom o WHERE o.stream_id = p.stream_id AND o.window_ord > p.up_to_before AND o.window_ord <= p.up_to) AS pending FROM pts p),
took AS (SELECT f.*, (SELECT min(m) FROM (SELECT 0 AS m, 0 AS c UNION ALL SELECT e.event_ord + 1, e.episodes_to FROM evs e WHERE e.stream_id = f.stream_id) WHERE f.n_episodes - f.pending::INT - c <= {C.episodic_capacity}) AS n_events FROM formed f),
st AS (SELECT fired.*, t.n_episodes, t.n_events, CASE WHEN t.n_events = 0 THEN 0 ELSE e.episodes_to END AS first_episode FROM fired LEFT JOIN took t ON t.stream_id = fired.stream_id AND t.fired_ord = fired.fired_ord LEFT JOIN evs e ON e.stream_id = t.stream_id AND e.event_ord = t.n_events - 1),
rec AS (SELECT st.question_id, st.stream_id, st.qv, st.qt, st.fired_ord, st.stream_time, w.window_ord, w.window_id, w.start_time, w.end_time, w.v, w.sv FROM st JOIN win w ON w.stream_id = st.stream_id AND w.window_ord BETWEEN st.fired_ord - {C.recent_capacity} + 1 AND st.fired_ord),
tier AS (SELECT st.question_id, st.stream_id, st.qv, st.qt, st.stream_time, e.episode_ord, e.episode_id, e.start_time, e.end_time, e.v, e.sv FROM st JOIN eps e ON e.stream_id = st.stream_id AND e.episode_ord >= st.first_episode AND e.episode_ord < st.n_episodes),
lng AS (SELECT st.question_id, st.stream_id, st.qv, st.qt, st.stream_time, e.event_ord, e.event_id, e.start_time, e.end_time, e.rep_vs, e.sv FROM st JOIN evs e ON e.stream_id = st.stream_id AND (st.fired_ord IS NULL OR e.event_ord < st.n_events)),
spn AS (SELECT question_id, greatest(max(end_time) - min(start_time), 1.0) AS span FROM (SELECT question_id, start_time, end_time FROM rec UNION ALL SELECT question_id, start_time, end_time FROM tier UNION ALL SELECT question_id, start_time, end_time FROM lng) GROUP BY ALL)"""
_DECAY = f"CASE WHEN stream_time BETWEEN start_time AND end_time THEN 1.0 ELSE exp(-least(abs(stream_time - start_time), abs(stream_time - end_time)) / greatest(span * {C.tau_fraction}, 1.0)) END"
_SCORE = f"(CASE WHEN sv IS NULL THEN vis ELSE {C.alpha} * vis + {C.beta} * {_cos('qt', 'sv')} END) * decay + 0.0"
HITS = f"""{STATE},
rs AS (SELECT *, {_SCORE} AS score FROM (SELECT *, {_cos('qv', 'v')} AS vis, {_DECAY} AS decay FROM rec JOIN spn USING (question_id))),
rh AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, window_ord) AS rank FROM rs QUALIFY rank <= {C.top_k}),
ls AS (SELECT *, {_SCORE} AS score FROM (SELECT *, list_max(list_transform(rep_vs, lambda r: {_cos('qv', 'r')})) AS vis, {_DECAY} AS decay FROM lng JOIN spn USING (question_id))),
lr AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, event_ord) AS r FROM ls),
best AS (SELECT * FROM lr WHERE r <= {C.top_m}),
newest AS (SELECT question_id, arg_max(event_id, (end_time, -event_ord)) AS newest_id FROM ls GROUP BY ALL),
absent AS (SELECT question_id, newest_id FROM newest WHERE NOT EXISTS (SELECT 1 FROM best WHERE best.question_id = newest.question_id AND best.event_id = newest.newest_id)),
ch AS (SELECT b.*, b.r AS rank, false AS forced FROM best b WHERE NOT EXISTS (SELECT 1 FROM absent a WHERE a.question_id = b.question_id AND b.r = (SELECT max(r) FROM best x WHERE x.question_id = b.question_id))
  UNION ALL SELECT l.*, (SELECT max(r) FROM best x WHERE x.question_id = l.question_id) AS rank, true FROM lr l JOIN absent a ON a.question_id = l.question_id AND a.newest_id = l.event_id),
inr AS (SELECT DISTINCT t.question_id, t.episode_ord, 'range' AS via FROM tier t JOIN ch ON ch.question_id = t.question_id AND t.start_time <= ch.end_time AND t.end_time >= ch.start_time),
tails AS (SELECT question_id, episode_ord, 'tail' AS via FROM (SELECT question_id, episode_ord, count(*) OVER (PARTITION BY question_id ORDER BY episode_ord DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS back FROM tier) t WHERE back <= {C.recent_episodes} AND question_id IN (SELECT question_id FROM ch) AND NOT EXISTS (SELECT 1 FROM inr WHERE inr.question_id = t.question_id AND inr.episode_ord = t.episode_ord)),
cands AS (SELECT * FROM inr UNION ALL SELECT * FROM tails),
named_ep AS (SELECT * FROM cands UNION ALL SELECT question_id, episode_ord, 'all' FROM tier WHERE question_id NOT IN (SELECT question_id FROM cands)),
cd AS (SELECT t.*, n.via FROM tier t JOIN named_ep n ON n.question_id = t.question_id AND n.episode_ord = t.episode_ord),
es AS (SELECT *, {_SCORE} AS score FROM (SELECT *, {_cos('qv', 'v')} AS vis, {_DECAY} AS decay FROM cd JOIN spn USING (question_id))),
eh AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, CASE WHEN via = 'tail' THEN 1 ELSE 0 END, episode_ord) AS rank FROM es QUALIFY rank <= {C.top_k}),
mem AS (SELECT stream_id, episode_ord, window_id, window_ord, row_number() OVER (PARTITION BY stream_id, episode_ord ORDER BY window_ord) - 1 AS position FROM seg),
rpos AS (SELECT m.stream_id, m.episode_ord, m.position, row_number() OVER (PARTITION BY m.stream_id, m.episode_ord ORDER BY m.position) AS k FROM mem m JOIN rep USING (stream_id, episode_ord, window_ord)),
nb AS (SELECT stream_id, episode_ord, position, window_id, row_number() OVER (PARTITION BY stream_id, episode_ord ORDER BY k, position) - 1 AS seq
  FROM (SELECT m.stream_id, m.episode_ord, m.position, m.window_id, min(r.k) AS k FROM mem m JOIN rpos r ON r.stream_id = m.stream_id AND r.episode_ord = m.episode_ord AND m.position BETWEEN r.position - {C.neighbor_radius} AND r.position + {C.neighbor_radius} GROUP BY ALL)),
pin AS (SELECT question_id, window_id, start_time, end_time, row_number() OVER (PARTITION BY question_id ORDER BY window_ord) AS rank FROM rec WHERE window_ord > fired_ord - {C.pin_n}),
named AS (SELECT question_id, window_id, 0 AS a, rank AS b, 0 AS c FROM rh UNION ALL SELECT eh.question_id, nb.window_id, 1, eh.rank, nb.seq FROM eh JOIN nb USING (stream_id, episode_ord)),
gr AS (SELECT question_id, window_id, arg_min(a, (a, b, c)) AS from_archive, row_number() OVER (PARTITION BY question_id ORDER BY min((a, b, c))) AS rank FROM named n WHERE NOT EXISTS (SELECT 1 FROM pin WHERE pin.question_id = n.question_id AND pin.window_id = n.window_id) GROUP BY question_id, window_id)"""


def sql(name: str, with_: str, body: str) -> None:
    ORACLES[name] = f"WITH RECURSIVE {with_}\n{body}" if with_ else body


_COORDS = "round(v[1], 6) + 0.0 AS v0, round(v[64], 6) + 0.0 AS v63, round(list_sum(list_transform(v, lambda y: abs(y))), 6) AS v_abs"
R = lambda x: f"round({x}, 6) + 0.0"
J = lambda x: f"array_to_string({x}, ',')"

sql("win_subsample", F2, "SELECT stream_id, count(*) AS n_kept, max(frame_idx) AS last_kept FROM kept GROUP BY stream_id")
sql("win_count_tumbling", F2, f"SELECT stream_id, window_ord, n_frames, ids[n_frames // 2 + 1] AS rep_frame_id, {J('ids')} AS frame_ids FROM wins")
sql("win_bounds", F2, "SELECT stream_id, window_ord, start_time, end_time, end_time - start_time AS duration FROM bounded")
sql("win_partial_tail", F2, "SELECT stream_id, window_ord, n_frames, end_time FROM bounded WHERE n_frames < 3")
sql("win_samples", F2, f"""SELECT stream_id, {J('list_transform(range(8), lambda i: a[(floor(i * (len(a) - 1) / 7.0))::INT + 1])')} AS uniform, {J('CASE WHEN len(a) <= 5 THEN a ELSE list_transform(range(5), lambda i: a[(floor(i * len(a) / 5.0))::INT + 1]) END')} AS strided
FROM (SELECT stream_id, list(window_ord ORDER BY window_ord) AS a FROM wins GROUP BY ALL)""")

sql("vec_cosine_pairs", "", f"SELECT a.vec_id, {R(_cos('a.v', 'b.v'))} AS cosine FROM (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings) a JOIN (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings) b ON b.vec_id = a.vec_id + 1")
sql("vec_centroid_by_label", f"e AS (SELECT label, embedding::DOUBLE[] AS v FROM embeddings), m AS {_mean_by('e', 'label', 'v')}, u AS (SELECT label, {_unit('v')} AS v FROM m)", f"SELECT label, {_COORDS} FROM u")
sql("vec_softmax_weights", "l AS (SELECT l_orderkey, l_linenumber, l_discount * 10 AS s FROM lineitem), x AS (SELECT *, exp(s - max(s) OVER (PARTITION BY l_orderkey)) AS e FROM l)", f"SELECT l_orderkey, l_linenumber, {R('e / (sum(e) OVER (PARTITION BY l_orderkey) + 1e-8)')} AS weight FROM x")
sql("vec_max_similarity", f"""e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings), m AS {_mean_by('e', 'label', 'v')},
near AS (SELECT e.*, row_number() OVER (PARTITION BY e.label ORDER BY round({_cos('e.v', 'm.v')}, 9) DESC, vec_id) AS rn FROM e JOIN m ON e.label IS NOT DISTINCT FROM m.label)""",
    f"SELECT a.vec_id, {R('max(' + _cos('a.v', 'b.v') + ')')} AS best FROM e a LEFT JOIN near b ON a.label IS NOT DISTINCT FROM b.label AND b.rn <= {C.n_rep_windows} GROUP BY a.vec_id")

sql("scl_hms", "e AS (SELECT event_id, string_split(CASE event_id % 5 WHEN 0 THEN '00:00:00' WHEN 1 THEN strftime(ts, '%H:%M:%S') WHEN 2 THEN strftime(ts, '%M:%S') ELSE strftime(ts, '%S') END, ':') AS p FROM events)", "SELECT event_id, list_reduce(list_transform(p, lambda x: x::DOUBLE), lambda a, b: a * 60 + b) AS seconds FROM e")
sql("txt_first_letter", "", "SELECT doc_id, coalesce(nullif(regexp_extract(text, '[ABCD]'), ''), '?') AS letter FROM documents")
sql("txt_mcq_split", "", r"""SELECT o_orderkey, 'Is ' || o_orderpriority || ' urgent?' AS stem, CASE WHEN o_orderkey % 3 <> 0 THEN 'A. yes ' || o_orderstatus || ',B. no,C. it/may,D. be' ELSE '' END AS options FROM orders""")
sql("txt_range_end", "", "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN strftime(ts, '%H:%M') ELSE strftime(ts, '%M:%S') END AS end_ref FROM events")
sql("txt_qa_convert", "", "SELECT o_orderkey::VARCHAR AS question_id, CASE o_orderkey % 4 WHEN 0 THEN 'unknown' WHEN 1 THEN o_orderstatus ELSE o_orderpriority || ', ' || o_orderstatus END AS task_type FROM orders")
sql("txt_literal_list", "", """SELECT event_id, CASE event_id % 10 WHEN 0 THEN 'a' || event_id || '|b' WHEN 1 THEN 'I don''t know ' || event_id || '|say "x"|c' WHEN 3 THEN 'no list ' || event_id WHEN 4 THEN '[broken ' || event_id
WHEN 6 THEN '1|' || event_id || '|x' WHEN 7 THEN 'quoted ' || event_id WHEN 9 THEN 'tab' || chr(9) || ' it''s ' || event_id ELSE '' END AS items, (CASE WHEN event_id % 10 IN (2, 5, 8) THEN 0 WHEN event_id % 10 IN (1, 6) THEN 3 WHEN event_id % 10 = 0 THEN 2 ELSE 1 END)::INT AS n_items FROM events""")
sql("txt_ids", "", "SELECT event_id, (event_id % 50)::INT AS sample_id, 'abc-' || lpad(event_id::VARCHAR, 7, '0') AS video_id FROM events")
sql("txt_chunk", "", f"""WITH t AS (SELECT doc_id, (doc_id % 14)::INT AS n FROM documents), c AS (SELECT doc_id, n, greatest(1, (n + 4) // 5) AS n_chunks FROM t), p AS (SELECT doc_id, n, n_chunks::INT AS n_chunks, unnest(range(n_chunks)) AS place FROM c),
z AS (SELECT *, least(5, n) AS widest, range(place * 5 + 1, least(n, place * 5 + 5) + 1) AS own FROM p)
SELECT doc_id, n_chunks, place::INT AS place, {J("list_concat(list_concat([101::BIGINT], list_concat(own, [102::BIGINT])), list_transform(range(widest - len(own)), lambda i: 0::BIGINT))")} AS ids, {J("list_concat(list_transform(range(len(own) + 2), lambda i: 1), list_transform(range(widest - len(own)), lambda i: 0))")} AS mask FROM z""")
sql("txt_option", f"{F1}, {QUESTIONS}", "SELECT question_id, answer || '. choice ' || k AS chosen FROM q")
sql("sum_window_note", "", "SELECT (vec_id // 100)::VARCHAR AS stream_id, vec_id % 100 AS window_ord, format('Scene at {:.1f}–{:.1f}s', (vec_id % 100) * 3.0::DOUBLE, (vec_id % 100) * 3.0::DOUBLE + 3) AS note FROM embeddings")
sql("sum_episode_stitch", SEG, """SELECT stream_id, episode_ord, CASE WHEN count(*) = 1 THEN max(format('Scene at {:.1f}–{:.1f}s', start_time, end_time)) ELSE format('Episode {:.1f}–{:.1f}s: ', min(start_time), max(end_time)) || string_agg(format('Scene at {:.1f}–{:.1f}s', start_time, end_time), '; ' ORDER BY window_ord) END AS summary FROM seg GROUP BY ALL""")
sql("sum_event_note", EVENTS, """SELECT stream_id, event_ord, format('Event {:.1f}–{:.1f}s: ', start_time, end_time) || array_to_string(list_transform(texts[1:5], lambda t: trim(string_split(t, ':')[1])), ' → ') AS note FROM evs""")

sql("mem_novelty", GATE, f"SELECT stream_id, window_ord, {R('max_sim')} AS max_sim, (max_sim IS NULL OR 1 - max_sim > {C.novelty_threshold}) AS promoted FROM gate")
sql("mem_novelty_stats", GATE, "SELECT stream_id, count(*) AS n_windows, count(p.window_ord) AS n_promoted, count(*) - count(p.window_ord) AS n_discarded FROM gate LEFT JOIN (SELECT stream_id, window_ord FROM prom) p USING (stream_id, window_ord) GROUP BY stream_id")
sql("mem_segment", SEG_PLAIN, "SELECT stream_id, window_ord, episode_ord FROM seg")
sql("mem_segment_cut", SEG, "SELECT stream_id, window_ord, episode_ord FROM seg")
sql("mem_episode_summary_row", POOL, f"SELECT stream_id, episode_ord, episode_id, start_time, end_time, n AS n_members, {J('ids')} AS members, summary_text FROM eps")
sql("mem_pool_weights", POOL, f"SELECT stream_id, episode_ord, window_ord, {R('w')} AS weight FROM wei")
sql("mem_pool_vector", POOL, f"SELECT stream_id, episode_ord, {_COORDS} FROM eps")
sql("mem_representatives", POOL, f"SELECT stream_id, episode_ord, {J('rep_ids')} AS reps FROM eps")
sql("mem_rep_fallback", POOL, f"SELECT stream_id, episode_ord, window_ord FROM (SELECT s.*, row_number() OVER (PARTITION BY s.stream_id, s.episode_ord ORDER BY {_cos('s.v', 'e.v')} DESC, s.window_ord) AS k FROM seg s JOIN eps e USING (stream_id, episode_ord)) WHERE k <= 2")
sql("mem_pending", POOL, f"SELECT stream_id, 'ep-pending-' || ids[1] || '-' || ids[-1] AS episode_id, start_time, end_time, {_COORDS} FROM eps QUALIFY row_number() OVER (PARTITION BY stream_id ORDER BY episode_ord DESC) = 1")
sql("mem_events", EVENTS, f"SELECT stream_id, event_ord, event_id, start_time, end_time, n_episodes, {J('ids')} AS members, {_COORDS} FROM evs")
sql("mem_event_reps", EVENTS, f"SELECT stream_id, event_ord, {J('rep_ids')} AS reps, summary_text FROM evs")
sql("mem_asof_state", STATE, "SELECT question_id, fired_ord, n_episodes, n_events, first_episode FROM st")
sql("mem_center_grounding", POOL, f"SELECT stream_id, episode_ord, {J('CASE WHEN n <= 3 THEN ids ELSE ids[n // 2 : n // 2 + 2] END')} AS windows FROM eps")
sql("mem_rep_neighbours", HITS, "SELECT stream_id, episode_ord, seq, position, window_id FROM nb")
sql("mem_stats", EVENTS, """SELECT stream_id, 0::BIGINT AS recent, 0::BIGINT AS pending_episode, 0::BIGINT AS episodic, n_events AS long_term, n_promoted, n_windows - n_promoted AS n_discarded, n_episodes AS n_episodes_flushed, n_events AS n_consolidated, n_members, longest_episode, largest_event FROM
(SELECT stream_id, count(*) AS n_windows FROM gate GROUP BY ALL) JOIN (SELECT stream_id, count(*) AS n_promoted FROM prom GROUP BY ALL) USING (stream_id) JOIN
(SELECT stream_id, count(*) AS n_episodes, sum(n)::BIGINT AS n_members, max(n) AS longest_episode FROM eps GROUP BY ALL) USING (stream_id) JOIN (SELECT stream_id, count(*) AS n_events, max(n_episodes) AS largest_event FROM evs GROUP BY ALL) USING (stream_id)""")

sql("ret_span", STATE, "SELECT question_id, span FROM spn")
sql("ret_decay", HITS, f"SELECT question_id, event_ord, {R('decay')} AS decay FROM ls")
sql("ret_stage0", HITS, f"SELECT question_id, rank, window_id, {R('score')} AS score FROM rh")
sql("ret_stage_a", HITS, f"SELECT question_id, rank, event_id, {R('score')} AS score FROM ch")
sql("ret_latest_forced", HITS, "SELECT question_id, event_id, rank, forced FROM ch JOIN newest USING (question_id) WHERE event_id = newest_id")
sql("ret_gate", HITS, "SELECT question_id, episode_id FROM cd WHERE via = 'range'")
sql("ret_tail", HITS, "SELECT question_id, episode_id, via FROM cd")
sql("ret_stage_b", HITS, f"SELECT question_id, rank, episode_id, {R('score')} AS score FROM eh")
sql("ret_grounded", HITS, "SELECT question_id, rank, window_id, from_archive FROM gr")
sql("ret_pinned", HITS, "SELECT question_id, rank, window_id FROM pin")
_SCORES = "SELECT question_id, event_id AS entry_id, score FROM ch UNION ALL SELECT question_id, episode_id, score FROM eh UNION ALL SELECT question_id, window_id, score FROM rh"
sql("ret_scores", HITS, f"SELECT question_id, entry_id, {R('score')} AS score FROM ({_SCORES})")
_ALL = f"""SELECT question_id, 'pinned' AS stage, rank, window_id AS entry_id, NULL::DOUBLE AS score FROM pin UNION ALL SELECT question_id, 'recent', rank, window_id, score FROM rh UNION ALL SELECT question_id, 'coarse', rank, event_id, score FROM ch
UNION ALL SELECT question_id, 'episodic', rank, episode_id, score FROM eh UNION ALL SELECT gr.question_id, 'grounded', gr.rank, gr.window_id, rh.score FROM gr LEFT JOIN rh USING (question_id, window_id)"""
sql("ret_hits", HITS, f"SELECT question_id, stage, rank, entry_id, {R('score')} AS score FROM ({_ALL})")
sql("ret_late_questions", HITS, f"SELECT question_id, rank, event_id, {R('score')} AS score FROM ch WHERE stream_time = 'inf'::DOUBLE")

BAS = f"""{F1}, {QUESTIONS}, bc AS (SELECT f.question_id, f.qv, w.window_id, w.window_ord, w.v FROM fired f JOIN win w ON w.stream_id = f.stream_id AND w.window_ord > coalesce(f.fired_ord, 99) - {C.baseline_windows} AND w.window_ord <= coalesce(f.fired_ord, 99))"""
sql("bas_topk", BAS, f"SELECT question_id, rank, window_id, {R('score')} AS score FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, window_ord) AS rank FROM (SELECT *, {_cos('qv', 'v')} AS score FROM bc)) WHERE rank <= {C.baseline_k}")
sql("bas_context", BAS, "SELECT question_id, window_id FROM bc")
sql("bas_stats", BAS, f"SELECT question_id, count(*) AS recent, {C.baseline_windows}::INT AS capacity FROM bc GROUP BY question_id")

DESC = f"""{HITS},
des AS (SELECT question_id, 'pinned' AS stage, rank, window_id AS entry_id, pin.start_time, pin.end_time, w.summary_text, NULL::DOUBLE AS score FROM pin JOIN win w USING (window_id)
UNION ALL SELECT ch.question_id, 'coarse', ch.rank, ch.event_id, ch.start_time, ch.end_time, e.summary_text, ch.score FROM ch JOIN evs e USING (event_id)
UNION ALL SELECT eh.question_id, 'episodic', eh.rank, eh.episode_id, eh.start_time, eh.end_time, e.summary_text, eh.score FROM eh JOIN eps e USING (episode_id)
UNION ALL SELECT gr.question_id, 'grounded', gr.rank, gr.window_id, w.start_time, w.end_time, w.summary_text, rh.score FROM gr JOIN win w USING (window_id) LEFT JOIN rh ON rh.question_id = gr.question_id AND rh.window_id = gr.window_id)"""
_LINE = "format('  [{:.1f}–{:.1f}s]', start_time, end_time) || CASE WHEN stage IN ('coarse', 'episodic') THEN coalesce(format(' sim={:.3f}', score), ' sim=—') WHEN stage = 'grounded' THEN coalesce(format(' sim={:.3f}', score), '') ELSE '' END || '  ' || summary_text"
sql("fmt_evidence_lines", DESC, f"SELECT question_id, stage, rank, {_LINE} AS line FROM des")
_SOURCES = "coalesce(string_agg(CASE stage WHEN 'pinned' THEN 'pinned_recent' WHEN 'grounded' THEN 'grounding_window' ELSE stage END, ',' ORDER BY CASE stage WHEN 'pinned' THEN 0 WHEN 'episodic' THEN 1 ELSE 2 END, rank) FILTER (stage <> 'coarse' AND shown), '')"
sql("fmt_llm_counts", DESC, f"""SELECT q.question_id, count(*) FILTER (stage <> 'coarse') AS n_visual_tokens, count(*) FILTER (stage = 'coarse') AS coarse_event_count, count(*) FILTER (stage = 'episodic') AS episodic_hit_count, (count(*) FILTER (stage <> 'coarse'))::INT AS n_context,
{_SOURCES} AS sources FROM q LEFT JOIN (SELECT *, true AS shown FROM des) d ON d.question_id = q.question_id GROUP BY q.question_id""")
FRAMES = f"""{HITS},
fr AS (SELECT question_id, window_id, 0 AS g, rank AS r, rank FROM gr UNION ALL SELECT question_id, window_id, 1, -rank, rank FROM pin),
fr2 AS (SELECT question_id, window_id, min((g, r, rank)) AS spot FROM fr WHERE regexp_extract(window_id, '\\d+')::BIGINT % 5 <> 0 GROUP BY ALL),
fr3 AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY spot) AS n FROM fr2 QUALIFY n <= {C.max_frames}),
slots AS (SELECT question_id, window_id, spot[1] AS g, row_number() OVER (PARTITION BY question_id ORDER BY spot[1], spot[3]) AS slot FROM fr3)"""
_SOURCE = "CASE WHEN g = 0 THEN 'grounding_window' ELSE 'pinned_recent' END"
sql("fmt_frames", FRAMES, f"SELECT question_id, slot, window_id, {_SOURCE} AS source FROM slots")
sql("fmt_image_lines", FRAMES, f"SELECT question_id, slot, format('  Image {{}}: [{{:.1f}}–{{:.1f}}s] (', slot, start_time, end_time) || {_SOURCE} || ')' AS line FROM slots JOIN win USING (window_id)")

RECS = "recs AS (SELECT CASE WHEN doc_id % 11 <> 0 THEN lang END AS task_type, quality = 1 AS h, toxic = 0 AS b FROM labels JOIN documents USING (doc_id))"
_FLAT = "count(*) AS n_qas, count(*) FILTER (h) AS hier_correct, count(*) FILTER (b) AS base_correct, round_even(count(*) FILTER (h) / count(*), 4)::DOUBLE AS hier_accuracy, round_even(count(*) FILTER (b) / count(*), 4)::DOUBLE AS base_accuracy, round_even((count(*) FILTER (h) - count(*) FILTER (b)) / count(*), 4)::DOUBLE AS delta_accuracy"
sql("evl_firing", f"{F1}, {QUESTIONS}", "SELECT question_id, t_seconds, fired_ord, stream_time FROM fired")
sql("evl_accuracy", RECS, f"SELECT {_FLAT} FROM recs")
sql("evl_flat", RECS, f"SELECT {_FLAT}, 7::INT AS videos_completed FROM recs")
sql("evl_paired", RECS, "SELECT count(*) FILTER (h AND NOT b) AS hierarchical_only, count(*) FILTER (b AND NOT h) AS baseline_only, count(*) FILTER (h AND b) AS both_correct, count(*) FILTER (NOT h AND NOT b) AS both_wrong FROM recs")
sql("evl_by_task", RECS, "SELECT coalesce(nullif(task_type, ''), 'unknown') AS task_type, count(*) AS n, round_even(count(*) FILTER (h) / count(*), 4)::DOUBLE AS hierarchical_accuracy, round_even(count(*) FILTER (b) / count(*), 4)::DOUBLE AS baseline_accuracy FROM recs GROUP BY 1")
sql("evl_judged", "", "SELECT doc_id, coalesce(nullif(regexp_extract(text, '[ABCD]'), ''), '?') AS pred_letter, substr('ABCD', (doc_id % 4 + 1)::INT, 1) AS ground_truth, coalesce(nullif(regexp_extract(text, '[ABCD]'), ''), '?') = substr('ABCD', (doc_id % 4 + 1)::INT, 1) AS correct FROM documents")
MAN = "man AS (SELECT c_custkey::INT AS sample_id, 'clip-' || (c_custkey % 40) AS video_key FROM customer)"
sql("evl_select", MAN, "SELECT sample_id, video_key FROM man WHERE sample_id BETWEEN 1 AND 399 AND (sample_id % 40) % 3 = 0 ORDER BY sample_id LIMIT 25")
sql("evl_resume", MAN, "SELECT sample_id, video_key FROM man WHERE sample_id % 3 <> 0")
sql("evl_sample", MAN, "SELECT sample_id, video_key FROM man ORDER BY md5('42|' || sample_id), sample_id LIMIT 30")

sql("pst_window_upsert", GATE, "SELECT g.window_id, g.start_time, g.end_time, CASE WHEN p.window_id IS NULL THEN 'recent' ELSE 'episodic' END AS tier, CASE WHEN p.window_id IS NULL THEN w.summary_text ELSE 'kept ' || w.summary_text END AS summary_text FROM gate g JOIN win w USING (window_id) LEFT JOIN prom p USING (window_id)")
sql("pst_bridge_rows", HITS, "SELECT 'ep-' || stream_id || '-' || episode_ord AS episode_id, mem.window_id, position, list_contains(rep_ids, mem.window_id) AS is_representative FROM mem JOIN eps USING (stream_id, episode_ord)")
sql("pst_event_bridge", EVENTS, "SELECT event_id, unnest(ids) AS episode_id, generate_subscripts(ids, 1) - 1 AS position FROM evs")
sql("pst_rep_dedupe", EVENTS, "SELECT event_id, window_id, min(position) AS position FROM (SELECT event_id, unnest(rep_ids) AS window_id, generate_subscripts(rep_ids, 1) - 1 AS position FROM evs) GROUP BY ALL")
sql("pst_counts", EVENTS, "SELECT 'window' AS table_name, count(*) AS n FROM win UNION ALL SELECT 'episode', count(*) FROM eps UNION ALL SELECT 'event', count(*) FROM evs")
sql("pst_integrity", "", "SELECT * FROM (VALUES ('episode_window', 0::BIGINT), ('event_episode', 0), ('event_rep_window', 0)) t(bridge, n_orphans)")
