"""The whole memory as one keyed stateful operator: windows and questions of a stream in, decisions, episodes, events and hits out.

Rows of a micro-batch are taken in order of (time, kind), windows before questions of the same time. A window older than the last one taken is late: it
is counted and otherwise ignored. An "end" row drains the memory and answers what is left. State is one record for each stream, in the state store, and
survives restarts by the checkpoint. Of the archive nothing is kept: promoted windows are numbered, so that which of them it still has follows from their
number. Only the long-term events grow with the stream; event_limit bounds them, and archive_limit the archive, where asked."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import asdict
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..config import Config

INPUT = "stream_id string, kind string, time double, id string, window_ord long, start_time double, end_time double, vector array<double>, text_vector array<double>"
OUTPUT = "stream_id string, tag string, id string, ord long, start_time double, end_time double, members string, value double, note string"
EPS = 1e-8
_ORDER = {"window": 0, "question": 1, "end": 2}


def _cos(a: np.ndarray, b: np.ndarray) -> float:
    return float(a @ b) / (float(np.linalg.norm(a)) * float(np.linalg.norm(b)) + EPS)


def _unit(v: np.ndarray) -> np.ndarray:
    return v / (np.linalg.norm(v) + EPS)


class Memory:
    """One stream's memory; every method gives rows of OUTPUT without stream_id."""

    def __init__(self, config: Config, state: dict[str, Any] | None = None, archive_limit: int | None = None, event_limit: int | None = None) -> None:
        self.c, self.archive_limit, self.event_limit = config, archive_limit, event_limit
        self.s = state or {"recent": [], "pending": [], "episodes": [], "events": [], "waiting": [], "n_windows": 0, "n_promoted": 0, "n_late": 0, "n_episodes": 0, "n_events": 0, "last": None, "ended": False}

    # windows

    def window(self, w: dict[str, Any]) -> list[tuple]:
        s, out = self.s, []
        if s["last"] is not None and w["end"] < s["last"] or s["ended"]:
            s["n_late"] += 1
            return [("late", w["id"], w["ord"], w["start"], w["end"], None, None, None)]
        s["last"] = w["end"]
        s["n_windows"] += 1
        s["recent"].append(w)
        if len(s["recent"]) > self.c.recent_capacity:
            out += self._evict()
        while len(s["episodes"]) > self.c.episodic_capacity:
            out += self._consolidate()
        return out

    def _evict(self) -> list[tuple]:
        s = self.s
        w = s["recent"].pop(0)
        v = np.array(w["v"])
        best = max((_cos(v, np.array(o["v"])) for o in s["recent"]), default=None)
        new = best is None or 1 - best > self.c.novelty_threshold
        out = [("window", w["id"], w["ord"], w["start"], w["end"], None, best, "promoted" if new else "discarded")]
        if new:
            w["nth"] = s["n_promoted"]
            s["n_promoted"] += 1
            out += self._join(w, v)
        return out

    def _join(self, w: dict[str, Any], v: np.ndarray) -> list[tuple]:
        p, out = self.s["pending"], []
        if p:
            fits = (self.c.episode_max_len is None or len(p) < self.c.episode_max_len) and w["start"] - p[-1]["end"] <= self.c.episode_max_gap
            if not fits or _cos(v, _unit(np.mean([x["v"] for x in p], axis=0))) < self.c.episode_min_sim:
                out = self.flush()
        self.s["pending"].append(w)
        return out

    def _episode(self, p: list[dict[str, Any]], name: str) -> dict[str, Any]:
        vs = np.array([w["v"] for w in p])
        if len(p) == 1:
            pool, weights = vs[0], np.ones(1)
        else:
            t, n = np.array([w["start"] for w in p]), np.linalg.norm(vs, axis=1)
            sim = vs @ vs.T / (n[:, None] * n[None, :] + EPS)
            near = np.exp(-np.abs(t[:, None] - t[None, :]) / (self.c.sigma_time + EPS)) * sim
            np.fill_diagonal(near, 0)
            score = self.c.lambda_center * -((t - (t[0] + t[-1]) / 2) ** 2) / (2 * self.c.sigma_center**2 + EPS) + self.c.mu_consistency * near.sum(1)
            e = np.exp(score - score.max())
            weights = e / (e.sum() + EPS)
            pool = _unit(weights @ vs)
        reps = sorted(sorted(range(len(p)), key=lambda i: (weights[i], i), reverse=True)[: self.c.n_rep_windows or None])
        return {"id": name, "first": p[0]["nth"], "start": p[0]["start"], "end": p[-1]["end"], "v": pool.tolist(), "members": [w["id"] for w in p], "reps": [p[i]["id"] for i in reps], "rep_v": [p[i]["v"] for i in reps], "t": p[reps[0]]["t"]}

    def flush(self) -> list[tuple]:
        s = self.s
        if not s["pending"]:
            return []
        e = self._episode(s["pending"], f"ep-{s['n_episodes']}")
        e["ord"] = s["n_episodes"]
        s["pending"], s["n_episodes"] = [], s["n_episodes"] + 1
        s["episodes"].append(e)
        return [("episode", e["id"], e["ord"], e["start"], e["end"], ",".join(e["members"]), None, ",".join(e["reps"]))]

    def _consolidate(self) -> list[tuple]:
        s, group = self.s, [self.s["episodes"][0]]
        for e in s["episodes"][1:]:
            if len(group) >= self.c.episodic_merge_batch or e["start"] - group[-1]["end"] > self.c.event_max_gap or _cos(np.array(e["v"]), _unit(np.mean([g["v"] for g in group], axis=0))) < self.c.event_min_episode_sim:
                break
            group.append(e)
        s["episodes"] = s["episodes"][len(group) :]
        ev = {"id": f"ev-{s['n_events']}", "ord": s["n_events"], "start": group[0]["start"], "end": group[-1]["end"], "v": _unit(np.mean([g["v"] for g in group], axis=0)).tolist(), "rep_v": [v for g in group for v in g["rep_v"]], "t": group[0]["t"]}
        s["n_events"] += 1
        s["events"].append(ev)
        if self.event_limit and len(s["events"]) > self.event_limit:
            s["events"].pop(0)
        return [("event", ev["id"], ev["ord"], ev["start"], ev["end"], ",".join(g["id"] for g in group), None, ",".join(r for g in group for r in g["reps"]))]

    # questions

    def question(self, q: dict[str, Any], at: float) -> list[tuple]:
        out = self.flush() if self.c.cut_on_query else []
        s, c = self.s, self.c
        qv, qt = np.array(q["v"]), np.array(q["t"] if q["t"] is not None else q["v"])
        tier = s["episodes"] + ([self._episode(s["pending"], f"ep-pending-{s['pending'][0]['id']}-{s['pending'][-1]['id']}")] if s["pending"] else [])
        everything = s["recent"] + tier + s["events"]
        span = max(max((x["end"] for x in everything), default=0) - min((x["start"] for x in everything), default=0), 1.0)

        def score(x: dict[str, Any], vectors: list) -> float:
            see = max(_cos(qv, np.array(v)) for v in vectors)
            mean = see if x["t"] is None else c.alpha * see + c.beta * _cos(qt, np.array(x["t"]))
            fade = 1.0 if x["start"] <= at <= x["end"] else float(np.exp(-min(abs(at - x["start"]), abs(at - x["end"])) / max(span * c.tau_fraction, 1.0)))
            return mean * fade

        best = lambda rows, k: sorted(rows, key=lambda r: r[0], reverse=True)[:k]
        recent = best([(score(w, [w["v"]]), w) for w in s["recent"]], c.top_k)
        every = [(score(e, e["rep_v"] or [e["v"]]), e) for e in s["events"]]
        coarse = best(every, c.top_m)
        if coarse:
            newest = max(s["events"], key=lambda e: e["end"])
            if all(e["id"] != newest["id"] for _, e in coarse):
                coarse[-1] = next(r for r in every if r[1]["id"] == newest["id"])
        near = [e for e in tier if any(e["start"] <= r["end"] and e["end"] >= r["start"] for _, r in coarse)]
        tail = [e for e in (tier[-c.recent_episodes :] if c.recent_episodes > 0 else []) if all(e is not n for n in near)]
        found = best([(score(e, [e["v"]]), e) for e in (near + tail if coarse and near + tail else tier)], c.top_k)
        pinned = s["recent"][-c.pin_n :] if c.pin_n > 0 else []
        seen, ground = {w["id"] for w in pinned}, []
        archive = [i for _, e in found for i in self._near_reps(e)] if c.ground_archive else []
        for i in [w["id"] for _, w in recent] + archive:
            if i not in seen:
                seen.add(i)
                ground.append(i)
        rows = [("pinned", w["id"], None) for w in pinned] + [("recent", w["id"], x) for x, w in recent] + [("coarse", e["id"], x) for x, e in coarse] + [("episodic", e["id"], x) for x, e in found] + [("grounded", i, None) for i in ground]
        rank: dict[str, int] = {}
        for stage, i, x in rows:
            rank[stage] = rank.get(stage, 0) + 1
            out.append((f"hit:{stage}", q["id"], rank[stage], None, None, i, x, None))
        return out

    def _near_reps(self, e: dict[str, Any]) -> list[str]:
        """The representatives and their neighbours among the members that the archive still has; the open episode has all of its own."""
        is_open = bool(self.s["pending"]) and e["first"] == self.s["pending"][0]["nth"]
        gone = self.s["n_promoted"] - self.archive_limit - e["first"] if self.archive_limit and not is_open else 0
        have = e["members"][max(0, gone) :]
        if not e["reps"]:
            k, d = len(have) // 2, self.c.neighbor_radius
            return have if d < 0 or len(have) <= 2 * d + 1 else have[max(0, k - d) : k + d + 1]
        out: list[str] = []
        for r in e["reps"]:
            if r in have:
                k, d = have.index(r), max(0, self.c.neighbor_radius)
                out += [i for i in have[max(0, k - d) : k + d + 1] if i not in out]
        return out

    def end(self) -> list[tuple]:
        s, out = self.s, []
        s["ended"] = True
        while s["recent"]:
            out += self._evict()
        out += self.flush()
        while s["episodes"]:
            out += self._consolidate()
        for q in s["waiting"]:
            out += self.question(q, float("inf"))
        s["waiting"] = []
        return out

    def take(self, rows: list[dict[str, Any]]) -> list[tuple]:
        """Rows of INPUT in order. A question waits for the first window that ends at or after its time."""
        out = []
        for r in rows:
            if r["kind"] == "window":
                out += self.window({"id": r["id"], "ord": r["window_ord"], "start": r["start_time"], "end": r["end_time"], "v": r["vector"], "t": r["text_vector"]})
                due = [q for q in self.s["waiting"] if q["at"] <= r["end_time"]]
                self.s["waiting"] = [q for q in self.s["waiting"] if q["at"] > r["end_time"]]
                for q in due:
                    out += self.question(q, r["end_time"])
            elif r["kind"] == "question":
                q = {"id": r["id"], "at": r["time"], "v": r["vector"], "t": r["text_vector"]}
                if self.s["ended"]:
                    out += self.question(q, float("inf"))
                elif self.s["last"] is not None and self.s["last"] >= q["at"]:
                    out += self.question(q, self.s["last"])
                else:
                    self.s["waiting"] = sorted([*self.s["waiting"], q], key=lambda x: x["at"])
            else:
                out += self.end()
        return out


def _plain(v):
    return None if v is None or isinstance(v, float) and np.isnan(v) else v.tolist() if isinstance(v, np.ndarray) else v


def process(rows: DataFrame, config: Config, archive_limit: int | None = None, event_limit: int | None = None, forget_ended: bool = False) -> DataFrame:
    """Rows of INPUT, streaming or batch, to rows of OUTPUT in append mode.

    forget_ended: a stream's state is removed with its "end" row, once the questions that wait are answered; questions that come later still are then
    taken for a new stream's. Else ended streams are kept, and answer."""
    names = [x.split()[0] for x in OUTPUT.split(", ")]
    settings = asdict(config)

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        memory = Memory(Config(**settings), json.loads(state.get[0]) if state.exists else None, archive_limit, event_limit)
        records = [{k: _plain(v) for k, v in r.items()} for f in frames for r in f.to_dict("records")]
        records.sort(key=lambda r: (r["time"], _ORDER[r["kind"]], r["window_ord"] or 0, r["id"] or ""))
        out = memory.take(records)
        if forget_ended and memory.s["ended"]:
            if state.exists:
                state.remove()
        else:
            state.update((json.dumps(memory.s),))
        if out:
            yield pd.DataFrame([(key[0], *r) for r in out], columns=names).astype({"ord": "Int64"})

    return rows.groupBy("stream_id").applyInPandasWithState(run, OUTPUT, "state string", "append", GroupStateTimeout.NoTimeout)


def simulate(rows: list[dict[str, Any]], config: Config) -> list[tuple]:
    """The same, over one stream's rows in memory."""
    memory = Memory(config)
    return memory.take(sorted(rows, key=lambda r: (r["time"], _ORDER[r["kind"]], r["window_ord"] or 0, r["id"] or "")))
