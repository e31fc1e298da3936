"""Quality rules with host verdicts: rule failures are counted by host, rates shrunk with a beta prior fitted to all hosts, verdicts joined back.

Defined cases: a null text has no words (and so fails); a null host gets no verdict (its documents stand on their own); rows that repeat count
each; an empty table gives no rows; clashing names among the other columns do no harm, as inner columns are named _q_*."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, materialize, mixed, utf8, word_hashes, words

#: Base rule: fewer words, or a larger share (in hundredths) of words in repeated windows, fails.
MIN_WORDS, MAX_REPEAT = 10, 20
WINDOW = 5
#: A host is rejected if its shrunk rate of failing documents is above this.
MAX_HOST_RATE = 0.5
#: Verdicts of so many hosts are small enough to be sent to every task; beyond, hosts are split by so many salts.
SENT_HOSTS, SALTS = 50_000, 64
#: The other rules whose failures are counted by host; a failure of these alone never rejects a document.
RULES = {"base": "_q_base_failed", "symbols": "_q_n_symbols > 0.1 * _q_word_chars", "lines": "_q_n_dup_lines > 0.3 * _q_n_lines", "length": "_q_word_chars < 2 * _q_n_words or _q_word_chars > 15 * _q_n_words"}
_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(b"#*$%&|<>")] = True
METRICS = {"_q_n_words": pa.int64(), "_q_word_chars": pa.int64(), "_q_n_symbols": pa.int64(), "_q_n_dup_lines": pa.int64(), "_q_n_repeat_words": pa.int64(), "_q_n_lines": pa.int64(), "_q_base_failed": pa.bool_()}


def _repeated(keys: np.ndarray) -> np.ndarray:
    """Which keys occur more than once. The low 24 bits of a key give way to its position, so both are sorted at once."""
    n = len(keys)
    if n < 2:
        return np.zeros(n, bool)
    if n >= 1 << 24:
        order = np.argsort(keys, kind="stable")
        s = keys[order]
    else:
        low = np.uint64((1 << 24) - 1)
        both = np.sort((keys & ~low) | np.arange(n, dtype=np.uint64))
        order = (both & low).astype(np.int64)
        s = both & ~low
    same = s[1:] == s[:-1]
    out = np.zeros(n, bool)
    near = np.zeros(n, bool)
    near[1:] |= same
    near[:-1] |= same
    cand = order[near]
    if n >= 1 << 24:
        out[cand] = True
        return out
    # keys equal in 40 bits: compare the whole of them
    _, back, count = np.unique(keys[cand], return_inverse=True, return_counts=True)
    out[cand[count[back] > 1]] = True
    return out


def measures(raw: np.ndarray, at: np.ndarray) -> dict[str, np.ndarray]:
    """The base figures of each text, from the bytes of all."""
    n = len(at) - 1
    start, end, row = words(raw, at)
    n_words = np.bincount(row, minlength=n)
    points = np.zeros(len(raw) + 1, np.int64)
    np.cumsum((raw & 0xC0) != 0x80, out=points[1:])
    word_chars = np.bincount(row, weights=points[end] - points[start], minlength=n).astype(np.int64)
    symbols = np.zeros(len(raw) + 1, np.int64)
    np.cumsum(_SYMBOL[raw], out=symbols[1:])
    n_symbols = symbols[at[1:]] - symbols[at[:-1]]
    hashes = word_hashes(raw, start, end)
    # words of repeated windows
    m = len(hashes) - WINDOW + 1
    repeat = np.zeros(len(hashes), bool)
    if m > 0:
        with np.errstate(over="ignore"):
            key = mixed(row[:m].astype(np.uint64) + np.uint64(1))
            for i in range(WINDOW):
                key = key * np.uint64(0x100000001B3) + hashes[i : i + m]
            key = mixed(key)
        inside = row[:m] == row[WINDOW - 1 :]
        where = np.flatnonzero(inside)
        found = where[_repeated(key[inside])]
        for i in range(WINDOW):
            repeat[found + i] = True
    n_repeat = np.bincount(row, weights=repeat, minlength=n).astype(np.int64)
    # lines, by their bytes as they stand
    n_dup, n_lines = np.zeros(n, np.int64), np.zeros(n, np.int64)
    if len(start):
        breaks = np.flatnonzero(raw == 0x0A)
        begin = np.unique(np.concatenate([at[:-1][np.diff(at) > 0], breaks + 1]))
        begin = begin[begin < len(raw)]
        stop = np.searchsorted(breaks, begin)
        line_end = np.where(stop < len(breaks), breaks[np.minimum(stop, max(len(breaks) - 1, 0))] if len(breaks) else len(raw), len(raw))
        line_row = np.searchsorted(at, begin, side="right") - 1
        line_end = np.minimum(line_end, at[line_row + 1])
        has = np.searchsorted(start, begin) < np.searchsorted(start, line_end)
        begin, line_end, line_row = begin[has], line_end[has], line_row[has]
        n_lines = np.bincount(line_row, minlength=n)
        line_key = word_hashes(raw, begin, line_end) ^ mixed(line_row.astype(np.uint64) + np.uint64(1))
        _, first = np.unique(line_key, return_index=True)
        dup = np.ones(len(begin), bool)
        dup[first] = False
        n_dup = np.bincount(line_row, weights=dup, minlength=n).astype(np.int64)
    failed = (n_words < MIN_WORDS) | (100 * n_repeat > MAX_REPEAT * n_words)
    return dict(zip(METRICS, (n_words, word_chars, n_symbols, n_dup, n_repeat, n_lines, failed), strict=True))


def measured(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """docs (or the columns in keep) and the base figures as _q_* columns; one pass, no shuffle. The text crosses to Python once."""
    keep = docs.columns if keep is None else keep
    inner = docs.select(*[docs[c] for c in keep], *([] if text in keep else [docs[text]]))
    at_text = keep.index(text) if text in keep else len(keep)
    fields = [f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep] + [f"{k} {'boolean' if v == pa.bool_() else 'long'}" for k, v in METRICS.items()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in chunks(whole, text):
                got = measures(*utf8(batch.column(at_text)))
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *[pa.array(got[k], v) for k, v in METRICS.items()]], names=[*keep, *METRICS])

    return inner.mapInArrow(run, ", ".join(fields))


def host_verdicts(rows: DataFrame, host: str, limit: float = MAX_HOST_RATE) -> DataFrame:
    """_q_host, _q_host_docs, _q_rate_<rule> and _q_host_ok of each host. Prior of each rule: beta by the moments of all hosts' rates."""
    by = rows.where(F.col(host).isNotNull()).groupBy(F.col(host).alias("_q_host")).agg(F.count("*").alias("_q_host_docs"), *[F.sum(F.expr(f"cast({r} as long)")).alias(f"_q_f_{k}") for k, r in RULES.items()])
    rates = [F.col(f"_q_f_{k}") / F.col("_q_host_docs") for k in RULES]
    moments = by.agg(F.avg(1 / F.col("_q_host_docs")).alias("_q_inv"), *[f(r).alias(f"_q_{n}_{k}") for k, r in zip(RULES, rates, strict=True) for n, f in (("mean", F.avg), ("var", F.var_pop))])
    out = by.crossJoin(F.broadcast(moments))  # one row
    for k in RULES:
        mean, spread = F.col(f"_q_mean_{k}"), F.col(f"_q_mean_{k}") * (1 - F.col(f"_q_mean_{k}"))
        between = F.greatest(F.col(f"_q_var_{k}") - spread * F.col("_q_inv"), spread * F.lit(1e-3))
        weight = F.when(spread > 0, F.greatest(spread / between - 1, F.lit(1.0))).otherwise(F.lit(1.0))
        out = out.withColumn(f"_q_rate_{k}", (F.col(f"_q_f_{k}") + mean * weight) / (F.col("_q_host_docs") + weight))
    return out.select("_q_host", "_q_host_docs", *[f"_q_rate_{k}" for k in RULES], (F.greatest(*[F.col(f"_q_rate_{k}") for k in RULES]) <= limit).alias("_q_host_ok"))


def judged(docs: DataFrame, host: str = "source", text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The measured rows with their host's figures and _q_kept. Measured rows and verdicts are written once. The verdicts of at most
    SENT_HOSTS hosts are broadcast; more are joined by host and salt, as one host may have a large part of all rows."""
    rows = materialize(measured(docs, text, keep), "quality")
    verdicts = materialize(host_verdicts(rows, host), "verdicts")
    if verdicts.count() <= SENT_HOSTS:
        out = rows.join(F.broadcast(verdicts), rows[host] == verdicts["_q_host"], "left")
    else:
        salted = rows.withColumn("_q_salt", F.pmod(F.xxhash64(*[F.col(c) for c in METRICS], F.monotonically_increasing_id()), F.lit(SALTS)).cast("int"))
        spread = verdicts.withColumn("_q_salt_of", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        out = salted.join(spread, (salted[host] == spread["_q_host"]) & (salted["_q_salt"] == spread["_q_salt_of"]), "left").drop("_q_salt", "_q_salt_of")
    return out.withColumn("_q_kept", ~F.col("_q_base_failed") & F.coalesce("_q_host_ok", F.lit(True)))
