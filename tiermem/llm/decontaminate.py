"""Benchmark decontamination by pigeonhole edit matching: an item is split into error-budget-plus-one pieces, so that any passage within the budget
holds one of them unchanged; exact piece hits are verified with Myers' bit-parallel edit distance against the text around them.

Texts and items are compared with A-Z lowered and runs of whitespace as one space. The budget is MAX_ERROR of an item's length, and the pieces of an
item of MIN_PIECE characters or more have MIN_PIECE at least, so short items get a smaller budget. An item below MIN_PIECE characters matches without
errors only, and only as whole words: no letter or digit stands at either end of it.

The items are a stated query set, taken in blocks of BLOCK_ITEMS items (and at most BLOCK_CHARS characters). One block is sent at a time: with more
than one, each has a pass of its own over the documents, whose hits are written before the next begins. So what tasks hold is bounded however many
items there are, and only the time grows with them.

Defined cases: null and empty texts match nothing; null, empty and all-space items match nothing; items that repeat each count; texts of any length
are searched whole; repeated documents each get a row; empty tables give no rows or no hits; other columns are ignored."""

from __future__ import annotations

import functools
import itertools
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

MAX_ERROR = 0.08
MIN_PIECE = 12
BLOCK_ITEMS, BLOCK_CHARS = 2000, 4_000_000
_SPACE = re.compile(r"[\x20\x09-\x0D]+")
_LOWER = {i: i + 32 for i in range(65, 91)}


def normal(text: str) -> str:
    return _SPACE.sub(" ", text).translate(_LOWER).strip(" ")


def budget(length: int) -> int:
    """Errors allowed: a share of the length, but pieces stay long enough."""
    return max(0, min(int(length * MAX_ERROR), length // MIN_PIECE - 1))


def pieces(item: str) -> list[tuple[int, str]]:
    """(place, piece): budget + 1 pieces of near equal length."""
    k = budget(len(item)) + 1
    cuts = [len(item) * i // k for i in range(k + 1)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def masks(item: str) -> dict[str, int]:
    """Where each character stands in the item, as bits."""
    peq: dict[str, int] = {}
    for i, c in enumerate(item):
        peq[c] = peq.get(c, 0) | 1 << i
    return peq


def best_distance(peq: dict[str, int], m: int, text: str) -> int:
    """The least edit distance of the item (length m) to any substring of text, by Myers' bit vectors."""
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best = full, 0, m, m
    for c in text:
        eq = peq.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | (~(xh | pv) & full)
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph = (ph << 1) & full
        mh = (mh << 1) & full
        pv = mh | (~(xv | ph) & full)
        mv = ph & xv
        if score < best:
            best = score
    return best


class Matcher:
    """The automaton of all pieces of a block of items."""

    def __init__(self, items: list[tuple[int, str]]) -> None:
        self.items = {i: t for i, (_, t) in enumerate(items)}
        self.ids = {i: key for i, (key, _) in enumerate(items)}
        self.masks = {i: masks(t) for i, t in self.items.items()}
        found: dict[str, list[tuple[int, int]]] = {}
        for i, t in self.items.items():
            for at, piece in pieces(t):
                found.setdefault(piece, []).append((i, at))
        self.automaton = ahocorasick.Automaton()
        for piece, where in found.items():
            self.automaton.add_word(piece, (len(piece), where))
        if found:
            self.automaton.make_automaton()
        self.any = bool(found)

    def hits(self, text: str) -> list[tuple[int, int]]:
        """(item id, least distance) of each item within its budget, sorted."""
        if not self.any:
            return []
        text = normal(text)
        spans: dict[int, list[tuple[int, int]]] = {}
        for end, (size, where) in self.automaton.iter(text):
            for i, at in where:
                k, start = budget(len(self.items[i])), end + 1 - size - at
                spans.setdefault(i, []).append((max(0, start - k), start + len(self.items[i]) + k))
        out = []
        for i, near in spans.items():
            m, best = len(self.items[i]), None
            merged: list[list[int]] = []
            for a, b in sorted(near):
                if merged and a <= merged[-1][1]:
                    merged[-1][1] = max(b, merged[-1][1])
                else:
                    merged.append([a, b])
            if m < MIN_PIECE:
                if any(not text[a - 1 : a].isalnum() and not text[b : b + 1].isalnum() for a, b in near):
                    out.append((self.ids[i], 0))
                continue
            for a, b in merged:
                part = text[a:b]
                d = 0 if self.items[i] in part else best_distance(self.masks[i], m, part)
                best = d if best is None else min(best, d)
                if not best:
                    break
            if best <= budget(m):
                out.append((self.ids[i], best))
        return sorted(out)


def blocks(benchmark: DataFrame, item_id: str, text: str) -> Iterator[list[tuple[int, str]]]:
    """The items in blocks of bounded size."""
    now, chars = [], 0
    for key, said in benchmark.select(F.col(item_id).cast("long"), F.col(text)).where(F.col(text).isNotNull()).toLocalIterator():
        said = normal(said)
        if said:
            now.append((key, said))
            chars += len(said)
        if len(now) >= BLOCK_ITEMS or chars >= BLOCK_CHARS:
            yield now
            now, chars = [], 0
    if now:
        yield now


_HITS = "array<struct<item:long,distance:int>>"


def _with_hits(docs: DataFrame, text: str, keep: list[str], items: list[tuple[int, str]], sent=None) -> DataFrame:
    """The columns keep of docs, and _d_hits, the items of one block found in each, sorted by item. The text crosses to Python once."""
    hit = pa.list_(pa.struct([("item", pa.int64()), ("distance", pa.int32())]))
    sent = sent or docs.sparkSession.sparkContext.broadcast(items)  # at most BLOCK_ITEMS items
    at = keep.index(text) if text in keep else len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(sent.value)
        for batch in batches:
            out = []
            for start in range(0, batch.num_rows, 128):
                out += [[{"item": i, "distance": d} for i, d in matcher.hits(t)] if t else [] for t in batch.column(at).slice(start, 128).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(out, hit)], names=[*keep, "_d_hits"])

    fields = [f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep] + [f"_d_hits {_HITS}"]
    return docs.select(*[docs[c] for c in keep], *([] if text in keep else [docs[text]])).mapInArrow(run, ", ".join(fields))


def matched(docs: DataFrame, benchmark: DataFrame, item_id: str = "item_id", item_text: str = "text", text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """docs (or the columns in keep) with _d_hits: array of (item, distance), sorted by item."""
    keep = docs.columns if keep is None else keep
    rest = blocks(benchmark, item_id, item_text)
    first = next(rest, None)
    if first is None:
        return docs.select(*keep, F.expr(f"cast(array() as {_HITS})").alias("_d_hits"))
    second = next(rest, None)
    if second is None:
        return _with_hits(docs, text, keep, first)
    # several blocks: a pass for each over numbered rows, of which those with hits are written
    rows = materialize(docs.select(*keep, *([] if text in keep else [docs[text]])).withColumn("_d_row", F.monotonically_increasing_id()), "decon-rows")
    found = []
    for items in itertools.chain((first, second), rest):
        sent = docs.sparkSession.sparkContext.broadcast(items)
        found.append(materialize(_with_hits(rows, text, ["_d_row"], items, sent).where("size(_d_hits) > 0"), "decon-hits"))
        sent.destroy()
    hits = functools.reduce(DataFrame.union, found).select("_d_row", F.explode("_d_hits").alias("h")).groupBy("_d_row").agg(F.sort_array(F.collect_list("h")).alias("_d_hits"))
    return rows.join(hits, "_d_row", "left").select(*keep, F.coalesce("_d_hits", F.expr(f"cast(array() as {_HITS})")).alias("_d_hits"))
