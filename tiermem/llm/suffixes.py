"""Suffix-array dedup by a common-prefix-aware distributed merge sort.

Removed is each byte covered by a LENGTH-byte string that also starts in a document with a smaller id.

A full suffix array would exchange every suffix. Here it is sparse and still exact: of each LENGTH-byte string the SEED-byte string with the least
hash is its anchor (the leftmost on ties), so equal strings have equal anchors at equal places, and comparing suffixes that start at anchors finds
all repeats. Consecutive strings with one anchor make an entry: the suffix from the anchor on, and the bytes to its left.

1. Anchors' hashes are counted over all documents by sorted runs; an anchor seen in one document cannot lie in a repeat.
2. Each block sorts the suffixes of its other anchors (equal entries once, with the smallest id), and exchanges them as front-coded sorted runs.
3. A loser tree merges the runs of a bucket. It keeps each head's common prefix with the last output, decides by those where they differ, and
   where they are equal compares from there on only. The merge yields the common prefixes of neighbours, which bound which strings can repeat.
4. Each run gets back which of its entries' strings start in a smaller document; blocks turn that into spans.

Where a passage that very many documents share begins or ends, as many unlike entries have one anchor, and would all be merged in one task. So anchors'
entries are counted too, and an anchor with more than hot_limit() of them is given up: all its strings become suffixes of their own, of which those seen in
one document go, equal ones of a block are exchanged once, and the others are spread by their hash. So no group grows but with the number of blocks.

Defined cases: null and empty texts have no bytes; texts shorter than LENGTH lose nothing; rows with equal ids never remove from each other;
a null id counts as larger than all; within a block, strings of a given-up anchor are compared by 64-bit hashes; repeated rows each get a row; an empty table gives no rows; other columns are ignored. A text is held whole in
one task, as a row is."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import EXTRA, KEY_BITS, MOST, NO_ID, PARTS, REPLY, count_rows, counted, each_block, n_buckets, opened, pack, parts, unzip, with_blocks, zip_
from .common import MIX, drop_materialized, materialize, mixed, powers, release, word_hashes

LENGTH, SEED = 50, 20
#: An anchor with more unlike entries than this, or than four for each block, is given up for its strings.
HOT = 4096
HOT_REPLY, HOT_EXTRA = -2, -1
#: Starts of strings that are worked on at once.
PIECE = 1 << 17
#: Low bits of a hash that give way to the position when the least is sought.
PLACE = np.uint64(28)
RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans string"
_RESULT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("spans", pa.string())])


def hot_limit(n_blocks: int) -> int:
    return min(MOST - 1, max(HOT, 4 * n_blocks))


def anchors(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """anchor, first and last start of the strings that have it, row, the anchor's 48-bit key, and a hash of the entry: one for each run of strings with one anchor.
    Worked out PIECE starts at a time, which bounds the memory; a run that goes over the border of two pieces is two."""
    got = [_anchors(raw[a : a + PIECE + LENGTH - 1], at[(at > a) & (at < a + PIECE + LENGTH - 1)] - a, a) for a in range(0, max(1, len(raw) - LENGTH + 1), PIECE)]
    anchor, first, last, key, entry = (np.concatenate(x) for x in zip(*got, strict=True))
    return anchor, first, last, np.searchsorted(at, first, side="right") - 1, key, entry


def _anchors(raw: np.ndarray, borders: np.ndarray, offset: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    n, none = len(raw), np.zeros(0, np.int64)
    if n < LENGTH:
        return none, none, none, np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    up, down = powers(n + 1)
    with np.errstate(over="ignore"):
        total = np.zeros(n + 1, np.uint64)
        np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[:n], out=total[1:])
        h = mixed((total[SEED:] - total[:-SEED]) * down[: n - SEED + 1])
    low = ((h >> PLACE) << PLACE) | np.arange(len(h), dtype=np.uint64)
    width, have = LENGTH - SEED + 1, 1
    while have * 2 <= width:
        low = np.minimum(low[:-have], low[have:])
        have *= 2
    if width > have:
        low = np.minimum(low[: len(low) - (width - have)], low[width - have :])
    place = (low & np.uint64((1 << int(PLACE)) - 1)).astype(np.int64)
    del low
    whole = np.zeros(n + 2, np.int32)
    np.add.at(whole, np.maximum(borders - LENGTH + 1, 0), 1)
    np.add.at(whole, borders, -1)
    starts = np.flatnonzero(np.cumsum(whole)[: len(place)] == 0)  # strings that cross no border of documents
    if not len(starts):
        return none, none, none, np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    p = place[starts]
    new = np.append(True, (p[1:] != p[:-1]) | (starts[1:] != starts[:-1] + 1))
    first = starts[new]
    last = starts[np.append(np.flatnonzero(new)[1:] - 1, len(starts) - 1)]
    a = p[new]
    with np.errstate(over="ignore"):
        entry = mixed((total[last + LENGTH] - total[first]) * down[first] + ((last - first) * LENGTH + a - first).astype(np.uint64) * MIX)
    # hashed anew, as anchors' hashes are all small
    return a + offset, first + offset, last + offset, mixed(h[a] ^ MIX) >> (np.uint64(64) - KEY_BITS), entry


def _distinct_counts(keys: np.ndarray, ids: np.ndarray, entries: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys, and how many unlike entries each has, or 2 where it has fewer but is found in more than one document."""
    if not len(keys):
        return keys, np.zeros(0, np.int64)
    order = np.argsort(keys, kind="stable")
    k = keys[order]
    first = np.flatnonzero(np.append(True, k[1:] != k[:-1]))
    size = np.diff(np.append(first, len(k)))
    count = np.ones(len(first), np.int64)
    many = np.flatnonzero(size > 1)  # the others, most of all, have one entry in one document
    if len(many):
        part = order[np.repeat(size > 1, size)]
        begin = np.append(0, np.cumsum(size[many])[:-1])
        d = ids[part]
        count[many] += np.minimum.reduceat(d, begin) != np.maximum.reduceat(d, begin)
        if entries is not None:
            group = np.repeat(np.arange(len(many)), size[many])
            by = np.lexsort((entries[part], group))
            e = entries[part][by]
            new = np.append(True, e[1:] != e[:-1])
            new[begin] = True
            count[many] = np.maximum(count[many], np.add.reduceat(new.astype(np.int64), begin))
    return k[first], count


def _count(buckets: int):
    def work(block: int, row: dict) -> Iterator[pa.RecordBatch]:
        ids, at, raw = opened(row)
        a, _, _, doc, key, entry = anchors(raw, at)
        if len(a):
            yield parts(list(count_rows(block, *_distinct_counts(key, ids[doc], entry), buckets)))

    return work


def front_coded(rights: list[bytes], lefts: list[bytes], ids: list[int]) -> bytes:
    """A sorted run: of each suffix what it shares with the one before, and the rest."""
    shared, before = bytearray(), b""
    tails = []
    for s in rights:
        n, most = 0, min(len(s), len(before))
        while n + 8 <= most and s[n : n + 8] == before[n : n + 8]:
            n += 8
        while n < most and s[n] == before[n]:
            n += 1
        shared.append(n)
        tails.append(s[n:])
        before = s
    body = b"".join(tails) + b"".join(lefts)
    head = len(rights).to_bytes(4, "little") + bytes(shared) + bytes(map(len, tails)) + bytes(map(len, lefts)) + np.array(ids, np.int64).tobytes()
    return zip_(head + body)


def run_of(data: bytes) -> tuple[list[bytes], list[int], list[bytes], list[int]]:
    """Suffixes, shared prefixes, left bytes and ids of a front-coded run."""
    data = unzip(data)
    n = int.from_bytes(data[:4], "little")
    shared, tail, left = (list(data[4 + i * n : 4 + (i + 1) * n]) for i in range(3))
    ids = np.frombuffer(data, np.int64, n, 4 + 3 * n).tolist()
    p = 4 + 11 * n
    rights, before = [], b""
    for s, t in zip(shared, tail, strict=True):
        before = before[:s] + data[p : p + t]
        rights.append(before)
        p += t
    lefts = []
    for t in left:
        lefts.append(data[p : p + t])
        p += t
    return rights, shared, lefts, ids


def merged(runs: list[tuple[list[bytes], list[int]]]) -> Iterator[tuple[int, int, int]]:
    """(run, place in it, prefix shared with the string before) of all strings in order: a loser tree on sorted runs with their shared prefixes."""
    k = 1
    while k < len(runs):
        k *= 2
    strings, known = [r for r, _ in runs], [c for _, c in runs]
    place = [0] * k
    head: list[bytes | None] = [s[0] if s else None for s in strings] + [None] * (k - len(runs))
    shared = [0 if h is not None else -1 for h in head]  # with the last output; -1: the run has ended
    loser = [0] * k

    def duel(x: int, y: int) -> tuple[int, int]:
        """Winner and loser of two heads, whose shared prefixes refer to the same string; the loser's then refers to the winner."""
        p, q = shared[x], shared[y]
        if p > q:
            return x, y
        if p < q:
            return y, x
        if p < 0:
            return x, y
        a, b = head[x], head[y]
        most = len(a) if len(a) < len(b) else len(b)
        while p + 8 <= most and a[p : p + 8] == b[p : p + 8]:
            p += 8
        while p < most and a[p] == b[p]:
            p += 1
        if p == len(a) or (p < len(b) and a[p] < b[p]):
            shared[y] = p
            return x, y
        shared[x] = p
        return y, x

    def build(node: int) -> int:
        if node >= k:
            return node - k
        win, lose = duel(build(2 * node), build(2 * node + 1))
        loser[node] = lose
        return win

    win = build(1)
    while shared[win] >= 0:
        at = place[win]
        yield win, at, shared[win]
        at += 1
        place[win] = at
        if at < len(strings[win]):
            head[win] = strings[win][at]
            shared[win] = known[win][at]
        else:
            head[win], shared[win] = None, -1
        node = (win + k) >> 1
        while node:
            other = loser[node]
            p, q = shared[win], shared[other]
            if p > q:
                pass
            elif p < q:
                win, loser[node] = other, win
            else:
                win, loser[node] = duel(win, other)
            node >>= 1


def _string_hashes(raw: np.ndarray, start: np.ndarray) -> np.ndarray:
    """64-bit hashes of the strings that begin at the given places, PIECE places at a time."""
    h, order = np.zeros(len(start), np.uint64), np.argsort(start, kind="stable")
    at = start[order]
    for x in range(0, int(at[-1]) + 1 if len(at) else 0, PIECE):
        i, j = np.searchsorted(at, (x, x + PIECE))
        if i < j:
            h[order[i:j]] = word_hashes(raw[x : x + PIECE + LENGTH], at[i:j] - x, at[i:j] - x + LENGTH)
    return h


def _hot_strings(block: int, raw: np.ndarray, first: np.ndarray, last: np.ndarray, who: np.ndarray, buckets: int) -> list[tuple]:
    """Of all strings of given-up anchors: the counts of their keys, and where they stand."""
    n = last - first + 1
    start = np.repeat(first - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(int(n.sum()))
    who = np.repeat(who, n)
    h = _string_hashes(raw, start)
    key = h >> (np.uint64(64) - KEY_BITS)
    # one of each string of the block, in order of its hash and so of its key
    order = np.lexsort((who, h))
    new = np.append(True, h[order][1:] != h[order][:-1])
    group = np.empty(len(h), np.int64)
    group[order] = np.cumsum(new) - 1
    chief = order[new]
    small = who > who[chief][group]
    local = [start[chief], who[chief], start, group, small.astype(np.int64)]
    sizes = np.array([len(chief), len(start)], np.int64)
    return [*((b, HOT_REPLY, k, d) for b, _, k, d in count_rows(block, *_distinct_counts(key, who), buckets)), (block, HOT_EXTRA, -1, zip_(b"".join(x.tobytes() for x in (sizes, *local))))]


def _hot_local(data: bytes) -> list[np.ndarray]:
    """Start and least id of each string, then start, string and whether a smaller document of the block has it, of each place."""
    whole = np.frombuffer(unzip(data), np.int64)
    m, n = whole[:2].tolist()
    return np.split(whole[2:], np.cumsum([m, m, n, n]))


def _hot_entries(buckets: int):
    def work(block: int, row: dict, got: list[tuple[int, int, bytes]]) -> Iterator[pa.RecordBatch]:
        local = [d for kind, _, d in got if kind == HOT_EXTRA]
        if not local:
            return
        raw = opened(row)[2]
        chief, least, start, group, small = _hot_local(local[0])
        key = _string_hashes(raw, chief) >> (np.uint64(64) - KEY_BITS)
        df = np.concatenate([np.frombuffer(unzip(d), np.uint16) for kind, _, d in got if kind == REPLY])
        live = np.flatnonzero(df[np.searchsorted(np.unique(key), key)] > 1)
        data = raw.tobytes()
        strings = [data[x : x + LENGTH] for x in chief[live].tolist()]
        bucket = np.searchsorted(np.array([(i << 48) // buckets for i in range(buckets)], np.uint64), key[live], side="right") - 1
        order = sorted(range(len(live)), key=lambda i: (bucket[i], strings[i]))
        entry = np.full(len(chief), -1, np.int64)
        entry[live[order]] = np.arange(len(order))
        rows = [(block, HOT_EXTRA, -1, zip_(np.concatenate([[len(start)], start, entry[group], small]).astype(np.int64).tobytes()))]
        sorted_bucket = bucket[order]
        cuts = np.append(np.flatnonzero(np.append(True, np.diff(sorted_bucket) != 0)), len(order)) if len(order) else [0]
        for x, y in zip(cuts, cuts[1:], strict=False):
            part = order[x:y]
            rows.append((block, HOT_REPLY, int(sorted_bucket[x]), front_coded([strings[i] for i in part], [b""] * len(part), least[live[part]].tolist())))
        yield parts(rows)

    return work


def _hottest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array([int(np.frombuffer(unzip(d), np.uint16).max(initial=0)) for d in batch.column(0).to_pylist()], pa.int64())], names=["most"])


def _entries(buckets: int, limit: int):
    def work(block: int, row: dict, got: list[tuple[int, int, bytes]]) -> Iterator[pa.RecordBatch]:
        ids, at, raw = opened(row)
        a, first, last, doc, key, _ = anchors(raw, at)
        if not len(a):
            return
        df = np.concatenate([np.frombuffer(unzip(d), np.uint16) for kind, _, d in got if kind == REPLY])
        names = np.unique(key)
        df = df[np.searchsorted(names, key)]
        hot = df > limit
        if hot.any():
            yield parts(_hot_strings(block, raw, first[hot], last[hot], ids[doc[hot]], buckets))
        live = (df > 1) & ~hot
        a, first, last, doc, key = a[live], first[live], last[live], doc[live], key[live]
        if not len(a):
            return
        data = raw.tobytes()
        who = ids[doc]
        # equal entries once, with the smallest id
        found: dict[tuple[bytes, bytes], list[int]] = {}
        cells = []
        for i, (s, f, e, w) in enumerate(zip(a.tolist(), first.tolist(), (last + LENGTH).tolist(), who.tolist(), strict=True)):
            cell = found.get(text := (data[s:e], data[f:s]))
            if cell is None:
                cell = found[text] = [w, i, 0]
            elif w < cell[0]:
                cell[0] = w
            cells.append(cell)
        ordered = sorted(found.items())
        one = np.array([c[1] for _, c in ordered])
        bucket = np.searchsorted(np.array([(i << 48) // buckets for i in range(buckets)], np.uint64), key[one], side="right") - 1
        by = np.argsort(bucket, kind="stable")
        rows, cuts = [], np.append(np.flatnonzero(np.append(True, np.diff(bucket[by]) != 0)), len(by))
        for n, j in enumerate(by.tolist()):
            ordered[j][1][2] = n
        for x, y in zip(cuts, cuts[1:], strict=False):
            part = [ordered[j] for j in by[x:y].tolist()]
            rows.append((block, REPLY, int(bucket[by[x]]), front_coded([t[0] for t, _ in part], [t[1] for t, _ in part], [c[0] for _, c in part])))
        # where the entries stand, for the last step
        entry = np.array([c[2] for c in cells], np.int32)
        small = np.array([c[0] for c in cells], np.int64) < who
        spot = [np.diff(first, prepend=0).astype(np.int32), (a - first).astype(np.uint8), (last - first).astype(np.uint8), entry, small.astype(np.uint8)]
        rows.append((block, EXTRA, -1, zip_(len(a).to_bytes(4, "little") + b"".join(x.tobytes() for x in spot))))
        yield parts(rows)

    return work


def covered(group: list[tuple[bytes, int, bytes, int]]) -> list[int]:
    """For entries with one anchor, as (suffix, shared prefix with the one before, left bytes, id) in order: of each, the bit set of the offsets
    before the anchor at which a string starts that also starts in a smaller document."""
    least: dict[tuple[bytes, bytes], int] = {}
    for right, _, left, who in group:
        if who < least.get((right, left), NO_ID + 1):
            least[right, left] = who
    everything = [((2 << len(left)) - 1) & ~((1 << (LENGTH - len(right))) - 1) for right, _, left, _ in group]
    if len(least) == 1:
        low = next(iter(least.values()))
        return [full if who > low else 0 for full, (*_, who) in zip(everything, group, strict=True)]
    # longest prefix that each shares with a neighbour: longer pieces to the right of the anchor are its own
    reach = {}
    for i, (right, shared, left, _) in enumerate(group):
        after = group[i + 1][1] if i + 1 < len(group) else 0
        reach[right, left] = max(reach.get((right, left), 0), shared if i else 0, after)
    seen: dict[bytes, int] = {}
    spans = {}
    for (right, left), who in least.items():
        n = len(left)
        lowest = max(LENGTH - len(right), LENGTH - reach[right, left])
        spans[right, left] = lowest
        whole = left + right
        for o in range(lowest, n + 1):
            s = whole[n - o : n - o + LENGTH]
            if who < seen.get(s, NO_ID + 1):
                seen[s] = who
    out = []
    done: dict[tuple[bytes, bytes, int], int] = {}
    for (right, _, left, who), full in zip(group, everything, strict=True):
        if who > least[right, left]:
            out.append(full)
            continue
        bits = done.get((right, left, who))
        if bits is None:
            bits, n, whole = 0, len(left), left + right
            for o in range(spans[right, left], n + 1):
                if seen[whole[n - o : n - o + LENGTH]] < who:
                    bits |= 1 << o
            done[right, left, who] = bits
        out.append(bits)
    return out


def _merged(least_shared: int, kind: int):
    def work(table: pa.Table) -> pa.Table:
        """One bucket: merge its runs, find what repeats among strings that share so many bytes, and answer each run."""
        runs = [run_of(d) for d in table.column("data").to_pylist()]
        answer = [np.zeros(len(r[0]), np.uint32) for r in runs]
        group: list[tuple[bytes, int, bytes, int]] = []
        where: list[tuple[int, int]] = []

        def close() -> None:
            if len(group) > 1:
                for (r, i), bits in zip(where, covered(group), strict=True):
                    if bits:
                        answer[r][i] = bits
            group.clear()
            where.clear()

        for r, i, shared in merged([(r[0], r[1]) for r in runs]):
            if shared < least_shared:
                close()
            group.append((runs[r][0][i], shared, runs[r][2][i], runs[r][3][i]))
            where.append((r, i))
        close()
        return pa.Table.from_batches([parts([(b, kind, k, zip_(x.tobytes())) for b, k, x in zip(table.column("block").to_pylist(), table.column("bucket").to_pylist(), answer, strict=True)])])

    return work


def _spans(block: int, row: dict, got: list[tuple[int, int, bytes]]) -> Iterator[pa.RecordBatch]:
    ids, at, raw = opened(row)
    n = len(raw)
    gone = np.zeros(n, bool)
    begun = np.zeros(n, bool)  # where a string starts that a smaller document has; every place starts one string at most
    extra = [unzip(d) for kind, _, d in got if kind == EXTRA]
    if extra:
        m = int.from_bytes(extra[0][:4], "little")
        take = lambda kind, p: np.frombuffer(extra[0], kind, m, 4 + p * m)
        first, back, wide = np.cumsum(take(np.int32, 0), dtype=np.int64), take(np.uint8, 4).astype(np.int64), take(np.uint8, 5).astype(np.int64)
        entry, small = take(np.int32, 6), take(np.uint8, 10) > 0
        bits = np.concatenate([np.frombuffer(unzip(d), np.uint32) for kind, _, d in got if kind == REPLY])[entry]
        if small.any():
            edge = np.bincount(first[small], minlength=n + 1) - np.bincount((first + wide + 1)[small], minlength=n + 1)
            begun |= np.cumsum(edge)[:n] > 0
        some = ~small & (bits > 0)
        bits, anchor = bits[some], (first + back)[some]
        for o in range(LENGTH - SEED + 1) if len(bits) else ():
            begun[anchor[(bits >> np.uint32(o)) & np.uint32(1) > 0] - o] = True
    hot = [unzip(d) for kind, _, d in got if kind == HOT_EXTRA]
    if hot:
        whole = np.frombuffer(hot[0], np.int64)
        start, entry, small = np.split(whole[1:], 3)
        found = [np.frombuffer(unzip(d), np.uint32) for kind, _, d in got if kind == HOT_REPLY]
        bits = np.append(np.concatenate(found) if found else np.zeros(0, np.uint32), np.uint32(0))  # the last for strings of no other document
        begun[start[(small > 0) | (bits[entry] > 0)]] = True
    if begun.any():
        gone = np.cumsum(begun, dtype=np.int32)
        gone[LENGTH:] -= gone[:-LENGTH].copy()
        gone = gone > 0
    total = np.zeros(n + 1, np.int64)
    np.cumsum(gone, out=total[1:])
    removed = total[at[1:]] - total[at[:-1]]
    data = raw.tobytes()
    rows = []
    for i, (a, b, lost) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), removed.tolist(), strict=True)):
        spans, digest = "", hashlib.sha256()
        k = 0
        if not lost:
            digest.update(data[a:b])
        else:
            part = gone[a:b]
            turn = np.flatnonzero(np.diff(np.concatenate([[False], part, [False]]).astype(np.int8))).tolist()
            k = len(turn) // 2
            spans = ",".join(f"{x}:{y}" for x, y in zip(turn[::2], turn[1::2], strict=True))
            digest.update(raw[a:b][~part].tobytes())
        rows.append((None if ids[i] == NO_ID else int(ids[i]), b - a, lost, k, digest.hexdigest(), spans))
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _RESULT, strict=True)], schema=_RESULT)


def dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and spans (start:end in bytes, comma-joined) of every document."""
    spark = docs.sparkSession
    blocks = pack(docs, doc_id, text)
    buckets, limit = n_buckets(blocks), hot_limit(blocks.count())
    replies = materialize(counted(each_block(blocks, _count(buckets), PARTS)), "suffix-counts")
    hottest = replies.select("data").mapInArrow(_hottest, "most long").agg(F.max("most")).first()[0] or 0
    release(spark)
    runs = materialize(with_blocks(blocks, replies, _entries(buckets, limit), PARTS), "suffix-runs")
    drop_materialized(replies)
    release(spark)
    answers = materialize(runs.where(f"kind = {REPLY}").groupBy("bucket").applyInArrow(_merged(SEED, REPLY), PARTS), "suffix-answers")
    release(spark)
    told = answers.union(runs.where(f"kind = {EXTRA}"))
    if hottest > limit:
        again = counted(runs.where(f"kind = {HOT_REPLY}")).union(runs.where(f"kind = {HOT_EXTRA}"))
        some = blocks.join(runs.where(f"kind = {HOT_EXTRA}").select("block"), "block", "left_semi")
        hot = materialize(with_blocks(some, again, _hot_entries(buckets), PARTS), "suffix-hot")
        release(spark)
        told = told.union(materialize(hot.where(f"kind = {HOT_REPLY}").groupBy("bucket").applyInArrow(_merged(LENGTH, HOT_REPLY), PARTS), "suffix-hot-answers")).union(hot.where(f"kind = {HOT_EXTRA}"))
        release(spark)
    return with_blocks(blocks, told, _spans, RESULT)
