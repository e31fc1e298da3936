"""N-gram Jaccard join as a blocked sparse matrix product of documents by n-gram incidence.

Words are runs of bytes that are no whitespace, with A-Z lowered. A document's set is its distinct shingles of ngram words; with fewer words the whole
sequence is the only one. Two documents link when percent * union <= 100 * intersection. NGRAM and PERCENT are what holds unless given.

1. Equal sets are one class; the rest of the work is on one document of each class.
2. Size-derived bounds name the rows and columns of the product that can hold a link. Two sets of a and b shingles that link have at least
   ceil(percent * max(a, b) / 100) in common, so with shingles ordered by hash, the first a - ceil(percent * a / 100) + a / 5 of them hold the
   first min(a, b) / 5 common ones. How many documents hold each of those is counted over all documents; ordered anew from rare to common,
   the same bound leaves a few of them, of which at least one must be shared.
3. Documents that share one are brought together, as components of that relation. A component beyond BLOCK documents or BLOCK_SHINGLES shingles is cut:
   into classes of set size, each wider than the threshold by factor, and classes into sub-blocks by hash, of half those bounds each. A pair of
   sub-blocks is a task if their classes are the same or neighbours; others' sizes cannot reach the threshold. So no group is ever gathered whole.
4. In a task the product of the incidence matrix with its transpose is accumulated for a block of rows at a time: common shingles as a dense product,
   rare ones by their postings. Pairs below the bound are dropped; links become a forest; forests of sub-blocks are joined to components.

Every pair of unlike sets that can link is in some task's product, so no link is lost; no pair is ever a row. Shingles are compared by 64-bit hashes.

Defined cases: null texts and texts without words have an empty set, are linked with nothing and are their own component; equal ids are rows of
their own; a null id takes part, and is the component's id only if all its ids are null; an empty table gives no rows; other columns are ignored."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .blocks import EXTRA, KEY_BITS, NO_ID, PARTS, REPLY, bucket_cuts, count_rows, counted, each_block, n_buckets, opened, pack, packed_run, parts, unpacked_run, unzip, with_blocks, zip_
from .common import MIX, components, drop_materialized, materialize, mixed, release, word_hashes, words

NGRAM, PERCENT = 4, 85
#: One in so many shingles, besides those that the size bound asks for, are looked at first.
EXTRA_SHARE = 5
#: Documents, and shingles of all its documents together, of one task of the product (but where one document alone has more).
BLOCK, BLOCK_SHINGLES = 4096, 4_000_000
#: Components up to so many documents share tasks.
SMALL = 64
#: A shingle in more documents of a task than this is part of the dense product.
DENSE = 48
EDGES = 3
IDX_BITS = 17
_TOP = np.uint64(64) - KEY_BITS


def shingle_sets(raw: np.ndarray, at: np.ndarray, ngram: int = NGRAM) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    upper = (raw >= 65) & (raw <= 90)
    raw = np.where(upper, raw + 32, raw).astype(np.uint8)
    start, end, row = words(raw, at)
    h = word_hashes(raw, start, end)
    n = np.bincount(row, minlength=len(at) - 1)
    edge = np.concatenate([[0], np.cumsum(n)])
    m = max(0, len(h) - ngram + 1)
    with np.errstate(over="ignore"):
        key = np.full(m, ngram, np.uint64)
        for i in range(ngram):
            key = key * np.uint64(0x100000001B3) + h[i : i + m]
        key = mixed(key)
        out = []
        for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
            if b - a >= ngram:
                out.append(np.unique(key[a : b - ngram + 1]))
            elif b > a:
                one = np.full(1, b - a, np.uint64)
                for x in h[a:b]:
                    one = one * np.uint64(0x100000001B3) + x
                out.append(mixed(one))
            else:
                out.append(np.zeros(0, np.uint64))
    return out


def least_common(n: int, percent: int = PERCENT) -> int:
    """What a set of n shares at least with any that links."""
    return -(-percent * n // 100)


def first_look(n: int, percent: int = PERCENT) -> int:
    return min(n, n - least_common(n, percent) + -(-n // EXTRA_SHARE))


def shared_there(n: int, percent: int = PERCENT) -> int:
    """What the first looks of a set of n and of any that links share at least."""
    return max(1, -(-least_common(n, percent) // EXTRA_SHARE))


def _looked(sets: list[np.ndarray], chosen: list[int], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """48-bit keys that the chosen sets are looked up by (hashed anew, as the first look takes small hashes), and whose they are."""
    keys = [np.unique(mixed(s[: first_look(len(s), percent)] ^ MIX) >> _TOP) for s in (sets[i] for i in chosen)]
    return (np.concatenate(keys), np.repeat(np.array(chosen), [len(k) for k in keys])) if keys else (np.zeros(0, np.uint64), np.zeros(0, np.int64))


def _signatures(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    with np.errstate(over="ignore"):
        one = np.array([s.sum(dtype=np.uint64) if len(s) else 0 for s in sets], np.uint64)
        two = np.array([np.bitwise_xor.reduce(mixed(s)) if len(s) else 0 for s in sets], np.uint64)
    return one.view(np.int64), two.view(np.int64)


def _distinct(sets: list[np.ndarray], one: np.ndarray, two: np.ndarray) -> list[int]:
    """The first document of each unlike, not empty set of a block."""
    seen: dict[tuple[int, int, int], int] = {}
    for i, (s, x, y) in enumerate(zip(sets, one.tolist(), two.tolist(), strict=True)):
        if len(s):
            seen.setdefault((x, y, len(s)), i)
    return list(seen.values())


def _count(buckets: int, ngram: int, percent: int):
    def work(block: int, row: dict) -> Iterator[pa.RecordBatch]:
        ids, at, raw = opened(row)
        sets = shingle_sets(raw, at, ngram)
        one, two = _signatures(sets)
        keys, _ = _looked(sets, _distinct(sets, one, two), percent)
        names, counts = np.unique(keys, return_counts=True)
        sizes = np.array([len(s) for s in sets], np.int64)
        yield parts([(block, EXTRA, -1, zip_(b"".join(x.tobytes() for x in (ids, one, two, sizes)))), *count_rows(block, names, counts, buckets)])

    return work


DOCS = "doc_id long, key long, sig1 long, sig2 long, n long"


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for block, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            ids, one, two, n = np.frombuffer(unzip(data), np.int64).reshape(4, -1)
            key = (block << IDX_BITS) + np.arange(len(ids))
            yield pa.RecordBatch.from_arrays([pa.array(ids, mask=ids == NO_ID), *map(pa.array, (key, one, two, n))], names=["doc_id", "key", "sig1", "sig2", "n"])


def _candidates(buckets: int, ngram: int, percent: int):
    def work(block: int, row: dict, got: list[tuple[int, int, bytes]]) -> Iterator[pa.RecordBatch]:
        firsts = [x.split(":") for kind, _, d in got if kind == EXTRA for x in d.decode().split(",")]
        weight = {int(i): int(n) for i, n in firsts}
        if not weight:
            return
        _, at, raw = opened(row)
        sets = shingle_sets(raw, at, ngram)
        keys, _ = _looked(sets, _distinct(sets, *_signatures(sets)), percent)
        names = np.unique(keys)
        df = np.concatenate([np.frombuffer(unzip(d), np.uint16) for kind, _, d in got if kind == REPLY]).astype(np.uint64)
        tokens, owners = [], []
        for i in sorted(weight):
            k, _ = _looked(sets, [i], percent)
            n, d = len(sets[i]), df[np.searchsorted(names, k)]
            most = shared_there(n, percent)
            if (d > 1).sum() < most:
                continue
            order = np.sort((d << KEY_BITS) | k)[: len(k) - most + 1]
            order = order[order >> KEY_BITS > 1] & np.uint64((1 << 48) - 1)
            if len(order):
                tokens.append(order)
                owners.append(np.full(len(order), i))
        if not tokens:
            return
        token, owner = np.concatenate(tokens), np.concatenate(owners)
        by = np.lexsort((owner, token))
        token, owner = token[by], owner[by]
        new = np.append(True, token[1:] != token[:-1])
        low = owner[new][np.cumsum(new) - 1]
        rows = []
        pairs = np.unique(np.stack([owner, low], axis=1)[owner != low], axis=0) + (block << IDX_BITS)
        if len(pairs):
            rows.append((block, EDGES, -1, zip_(pairs.astype(np.int64).tobytes())))
        token, low = token[new], low[new]
        cuts = bucket_cuts(token, buckets)
        for b in np.flatnonzero(np.diff(cuts)):
            x, y = cuts[b], cuts[b + 1]
            run = packed_run(token[x:y])
            rows.append((block, REPLY, int(b), len(run).to_bytes(4, "little") + run + zip_(low[x:y].astype(np.uint32).tobytes())))
        for i in np.unique(owner).tolist():
            rows.append((block, EXTRA, (block << IDX_BITS) + i, weight[i].to_bytes(8, "little") + sets[i].tobytes()))
        yield parts(rows)

    return work


def _met(table: pa.Table) -> pa.Table:
    """For one bucket: the edges between the first documents of blocks that share a shingle."""
    tokens, owners = [], []
    for block, data in zip(table.column("block").to_pylist(), table.column("data").to_pylist(), strict=True):
        size = int.from_bytes(data[:4], "little")
        tokens.append(unpacked_run(data[4 : 4 + size]))
        owners.append(np.frombuffer(unzip(data[4 + size :]), np.uint32).astype(np.int64) + (block << IDX_BITS))
    token, owner = np.concatenate(tokens), np.concatenate(owners)
    by = np.lexsort((owner, token))
    token, owner = token[by], owner[by]
    new = np.append(True, token[1:] != token[:-1])
    low = owner[new][np.cumsum(new) - 1]
    pairs = np.unique(np.stack([owner, low], axis=1)[owner != low], axis=0)
    return pa.table({"a": pa.array(pairs[:, 0]), "b": pa.array(pairs[:, 1])})


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for data in batch.column(0).to_pylist():
            pairs = np.frombuffer(unzip(data), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])


def product_links(sets: list[np.ndarray], weights: np.ndarray, side: np.ndarray | None = None, percent: int = PERCENT) -> tuple[np.ndarray, np.ndarray]:
    """Least linked index reachable from each set, and the summed weights of those it links with. side: only sets of unlike sides count as pairs."""
    m = len(sets)
    size = np.array([len(s) for s in sets], np.int64)
    root, links = np.arange(m), np.zeros(m, np.int64)
    token, owner = np.concatenate(sets), np.repeat(np.arange(m), size)
    by = np.argsort(token, kind="stable")
    token, owner = token[by], owner[by]
    new = np.flatnonzero(np.append(True, token[1:] != token[:-1]))
    df = np.diff(np.append(new, len(token)))
    group = np.repeat(np.arange(len(new)), df)
    dense = np.flatnonzero(df > DENSE)
    column = np.full(len(new), -1)
    column[dense] = np.arange(len(dense))
    # postings of rare shingles, by document
    rare = (df[group] > 1) & (df[group] <= DENSE)
    r_owner, r_group = owner[rare], group[rare]
    doc_order = np.argsort(r_owner, kind="stable")
    r_of_doc = np.searchsorted(r_owner[doc_order], np.arange(m + 1))
    d_sel = column[group] >= 0
    d_owner, d_col = owner[d_sel], column[group[d_sel]]
    step = max(1, min(m, (2 << 20) // m))
    slab = max(1, (8 << 20) // max(m, 1))
    for a in range(0, m, step):
        b = min(m, a + step)
        common = np.zeros((b - a) * m, np.int64)
        mine = doc_order[r_of_doc[a] : r_of_doc[b]]
        for x in range(0, len(mine), 1 << 16):
            part = mine[x : x + (1 << 16)]
            g = r_group[part]
            reps = df[g]
            base = np.repeat(new[g] - np.concatenate([[0], np.cumsum(reps)[:-1]]), reps)
            other = owner[base + np.arange(int(reps.sum()))]
            common += np.bincount(np.repeat((r_owner[part] - a) * m, reps) + other, minlength=len(common))
        common = common.reshape(b - a, m)
        for x in range(0, len(dense), slab):
            here = (d_col >= x) & (d_col < x + slab)
            matrix = np.zeros((m, min(slab, len(dense) - x)), np.float32)
            matrix[d_owner[here], d_col[here] - x] = 1
            common += (matrix[a:b] @ matrix.T).astype(np.int64)
        linked = 100 * common >= percent * (size[a:b, None] + size[None, :] - common)
        linked[np.arange(b - a), np.arange(a, b)] = False
        if side is not None:
            linked &= side[a:b, None] != side[None, :]
        links[a:b] = linked @ weights
        # join the groups: each row with each group that it links with, once
        for i in range(b - a):
            near = np.unique(root[linked[i]])
            if len(near):
                low = min(int(near[0]), int(root[a + i]))
                root[np.isin(root, np.append(near, root[a + i]))] = low
    return root, links


def _product(percent: int):
    def work(table: pa.Table) -> pa.Table:
        """One task: the components of one bin, or one pair of sub-blocks of a component."""
        table = table.sort_by([("component", "ascending"), ("key", "ascending")])
        comp, key, side, whole = (table.column(c).to_numpy() for c in ("component", "key", "side", "pair"))
        data = table.column("data").to_pylist()
        cut = np.flatnonzero(np.append(True, comp[1:] != comp[:-1])).tolist() + [len(comp)]
        roots, links = [], []
        for a, b in zip(cut, cut[1:], strict=False):
            sets = [np.frombuffer(d, np.uint64, offset=8) for d in data[a:b]]
            weights = np.array([int.from_bytes(d[:8], "little") for d in data[a:b]], np.int64)
            if b - a == 1:
                root, n = np.zeros(1, np.int64), np.zeros(1, np.int64)
            elif b - a == 2 and whole[a] == 0:
                x, y = sets
                common = len(np.intersect1d(x, y, assume_unique=True))
                tied = 100 * common >= percent * (len(x) + len(y) - common)
                root, n = np.array([0, 0 if tied else 1]), weights[::-1] * tied
            else:
                root, n = product_links(sets, weights, side[a:b] if whole[a] == 2 else None, percent)
            roots.append(key[a:b][root])
            links.append(n)
        return pa.table({"key": key, "component": comp, "root": np.concatenate(roots), "links": np.concatenate(links), "split": whole > 0})

    return work


def _tasks(nodes: DataFrame, bins: int, percent: int) -> DataFrame:
    """key, component, task, side and pair (0: a whole component, 1: a sub-block by itself, 2: two sub-blocks) of every node (node, component, n), once for each of its tasks."""
    # a hair wider than the threshold, so that rounding never puts sizes that may link two classes apart
    size_class = F.floor(F.log(F.col("n").cast("double")) / F.lit(math.log(100 / percent) * (1 + 1e-9))) if percent < 100 else F.col("n")
    nodes = nodes.select(F.col("node").alias("key"), "component", "n", size_class.cast("long").alias("c"))
    by_class = nodes.groupBy("component", "c").agg(F.count("*").alias("m_c"), F.sum("n").alias("t_c"))
    half = F.ceil(F.greatest(F.col("m_c") / F.lit(max(1, BLOCK // 2)), F.col("t_c") / F.lit(BLOCK_SHINGLES // 2))).cast("int")
    one = Window.partitionBy("component")  # a row for each class: as many as a logarithm of the largest set
    near = one.orderBy("c").rangeBetween
    by_class = by_class.withColumn("m", F.sum("m_c").over(one)).withColumn("t", F.sum("t_c").over(one)).withColumn("k", half)
    by_class = by_class.withColumn("below", F.coalesce(F.max("k").over(near(-1, -1)), F.lit(0))).withColumn("above", F.coalesce(F.max("k").over(near(1, 1)), F.lit(0))).select("component", "c", "m", "t", "k", "below", "above")
    rows = nodes.join(by_class, ["component", "c"]).withColumn("whole", F.expr(f"m <= {BLOCK} and t <= {BLOCK_SHINGLES}"))
    rows = rows.withColumn("s", F.when(F.col("whole"), 0).otherwise(F.pmod(F.xxhash64("key"), F.col("k")).cast("int")))
    others = F.expr("flatten(array(" + ", ".join(f"if({n} > 0, transform(sequence(0, {n} - 1), x -> struct(c + {d} as c, x as s)), array())" for n, d in (("below", -1), ("k", 0), ("above", 1))) + "))")
    rows = rows.withColumn("o", F.explode(F.when(F.col("whole"), F.array(F.struct("c", "s"))).otherwise(others)))
    pair = F.when(F.col("whole"), 0).when((F.col("o.c") == F.col("c")) & (F.col("o.s") == F.col("s")), 1).otherwise(2)
    mine, other = F.concat_ws(".", "c", "s"), F.concat_ws(".", "o.c", "o.s")
    task = F.when(F.col("whole") & (F.col("m") <= min(SMALL, BLOCK)), F.concat(F.lit("bin"), F.pmod(F.xxhash64("component"), F.lit(bins)))).when(F.col("whole"), F.col("component").cast("string")).otherwise(F.concat_ws("-", F.col("component"), F.least(mine, other), F.greatest(mine, other)))
    return rows.select("key", "component", task.alias("task"), (F.col("c") * (1 << 24) + F.col("s")).alias("side"), pair.alias("pair"))


def join(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", ngram: int = NGRAM, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id and n_links (documents that it links with, copies of its own set included) of every document."""
    spark = docs.sparkSession
    blocks = pack(docs, doc_id, text)
    buckets = n_buckets(blocks)
    found = materialize(each_block(blocks, _count(buckets, ngram, percent), PARTS), "jaccard-count")
    replies = counted(found.where(f"kind = {REPLY}"))
    rows = materialize(found.where(f"kind = {EXTRA}").select("block", "data").mapInArrow(_documents, DOCS), "jaccard-docs")
    classes = rows.where("n > 0").groupBy("sig1", "sig2", "n").agg(F.min("key").alias("rep"), F.min("doc_id").alias("least"), F.count("*").alias("copies"))
    classes = materialize(classes, "jaccard-classes")
    firsts = classes.select(F.shiftright("rep", IDX_BITS).alias("block"), F.concat_ws(":", F.col("rep").bitwiseAND((1 << IDX_BITS) - 1), "copies").alias("one"))
    firsts = firsts.groupBy("block").agg(F.encode(F.array_join(F.collect_list("one"), ","), "utf-8").alias("data")).select("block", F.lit(EXTRA).alias("kind"), F.lit(-1).cast("long").alias("bucket"), "data")
    release(spark)
    made = materialize(with_blocks(blocks, replies.union(firsts), _candidates(buckets, ngram, percent), PARTS), "jaccard-made")
    edges = made.where(f"kind = {EDGES}").select("data").mapInArrow(_edges, "a long, b long").union(made.where(f"kind = {REPLY}").groupBy("bucket").applyInArrow(_met, "a long, b long"))
    drop_materialized(blocks)
    release(spark)
    groups = materialize(components(edges, "jaccard-cc"), "jaccard-groups")
    drop_materialized(found)
    bins = max(8, buckets)
    sets = made.where(f"kind = {EXTRA}").select(F.col("bucket").alias("key"), "data")
    plan = materialize(_tasks(groups.join(classes.select(F.col("rep").alias("node"), "n"), "node"), bins, percent), "jaccard-plan")
    # both sides grow with the input, so neither is broadcast at any size
    tasks = plan.hint("merge").join(sets, "key").select("task", "component", "key", "side", "pair", "data")
    release(spark)
    out = materialize(tasks.groupBy("task").applyInArrow(_product(percent), "key long, component long, root long, links long, split boolean"), "jaccard-links")
    drop_materialized(made, plan)
    release(spark)
    roots = out.groupBy("key").agg(F.min("root").alias("root"), F.sum("links").alias("links"), F.max("split").alias("split"))
    if out.where("split").limit(1).count():
        across = components(out.where("split and key <> root").select(F.col("key").alias("a"), F.col("root").alias("b")), "jaccard-across")
        roots = roots.join(across, roots["key"] == across["node"], "left").select("key", F.when(F.col("split"), F.coalesce("component", "key")).otherwise(F.col("root")).alias("root"), "links")
    named = classes.join(roots.select("key", "root", "links"), classes["rep"] == F.col("key"), "left").select("sig1", "sig2", "n", "least", "copies", F.coalesce("root", "rep").alias("root"), F.coalesce("links", F.lit(0)).alias("links"))
    named = materialize(named, "jaccard-named")
    ids = named.groupBy("root").agg(F.min("least").alias("component_id"))
    named = named.join(ids, "root").select("sig1", "sig2", "n", "component_id", (F.col("links") + F.col("copies") - 1).alias("n_links"))
    whole = rows.where("n > 0").join(named, ["sig1", "sig2", "n"]).select("doc_id", F.col("n").alias("n_shingles"), "component_id", "n_links")
    return whole.union(rows.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.lit(0).cast("long").alias("n_links")))
