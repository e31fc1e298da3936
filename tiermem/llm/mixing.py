"""Temperature mixing: source token shares are raised to an exponent that is bisected to meet a repetition limit or a target entropy,
and the normalised weights are realised as budgeted block permutations.

Weights are p**a normalised; a = 1 mixes in proportion, a = 0 evenly. The budget is such that the source with the least weight for its size is read
exactly once, so no document is lost; the others are read more often, up to the repetition limit. Each pass over a source is a permutation of its
documents (by md5 of seed, pass and doc_id) cut into blocks by the leading hex digits; a last, partial pass ends at the document where the
source's budget is used up. Blocks of all sources are then permuted by mix_key; within a block, documents stand in order of their own key.

Defined cases: a null text has no tokens; a null source is a source; a null source or doc_id is ordered as an empty string; rows of equal doc_id and source go
through the same passes; a source without tokens is read once and weighs 0, also where no source has any; an empty table gives no rows; clashing names do no harm, as inner columns are named _m_*."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize

#: No source is read more often than this.
MAX_REPEAT = 2.0
SEED = "mix-1"
#: Leading hex digits of the order key that name a block.
BLOCK_DIGITS = 3
#: Plans of so many sources are small enough to be sent to every task; beyond, sources are split by so many salts.
SENT_SOURCES, SALTS = 50_000, 64
#: Levels of bisection in one pass over the sources, and passes.
LEVELS, ROUNDS = 5, 7


def n_tokens(text: Column) -> Column:
    """Words of a text: runs of bytes that are no whitespace."""
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")).cast("long")


def bisect(shares: DataFrame, max_repeat: float | None = MAX_REPEAT, entropy: float | None = None) -> float:
    """The exponent in [0, 1]. Both conditions hold more surely the larger (repeats) or smaller (entropy, in nats) it is: with max_repeat, the least
    exponent that keeps within it; with entropy, the greatest that reaches it. Each pass over the sources tries all midpoints of LEVELS halvings."""
    low, high = 0.0, 1.0
    n = 1 << LEVELS
    p = F.col("_m_tokens") / F.col("_m_all")
    edge = shares.agg(F.max("_m_tokens"), F.min("_m_tokens"), F.sum("_m_tokens")).first()
    if not edge[0]:
        return 1.0
    used = shares.where("_m_tokens > 0").withColumn("_m_all", F.lit(edge[2]))
    for _ in range(ROUNDS):
        tries = [low + (high - low) * i / n for i in range(1, n)]
        if entropy is not None:
            row = used.agg(*[c for a in tries for c in (F.sum(F.pow(p, F.lit(a))), F.sum(F.pow(p, F.lit(a)) * F.lit(a) * F.log(p)))]).first()
            good = [_entropy(row[2 * i], row[2 * i + 1]) >= entropy for i in range(n - 1)]
            k = sum(good)  # good up to the k-th try
        else:
            row = used.agg(*[F.max(F.pow(p, F.lit(a - 1))) / F.min(F.pow(p, F.lit(a - 1))) for a in tries]).first()
            k = sum(not row[i] <= max_repeat for i in range(n - 1))  # too many repeats up to the k-th try
        low, high = low + (high - low) * k / n, low + (high - low) * (k + 1) / n
    return low if entropy is not None else high


def _entropy(total: float, weighted: float) -> float:
    return math.log(total) - weighted / total


def order_key(turn: Column | str, doc_id: str = "doc_id", source: str = "source") -> Column:
    return F.md5(F.concat_ws("|", F.lit(SEED), F.coalesce(F.col(source).cast("string"), F.lit("")), F.coalesce(F.col(doc_id).cast("string"), F.lit("")), turn.cast("string") if isinstance(turn, Column) else F.lit(turn)).cast("binary"))


def plan(docs: DataFrame, max_repeat: float | None = MAX_REPEAT, entropy: float | None = None, text: str = "text", doc_id: str = "doc_id", source: str = "source") -> DataFrame:
    """_m_source, _m_tokens, _m_weight, _m_epochs, _m_full (whole passes) and _m_cut (the last order key of the partial pass; null: none): a row for each source."""
    rows = materialize(docs.select(F.col(source).cast("string").alias("source"), F.col(doc_id).alias("doc_id"), n_tokens(F.col(text)).alias("n")), "mix-rows")
    shares = materialize(rows.groupBy(F.col("source").alias("_m_source")).agg(F.sum("n").alias("_m_tokens")), "mix-shares")
    a = bisect(shares, max_repeat, entropy)
    some = F.col("_m_tokens") > 0
    total = shares.agg(F.sum("_m_tokens").alias("_m_all"), F.max(F.when(some, F.pow("_m_tokens", F.lit(1 - a)))).alias("_m_top"))
    epochs = F.when(some, F.col("_m_top") / F.pow("_m_tokens", F.lit(1 - a))).otherwise(F.lit(1.0))  # (p_max / p)**(1 - a)
    shares = shares.crossJoin(F.broadcast(total)).withColumn("_m_epochs", F.round(epochs, 9))
    used = shares.agg(F.sum(F.col("_m_tokens") * F.col("_m_epochs")).alias("_m_used"))  # one row
    shares = shares.crossJoin(F.broadcast(used)).withColumn("_m_weight", F.coalesce(F.try_divide(F.col("_m_tokens") * F.col("_m_epochs"), F.col("_m_used")), F.lit(0.0))).withColumn("_m_full", F.floor("_m_epochs").cast("long"))
    shares = shares.withColumn("_m_rest", F.floor((F.col("_m_epochs") - F.col("_m_full")) * F.col("_m_tokens")).cast("long"))
    # where the partial pass ends: blocks first, then the documents of the one block in which the budget runs out
    partial = rows.join(shares.where("_m_rest > 0"), rows["source"].eqNullSafe(shares["_m_source"])).withColumn("_m_key", order_key(F.col("_m_full")))
    keyed = partial.select("source", "_m_rest", "_m_key", "n", F.substring("_m_key", 1, BLOCK_DIGITS).alias("_m_block"))
    blocks = keyed.groupBy("source", "_m_block", "_m_rest").agg(F.sum("n").alias("n"))
    run = Window.partitionBy("source").orderBy("_m_block").rowsBetween(Window.unboundedPreceding, 0)
    edge = blocks.withColumn("_m_to", F.sum("n").over(run)).where("_m_to >= _m_rest and _m_to - n < _m_rest").select(F.col("source").alias("_e_source"), F.col("_m_block").alias("_e_block"), (F.col("_m_rest") - (F.col("_m_to") - F.col("n"))).alias("_e_left"))
    last = keyed.join(edge, F.col("source").eqNullSafe(F.col("_e_source")) & (F.col("_m_block") == F.col("_e_block")))
    inside = Window.partitionBy("source").orderBy("_m_key").rangeBetween(Window.unboundedPreceding, 0)
    cut = last.withColumn("_m_to", F.sum("n").over(inside)).where("_m_to - n < _e_left").groupBy("source").agg(F.max("_m_key").alias("_m_cut"))
    return shares.join(cut, shares["_m_source"].eqNullSafe(cut["source"]), "left").select("_m_source", "_m_tokens", "_m_weight", "_m_epochs", "_m_full", "_m_cut")


def mix(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", **kw) -> DataFrame:
    """docs, each row as often as the mix reads it, with _m_epoch (pass), _m_block, _m_key (order of blocks), _m_order (order within a block) and
    _m_weight (its source's). The mix is the rows in order of _m_key, _m_order.

    The plan's rows, one for each source, are broadcast up to SENT_SOURCES; more are joined by source and salt, as one source may have a large part of all rows."""
    made = materialize(plan(docs, doc_id=doc_id, source=source, **kw), "mix-plan")
    mine = docs[source].cast("string")
    if made.count() <= SENT_SOURCES:
        out = docs.join(F.broadcast(made), mine.eqNullSafe(made["_m_source"]), "left")
    else:
        salted = docs.withColumn("_m_salt", F.pmod(F.xxhash64(docs[doc_id], F.monotonically_increasing_id()), F.lit(SALTS)).cast("int"))
        spread = made.withColumn("_m_salt_of", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        out = salted.join(spread, salted[source].cast("string").eqNullSafe(spread["_m_source"]) & (salted["_m_salt"] == spread["_m_salt_of"]), "left").drop("_m_salt", "_m_salt_of")
    partly = F.col("_m_cut").isNotNull() & (order_key(F.col("_m_full"), doc_id, source) <= F.col("_m_cut"))
    out = out.withColumn("_m_epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_m_full") - 1 + partly.cast("long"))))
    return placed(out, F.col("_m_epoch"), doc_id, source).drop("_m_source", "_m_tokens", "_m_epochs", "_m_full", "_m_cut")


def placed(rows: DataFrame, turn: Column, doc_id: str = "doc_id", source: str = "source") -> DataFrame:
    """rows with _m_order, _m_block and _m_key of the pass turn: where the mix has them follows from the row and the pass alone."""
    out = rows.withColumn("_m_order", order_key(turn, doc_id, source)).withColumn("_m_block", F.conv(F.substring("_m_order", 1, BLOCK_DIGITS), 16, 10).cast("long"))
    return out.withColumn("_m_key", F.md5(F.concat_ws("|", F.lit(SEED), F.coalesce(F.col(source).cast("string"), F.lit("")), turn.cast("string"), F.col("_m_block").cast("string")).cast("binary")))
