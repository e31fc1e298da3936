"""The pipeline's stages against plain versions, each on its own input."""

import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from tests.llm import brute
from tiermem.llm import decontaminate, mixing

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    rows = {r.doc_id: r.text for r in docs.collect()}
    good = pipeline.quality_rules(spark, docs, SF).cache()
    kept = {r.doc_id for r in good.collect()}
    for d, t in rows.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        five = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
        inside = {i + k for i, g in enumerate(five) if five.count(g) > 1 for k in range(5)}
        assert (d in kept) == (len(w) >= 10 and 100 * len(inside) <= 20 * len(w))
    once = pipeline.near_duplicates(spark, good, SF).cache()
    want = {d for d, _, c, _ in brute.groups([(d, rows[d]) for d in sorted(kept)]) if d == c}
    assert sorted(r.doc_id for r in once.collect()) == sorted(want)
    clean = pipeline.benchmark_decontamination(spark, once, SF).cache()
    items = [decontaminate.normal(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    left = {r.doc_id for r in clean.collect()}
    assert left == {d for d in want if not any(i in decontaminate.normal(rows[d]) for i in items)}
    mixed = pipeline.source_mixing(spark, clean, SF).cache()
    assert {r.doc_id for r in mixed.collect()} == left
    assert good.columns == once.columns == clean.columns == mixed.columns == columns
    manifest = pipeline.shards(spark, mixed, SF)
    assert manifest.count() == mixed.count() and manifest.select("shard", "slot").distinct().count() == mixed.count()


def test_run_and_repeated_rows(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    docs.union(docs.limit(20)).write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{SF}/benchmark.parquet").write.parquet(str(tmp_path / "benchmark.parquet"))
    a, b = pipeline.run(spark, SF), pipeline.run(spark, str(tmp_path))
    assert {r.doc_id for r in a.collect()} == {r.doc_id for r in b.collect()} and a.count() == b.count()


def test_empty(spark, tmp_path):
    spark.read.parquet(f"{SF}/documents.parquet").where("false").write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{SF}/benchmark.parquet").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert pipeline.run(spark, str(tmp_path)).count() == 0


PROSE = " ".join(f"word{i} goes{i % 17}" for i in range(60))
LONG = " ".join(f"l{i}" for i in range(20_000))
ODD = [(1, PROSE, "en", "a", 3), (1, PROSE, "en", "a", 3), (1, LONG, "en", "a", 3), (2, PROSE + " tail", "en", None, None), (None, PROSE, None, "b", 1), (3, None, "en", "b", 1), (4, "", "de", "b", 1), (5, LONG, "en", "b", 1), (None, None, None, None, None), (6, "é à " + PROSE[:200], "fr", "c", 9)]


def _odd(spark, rows=ODD):
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name in ("key", "shard", "size", "tie", "hits", "component_id", "block"):
        docs = docs.withColumn(name, F.lit("x"))
    return docs


@pytest.mark.parametrize("stage", range(len(pipeline.STAGES)))
def test_stages_on_odd_rows(spark, stage):
    """Nulls, long and empty texts, repeated rows and names that clash: each stage gives its defined rows; an empty table gives none."""
    name, work = pipeline.STAGES[stage]
    docs = _odd(spark)
    got = work(spark, docs, SF).collect()
    assert work(spark, docs.where("false"), SF).count() == 0
    told = lambda rows: sorted((str(r[0]), r[1] or "") for r in rows)
    if name == "quality_rules":
        assert told(got) == told([r for r in ODD if r[1] and len(r[1]) > 20])
    elif name == "near_duplicates":
        # the prose goes with its near copies to document 1, the long text of 1 and 5 to 1; what has no words stays once for each id
        assert told(got) == told([(1, PROSE), (1, LONG), (3, ""), (4, ""), (None, ""), (6, ODD[-1][1])])
    elif name == "benchmark_decontamination":
        assert told(got) == told(ODD)
    elif name == "source_mixing":
        assert {x for x in told(got)} == {x for x in told(ODD)} and len(got) >= len(ODD)
    else:
        assert len(got) == len(ODD) and len({(r.shard, r.slot) for r in got}) == len(ODD)


def test_near_duplicates_of_unlike_rows_with_one_id(spark):
    rows = [(3, PROSE), (5, LONG), (5, PROSE + " tail")]
    got = pipeline.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()
    assert sorted((r.doc_id, r.text) for r in got) == [(3, PROSE), (5, LONG)]


def test_shards_keep_the_order_of_the_mix(spark):
    docs = spark.createDataFrame([(i, f"text number {i}", "en", f"s{i % 3}", 5) for i in range(200)] + [(900 + i, "w", "en", "small", 1) for i in range(5)], "doc_id long, text string, lang string, source string, n_chars long")
    mixed = mixing.mix(docs)
    want = [r.doc_id for r in mixed.orderBy("_m_key", "_m_order").collect()]
    manifest = pipeline.shards(spark, mixed.select(*docs.columns), SF)
    assert [r.doc_id for r in manifest.orderBy("shard", "slot").collect()] == want and len(want) > len(set(want))
