"""The novelty gate's band against all pairs: streams longer than a block and than a batch, gaps, odd vectors; and its plan."""

import math
import random

import pytest

from tiermem.config import Config
from tiermem.operators import memory
from tiermem.plans import fixtures

SF = "/root/testdata/sf0.001"
WINDOWS = "stream_id string, window_ord long, visual_embedding array<double>"


def _cosine(a, b):
    if a is None or b is None or len(a) != len(b) or None in a or None in b:
        return None
    return sum(x * y for x, y in zip(a, b, strict=True)) / (math.sqrt(sum(x * x for x in a)) * math.sqrt(sum(x * x for x in b)) + 1e-8)


@pytest.mark.parametrize("per_batch", [7, 10000])
def test_every_pair_of_the_band(spark, per_batch):
    rng = random.Random(5)
    rows = [(s, o, [rng.gauss(0, 1) for _ in range(4)]) for s, n in (("a", 97), ("b", 3), ("c", 1)) for o in range(n)]
    rows += [("gap", o, [rng.gauss(0, 1) for _ in range(4)]) for o in (0, 4, 5, 11, 12, 30, 34)]
    rows += [("odd", o, v) for o, v in enumerate([[1.0, 0.0], None, [1.0, 1.0], [1.0, None], [0.0, 0.0], [1.0, 2.0, 3.0], [2.0, 4.0, 6.0], []])] + [(None, 0, [1.0]), (None, 1, [1.0])]
    config = Config(recent_capacity=5, novelty_threshold=0.4)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", per_batch)
    try:
        got = {(r.stream_id, r.window_ord): (r.max_sim, r.promoted) for r in memory.novelty(spark.createDataFrame(rows, WINDOWS), config).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(got) == len(rows)
    for s, o, v in rows:
        sims = [x for t, p, w in rows if s is not None and t == s and 0 < p - o <= 5 for x in [_cosine(v, w)] if x is not None]
        sim, promoted = got[s, o]
        assert (sim is None) == (not sims) and (sim is None or math.isclose(sim, max(sims), abs_tol=1e-12))
        assert promoted == (sim is None or 1 - max(sims) > 0.4)


def test_no_row_for_each_pair(spark):
    """The gate's plan joins windows only with their own result, and questions are read off their windows: no join at all."""
    base = fixtures.windows(spark, SF)
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert plan(memory.novelty(base, fixtures.CONFIG)).count("Join ") == 1
    assert "Join" not in plan(fixtures.questions(base))
