"""The near_duplicates stage against brute force at its own shingle length and threshold."""

import random
from functools import partial

import pytest

import corpus_pipeline as pipeline
from tests.llm import brute
from tiermem.llm import jaccard

R = random.Random(11)
DOCS = "doc_id long, text string, source string"


def _words(n):
    return [f"w{R.randrange(5000)}" for _ in range(n)]


def _changed(words, k):
    """k neighbouring words at the end changed, or k words anywhere."""
    words = list(words)
    at = range(len(words) - k, len(words)) if R.random() < 0.5 else R.sample(range(len(words)), k)
    for i in at:
        words[i] = f"x{R.randrange(10**9)}"
    return words


def _rows(groups=40):
    rows = []
    for _ in range(groups):
        base = _words(R.randint(3, 160))
        for k in range(R.randint(1, 5)):
            rows.append(" ".join(_changed(base, min(len(base), k * max(1, len(base) // 60)))))
    return [(i, t) for i, t in enumerate(rows)]


@pytest.fixture
def five(monkeypatch):
    monkeypatch.setattr(brute, "shingles", partial(brute.shingles, n=5))


def test_links_of_five_words_and_eighty_percent(spark, five):
    rows = _rows()
    want = {d for d, _, c, _ in brute.groups(rows, 80) if d == c}
    assert want < {d for d, _ in rows}
    df = spark.createDataFrame([(d, t, "s") for d, t in rows], DOCS)
    assert {r.doc_id for r in pipeline.near_duplicates(spark, df, "").collect()} == want
    assert sorted(tuple(r) for r in jaccard.join(df, ngram=5, percent=80).collect()) == sorted(brute.groups(rows, 80))


def test_a_pair_below_the_threshold_of_four_words(spark):
    """45 of 55 shingles of five words in common (81.8 %), of four words 46 of 56 (82.1 %, below 85)."""
    base = [f"w{i}" for i in range(54)]
    rows = [(1, " ".join(base), "s"), (2, " ".join(base[:49] + [f"x{i}" for i in range(5)]), "s"), (3, "other words only here", "s")]
    assert {r.doc_id for r in pipeline.near_duplicates(spark, spark.createDataFrame(rows, DOCS), "").collect()} == {1, 3}


def test_bounds_hold_at_other_thresholds():
    for percent in (50, 80, 95, 100):
        for n in range(1, 400):
            assert jaccard.least_common(n, percent) == -(-percent * n // 100) and 1 <= jaccard.first_look(n, percent) <= n
            assert jaccard.shared_there(n, percent) <= jaccard.first_look(n, percent)


def test_rows_without_an_id(spark):
    """Copies without an id go where one with an id is linked with, and else one of each group stays."""
    a, b, c = (" ".join(_words(60)) for _ in range(3))
    near = lambda t: " ".join(t.split(" ")[:-2] + ["p", "q"])
    rows = [(5, a), (None, a), (None, near(a)), (None, b), (None, b), (None, near(b)), (None, c), (7, near(c)), (8, c), (8, c), (None, None), (None, None), (None, ""), (9, None), (9, None), (10, "")]
    got = pipeline.near_duplicates(spark, spark.createDataFrame([(*r, "s") for r in rows], DOCS), "").collect()
    assert sorted(r.doc_id for r in got if r.doc_id is not None) == [5, 7, 9, 10]
    unnamed = [r.text for r in got if r.doc_id is None]
    assert len([t for t in unnamed if t]) == 1 and {t for t in unnamed if t} <= {b, near(b)} and len([t for t in unnamed if not t]) == 3
