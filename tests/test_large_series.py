"""Series of several blocks: numbers and matches without a shuffle of pairs."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from minutario.operators import alignment, pairs


@pytest.fixture
def decided(spark, monkeypatch):
    for name, value in (("BLOCK", 7), ("TILE", 5), ("TERMS_AT_ONCE", 3)):
        monkeypatch.setattr(pairs, name, value)
    draw = random.Random(5)
    rows = [(f"d{i}", s, draw.choice(("", "", "z")) + s + draw.choice("abcdx"), draw.sample("pqrstuvw", draw.randrange(6))) for s, n in (("A", 90), ("B", 7), ("C", 8), ("D", 1)) for i in range(100 * ord(s), 100 * ord(s) + n)]
    return spark.createDataFrame([*rows, ("e", None, "Aa", ["p", "q"]), (None, "A", "Aa", ["p", "q"])], "id string, series_id string, meeting_id string, terms array<string>")


@pytest.mark.parametrize("point", [(0.3, 2), (0.6, 1)])
def test_numbers_equal_those_of_a_window_over_the_pairs(decided, point):
    wanted = pairs.numbered(pairs.scored_candidates(decided, *point))
    got = pairs.numbered_candidates(decided, *point)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, wanted.select(got.columns).collect())) != []
    assert pairs.numbered_candidates(decided.where("false")).count() == 0


def test_numbers_of_a_thousand_and_more(spark):
    n = spark.createDataFrame([("A", k) for k in (1, 999, 1000, 12345678901)], "series_id string, k long").select(pairs.pair_number(F.col("k")).alias("x"))
    assert [r.x for r in n.collect()] == ["A.p001", "A.p999", "A.p1000", "A.p12345678901"]


def test_only_candidates_without_a_pair_in_a_window(spark, folder):
    """The plan of j03 shuffles items and counts; the window is over counts."""
    from minutario.plans.registry import queries

    plan = queries()["j03_candidate_pairs"](spark, folder)._jdf.queryExecution().optimizedPlan().toString()
    window = next((line for line in plan.split("\n") if "Window" in line and "row_number" in line and "score" in line), None)
    assert window is None and "Window" in plan


@pytest.mark.parametrize("nearest", [(1, 4), (64, 256)])
def test_matches_worked_out_by_row_equal_those_of_the_matrix(nearest, monkeypatch):
    monkeypatch.setattr(alignment, "NEAREST", nearest[0])
    monkeypatch.setattr(alignment, "MOST_NEAREST", nearest[1])
    draw = np.random.default_rng(4)
    for _ in range(150):
        n, m = draw.integers(1, 14, 2)
        s = draw.integers(0, 9, (n, m)) / 10
        kept = {}
        for tau in (0.3, 0.6):
            got = alignment.sparse_aligned(lambda i: (np.flatnonzero(s[i] >= 0.3), s[i][s[i] >= 0.3]), n, m, tau, kept)  # noqa: B023
            wanted = alignment.aligned(s, tau)
            assert len(got) == len(wanted) and abs(sum(x[2] for x in got) - sum(x[2] for x in wanted)) < 1e-6
            assert all(s[i, j] == x >= tau for i, j, x in got) and len({i for i, *_ in got}) == len({j for _, j, _ in got}) == len(got)


def test_alignment_of_candidates_equals_that_of_their_pairs(decided):
    given = pairs.scored_candidates(decided).select(F.concat_ws("-", "earlier_meeting", "later_meeting").alias("meetings"), F.col("earlier").alias("p"), F.col("later").alias("r"), "score")
    total = lambda df: {(r.meetings, r.tau): (r.n, round(r.s, 6)) for r in df.groupBy("meetings", "tau").agg(F.count("*").alias("n"), F.sum("similarity").alias("s")).collect()}
    got = alignment.align_candidates(decided, [0.4, 0.6])
    assert total(got) == total(alignment.align_groups(given, "meetings", "p", "r", "score", [0.4, 0.6])) != {}
    scores = {(r.earlier, r.later): r.score for r in pairs.scored_candidates(decided).collect()}
    assert all(scores[r.predicted, r.reference] == r.similarity >= r.tau for r in got.collect())
    assert alignment.align_candidates(decided.where("false"), [0.4]).count() == 0


def test_the_features_of_pairs_read_items_that_are_put_by(spark, folder):
    """Before, the shuffle files of the whole decisions lay beside those of the blocks, and the decisions were read twice."""
    from minutario.plans.registry import queries

    assert "decision_content" not in queries()["j05_pair_features"](spark, folder)._jdf.queryExecution().optimizedPlan().toString()
