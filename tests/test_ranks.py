"""Ranks over ranges of values against a plain sort."""

import random

from minutario.operators import stats


def brute(rows):
    out = {}
    for g in {g for g, _ in rows}:
        own = sorted(v for h, v in rows if h == g and v is not None)
        for v in set(own):
            at = [n + 1 for n, x in enumerate(own) if x == v]
            out[g, v] = (sum(at) / len(at), len(at))
    return out


def test_mid_ranks_by_group_with_ties_nulls_and_a_hot_value(spark):
    rng = random.Random(2)
    rows = [(rng.choice(["a", "b", None]), rng.choice([None, float(rng.randrange(40)), rng.random() * 1000])) for _ in range(600)] + [("a", 7.0)] * 300
    df = spark.createDataFrame(rows, "g string, v double").repartition(7)
    got = {(r.g, r.v, r["rank"], r.ties) for r in stats.mid_ranks(df, "v", "g").collect()}
    assert got == {(g, v, *x) for (g, v), x in brute(rows).items()}
    whole = {(r.v, r["rank"], r.ties) for r in stats.mid_ranks(df.select("v"), "v").collect()}
    assert whole == {(v, *x) for (_, v), x in brute([(0, v) for _, v in rows]).items()}
    assert stats.mid_ranks(df.where("false"), "v", "g").count() == 0


def test_correlations_keep_pairs_without_rows(spark):
    df = spark.createDataFrame([(1.0, 2.0, None), (2.0, 4.0, None), (3.0, 9.0, None)], "a double, b double, c double")
    got = {(r.x, r.y): (r.n, r.spearman) for r in stats.correlations(df, ["a", "b", "c"]).collect()}
    assert got[("a", "b")] == (3, 1.0) and got[("a", "c")] == (0, None)
