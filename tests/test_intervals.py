"""Weighted bootstrap and interval verdicts."""

import numpy as np
from pyspark.sql import functions as F

from minutario.operators import agreement, intervals


def test_weighted_bootstrap_is_close_to_theory_and_ignores_partitioning(spark):
    rng = np.random.default_rng(4)
    rows = [("a", f"u{i}", float(v)) for i, v in enumerate(rng.normal(5, 2, 400))] + [("b", "x", 1.0), ("b", "x", 3.0), ("c", None, 1.0), (None, "y", 1.0), ("a", "u0", None)]
    df = spark.createDataFrame(rows, "g string, u string, v double")
    got = {r.g: r for r in intervals.weighted_bootstrap_means(df, "g", "u", "v", n=300).collect()}
    again = {r.g: r for r in intervals.weighted_bootstrap_means(df.repartition(5, "v"), "g", "u", "v", n=300).collect()}
    assert set(got) == {"a", "b"} and got["b"].point == got["b"].lower == got["b"].upper == 2.0
    assert all(abs(got[g][c] - again[g][c]) < 1e-9 for g in got for c in ("point", "lower", "upper"))
    half = (got["a"].upper - got["a"].lower) / 2
    assert abs(half - 1.96 * 2 / 20) < 0.04 and got["a"].lower < got["a"].point < got["a"].upper
    assert intervals.weighted_bootstrap_means(df.where("false"), "g", "u", "v").count() == 0


def test_intervals_apart_and_kappa_of_counts(spark):
    df = spark.createDataFrame([(0.5, 0.6, 0.1, 0.4, 5, 0, 0, 5), (0.1, 0.2, 0.3, 0.4, 3, 0, 0, 0), (0.1, 0.4, 0.4, 0.5, 2, 2, 2, 2), (None, 0.4, 0.4, 0.5, 0, 0, 0, 0)], "a double, b double, c double, d double, p int, q int, r int, s int")
    got = df.select(intervals.apart(F.col("a"), F.col("b"), F.col("c"), F.col("d")).alias("v"), agreement.kappa_of_counts(*[F.col(c) for c in "pqrs"]).alias("k")).collect()
    assert [r.v for r in got] == ["above", "below", "overlap", None] and [r.k for r in got] == [1.0, None, 0.0, None]
