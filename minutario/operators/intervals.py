"""Uncertainty: Wilson intervals as expressions, bootstraps as grouped functions with the standard library's generator."""

from __future__ import annotations

import random
from collections.abc import Callable, Iterator, Sequence
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def z_value(level: float = 0.95) -> float:
    return NormalDist().inv_cdf(1 - (1 - level) / 2)


def apart(lower_a: Column, upper_a: Column, lower_b: Column, upper_b: Column) -> Column:
    """above, below or overlap: where interval a lies against b; null if a bound is missing."""
    return F.when(lower_a > upper_b, "above").when(upper_a < lower_b, "below").when((lower_a <= upper_b) & (upper_a >= lower_b), "overlap")


def wilson(rate: Column, n: Column, level: float = 0.95) -> tuple[Column, Column]:
    """Bounds of a proportion, clipped to [0, 1]; null for n = 0. n may be fractional."""
    z = z_value(level)
    size = F.when(n > 0, n.cast("double"))
    centre = (rate + z * z / (2 * size)) / (1 + z * z / size)
    half = z * F.sqrt(rate * (1 - rate) / size + z * z / (4 * size * size)) / (1 + z * z / size)
    return F.greatest(F.lit(0.0), centre - half), F.least(F.lit(1.0), centre + half)


def bootstrap(values: Sequence[float], statistic: Callable[[Sequence[float]], float], n: int, seed: int, level: float = 0.95) -> tuple[float, float, float]:
    """(point, lower, upper): percentiles picked by index, without interpolation, of n resamples."""
    draw = random.Random(seed).randrange
    size = len(values)
    drawn = sorted(statistic([values[draw(size)] for _ in range(size)]) for _ in range(n))
    tail = (1 - level) / 2
    return statistic(values), drawn[max(0, int(tail * n))], drawn[min(n - 1, int((1 - tail) * n))]


def bootstrap_means(df: DataFrame, group: str, unit: str, value: str, n: int = 1000, seed: int = 20240501, level: float = 0.95) -> DataFrame:
    """(group, n_units, point, lower, upper) of the mean over units of each unit's mean.

    Units are first averaged in the JVM; a group's units are then resampled in the order of their names, so the result
    doesn't depend on the partitioning. Null values and units don't count.
    """
    units = df.where(F.col(value).isNotNull() & F.col(unit).isNotNull()).groupBy(group, unit).agg(F.avg(value).alias("_mean"))

    def one(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        values = frame.sort_values(unit)["_mean"].tolist()
        point, lower, upper = bootstrap(values, lambda v: sum(v) / len(v), n, seed, level)
        return pd.DataFrame({group: [key[0]], "n_units": [len(values)], "point": [point], "lower": [lower], "upper": [upper]})

    return units.groupBy(group).applyInPandas(one, f"`{group}` string, n_units long, point double, lower double, upper double")


def weighted_bootstrap_means(df: DataFrame, group: str, unit: str, value: str, n: int = 1000, seed: int = 20240501, level: float = 0.95) -> DataFrame:
    """(group, n_units, point, lower, upper) like bootstrap_means, for groups of any number of units.

    Instead of drawing units, every unit gets a Poisson weight of mean 1 in each of n resamples, from a generator seeded
    by its own hash; a batch gives n sums for each of its groups and the sums are added by group and resample. No task holds a
    group's units, and the result depends on neither partitioning nor order. Null values, units and groups don't count.
    """
    units = df.where(F.col(value).isNotNull() & F.col(unit).isNotNull() & F.col(group).isNotNull()).groupBy(group, unit).agg(F.avg(value).alias("_mean"))
    hashed = units.select(F.col(group).cast("string").alias("g"), F.xxhash64(unit).alias("h"), "_mean")

    def summed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for g, own in batch.groupby("g"):
                totals = np.zeros((2, n))
                for h, mean in zip(own["h"], own["_mean"]):
                    weight = np.random.Generator(np.random.SFC64([seed, h & 0xFFFFFFFF, (h >> 32) & 0xFFFFFFFF])).poisson(1.0, n)
                    totals += [weight, weight * mean]
                yield pd.DataFrame({"g": g, "resample": np.arange(n), "weight": totals[0], "total": totals[1]})

    sums = hashed.mapInPandas(summed, "g string, resample int, weight double, total double").groupBy("g", "resample").agg(F.sum("weight").alias("w"), F.sum("total").alias("t"))
    means = sums.where("w > 0").groupBy("g").agg(F.array_sort(F.collect_list(F.col("t") / F.col("w"))).alias("m"))  # n values to a group
    points = hashed.groupBy("g").agg(F.count("*").alias("n_units"), F.avg("_mean").alias("point"))
    tail, size = (1 - level) / 2, F.size("m")
    at = lambda share: F.element_at("m", F.least(size, F.floor(size * share).cast("int") + 1))
    return points.join(means, "g").select(F.col("g").alias(group), "n_units", "point", at(tail).alias("lower"), at(1 - tail).alias("upper"))


def cluster_bootstrap_prf(counts: DataFrame, group: str, cluster: str, n: int = 1000, seed: int = 20240501, level: float = 0.95) -> DataFrame:
    """Precision, recall and F1 with intervals from counts (group, cluster, hits_p, n_p, hits_r, n_r) per cluster."""

    def one(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        rows = frame.sort_values(cluster)[["hits_p", "n_p", "hits_r", "n_r"]].values.tolist()

        def scores(total: Sequence[float]) -> tuple[float, float, float]:
            p = total[0] / total[1] if total[1] else 0.0
            r = total[2] / total[3] if total[3] else 0.0
            return p, r, 2 * p * r / (p + r) if p + r else 0.0

        draw = random.Random(seed).randrange
        drawn = [scores([sum(c) for c in zip(*[rows[draw(len(rows))] for _ in rows])]) for _ in range(n)]
        out = {group: [key[0]], "n_clusters": [len(rows)]}
        tail = (1 - level) / 2
        for name, point, values in zip(("precision", "recall", "f1"), scores([sum(c) for c in zip(*rows)]), zip(*drawn)):
            ordered = sorted(values)
            out |= {name: [point], f"{name}_lower": [ordered[max(0, int(tail * n))]], f"{name}_upper": [ordered[min(n - 1, int((1 - tail) * n))]]}
        return pd.DataFrame(out)

    numbers = ", ".join(f"{m}{s} double" for m in ("precision", "recall", "f1") for s in ("", "_lower", "_upper"))
    return counts.groupBy(group).applyInPandas(one, f"`{group}` string, n_clusters long, {numbers}")


def stratified_recall(strata: DataFrame, by: Sequence[str] = (), level: float = 0.95) -> DataFrame:
    """Recall from rejected samples: columns population, n_sampled, n_missed, kept per stratum.

    The missed rate is weighted by population; its interval has the effective sample size (sum p)^2 / sum(p^2 / n).
    """
    p, s = F.col("population"), F.col("n_sampled")
    sums = strata.groupBy(*by).agg(
        F.count("*").alias("n_strata"), F.sum(s).alias("n_sampled"), F.sum("n_missed").alias("n_missed"), F.sum(p).alias("population"), F.sum("kept").alias("kept"),
        (F.sum(p * F.col("n_missed") / s) / F.sum(p)).alias("rate"), (F.sum(p) * F.sum(p) / F.sum(p * p / s)).alias("n_eff"),
    )
    lower, upper = wilson(F.col("rate"), F.col("n_eff"), level)
    recall = lambda r: F.when(F.col("kept") + r * p > 0, F.col("kept") / (F.col("kept") + r * p)).otherwise(1.0)
    return sums.select("*", lower.alias("rate_lower"), upper.alias("rate_upper"), recall(F.col("rate")).alias("recall"), recall(upper).alias("recall_lower"), recall(lower).alias("recall_upper"))
