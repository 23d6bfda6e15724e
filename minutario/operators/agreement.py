"""Agreement of two labellers: Cohen's kappa and what it rests on, as plain aggregations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def kappa(df: DataFrame, a: str, b: str, by: Sequence[str] = ()) -> DataFrame:
    """(by..., n, observed, expected, kappa) over rows where both labels are known.

    kappa is null when chance agreement is complete (one category on both sides). Contingency cells are summed map-side;
    the rest works on cells, whose number is that of the label pairs.
    """
    by = list(by)
    cells = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(*by, F.col(a).alias("_a"), F.col(b).alias("_b")).agg(F.count("*").alias("_n"))
    rows = cells.groupBy(*by, F.col("_a").alias("_l")).agg(F.sum("_n").alias("_ra"))
    columns = cells.groupBy(*by, F.col("_b").alias("_l")).agg(F.sum("_n").alias("_cb"))
    same = cells.groupBy(*by).agg(F.sum("_n").alias("n"), F.sum(F.when(F.col("_a") == F.col("_b"), F.col("_n")).otherwise(0)).alias("_same"))
    chance = rows.join(columns, [*by, "_l"]).groupBy(*by).agg(F.sum(F.col("_ra") * F.col("_cb")).alias("_chance"))
    both = same.join(chance, by, "left") if by else same.crossJoin(chance)
    observed = F.col("_same") / F.col("n")
    expected = F.coalesce("_chance", F.lit(0)) / (F.col("n") * F.col("n"))
    full = both.where("n > 0").select(*by, "n", observed.alias("observed"), expected.alias("expected"))
    return full.withColumn("kappa", F.when(F.col("expected") < 1, (F.col("observed") - F.col("expected")) / (1 - F.col("expected"))))


def precision_recall_f1(tp: Column, fp: Column, fn: Column) -> tuple[Column, Column, Column]:
    """Zero where a denominator is zero."""
    precision = F.when(tp + fp > 0, tp / (tp + fp)).otherwise(0.0)
    recall = F.when(tp + fn > 0, tp / (tp + fn)).otherwise(0.0)
    f1 = F.when(precision + recall > 0, 2 * precision * recall / (precision + recall)).otherwise(0.0)
    return precision, recall, f1


def kappa_of_counts(both: Column, only_a: Column, only_b: Column, neither: Column) -> Column:
    """Cohen's kappa of two yes-no labellers from their four counts; null where chance agreement is complete."""
    chance = (both + only_a) * (only_a + neither) + (both + only_b) * (only_b + neither)
    return F.when(chance > 0, 2 * (both * neither - only_a * only_b) / chance)


def settled_kappa(df: DataFrame, a: str, b: str, by: Sequence[str] = ()) -> DataFrame:
    """kappa with its two open cases settled: 1 where all labels are equal, 0 where it is undefined otherwise."""
    return kappa(df, a, b, by).withColumn("kappa", F.when(F.col("observed") == 1, 1.0).otherwise(F.coalesce("kappa", F.lit(0.0))))
