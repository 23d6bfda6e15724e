"""Intervals: overlap and containment joins, merged runs, nearest neighbours and gaps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def merged_spans(df: DataFrame, by: Sequence[str], start: str, end: str, gap: int = 0) -> DataFrame:
    """(by..., start, end, n) of runs whose spans overlap or lie at most gap apart (gap -1: they must overlap)."""
    w = W.partitionBy(*by).orderBy(start, end)
    reach = F.max(end).over(w.rowsBetween(W.unboundedPreceding, -1))
    marked = df.where(F.col(start).isNotNull() & F.col(end).isNotNull()).withColumn("_new", F.when(reach.isNull() | (F.col(start) > reach + gap), 1).otherwise(0))
    run = marked.withColumn("_run", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return run.groupBy(*by, "_run").agg(F.min(start).alias(start), F.max(end).alias(end), F.count("*").alias("n")).drop("_run")


def consecutive_runs(df: DataFrame, by: Sequence[str], index: str) -> DataFrame:
    """(by..., first, last, n) of runs of consecutive distinct indexes."""
    distinct = df.select(*by, index).where(F.col(index).isNotNull()).distinct()
    island = distinct.withColumn("_i", F.col(index) - F.row_number().over(W.partitionBy(*by).orderBy(index)))
    return island.groupBy(*by, "_i").agg(F.min(index).alias("first"), F.max(index).alias("last"), F.count("*").alias("n")).drop("_i")


def overlap_join(left: DataFrame, right: DataFrame, by: Sequence[str], l: tuple[str, str], r: tuple[str, str], width: int) -> DataFrame:
    """Rows of one group whose half-open spans overlap. Both sides are dealt to bins of `width`, the pair counts once.

    Bins keep a group with many spans from becoming one task; a pair is kept in the bin where the later of the two begins.
    """
    bins = lambda s, e: F.explode(F.sequence(F.floor(F.col(s) / width), F.floor((F.greatest(F.col(e) - 1, F.col(s))) / width)))
    a = left.where(F.col(l[0]) < F.col(l[1])).withColumn("_bin", bins(*l))
    b = right.where(F.col(r[0]) < F.col(r[1])).withColumn("_bin", bins(*r))
    both = a.join(b, [*by, "_bin"])
    overlap = (F.col(l[0]) < F.col(r[1])) & (F.col(r[0]) < F.col(l[1]))
    return both.where(overlap & (F.floor(F.greatest(l[0], r[0]) / width) == F.col("_bin"))).drop("_bin")


def nearest(left: DataFrame, right: DataFrame, by: Sequence[str], key: str, at: str, other: str) -> DataFrame:
    """(by..., key, at, nearest, gap): for each left row the closest right value; the earlier one on a tie.

    One union and two running windows per group instead of a range join; null when the group has no right rows.
    """
    l = left.select(*by, F.col(key).alias("_k"), F.col(at).alias("_t"), F.lit(None).cast(right.schema[other].dataType).alias("_o"))
    r = right.select(*by, F.lit(None).cast(left.schema[key].dataType).alias("_k"), F.col(other).alias("_t"), F.col(other).alias("_o"))
    w = W.partitionBy(*by).orderBy("_t")
    seen = l.unionByName(r).select(
        "*", F.last("_o", ignorenulls=True).over(w.rangeBetween(W.unboundedPreceding, 0)).alias("_before"),
        F.first("_o", ignorenulls=True).over(w.rangeBetween(0, W.unboundedFollowing)).alias("_after"),
    ).where("_k is not null")
    back, ahead = F.col("_t") - F.col("_before"), F.col("_after") - F.col("_t")
    pick = F.when(ahead.isNull() | (back <= ahead), F.col("_before")).otherwise(F.col("_after"))
    return seen.select(*by, F.col("_k").alias(key), F.col("_t").alias(at), pick.alias("nearest"), F.abs(F.col("_t") - pick).alias("gap"))
