"""Rules whose violations are rows, not exceptions."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def issues(df: DataFrame, key: str, rules: Mapping[str, Column]) -> DataFrame:
    """(key, issue) for every rule that a row breaks, in one pass. A rule that is null isn't broken."""
    broken = F.array_compact(F.array(*[F.when(condition, F.lit(name)) for name, condition in rules.items()]))
    return df.select(key, F.explode(broken).alias("issue"))


def dangling(df: DataFrame, key: str, reference: str, target: DataFrame, target_key: str) -> DataFrame:
    """(key, reference) of rows whose reference names no target; null references dangle from nothing."""
    known = target.select(F.col(target_key).alias(reference)).distinct()
    return df.where(F.col(reference).isNotNull()).join(known, reference, "left_anti").select(key, reference)


def duplicates(df: DataFrame, *key: str) -> DataFrame:
    """(key..., n) of keys with more than one row."""
    return df.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")


def changed_rows(base: DataFrame, other: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, change, column): rows added or missing, and columns that differ (null equals null)."""
    b = base.select(key, F.struct(*columns).alias("_b"))
    o = other.select(key, F.struct(*columns).alias("_o"))
    differing = F.array_compact(F.array(*[F.when(~F.col("_b")[c].eqNullSafe(F.col("_o")[c]), F.lit(c)) for c in columns]))
    both = b.join(o, key, "full")
    change = F.when(F.col("_b").isNull(), F.lit("added")).when(F.col("_o").isNull(), F.lit("missing")).otherwise("changed")
    listed = F.when(F.col("_b").isNull() | F.col("_o").isNull(), F.array(F.lit(None).cast("string"))).otherwise(differing)
    return both.select(key, change.alias("change"), F.explode(listed).alias("column"))


def not_increasing(df: DataFrame, by: str, order: str, value: str) -> DataFrame:
    """(by, order, value, before) where a value isn't above the one before it in its group; nulls are passed over."""
    before = F.lag(value).over(W.partitionBy(by).orderBy(order))
    return df.where(F.col(value).isNotNull()).withColumn("before", before).where(F.col(value) <= F.col("before")).select(by, order, value, "before")


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of new replace those of the same key, the others stay."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)
