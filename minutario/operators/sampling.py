"""Seeded samples that don't depend on partitioning: the standard library's generator over sorted ids."""

from __future__ import annotations

import math
import random

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stratified_sample(df: DataFrame, stratum: str, key: str, per_stratum: int, seed: int | str) -> DataFrame:
    """Rows of up to per_stratum ids of each stratum, drawn by a generator seeded with the seed and the stratum.

    Only ids are grouped. A hash order first leaves each stratum at most 64 * per_stratum ids or all of them, so no
    task holds a whole stratum; the draw itself is then exact and repeatable.
    """
    kinds = {c: df.schema[c].dataType.simpleString() for c in (stratum, key)}
    ids = df.select(stratum, key).where(F.col(stratum).isNotNull() & F.col(key).isNotNull()).distinct()
    order = F.struct(F.xxhash64(F.lit(str(seed)), F.col(key)).alias("h"), F.col(key).alias("k"))
    from pyspark.sql import Window as W

    few = ids.withColumn("_r", F.row_number().over(W.partitionBy(stratum).orderBy(order))).where(F.col("_r") <= 64 * per_stratum).drop("_r")

    def draw(name: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        own = sorted(frame[key])
        picked = random.Random(f"{seed}/{name[0]}").sample(own, min(per_stratum, len(own)))
        return pd.DataFrame({stratum: name[0], key: sorted(picked)})

    chosen = few.groupBy(stratum).applyInPandas(draw, f"`{stratum}` {kinds[stratum]}, `{key}` {kinds[key]}")
    return df.join(chosen, [stratum, key], "left_semi")


def quota(sizes: dict[str, int], total: int, share: dict[str, float]) -> dict[str, int]:
    """How many of each stratum: its rounded share (half to even), what one lacks goes to the others in order."""
    want = {k: min(sizes[k], round(total * share[k])) for k in sizes}
    left = min(total, sum(sizes.values())) - sum(want.values())
    for k in sizes:
        more = min(max(left, 0), sizes[k] - want[k])
        want[k] += more
        left -= more
    return want


def halving(candidates: DataFrame, name: str, gain: str, upper: str, veto: str) -> DataFrame:
    """Who goes on: without veto and with an upper bound not below 0, best first, max(ceil(k / 2), min(2, eligible)) of k."""
    rows = candidates.select(name, gain, upper, veto).collect()  # one row per entrant of a screen
    eligible = sorted((r for r in rows if not r[veto] and r[upper] >= 0), key=lambda r: (-r[gain], r[name]))
    keep = max(math.ceil(len(rows) / 2), min(2, len(eligible)))
    return candidates.where(F.col(name).isin([r[name] for r in eligible[:keep]] or [None]))
