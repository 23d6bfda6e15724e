"""Which row of a key holds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest(df: DataFrame, key: str, columns: Sequence[str], order: str = "ingested_at") -> DataFrame:
    """Per key the columns of the row with the greatest order value.

    Ties go to the greatest row in column order, so the result doesn't depend on the file layout. A null order value is
    the least; rows with a null key are dropped. Maxima are taken before the shuffle, so a key with many rows is cheap.
    """
    rest = [c for c in columns if c not in (key, order)]
    row = F.struct(F.col(order), *[F.col(c) for c in rest])
    picked = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.max(row).alias("_row"))
    return picked.select(key, *[F.col("_row")[c].alias(c) for c in columns if c != key])
