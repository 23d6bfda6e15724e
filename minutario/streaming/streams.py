"""Structured Streaming forms of the append-only log: windows, last-wins state and resumable work."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def windowed_totals(stream: DataFrame, time: str, value: str, by: str, width: str = "1 hour", slide: str | None = None, late: str = "2 hours") -> DataFrame:
    """(start, by, n, total) per window; rows later than the watermark are dropped, as the engine's contract has it."""
    window = F.window(time, width, slide) if slide else F.window(time, width)
    sums = stream.withWatermark(time, late).groupBy(window.alias("w"), by).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return sums.select(F.col("w.start").alias("start"), by, "n", "total")


def last_wins(stream: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """(key, order, value) updates: per key the row with the greatest order so far; older rows arriving late change nothing.

    The engine's own deduplication keeps the first row; this state keeps the last. Ties go to the greater value.
    """
    kinds = {c: stream.schema[c].dataType.simpleString() for c in (key, order, value)}
    number = kinds[order] in ("bigint", "int")

    def update(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        best = state.get if state.exists else None
        before = best
        for batch in batches:
            own = batch.dropna(subset=[order]).sort_values([order, value], na_position="first")
            if len(own):
                last = (own[order].iloc[-1], own[value].iloc[-1])
                if best is None or last > tuple(best):
                    best = (int(last[0]) if number else last[0], last[1])
        if best is not None and best != before:
            state.update(tuple(best))
            yield pd.DataFrame({key: [k[0]], order: [best[0]], value: [best[1]]})

    return stream.select(key, order, value).groupBy(key).applyInPandasWithState(update, f"`{key}` {kinds[key]}, `{order}` {kinds[order]}, `{value}` {kinds[value]}", f"`{order}` {kinds[order]}, `{value}` {kinds[value]}", "update", GroupStateTimeout.NoTimeout)


def pending(work: DataFrame, log: DataFrame, key: list[str], error: str = "error") -> DataFrame:
    """Work without a record, or whose last record has an error: what a resumed run still has to do."""
    done = log.where(F.col(error).isNull()).select(*key).distinct()
    return work.join(done, key, "left_anti")


def evaluated(work: DataFrame, function: Callable[[dict], str], key: list[str]) -> DataFrame:
    """(key..., answer, error): the function on every row; an exception becomes data of its row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for row in batch.to_dict("records"):
                try:
                    rows.append((*[row[k] for k in key], function(row), None))
                except Exception as e:  # noqa: BLE001
                    rows.append((*[row[k] for k in key], None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=[*key, "answer", "error"])

    kinds = ", ".join(f"`{k}` {work.schema[k].dataType.simpleString()}" for k in key)
    return work.mapInPandas(run, f"{kinds}, answer string, error string")
