"""Candidate pairs of rows that share a bucket, in bounded memory whatever a bucket's size."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from minutario.session import shuffle_width

#: Rows of one bucket that are paired in place. Larger buckets are cut into blocks of this size.
BLOCK = 128

_OUT = "a bigint, b bigint, key bigint, block int, mark bigint"


def _pairs_in(key: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (i < j) with equal keys; key is sorted and no run is longer than block."""
    firsts, seconds = [], []
    rows = np.arange(len(key))
    for step in range(1, block):
        near = rows[rows + step < len(key)]
        near = near[key[near] == key[near + step]]
        if not len(near):
            break
        firsts.append(near)
        seconds.append(near + step)
        rows = near
    empty = np.zeros(0, dtype=np.int64)
    return (np.concatenate(firsts), np.concatenate(seconds)) if firsts else (empty, empty)


def _stream(batches: Iterator[pa.RecordBatch], block: int, near: int, accept) -> Iterator[pa.RecordBatch]:
    """Batches sorted by key -> accepted pairs of small buckets, and members with a block number of large ones.

    With near > 0 the members of large buckets also give the accepted pairs with the bucket's first row and with the
    next few rows, which is enough to join most of a bucket of near copies.
    """
    held: dict[str, np.ndarray] | None = None
    hot_key, hot_seen, hot_first = None, 0, None
    names: list[str] = []

    def emit(rows: dict[str, np.ndarray], i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        ok = accept(rows, i, j)
        a, b = rows["id"][i[ok]], rows["id"][j[ok]]
        return np.minimum(a, b), np.maximum(a, b)

    def out(a, b, key, blk, mark) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int32() if n == "block" else pa.int64()) for n, x in zip(("a", "b", "key", "block", "mark"), (a, b, key, blk, mark))], names=["a", "b", "key", "block", "mark"])

    def plain(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        none = pa.nulls(len(a), pa.int64())
        return out(a, b, none, none.cast(pa.int32()), none)

    def hot(rows: dict[str, np.ndarray], place: np.ndarray, first: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        none = pa.nulls(len(place), pa.int64())
        yield out(rows["id"], none, rows["key"], (place // block).astype(np.int32), rows.get("mark", none))
        if near:
            n = len(place)
            both = {c: np.concatenate([first[c], rows[c]]) for c in names}
            i = [np.zeros(n, np.int64), *[np.arange(1, n + 1 - d) for d in range(1, near + 1)]]
            j = [np.arange(1, n + 1), *[np.arange(1 + d, n + 1) for d in range(1, near + 1)]]
            i, j = np.concatenate(i), np.concatenate(j)
            a, b = emit(both, i, j)
            yield plain(a[a != b], b[a != b])

    def flush(rows: dict[str, np.ndarray], last: bool) -> Iterator[pa.RecordBatch]:
        nonlocal held, hot_key, hot_seen, hot_first
        key = rows["key"]
        starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        ends = np.r_[starts[1:], len(key)]
        open_from = len(key)
        if not last and ends[-1] - starts[-1] <= block and key[-1] != hot_key:
            open_from = starts[-1]  # the run may go on in the next batch
        size = ends - starts
        is_hot = (size > block) | (key[starts] == hot_key)
        for s, e in zip(starts[is_hot], ends[is_hot]):
            if key[s] != hot_key:
                hot_key, hot_seen, hot_first = key[s], 0, {c: rows[c][s : s + 1] for c in names}
            yield from hot({c: rows[c][s:e] for c in names}, hot_seen + np.arange(e - s), hot_first)
            hot_seen += e - s
        cold = ~np.repeat(is_hot, size)
        cold[open_from:] = False
        keep = cold & np.repeat(size > 1, size)
        if keep.any():
            small = {c: rows[c][keep] for c in names}
            i, j = _pairs_in(small["key"], block)
            for at in range(0, len(i), 2_000_000):
                yield plain(*emit(small, i[at : at + 2_000_000], j[at : at + 2_000_000]))
        held = {c: rows[c][open_from:] for c in names} if open_from < len(key) else None

    for batch in batches:
        names = batch.schema.names
        rows = {c: batch.column(k).to_numpy(zero_copy_only=False) for k, c in enumerate(names)}
        if held is not None:
            rows = {c: np.concatenate([held[c], rows[c]]) for c in names}
        if len(rows["key"]):
            yield from flush(rows, False)
    if held is not None:
        yield from flush(held, True)


def bucket_candidates(rows: DataFrame, accept: Callable, block: int = BLOCK, near: int = 0) -> DataFrame:
    """Rows (key, id, payload...) of longs -> (a, b) accepted pairs, and (a, key, block, mark) members of large buckets.

    One shuffle by key; within a task the sorted rows stream by, so a bucket with a third of all rows is never held.
    accept(columns, i, j) says which index pairs are worth a look; a payload named mark stays with the members.
    """
    sorted_ = rows.repartition(shuffle_width(rows.sparkSession), "key").sortWithinPartitions("key", "id")
    return sorted_.mapInArrow(lambda batches: _stream(batches, block, near, accept), _OUT)


def block_pairs(members: DataFrame, condition: Callable[[str, str], Column]) -> DataFrame:
    """All (a, b) of members (key, block, id, ...) of one key that meet the condition, as a join of block with block.

    A bucket of n rows becomes (n / block)^2 / 2 small joins that spread over all tasks; none sees more than two blocks.
    """
    last = members.groupBy("key").agg(F.max("block").alias("last"))
    both = members.join(last, "key")
    left = both.withColumn("other", F.explode(F.sequence("block", "last"))).alias("l")
    right = both.withColumn("other", F.explode(F.sequence(F.lit(0), "block"))).alias("r")
    on = (F.col("l.key") == F.col("r.key")) & (F.col("l.block") == F.col("r.other")) & (F.col("l.other") == F.col("r.block"))
    on &= (F.col("l.block") < F.col("r.block")) | (F.col("l.id") < F.col("r.id"))
    pair = left.join(right, on & condition("l", "r"))
    return pair.select(F.least("l.id", "r.id").alias("a"), F.greatest("l.id", "r.id").alias("b"))


def block_pairs_with(few: DataFrame, members: DataFrame, condition: Callable[[str, str], Column]) -> DataFrame:
    """All (a, b) of a row of few and a member of the same key that meet the condition: few go to each of the key's blocks.

    One task's share is a block of few beside a block of members; the work is few times members, not members squared.
    """
    last = members.groupBy("key").agg(F.max("block").alias("last"))
    left = few.join(last, "key").withColumn("other", F.explode(F.sequence(F.lit(0), "last"))).alias("l")
    right = members.alias("r")
    pair = left.join(right, (F.col("l.key") == F.col("r.key")) & (F.col("l.other") == F.col("r.block")) & (F.col("l.id") != F.col("r.id")) & condition("l", "r"))
    return pair.select(F.least("l.id", "r.id").alias("a"), F.greatest("l.id", "r.id").alias("b"))
