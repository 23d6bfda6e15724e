"""Consolidating pairwise matches into groups (problem 3): partition-wise union-find, merged hierarchically."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from minutario.session import cut

#: Links that one task may hold when forests are merged: about 100 MB of id strings.
LINKS_PER_TASK = 1_000_000


def local_forest(left: pd.Series, right: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """Spanning forest of the links as (node, least node of its tree), one entry per node that isn't the least."""
    codes, names = pd.factorize(pd.concat([left, right], ignore_index=True), sort=True)
    a, b = codes[: len(left)], codes[len(left) :]
    root = np.arange(len(names))
    while True:
        ra, rb = root[a], root[b]
        open_ = ra != rb
        if not open_.any():
            break
        a, b, ra, rb = a[open_], b[open_], ra[open_], rb[open_]
        np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
    child = np.flatnonzero(root != np.arange(len(names)))
    names = np.asarray(names)
    return names[child], names[root[child]]


def _merge(batches: Iterator[pd.DataFrame], limit: int) -> Iterator[pd.DataFrame]:
    """Union-find over a partition; whenever limit links have been gathered they shrink to their forest.

    A forest that stays above half the limit is passed on as it is and a new one begun: memory keeps its bound, and
    the next level joins the two.
    """
    held: list[pd.DataFrame] = []
    size = 0

    def shrunk() -> pd.DataFrame:
        rows = pd.concat(held, ignore_index=True)
        node, root = local_forest(rows["node"], rows["root"])
        return pd.DataFrame({"node": node, "root": root})

    for batch in batches:
        held.append(batch)
        size += len(batch)
        if size > limit:
            held = [shrunk()]
            size = len(held[0])
            if size > limit // 2:
                yield held.pop()
                size = 0
    if size:
        yield shrunk()


def connected_components(links: DataFrame, left: str, right: str, links_per_task: int = LINKS_PER_TASK) -> DataFrame:
    """(node, root) for every node with a link to another one; root is the least node of its component.

    Links with a null end or with equal ends tie nothing; repeated links and either direction are fine; no links give
    no rows. Each level runs union-find inside the partitions and keeps only spanning forests. The forests then go to
    fewer, bounded partitions, grouped by node. Once all fit into one bounded task, that task ends the job. A forest
    that no longer shrinks and is too large for one task is finished by pointer jumping, as joins and sums over all
    tasks, until every node points to a root; no task ever holds more than links_per_task links in Python.
    """
    kind = links.schema[left].dataType.simpleString()
    schema = f"node {kind}, root {kind}"
    a, b = F.col(left), F.col(right)
    ordered = links.where(a.isNotNull() & b.isNotNull() & (a != b)).select(
        F.greatest(a, b).alias("node"), F.least(a, b).alias("root")
    )

    def merged(df: DataFrame) -> DataFrame:
        return df.mapInPandas(lambda batches: _merge(batches, links_per_task), schema)

    forest = cut(merged(ordered))
    before = None
    while True:
        size = forest.count()
        if size <= links_per_task:
            return merged(forest.coalesce(1))
        parts = max(-(-2 * size // links_per_task), 2)
        if before is None or size < 0.7 * before:
            before = size
            forest = cut(merged(forest.repartition(parts, "node")))
            continue
        return _jump_until_flat(forest)


def _jump_until_flat(forest: DataFrame) -> DataFrame:
    """Large forests: each node's roots are tied to the least of them, then every root is replaced by its own root.

    Nodes with a third of all links are only ever the broadcast-free probe side of a join by root, which adaptive
    execution splits; grouping is by node after map-side minima.
    """
    while True:
        least = forest.groupBy("node").agg(F.min("root").alias("least"))
        tied = (
            forest.join(least, "node")
            .select(F.explode(F.array(
                F.struct("node", F.col("least").alias("root")),
                F.struct(F.col("root").alias("node"), F.col("least").alias("root")),
            )).alias("_l"))
            .select("_l.*")
            .where("node <> root")
            .distinct()
        )
        tied = cut(tied)
        up = tied.groupBy("node").agg(F.min("root").alias("up")).withColumnRenamed("node", "root")
        jumped = tied.join(up, "root", "left").select("node", F.coalesce("up", "root").alias("root"), F.col("up").isNotNull().alias("moved"))
        forest = cut(jumped)
        moving = forest.where("moved").limit(1).count()
        doubled = forest.groupBy("node").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x <> y").limit(1).count()
        forest = forest.select("node", "root").distinct()
        if not moving and not doubled:
            return forest


def tied_groups(pairs: DataFrame, left: str, right: str, links_per_task: int = LINKS_PER_TASK) -> DataFrame:
    """(decision_id, group_id) for every id tied to another, the root included; group_id is the least id."""
    tree = cut(connected_components(pairs, left, right, links_per_task))
    roots = tree.select(F.col("root").alias("decision_id"), F.col("root").alias("group_id")).distinct()
    return tree.select(F.col("node").alias("decision_id"), F.col("root").alias("group_id")).unionByName(roots)
