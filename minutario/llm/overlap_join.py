"""All similar pairs between set-valued records (problem 2): size-aware overlap join."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from minutario.functions.text import decision_id, decision_terms
from minutario.llm.buckets import block_pairs, bucket_candidates
from minutario.llm.near_duplicates import pairs_in_groups
from minutario.session import cut
from minutario.versions import latest

#: Entries of one inverted list that a join key holds. Longer lists are cut into blocks that the probes visit one by one.
LIST_BLOCK = 1000


def _needed(size: np.ndarray | int, least: int, share: float):
    """Common tokens that a set of this size needs as the smaller one of a pair."""
    return np.maximum(least, np.ceil(np.asarray(size) * share - 1e-9).astype(int))


def _subset_rows(batches: Iterator[pa.RecordBatch], least: int, share: float) -> Iterator[pa.RecordBatch]:
    """(part, id, tokens by rising frequency) of small sets -> (key of a subset of `least` tokens, id, mark).

    The `least` rarest common tokens of a pair lie among the smaller set's first size - needed + least tokens; the mark
    is 1 for subsets from there, and only pairs with such a mark on either side are of use.
    """
    m = np.uint64(0xFF51AFD7ED558CCD)
    with np.errstate(over="ignore"):
        for batch in batches:
            part = batch.column("part").to_numpy(zero_copy_only=False).view(np.uint64)
            ids = batch.column("id").to_numpy(zero_copy_only=False)
            tokens = batch.column("tokens")
            flat = tokens.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            offsets = tokens.offsets.to_numpy() - tokens.offsets[0].as_py()
            sizes = np.diff(offsets)
            for size in np.unique(sizes):
                rows = np.flatnonzero(sizes == size)
                if size < least:
                    continue
                table = flat[offsets[rows][:, None] + np.arange(size)]
                choice = np.array(list(combinations(range(size), least)))
                first = (choice.max(1) < size - int(_needed(int(size), least, share)) + least).astype(np.int64)
                for at in range(0, len(rows), 2048):
                    block = table[at : at + 2048]
                    key = np.repeat(part[rows[at : at + 2048]][:, None], len(choice), 1)
                    for c in range(least):
                        key = (key ^ block[:, choice[:, c]]) * m
                        key ^= key >> np.uint64(32)
                    n = len(block)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(key.reshape(-1).view(np.int64)), pa.array(np.repeat(ids[rows[at : at + 2048]], len(choice))), pa.array(np.tile(first, n))],
                        names=["key", "id", "mark"],
                    )


def _marked(rows: dict[str, np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    return (rows["mark"][i] | rows["mark"][j]) == 1


def small_size(costs: dict[int, tuple[int, int]], least: int) -> int:
    """The size up to which sets are small, from (number of sets, entries of the lists they would scan) by size.

    A small set costs its subsets of `least` tokens, a large one the lists of its first tokens; the boundary with the
    least sum is taken, the lower one of equals.
    """
    sizes = sorted(costs)
    total = sum(scanned for _, scanned in costs.values())
    best, boundary = total, least - 1
    for size in sizes:
        number, scanned = costs[size]
        total += number * comb(size, least) - scanned
        if total < best:
            best, boundary = total, size
    return boundary


def overlap_pairs(sets: DataFrame, least: int = 3, share: float = 0.75, small: int | None = None, list_block: int = LIST_BLOCK) -> DataFrame:
    """(a, b), a < b, for sets (id long, part string, tokens array<string>) of one part whose overlap suffices.

    small is the size up to which sets are small; None takes the one with the least cost by the counted list lengths.

    Wanted are at least `least` common tokens that are also at least `share` of the smaller set. Ids and tokens within
    a set are distinct; null arrays and sets below `least` tokens pair with nothing; no sets give no rows. Tokens are
    ordered by their frequency inside the part. Two small sets are found through a common subset of `least` tokens.
    Pairs with a large set are found through inverted lists: a set's rare first tokens, of which one at least must be
    common, probe the lists of the large sets' tokens, and the large sets' first tokens those of all sets. The union
    of the pairs is checked on the exact overlap. Full buckets and long lists are cut into blocks, so neither a part with
    a third of the rows nor a frequent subset or token makes a long task.
    """
    base = sets.where(F.size("tokens") >= least).select("id", F.xxhash64("part").alias("part"), F.explode("tokens").alias("token"))
    counted = base.groupBy("part", "token").agg(F.count("*").alias("n"))
    ranked = base.join(counted, ["part", "token"]).groupBy("part", "id").agg(F.array_sort(F.collect_list(F.struct("n", F.xxhash64("token").alias("t")))).alias("ranked"))
    ranked = ranked.select("part", "id", F.transform("ranked", lambda x: x["t"]).alias("tokens"), F.transform("ranked", lambda x: x["n"]).alias("lists"))
    ranked = cut(ranked)
    n = F.size("tokens")
    needed = F.greatest(F.lit(least), F.ceil(n * share - 1e-9)).cast("int")
    if small is None:
        scanned = F.aggregate(F.slice("lists", 1, n - needed + 1), F.lit(0).cast("long"), lambda acc, x: acc + x)
        costs = ranked.groupBy(n.alias("size")).agg(F.count("*").alias("number"), F.sum(scanned).alias("scanned")).collect()  # a row for each size
        small = small_size({c.size: (c.number, c.scanned) for c in costs}, least)

    subsets = ranked.where(F.size("tokens") <= small).mapInArrow(lambda b: _subset_rows(b, least, share), "key bigint, id bigint, mark bigint")
    found = cut(bucket_candidates(subsets, _marked))
    candidates = found.where("b is not null").select("a", "b").distinct()
    hot = found.where("key is not null")
    if not hot.isEmpty():
        members = hot.select("key", "block", F.col("a").alias("id"), "mark")
        candidates = candidates.unionByName(block_pairs(members, lambda l, r: F.greatest(f"{l}.mark", f"{r}.mark") == 1))

    blocks = F.ceil(F.col("e.lists") / list_block).cast("int")
    entry = lambda upto: F.explode(F.arrays_zip(F.slice("tokens", 1, upto).alias("tokens"), F.slice("lists", 1, upto).alias("lists"))).alias("e")
    probes = ranked.select("part", "id", n.alias("size"), entry(n - needed + 1)).select("part", "id", "size", F.col("e.tokens").alias("token"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("block"))
    large = ranked.where(n > small).select("part", F.col("id").alias("other"), n.alias("other_size"), entry(n))
    large = large.select("part", "other", "other_size", F.col("e.tokens").alias("token"), F.pmod(F.xxhash64("other"), blocks).cast("int").alias("block"))
    # With a large set as the larger one, and as the smaller or equal one.
    scanned = probes.join(large, ["part", "token", "block"]).where("id <> other and size <= other_size")
    candidates = candidates.unionByName(scanned.select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b")))

    x = ranked.select(F.col("id").alias("a"), F.col("tokens").alias("ta"))
    y = ranked.select(F.col("id").alias("b"), F.col("tokens").alias("tb"))
    both = candidates.distinct().join(x, "a").join(y, "b").select("a", "b", F.size(F.array_intersect("ta", "tb")).alias("shared"), F.least(F.size("ta"), F.size("tb")).alias("smaller"))
    return both.where((F.col("shared") >= least) & (F.col("shared") / F.col("smaller") >= share)).select("a", "b", "shared", "smaller")


def candidate_decisions(candidates: DataFrame) -> DataFrame:
    """(decision_id, series_id, meeting_id, terms) of every decision on any side of a row that holds.

    Ids count in their plain form. A decision's text may be null in some rows; its terms are those of all its texts.
    Series and meeting are read off the id.
    """
    columns = ["pair_id", "earlier_decision_id", "later_decision_id", "earlier_text", "later_text"]
    held = latest(candidates.select(*columns, "ingested_at"), "pair_id", columns)
    side = F.explode(F.array(*[F.struct(decision_id(F.col(f"{s}_decision_id")).alias("decision_id"), F.col(f"{s}_text").alias("text")) for s in ("earlier", "later")]))
    rows = held.select(side.alias("s")).select("s.*").where("decision_id is not null")
    rows = rows.select("decision_id", decision_terms(F.col("text")).alias("terms")).distinct()
    whole = rows.groupBy("decision_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("terms")))).alias("terms"))
    meeting = F.substring_index("decision_id", ".", 1)
    return whole.select("decision_id", F.regexp_extract(meeting, r"^[A-Z]+[0-9]+", 0).alias("series_id"), meeting.alias("meeting_id"), "terms")


def similar_decisions(decisions: DataFrame, least: int = 3, share: float = 0.75) -> DataFrame:
    """(decision_id_a, decision_id_b) of one series but different meetings whose terms overlap enough.

    Decisions of a series with one and the same set of terms form a class; classes are joined, their members put in.
    """
    own = cut(decisions.where(F.size("terms") >= least).withColumn("mark", F.md5(F.concat_ws(" ", "series_id", "terms"))))
    classes = own.groupBy("mark").agg(F.first("series_id").alias("part"), F.first("terms").alias("tokens"))
    classes = cut(classes.withColumn("id", F.monotonically_increasing_id()))
    member = cut(own.join(classes.select("mark", "id"), "mark").select("id", "decision_id", "meeting_id"))
    pairs = overlap_pairs(classes.select("id", "part", "tokens"), least, share).select("a", "b")
    same = pairs_in_groups(member, "decision_id", "id").where(F.substring_index("decision_id_a", ".", 1) != F.substring_index("decision_id_b", ".", 1))
    x = member.select(F.col("id").alias("a"), F.col("decision_id").alias("x"), F.col("meeting_id").alias("mx"))
    y = member.select(F.col("id").alias("b"), F.col("decision_id").alias("y"), F.col("meeting_id").alias("my"))
    both = pairs.join(x, "a").join(y, "b").where("mx <> my and x <> y")
    return both.select(F.least("x", "y").alias("decision_id_a"), F.greatest("x", "y").alias("decision_id_b")).unionByName(same).distinct()
