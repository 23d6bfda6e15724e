"""Blocking: pairs of decisions of one series from different meetings, scored by their common terms."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from minutario.session import shuffle_width, stored

THRESHOLD, LEAST_SHARED = 0.3, 2
#: Items of a series that are compared in one block; cells of a tile of counts; terms of one matrix product.
BLOCK, TILE, TERMS_AT_ONCE = 8192, 1 << 20, 2048


def meeting_order(meeting_id: Column) -> Column:
    """0 to 3 by the meeting's letter a to d; null for any other letter."""
    place = F.instr(F.lit("abcd"), F.right(meeting_id, F.lit(1)))
    return F.when(place > 0, place - 1)


def overlap_coefficient(a: Column, b: Column) -> Column:
    smaller = F.least(F.size(a), F.size(b))
    return F.when(smaller > 0, F.size(F.array_intersect(a, b)) / smaller).otherwise(0.0)


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(0.0)


def chronological_pairs(items: DataFrame) -> DataFrame:
    """The whole universe: (series_id, earlier, later) of items (id, series_id, meeting_id, terms). Quadratic in a series."""
    ordered = items.withColumn("o", meeting_order(F.col("meeting_id")))
    a = ordered.select("series_id", F.col("id").alias("earlier"), F.col("o").alias("oa"), F.col("meeting_id").alias("earlier_meeting"), F.col("terms").alias("ta"))
    b = ordered.select("series_id", F.col("id").alias("later"), F.col("o").alias("ob"), F.col("meeting_id").alias("later_meeting"), F.col("terms").alias("tb"))
    return a.join(b, "series_id").where("oa < ob").drop("oa", "ob")


def universe_size(items: DataFrame) -> DataFrame:
    """(series_id, universe): the number of chronological pairs from the counts per meeting, without forming them."""
    counts = items.where(meeting_order(F.col("meeting_id")).isNotNull()).groupBy("series_id", "meeting_id").count()
    n, sq = F.sum("count"), F.sum(F.col("count") * F.col("count"))
    return counts.groupBy("series_id").agg(((n * n - sq) / 2).cast("long").alias("universe"))


def _least_needed(sizes: np.ndarray, threshold: float, least_shared: int) -> np.ndarray:
    """For each size of a smaller set the least number of common terms that meets both conditions; it rises with the size."""
    most = int(sizes.max(initial=0))
    table, s = np.zeros(most + 1, np.float32), least_shared
    for k in range(1, most + 1):
        while s / k < threshold:
            s += 1
        table[k] = s
    return table[sizes]


def _shared_counts(rows: tuple[np.ndarray, np.ndarray], columns: tuple[np.ndarray, np.ndarray], n: int, m: int) -> Iterator[tuple[int, np.ndarray]]:
    """(first row, counts of common terms as float32) for tiles of rows by all columns; both given as (item, term) entries."""
    terms = np.intersect1d(rows[1], columns[1])
    both = []
    for item, term in (rows, columns):
        at = np.minimum(np.searchsorted(terms, term), max(len(terms) - 1, 0))
        known = terms[at] == term if len(terms) else np.zeros(len(term), bool)
        both.append((item[known], at[known]))

    def dense(side: int, low: int, high: int, first: int, count: int) -> np.ndarray:
        item, term = both[side]
        own = (item >= first) & (item < first + count) & (term >= low) & (term < high)
        out = np.zeros((count, high - low), np.float32)
        out[item[own] - first, term[own] - low] = 1
        return out

    step = max(1, TILE // max(m, 1))
    slices = [(low, min(low + TERMS_AT_ONCE, len(terms))) for low in range(0, len(terms), TERMS_AT_ONCE)]
    whole = [dense(k, *slices[0], 0, size) for k, size in enumerate((n, m))] if len(slices) == 1 else None
    for first in range(0, n if slices else 0, step):
        count = min(step, n - first)
        if whole:
            yield first, whole[0][first : first + count] @ whole[1].T
        else:
            yield first, sum(dense(0, low, high, first, count) @ dense(1, low, high, 0, m).T for low, high in slices)


def _accepted(group: pa.RecordBatch, threshold: float, least_shared: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(rows earlier, rows later, shared counts, accepted) by tiles for the rows of one pair of blocks of one series."""
    o, part = (group.column(c).to_numpy(zero_copy_only=False) for c in ("o", "part"))
    terms = group.column("terms")
    size = pc.list_value_length(terms).to_numpy(zero_copy_only=False).astype(np.int64)
    code = terms.flatten().dictionary_encode().indices.to_numpy(zero_copy_only=False)
    item = np.repeat(np.arange(len(o)), size)
    needed = _least_needed(size, threshold, least_shared)
    low, high = part.min(), part.max()

    def entries(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        place = np.full(len(o), -1)
        place[rows] = np.arange(len(rows))
        own = place[item] >= 0
        return place[item[own]], code[own]

    for first, second in [(low, high), (high, low)] if low < high else [(low, low)]:
        for place in np.unique(o):
            rows, columns = np.flatnonzero((part == first) & (o == place)), np.flatnonzero((part == second) & (o > place))
            if len(rows) and len(columns):
                for at, shared in _shared_counts(entries(rows), entries(columns), len(rows), len(columns)):
                    own = rows[at : at + len(shared)]
                    yield own, columns, shared, shared >= np.minimum(needed[own][:, None], needed[columns][None, :])


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of each (series_id, low, high) in one batch, from batches sorted by these."""
    held: list[pa.RecordBatch] = []

    def whole() -> pa.RecordBatch:
        return pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    for batch in batches:
        if not batch.num_rows:
            continue
        names = batch.column("series_id").dictionary_encode().indices.to_numpy()
        keys = np.stack([names, *[batch.column(c).to_numpy() for c in ("low", "high")]])
        starts = np.flatnonzero(np.r_[True, (keys[:, 1:] != keys[:, :-1]).any(0)])
        for start, end in zip(starts, [*starts[1:], batch.num_rows]):
            own = batch.slice(start, end - start)
            if held and any(held[-1].column(c)[0] != own.column(c)[0] for c in ("series_id", "low", "high")):
                yield whole()
                held = []
            held.append(own)
    if held:
        yield whole()


def comparable(items: DataFrame) -> DataFrame:
    """Items that can be in a pair, with o, the order of their meeting."""
    known = (F.size("terms") > 0) & F.col("series_id").isNotNull() & F.col("id").isNotNull()
    return items.where(known).select("series_id", "id", "meeting_id", "terms", meeting_order(F.col("meeting_id")).cast("int").alias("o")).where("o is not null")


def by_meetings(base: DataFrame, found: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]], schema: str, block: int | None = None) -> DataFrame:
    """found over the items of every two places in the order of a series' meetings, sorted by whether they are the later ones and by id.

    base is of comparable. Each item is sent three times, and no pair leaves a task before it is counted, matched or
    numbered. With a block the earlier items are dealt to tasks by that many in order of id, and the later ones are sent
    to each of these; the column high is the number of the block, low the two places.
    """
    one = F.array(F.lit(0))
    dealt = base.select("*", one.alias("own"), F.array(*[one] * 4).alias("blocks"))
    if block:
        nth = F.row_number().over(W.partitionBy("series_id", "o").orderBy("id"))
        bounds = base.select("series_id", "o", "id", nth.alias("nth")).where((F.col("nth") - 1) % block == 0).groupBy("series_id", "o").agg(F.array_sort(F.collect_list("id")).alias("from"))
        sides = bounds.groupBy("series_id").agg(*[F.first(F.when(F.col("o") == o, F.col("from")), True).alias(f"f{o}") for o in range(4)])
        froms = F.array(*[F.coalesce(f"f{o}", F.array().cast(f"array<{base.schema['id'].dataType.simpleString()}>")) for o in range(4)])
        dealt = base.join(F.broadcast(sides), "series_id").withColumn("froms", froms)
        own = F.size(F.filter(F.get("froms", F.col("o")), lambda x: x <= F.col("id"))) - 1
        blocks = F.transform("froms", lambda x: F.when(F.size(x) > 0, F.sequence(F.lit(0), F.size(x) - 1)).otherwise(F.array().cast("array<int>")))
        dealt = dealt.select(*base.columns, F.array(own).alias("own"), blocks.alias("blocks"))
    later = F.transform(F.filter(F.sequence(F.lit(0), F.lit(3)), lambda x: x > F.col("o")), lambda x: F.transform("own", lambda b: F.struct((F.col("o") * 4 + x).alias("low"), b.alias("high"), F.lit(0).alias("part"))))
    earlier = F.transform(F.filter(F.sequence(F.lit(0), F.lit(3)), lambda x: x < F.col("o")), lambda x: F.transform(F.get("blocks", x), lambda b: F.struct((x * 4 + F.col("o")).alias("low"), b.alias("high"), F.lit(1).alias("part"))))
    sent = dealt.select("series_id", F.explode(F.flatten(F.concat(later, earlier))).alias("to"), "id", "meeting_id", "o", "terms").select("series_id", "to.*", "id", "meeting_id", "o", "terms")
    by = ["series_id", "low", "high"]
    ordered = sent.repartition(shuffle_width(base.sparkSession), *by).sortWithinPartitions(*by, "part", "id")
    return ordered.mapInArrow(lambda batches: (out for group in _groups(batches) for out in found(group)), schema)


def _by_blocks(items: DataFrame, found: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """found over the items of every pair of blocks of a series; a series of up to BLOCK items is one block.

    An item of a series of n is sent n / BLOCK times, so the shuffle grows with the items of large series times their
    blocks, never with the pairs; a task holds two blocks.
    """
    base = items.where((F.size("terms") > 0) & F.col("series_id").isNotNull() & F.col("id").isNotNull()).withColumn("o", meeting_order(F.col("meeting_id"))).where("o is not null")
    large = base.groupBy("series_id").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts")).where("parts > 1")
    dealt = base.join(F.broadcast(large), "series_id", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))  # at most one row to BLOCK items
    dealt = dealt.withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    sent = dealt.select("series_id", F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high"), "part", "id", "meeting_id", F.col("o").cast("int").alias("o"), "terms")
    by = ["series_id", "low", "high"]
    ordered = sent.repartition(shuffle_width(items.sparkSession), *by).sortWithinPartitions(*by)
    return ordered.mapInArrow(lambda batches: (out for group in _groups(batches) for out in found(group)), schema)


def scored_candidates(items: DataFrame, threshold: float = THRESHOLD, least_shared: int = LEAST_SHARED) -> DataFrame:
    """(series_id, earlier, later, ..., shared, score) with score >= threshold and shared >= least_shared (1 or more).

    Common terms are counted as products of 0/1 matrices, block by block of a series, and only pairs that meet both
    conditions leave a task. Equal to scoring all pairs, as a test shows; an empty set is in no pair.
    """
    least_shared = max(least_shared, 1)
    kind = {c: items.schema[c].dataType.simpleString() for c in ("series_id", "id", "meeting_id")}

    def found(group: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        size = pc.list_value_length(group.column("terms")).to_numpy(zero_copy_only=False).astype(np.int32)
        for rows, columns, shared, kept in _accepted(group, threshold, least_shared):
            at, other = np.nonzero(kept)
            a, b = rows[at], columns[other]
            pick = lambda c, x: group.column(c).take(pa.array(x))
            numbers = [pa.array(x.astype(np.int32)) for x in (shared[kept], size[a], size[b])]
            yield pa.RecordBatch.from_arrays([pick("series_id", a), pick("id", a), pick("id", b), pick("meeting_id", a), pick("meeting_id", b), *numbers], names=["series_id", "earlier", "later", "earlier_meeting", "later_meeting", "shared", "na", "nb"])

    schema = f"series_id {kind['series_id']}, earlier {kind['id']}, later {kind['id']}, earlier_meeting {kind['meeting_id']}, later_meeting {kind['meeting_id']}, shared int, na int, nb int"
    return _by_blocks(items, found, schema).withColumn("score", F.col("shared") / F.least("na", "nb"))


def candidate_counts(items: DataFrame, threshold: float = THRESHOLD, least_shared: int = LEAST_SHARED) -> DataFrame:
    """(series_id, smaller, shared, n, score): scored_candidates counted by the smaller set's size and the common terms.

    The pairs themselves never leave a task.
    """
    least_shared = max(least_shared, 1)
    kind = items.schema["series_id"].dataType.simpleString()

    def found(group: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        size = pc.list_value_length(group.column("terms")).to_numpy(zero_copy_only=False).astype(np.int64)
        width = int(size.max()) + 1
        total = np.zeros(width * width, np.int64)
        for rows, columns, shared, kept in _accepted(group, threshold, least_shared):
            at, other = np.nonzero(kept)
            cell = np.minimum(size[rows][at], size[columns][other]) * width + shared[kept].astype(np.int64)
            total += np.bincount(cell, minlength=width * width)
        cell = np.flatnonzero(total)
        name = group.column("series_id").take(pa.array(np.zeros(len(cell), np.int64)))
        yield pa.RecordBatch.from_arrays([name, pa.array((cell // width).astype(np.int32)), pa.array((cell % width).astype(np.int32)), pa.array(total[cell])], names=["series_id", "smaller", "shared", "n"])

    counted = _by_blocks(items, found, f"series_id {kind}, smaller int, shared int, n long").groupBy("series_id", "smaller", "shared").agg(F.sum("n").alias("n"))
    return counted.withColumn("score", F.col("shared") / F.col("smaller"))


def candidate_members(items: DataFrame, threshold: float = THRESHOLD, least_shared: int = LEAST_SHARED) -> DataFrame:
    """(id, earlier, later) of items that are in a scored candidate, and whether as the earlier or the later one."""
    least_shared = max(least_shared, 1)
    kind = items.schema["id"].dataType.simpleString()

    def found(group: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        sides = np.zeros((2, group.num_rows), bool)
        for rows, columns, _, kept in _accepted(group, threshold, least_shared):
            sides[0, rows] |= kept.any(1)
            sides[1, columns] |= kept.any(0)
        own = np.flatnonzero(sides.any(0))
        yield pa.RecordBatch.from_arrays([group.column("id").take(pa.array(own)), *[pa.array(x[own]) for x in sides]], names=["id", "earlier", "later"])

    return _by_blocks(items, found, f"id {kind}, earlier boolean, later boolean").groupBy("id").agg(F.bool_or("earlier").alias("earlier"), F.bool_or("later").alias("later"))


def numbered(pairs: DataFrame, infix: str = "p") -> DataFrame:
    """Pair ids SERIES.p001 ... by earlier meeting, later meeting, falling score and the two ids."""
    order = W.partitionBy("series_id").orderBy("earlier_meeting", "later_meeting", F.desc("score"), "earlier", "later")
    return pairs.withColumn("pair_id", F.format_string(f"%s.{infix}%03d", "series_id", F.row_number().over(order)))


def pair_number(n: Column, infix: str = "p") -> Column:
    return F.concat("series_id", F.lit(f".{infix}"), F.when(n < 1000, F.lpad(n.cast("string"), 3, "0")).otherwise(n.cast("string")))


def numbered_candidates(items: DataFrame, threshold: float = THRESHOLD, least_shared: int = LEAST_SHARED) -> DataFrame:
    """(pair_id, series_id, earlier, later, shared, score): scored_candidates, numbered like numbered without a window over pairs.

    A series of up to BLOCK items is numbered in its task. For a larger one the pairs of each block of earlier items are
    counted by score first; a pair's number is what comes before its block and score, and its place there. The pairs are
    worked out twice and never shuffled. A task holds a block of earlier items and all later ones of a meeting.
    """
    least_shared = max(least_shared, 1)
    kind = {c: items.schema[c].dataType.simpleString() for c in ("series_id", "id", "meeting_id")}
    base = stored(comparable(items))
    large = F.broadcast(base.groupBy("series_id").count().where(F.col("count") > BLOCK).select("series_id"))

    def ranks(group: pa.RecordBatch, name: str) -> np.ndarray:
        return pc.rank(group.column(name), sort_keys="ascending", tiebreaker="dense").to_numpy(zero_copy_only=False)

    def listed(group: pa.RecordBatch, a: np.ndarray, b: np.ndarray, shared: np.ndarray, score: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        pick = lambda c, x: group.column(c).take(pa.array(x))
        columns = [pick("series_id", a), pick("id", a), pick("id", b), pick("meeting_id", a), pick("meeting_id", b), pa.array(shared.astype(np.int32)), pa.array(score), pa.array(group.column("high")[0].as_py() + np.zeros(len(a), np.int32)), pa.array(n.astype(np.int64))]
        return pa.RecordBatch.from_arrays(columns, names=["series_id", "earlier", "later", "earlier_meeting", "later_meeting", "shared", "score", "block", "n"])

    def tiles(group: pa.RecordBatch) -> Iterator[tuple[np.ndarray, ...]]:
        size = pc.list_value_length(group.column("terms")).to_numpy(zero_copy_only=False).astype(np.int64)
        for rows, columns, shared, kept in _accepted(group, threshold, least_shared):
            at, other = np.nonzero(kept)
            a, b, common = rows[at], columns[other], shared[kept].astype(np.int64)
            yield a, b, common, common / np.minimum(size[a], size[b])

    def whole(group: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        parts = list(tiles(group))
        if parts:
            a, b, shared, score = (np.concatenate(x) for x in zip(*parts))
            meeting, name = ranks(group, "meeting_id"), ranks(group, "id")
            order = np.lexsort((name[b], name[a], -score, meeting[b], meeting[a]))
            for at in range(0, len(order), TILE):
                own = order[at : at + TILE]
                yield listed(group, a[own], b[own], shared[own], score[own], np.arange(at + 1, at + 1 + len(own)))

    def split(group: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, Iterator[tuple[np.ndarray, ...]]]]:
        """By pair of meetings, of which a letter has more than one only in odd tables; all in order of earlier and later id."""
        part, meeting = group.column("part").to_numpy(), group.column("meeting_id").dictionary_encode().indices.to_numpy(zero_copy_only=False)
        same = pa.array(np.zeros(group.num_rows, np.int32))
        for first in np.unique(meeting[part == 0]):
            for second in np.unique(meeting[part == 1]):
                own = group.take(pa.array(np.flatnonzero(((part == 0) & (meeting == first)) | ((part == 1) & (meeting == second)))))
                yield own.set_column(own.schema.get_field_index("part"), "part", same.slice(0, own.num_rows))

    def counted(group: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for own in split(group):
            total: dict[float, int] = {}
            for _, _, _, score in tiles(own):
                for s, n in zip(*(x.tolist() for x in np.unique(score, return_counts=True))):
                    total[s] = total.get(s, 0) + n
            ends = [pa.array([k] * len(total), pa.int64()) for k in (0, own.num_rows - 1)]
            columns = [own.column("series_id").take(ends[0]), own.column("meeting_id").take(ends[0]), own.column("meeting_id").take(ends[1]), own.column("high").take(ends[0]), pa.array(list(total), pa.float64()), pa.array(list(total.values()), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["series_id", "earlier_meeting", "later_meeting", "block", "score", "n"])

    def placed(group: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for own in split(group):
            seen: dict[float, int] = {}
            for a, b, shared, score in tiles(own):
                order = np.argsort(-score, kind="stable")
                values, first, n = np.unique(-score[order], return_index=True, return_counts=True)
                before = np.array([seen.get(v, 0) for v in values.tolist()], np.int64)
                seen |= dict(zip(values.tolist(), (before + n).tolist()))
                place = np.empty(len(order), np.int64)
                place[order] = np.arange(1, len(order) + 1) + np.repeat(before - first, n)
                yield listed(own, a, b, shared, score, place)

    schema = f"series_id {kind['series_id']}, earlier {kind['id']}, later {kind['id']}, earlier_meeting {kind['meeting_id']}, later_meeting {kind['meeting_id']}, shared int, score double, block int, n long"
    of_large = base.join(large, "series_id", "left_semi")
    counts = by_meetings(of_large, counted, f"series_id {kind['series_id']}, earlier_meeting {kind['meeting_id']}, later_meeting {kind['meeting_id']}, block int, score double, n long", BLOCK)
    order = W.partitionBy("series_id").orderBy("earlier_meeting", "later_meeting", F.desc("score"), "block")
    by = ["series_id", "earlier_meeting", "later_meeting", "block", "score"]
    starts = F.broadcast(stored(counts).withColumn("start", F.sum("n").over(order) - F.col("n")).drop("n"))
    pairs = by_meetings(of_large, placed, schema, BLOCK).join(starts, by).withColumn("n", F.col("n") + F.col("start")).drop("start")
    pairs = pairs.unionByName(_by_blocks(base.join(large, "series_id", "left_anti"), whole, schema))
    return pairs.select(pair_number(F.col("n")).alias("pair_id"), "series_id", "earlier", "later", "shared", "score")


def rejected_population(items: DataFrame, candidates: DataFrame) -> DataFrame:
    """(series_id, universe, candidates, rejected): the complement's size by arithmetic from candidate_counts."""
    kept = candidates.groupBy("series_id").agg(F.sum("n").alias("candidates"))
    both = universe_size(items).join(kept, "series_id", "left").na.fill(0, ["candidates"])
    return both.withColumn("rejected", F.col("universe") - F.col("candidates"))
