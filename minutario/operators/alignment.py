"""One-to-one alignment of predicted and reference items, and its scores."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from heapq import heappop, heappush

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from minutario.operators import pairs as P
from minutario.session import stored

#: Cost of a forbidden pair: the number of allowed pairs is maximised first, their similarity second.
FORBIDDEN = 1e6
#: Pairs that are kept of a row at first, and at most.
NEAREST, MOST_NEAREST = 64, 256


def assign(cost: np.ndarray) -> list[tuple[int, int]]:
    """Least-cost assignment of every row of the shorter side, by shortest augmenting paths over dual prices."""
    if cost.size == 0:
        return []
    flipped = cost.shape[0] > cost.shape[1]
    c = cost.T if flipped else cost
    n, m = c.shape
    row_price, column_price = np.zeros(n), np.zeros(m)
    row_of = np.full(m, -1)
    for row in range(n):
        dist = np.full(m, np.inf)
        parent = np.full(m, -1)
        done = np.zeros(m, bool)
        at, column, low = row, -1, 0.0
        while True:
            reach = low + c[at] - row_price[at] - column_price
            better = ~done & (reach < dist)
            dist[better] = reach[better]
            parent[better] = column
            column = int(np.where(done, np.inf, dist).argmin())
            low = dist[column]
            done[column] = True
            if row_of[column] < 0:
                break
            at = int(row_of[column])
        inner = done.copy()
        inner[column] = False
        row_price[row_of[inner]] += low - dist[inner]
        column_price[inner] -= low - dist[inner]
        row_price[row] += low
        while column >= 0:
            before = int(parent[column])
            row_of[column] = row_of[before] if before >= 0 else row
            column = before
    pairs = [(int(r), j) for j, r in enumerate(row_of) if r >= 0]
    return sorted((j, i) if flipped else (i, j) for i, j in pairs)


def _components(allowed: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(rows, columns) of the connected parts of the allowed pairs; rows and columns without one are left out."""
    n, m = allowed.shape
    label = np.where(allowed.any(1), np.arange(n), n)
    while True:
        column = np.where(allowed, label[:, None], n).min(0, initial=n)
        moved = np.minimum(label, np.where(allowed, column[None, :], n).min(1, initial=n))
        if (moved == label).all():
            return [(np.flatnonzero(label == k), np.flatnonzero(column == k)) for k in np.unique(label[label < n])]
        label = moved


def aligned(similarity: np.ndarray, tau: float) -> list[tuple[int, int, float]]:
    """Matches with a similarity of at least tau: as many as possible, then as similar as possible.

    Connected parts of the allowed pairs are independent of each other and solved one by one.
    """
    allowed = np.isfinite(similarity) & (similarity >= tau)
    out = []
    for rows, columns in _components(allowed):
        part = np.ix_(rows, columns)
        cost = np.where(allowed[part], -np.where(allowed[part], similarity[part], 0), FORBIDDEN)
        out += [(int(rows[i]), int(columns[j]), float(similarity[rows[i], columns[j]])) for i, j in assign(cost) if allowed[rows[i], columns[j]]]
    return sorted(out)


class _Overlaps:
    """Scores of one row of sets against all columns, from the columns' inverted lists; nothing of rows x columns is kept."""

    def __init__(self, rows: tuple[np.ndarray, np.ndarray], columns: tuple[np.ndarray, np.ndarray], least: float, least_shared: int):
        (self.codes, self.ends), (codes, ends) = rows, columns
        self.size = np.diff(ends, prepend=0)
        order = np.argsort(codes, kind="stable")
        self.lists = np.repeat(np.arange(len(ends)), self.size)[order]
        self.starts = np.searchsorted(codes[order], np.arange(max(self.codes.max(initial=-1), codes.max(initial=-1)) + 2))
        self.least, self.least_shared = least, least_shared

    def __call__(self, row: int) -> tuple[np.ndarray, np.ndarray]:
        """(columns, scores) of a row's admissible pairs."""
        own = self.codes[self.ends[row - 1] if row else 0 : self.ends[row]]
        if not len(own):
            return np.zeros(0, np.int64), np.zeros(0)
        shared = np.bincount(np.concatenate([self.lists[self.starts[t] : self.starts[t + 1]] for t in own]), minlength=len(self.size))
        at = np.flatnonzero(shared >= max(self.least_shared, np.ceil(self.least * min(len(own), self.size.min(initial=0)) - 1e-9)))
        score = shared[at] / np.minimum(self.size[at], len(own))
        kept = score >= self.least
        return at[kept], score[kept]


def sparse_aligned(edges: Callable[[int], tuple[np.ndarray, np.ndarray]], n: int, m: int, tau: float, kept: dict | None = None) -> list[tuple[int, int, float]]:
    """aligned for n rows and m columns whose pairs (columns, scores) are worked out row by row when they are asked for.

    Shortest augmenting paths over dual prices, as in assign. Of a row only the best NEAREST pairs are kept (in kept, for
    further thresholds); the rest has a bound by its least score and is worked out again when a path may need it. A row
    may stay alone at a cost of FORBIDDEN, which makes the number of matches come first.
    """
    kept = {} if kept is None else kept
    row_price, column_price = np.zeros(n), np.zeros(m)
    row_of, column_of = np.full(m, -1), np.full(n, -1)
    dist, value = np.full(m, np.inf), np.zeros(n)
    parent = np.full(m, -1)

    def near(row: int, most: int) -> tuple[np.ndarray, np.ndarray, float]:
        columns, scores = edges(row)
        bound = -np.inf
        if len(columns) > most:
            # among equals the ones behind the row's own place, so that rows don't all ask for the same columns
            best = np.argpartition(-scores + ((columns - row * 7919) % m) * (1e-6 / m), most)
            columns, scores, bound = columns[best[:most]], scores[best[:most]], float(scores[best[most:]].max())
        kept[row] = columns.astype(np.int32), scores, bound
        return kept[row]

    for start in range(n):
        best, end = np.inf, None
        heap: list[tuple[float, int, int]] = [(0.0, 0, start)]
        done, touched = [], []

        def relax(row: int, low: float, columns: np.ndarray, scores: np.ndarray, best: float, end):
            reach = low - scores - row_price[row] - column_price[columns]
            closer = np.flatnonzero((reach < best) & (reach < dist[columns]) & (scores >= tau))
            if len(closer):
                columns, reach = columns[closer], reach[closer]
                free = row_of[columns] < 0
                if free.any():
                    k = int(np.where(free, reach, np.inf).argmin())
                    best, end = float(reach[k]), int(columns[k])
                    parent[end] = row
                    inner = ~free & (reach < best)
                    columns, reach = columns[inner], reach[inner]
                dist[columns] = reach
                parent[columns] = row
                touched.append(columns)
                for d, c in zip(reach.tolist(), columns.tolist()):
                    heappush(heap, (d, 1, c))
            return best, end

        while heap:
            low, kind, at = heappop(heap)
            if low >= best:
                break
            if kind == 2:
                nearest, _, bound = kept[at]
                most = 4 * len(nearest)
                columns, scores = edges(at)
                if most <= MOST_NEAREST:
                    near(at, most)
                best, end = relax(at, low + bound + row_price[at], columns, scores, best, end)
                continue
            if kind == 1:
                if low > dist[at]:
                    continue
                done.append((at, low))
                dist[at] = -np.inf  # closed: rounding can't reach it again
                row = int(row_of[at])
            else:
                row = at
            if low + FORBIDDEN - row_price[row] < best:
                best, end = low + FORBIDDEN - row_price[row], (row,)
            columns, scores, bound = kept.get(row) or near(row, NEAREST)
            best, end = relax(row, low, columns, scores, best, end)
            if bound >= tau and low - bound - row_price[row] < best:
                heappush(heap, (low - bound - row_price[row], 2, row))
        if done:
            inner = np.array([c for c, _ in done])
            step = best - np.array([d for _, d in done])
            row_price[row_of[inner]] += step
            column_price[inner] -= step
        row_price[start] += best
        for columns in touched:
            dist[columns] = np.inf
        if isinstance(end, tuple):
            column, column_of[end[0]] = column_of[end[0]], -1
            if end[0] == start:
                continue
        else:
            column = end
        while True:
            row = int(parent[column])
            row_of[column], before = row, column_of[row]
            column_of[row] = column
            if row == start:
                break
            column = before
    for row in np.flatnonzero(column_of >= 0).tolist():
        columns, scores, _ = kept[row]
        if not (columns == column_of[row]).any():
            columns, scores = edges(row)
        value[row] = scores[columns == column_of[row]][0]
    return [(i, int(column_of[i]), float(value[i])) for i in np.flatnonzero(column_of >= 0).tolist()]


def align_groups(pairs: DataFrame, by: str, predicted: str, reference: str, similarity: str, taus: Sequence[float]) -> DataFrame:
    """(by, tau, predicted, reference, similarity): matches within every group, from long rows of admissible pairs.

    Pairs below the least tau are dropped before the shuffle; a pair that isn't given, or has a null similarity, can't
    match. A group is a meeting's or series' items, the unit of the matching; it is solved in one task.
    """
    kind = {c: pairs.schema[c].dataType.simpleString() for c in (by, predicted, reference)}
    given = pairs.where(F.col(similarity) >= min(taus)).groupBy(by, predicted, reference).agg(F.max(similarity).alias("similarity"))

    def solve(frame: pd.DataFrame) -> pd.DataFrame:
        p, r = sorted(frame[predicted].unique()), sorted(frame[reference].unique())
        matrix = np.full((len(p), len(r)), -np.inf)
        matrix[np.searchsorted(p, frame[predicted]), np.searchsorted(r, frame[reference])] = frame["similarity"]
        rows = [(frame[by].iloc[0], tau, p[i], r[j], s) for tau in taus for i, j, s in aligned(matrix, tau)]
        return pd.DataFrame(rows, columns=[by, "tau", predicted, reference, "similarity"])

    return given.groupBy(by).applyInPandas(solve, f"`{by}` {kind[by]}, tau double, `{predicted}` {kind[predicted]}, `{reference}` {kind[reference]}, similarity double")


def align_candidates(items: DataFrame, taus: Sequence[float], least_shared: int = P.LEAST_SHARED) -> DataFrame:
    """(meetings, tau, predicted, reference, similarity): align_groups over the scored pairs of items, by pair of meetings.

    Items (id, series_id, meeting_id, terms) are sent to the task of each pair of meetings, where pairs are worked out
    row by row as the matching asks for them; the pairs are neither shuffled nor held.
    """
    kind = items.schema["id"].dataType.simpleString()

    def found(group: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        part, meeting = group.column("part").to_numpy(), group.column("meeting_id").to_numpy(zero_copy_only=False)
        size = pc.list_value_length(group.column("terms")).to_numpy(zero_copy_only=False).astype(np.int64)
        code, item = group.column("terms").flatten().dictionary_encode().indices.to_numpy(zero_copy_only=False), np.repeat(np.arange(len(size)), size)

        def entries(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            return code[np.isin(item, rows)], np.cumsum(size[rows])

        for first in sorted(set(meeting[part == 0])):
            for second in sorted(set(meeting[part == 1])):
                a, b = np.flatnonzero((part == 0) & (meeting == first)), np.flatnonzero((part == 1) & (meeting == second))
                flipped = len(a) > len(b)
                rows, columns = (b, a) if flipped else (a, b)
                kept: dict = {}
                edges = _Overlaps(entries(rows), entries(columns), min(taus), least_shared)
                for tau in taus:
                    matches = sparse_aligned(edges, len(rows), len(columns), tau, kept)
                    i, j = rows[[x[0] for x in matches]] if matches else rows[:0], columns[[x[1] for x in matches]] if matches else columns[:0]
                    p, r = (j, i) if flipped else (i, j)
                    pick = lambda x: group.column("id").take(pa.array(x))
                    yield pa.RecordBatch.from_arrays([pa.array([f"{first}-{second}"] * len(p), pa.string()), pa.array([float(tau)] * len(p), pa.float64()), pick(p), pick(r), pa.array([x[2] for x in matches], pa.float64())], names=["meetings", "tau", "predicted", "reference", "similarity"])

    return P.by_meetings(stored(P.comparable(items)), found, f"meetings string, tau double, predicted {kind}, reference {kind}, similarity double")
