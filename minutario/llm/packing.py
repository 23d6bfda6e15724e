"""Filling fixed-capacity containers with texts (problem 7): linear grouping, configurations, best fit for the small."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from minutario.session import cut

CAPACITY = 2048
#: Items above this share of the capacity are large.
LARGE = 1 / 8
#: Groups of equal cardinality that large lengths are rounded up within.
GROUPS = 40
#: Items packed together in one task. A shard of this size loses at most a few containers to its rim.
SHARD = 20_000


def load_encoding(vocabulary: str):
    """The tokenizer of a vocabulary file of ranks. Tasks load it once each."""
    import public_tokenizers
    import tiktoken

    with open(vocabulary, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_pieces(text: str, encoding, capacity: int) -> list[tuple[int, int, int]]:
    """(start, end, tokens) in characters: one piece if the text fits, else pieces of at most capacity tokens each.

    A piece's tokens are those of its own text. Cuts lie between characters and, where one is near, before a blank.
    """
    tokens = encoding.encode_ordinary(text)
    if len(tokens) <= capacity:
        return [(0, len(text), len(tokens))]
    pieces, start = [], 0
    while start < len(text):
        rest = encoding.encode_ordinary(text[start : start + 16 * capacity])
        if len(rest) <= capacity and start + 16 * capacity >= len(text):
            pieces.append((start, len(text), len(rest)))
            break
        size = len(encoding.decode_bytes(rest[:capacity]).decode("utf-8", "ignore"))
        while True:
            end = start + size
            blank = text.rfind(" ", start + size * 9 // 10, end)
            end = blank if blank > start else end
            count = len(encoding.encode_ordinary(text[start:end]))
            if count <= capacity or size <= 1:
                break
            size -= max(1, (count - capacity) * size // count)
        pieces.append((start, end, count))
        start = end
    return pieces


def _best_configuration(sizes: np.ndarray, counts: np.ndarray, capacity: int) -> np.ndarray:
    """How many items of each rounded size go into one container: one of the longest, the rest filled most fully.

    A container with the longest size left is hardest to fill later; the space beside it is a bounded knapsack.
    """
    counts = counts.copy()
    counts[0] -= 1
    capacity -= int(sizes[0])
    reach = np.full(capacity + 1, -1, np.int64)  # the size added last
    reach[0] = len(sizes)
    before = np.zeros(capacity + 1, np.int64)
    for k in range(len(sizes)):
        size = int(sizes[k])
        used = np.zeros(capacity + 1, np.int64)
        for _ in range(min(int(counts[k]), capacity // size)):
            source = np.flatnonzero(reach >= 0)
            source = source[source + size <= capacity]
            fresh = source[(reach[source + size] < 0) & (used[source] < counts[k])]
            if not len(fresh):
                break
            reach[fresh + size] = k
            before[fresh + size] = fresh
            used[fresh + size] = used[fresh] + 1
        if reach[capacity] >= 0:
            break
    at = int(np.flatnonzero(reach >= 0).max())
    chosen = np.zeros(len(sizes), np.int64)
    chosen[0] = 1
    while at:
        chosen[reach[at]] += 1
        at = int(before[at])
    return chosen


def pack(lengths: np.ndarray, capacity: int = CAPACITY) -> np.ndarray:
    """The container number of each length (all between 1 and capacity).

    Linear grouping: large lengths, from long to short, form GROUPS groups of equal cardinality and are rounded up to
    their group's longest. Configurations of the few rounded sizes are chosen one after the other, each the fullest
    around the longest size left, and used as often as the remaining counts allow. The actual items take the places of their group,
    and the small items go, from long to short, where they leave the least space.
    """
    container = np.full(len(lengths), -1, np.int64)
    large = np.flatnonzero(lengths > LARGE * capacity)
    large = large[np.argsort(-lengths[large], kind="stable")]
    groups = [g for g in np.array_split(large, min(GROUPS, len(large)) or 1) if len(g)]
    sizes = np.array([lengths[g[0]] for g in groups], np.int64)
    left = np.array([len(g) for g in groups], np.int64)
    taken = np.zeros(len(groups), np.int64)
    room: list[int] = []
    while left.sum():
        live = np.flatnonzero(left)
        chosen = np.zeros(len(groups), np.int64)
        chosen[live] = _best_configuration(sizes[live], left[live], capacity)
        times = int((left[chosen > 0] // chosen[chosen > 0]).min())
        for k in np.flatnonzero(chosen):
            items = groups[k][taken[k] : taken[k] + times * chosen[k]]
            container[items] = len(room) + np.repeat(np.arange(times), chosen[k])
            taken[k] += times * chosen[k]
        left -= times * chosen
        room.extend([capacity] * times)
    space = np.array(room, np.int64)
    if len(large):
        np.subtract.at(space, container[large], lengths[large])
    by_space: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask = 0
    for c, s in enumerate(space.tolist()):
        by_space[s].append(c)
        mask |= 1 << s
    n = len(room)
    small = np.flatnonzero(lengths <= LARGE * capacity)
    for item in small[np.argsort(-lengths[small], kind="stable")].tolist():
        size = int(lengths[item])
        fitting = mask >> size
        if fitting:
            s = size + (fitting & -fitting).bit_length() - 1
            c = by_space[s].pop()
            if not by_space[s]:
                mask &= ~(1 << s)
        else:
            s, c, n = capacity, n, n + 1
        container[item] = c
        by_space[s - size].append(c)
        mask |= 1 << (s - size)
    return container


def sized_pieces(documents: DataFrame, vocabulary: str, doc: str = "doc_id", text: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """(doc, piece, from_char, to_char, n_tokens): texts in tokens, split only above the capacity; no tokens, no row."""
    kind = documents.schema[doc].dataType.simpleString()

    def sized(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoding = load_encoding(vocabulary)
        for batch in batches:
            rows = [(d, n, a, b, size) for d, t in zip(batch[doc], batch[text]) for n, (a, b, size) in enumerate(token_pieces(t, encoding, capacity)) if size]
            yield pd.DataFrame(rows, columns=[doc, "piece", "from_char", "to_char", "n_tokens"])

    return documents.select(doc, text).where(F.col(text).isNotNull()).mapInPandas(sized, f"`{doc}` {kind}, piece int, from_char int, to_char int, n_tokens int")


def packed_containers(documents: DataFrame, vocabulary: str, doc: str = "doc_id", text: str = "text", capacity: int = CAPACITY, shard: int = SHARD) -> DataFrame:
    """(container_id, doc, piece, from_char, to_char, n_tokens) for every text with a token; no container overflows.

    Null and empty texts need no place and don't come out; equal texts and repeated rows are packed one by one. A hash
    of document and piece deals the pieces, which are counted, to shards of about `shard` items, each packed by one task;
    only lengths are shuffled, texts stay where they are. container_id is shard and number.
    """
    pieces = sized_pieces(documents, vocabulary, doc, text, capacity)
    pieces = cut(pieces)  # the tokenizer runs once; only lengths are written
    shards = max(1, -(-pieces.count() // shard))
    kind = documents.schema[doc].dataType.simpleString()

    def packed(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values([doc, "piece"], kind="stable")
        number = pack(frame["n_tokens"].to_numpy(np.int64), capacity)
        frame.insert(0, "container_id", [f"{s}-{n}" for s, n in zip(frame["shard"], number)])
        return frame.drop(columns="shard")

    dealt = pieces.withColumn("shard", F.pmod(F.xxhash64(doc, "piece"), F.lit(shards)).cast("int"))
    return dealt.groupBy("shard").applyInPandas(packed, f"container_id string, `{doc}` {kind}, piece int, from_char int, to_char int, n_tokens int")
