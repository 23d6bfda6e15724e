"""Evaluation texts leaking into training text (problem 8): size-partitioned MinHash containment search, verified exactly."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from minutario.session import cut

WORDS, CONTAINMENT = 5, 0.3
#: One-permutation MinHash: registers of a window and of an item.
REGISTERS = 256
#: Documents are cut into windows of a few sizes: the least that holds the item's sequences twice. A window overlaps
#: the next one by half, so every stretch as long as an item lies within one.
WINDOW_SIZES = (128, 256, 512, 1024)
#: Items of up to so many sequences are looked up by all of them: registers of so few would leave the search to chance.
SHORT = 32
#: Share of an item's registers that must agree with windows of its class, against the containment asked for. A shared
#: sequence that is the least of the item's register is that of the window's with a chance of a half or more.
LEAST_ESTIMATE = 0.25
#: Bits of the filter over all items' sequences that is sent to the tasks: 8 MB, whatever the number of items.
FILTER_BITS = 1 << 26


_WORD = re.compile(r"[^\W_]+")


#: Word hashes that a task keeps at once.
KEPT_WORDS = 500_000


class WordHashes(dict):
    """Hashes of words, worked out once each; emptied when it has grown to KEPT_WORDS."""

    def __missing__(self, word: str) -> int:
        if len(self) >= KEPT_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


def word_sequences(text: str | None, hashes: WordHashes | None = None, n: int = WORDS) -> np.ndarray:
    """64-bit hashes of all sequences of n consecutive words in order; fewer than n words give none."""
    words = _WORD.findall((text or "").lower())
    if len(words) < n:
        return np.zeros(0, np.uint64)
    known = WordHashes() if hashes is None else hashes
    at = np.fromiter((known[w] for w in words), np.uint64, len(words))
    total = np.zeros(len(words) - n + 1, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(n):
            total = (total ^ at[k : len(words) - n + 1 + k]) * np.uint64(0x9E3779B97F4A7C15)
            total ^= total >> np.uint64(29)
    return total


def registers(hashes: np.ndarray) -> np.ndarray:
    """One-permutation MinHash: the least hash of each register, all ones where none falls into it."""
    out = np.full(REGISTERS, np.uint64(0xFFFFFFFFFFFFFFFF))
    np.minimum.at(out, (hashes & np.uint64(REGISTERS - 1)).astype(np.int64), hashes)
    return out


def item_rows(passage: str | None) -> list[tuple]:
    """(hash, class, sketched, kept, n) for each distinct sequence of an item.

    class is the place of its window size, one past the last for items looked up by every sequence; kept the number of
    sequences in the sketch, n that of all.
    """
    sequences = np.unique(word_sequences(passage))
    n = len(sequences)
    if n <= SHORT:
        return [(int(h), len(WINDOW_SIZES), True, n, n) for h in sequences.view(np.int64)]
    place = next((k for k, w in enumerate(WINDOW_SIZES) if w >= 2 * n), len(WINDOW_SIZES) - 1)
    sketched = np.isin(sequences, registers(sequences))
    kept = int(sketched.sum())
    return [(int(h), place, bool(s), kept, n) for h, s in zip(sequences.view(np.int64), sketched)]


def _window_registers(hashes: np.ndarray, size: int) -> np.ndarray:
    """The distinct register values of all windows: least hashes by (half window, register), halves joined in pairs."""
    half = size // 2
    part = np.arange(len(hashes)) // half
    n = int(part[-1]) + 1
    table = np.full((n, REGISTERS), np.uint64(0xFFFFFFFFFFFFFFFF))
    np.minimum.at(table, (part, (hashes & np.uint64(REGISTERS - 1)).astype(np.int64)), hashes)
    joined = np.minimum(table[:-1], table[1:]) if n > 1 else table
    return np.unique(joined)


def text_hits(text: str | None, bits: np.ndarray, used: list[int], words: WordHashes | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, classes): the text's distinct sequences that pass the filter of the items' sequences.

    Bit k of classes says that the sequence is the least of its register in some window of class k; the bit past the
    last is always set. used: the classes that items are of. A sketch never agrees in a single sequence only.
    """
    hashes = word_sequences(text, words)
    at = hashes & np.uint64(FILTER_BITS - 1)
    hit = (bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
    if not hit.any():
        return np.zeros(0, np.uint64), np.zeros(0, np.int32)
    own = np.unique(hashes[hit])
    classes = np.full(len(own), 1 << len(WINDOW_SIZES), np.int32)
    for k in used if len(own) > 1 else ():
        classes |= np.isin(own, _window_registers(hashes, WINDOW_SIZES[k])).astype(np.int32) << k
    return own, classes


def _filter_bits(rows: DataFrame) -> np.ndarray:
    """The filter as bytes: one bit for each hash, set by sums in the JVM. At most FILTER_BITS / 64 rows come to the driver."""
    at = F.col("hash").bitwiseAND(FILTER_BITS - 1)
    words = rows.groupBy(F.shiftright(at, 6).alias("word")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast((hash & {FILTER_BITS - 1}) % 64 as int))")).alias("bits"))
    out = np.zeros(FILTER_BITS // 64, np.int64)
    known = words.toPandas()
    out[known["word"].to_numpy(np.int64)] = known["bits"].to_numpy(np.int64)
    return out.view(np.uint8)


def leaked_items(documents: DataFrame, items: DataFrame, doc: str = "doc_id", text: str = "text", item: str = "item_id", passage: str = "passage", least: float = CONTAINMENT) -> DataFrame:
    """(doc, item, containment): documents that hold at least `least` of an item's distinct sequences of five words.

    Words are runs of letters and digits in lower case. Null or short passages and texts match nothing; repeated rows
    come out once; a key that comes with several texts counts for all of them; empty tables give no rows.

    Items are tables of their sequences, with those marked that a MinHash sketch keeps. The texts are read once,
    whatever the number of items: a filter of fixed size passes the sequences that some item may have, each with the
    classes of windows whose sketch keeps it. Joined by sequence, an item is a candidate for a document if enough
    registers of its size class agree, and is verified on the exact number of shared sequences. Items of up to SHORT
    sequences are candidates by any of them.
    """
    kind = documents.schema[doc].dataType.simpleString()
    item_kind = items.schema[item].dataType.simpleString()
    source = documents.select(F.col(doc).alias("d"), F.col(text).alias("t")).where(F.col(text).isNotNull())

    passages = items.select(F.col(item).alias("i"), F.col(passage).alias("p")).where(F.col(passage).isNotNull()).distinct()
    flat = passages.select("i", F.xxhash64("p").alias("part"), "p")  # an item that comes with several passages keeps them apart

    def sketched(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(i, part, *r) for i, part, p in zip(batch["i"], batch["part"], batch["p"]) for r in item_rows(p)]
            yield pd.DataFrame(rows, columns=["i", "part", "hash", "class", "sketched", "kept", "n"])

    table = cut(flat.mapInPandas(sketched, f"i {item_kind}, part long, hash long, class int, sketched boolean, kept int, n int"))
    bits = documents.sparkSession.sparkContext.broadcast(_filter_bits(table))
    used = sorted(r[0] for r in table.where(F.col("class") < len(WINDOW_SIZES)).select("class").distinct().collect())  # at most as many as sizes

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = WordHashes()
        for batch in batches:
            keys, hashes, classes = [], [], []
            for d, t in zip(batch["d"], batch["t"]):
                own, seen = text_hits(t, bits.value, used, words)
                keys += [d] * len(own)
                hashes.append(own.view(np.int64))
                classes.append(seen)
            if keys:
                yield pd.DataFrame({"d": pd.Series(keys), "hash": np.concatenate(hashes), "classes": np.concatenate(classes)})

    hits = source.mapInPandas(scan, f"d {kind}, hash long, classes int")
    hits = hits.groupBy("d", "hash").agg(F.bit_or("classes").alias("classes"))
    agrees = F.col("sketched") & (F.expr("shiftright(classes, class) & 1") == 1)
    both = hits.join(table, "hash").groupBy("d", "i", "part").agg(F.count("*").alias("shared"), F.count_if(agrees).alias("agree"), F.first("kept").alias("kept"), F.first("n").alias("n"))
    found = both.where((F.col("agree") >= LEAST_ESTIMATE * least * F.col("kept")) & (F.col("agree") > 0) & (F.col("shared") >= least * F.col("n") - 1e-9))
    return found.groupBy(F.col("d").alias(doc), F.col("i").alias(item)).agg(F.max(F.col("shared") / F.col("n")).alias("containment"))
