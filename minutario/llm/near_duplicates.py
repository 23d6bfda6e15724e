"""Near-duplicate records with small edits (problem 1): weighted HyperMinHash sketches, banded, filtered by bitmaps, verified."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from minutario.functions.text import ascii_words
from minutario.llm.buckets import block_pairs_with, bucket_candidates
from minutario.llm.components import connected_components
from minutario.session import cut, stored
from minutario.versions import latest

#: A word in more than this share of the texts counts as common and gets COMMON_WEIGHT in the sketches. At most
#: (mean number of words) / COMMON_SHARE words can be common, whatever the number of texts.
COMMON_SHARE, COMMON_WEIGHT = 0.02, 0.4
#: A hash function deals the words to BUCKETS registers, which make one band; BANDS functions. A pair of weighted
#: similarity s shares a band with a probability of 1 - (1 - s^5)^56.
BUCKETS, BANDS = 5, 56
#: Bands that are shuffled at once, so the disk holds an eighth of all band rows; up to SMALL_ROWS go in one pass.
BANDS_AT_ONCE, SMALL_ROWS = 7, 4_000_000
#: Bits of the bitmap of words that travels with a band key; the last 16 bits of its three longs are the set's size.
BITMAP = 176
MANTISSA_BITS = 10
#: Members of a part of a large group whose pairs are written out.
PAIR_PART = 1000

_M64 = 0xFFFFFFFFFFFFFFFF


def _mixed(values: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit hash function for each seed, by multiply and shift."""
    with np.errstate(over="ignore"):
        x = values ^ np.uint64((0x9E3779B97F4A7C15 * (2 * seed + 1)) & _M64)
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
        return x ^ (x >> np.uint64(33))


def sketch(codes: np.ndarray, vocabulary: np.ndarray, common: np.ndarray, starts: np.ndarray, seeds: range) -> np.ndarray:
    """Registers (len(seeds) * BUCKETS, sets) as uint16.

    codes: the words of all sets, one after the other, as places in vocabulary; starts: where each set begins (no set
    is empty). A register holds the leading zeros of the bucket's least value and the MANTISSA_BITS bits after them;
    0 stands for an empty bucket. A common word's value u becomes 1 - (1 - u)^(1 / COMMON_WEIGHT), the law of a least
    value drawn at that weight, so two sets agree in a register with their weighted Jaccard similarity.
    """
    out = np.empty((len(seeds) * BUCKETS, len(starts)), np.uint16)
    for at, seed in enumerate(seeds):
        h = _mixed(vocabulary, seed)
        value = ((h >> np.uint64(11)).astype(np.float64) + 0.5) / 2.0**53
        value[common] = -np.expm1(np.log1p(-value[common]) / COMMON_WEIGHT)
        bucket = (h & np.uint64(0x7FF)).astype(np.int64) % BUCKETS
        for b in range(BUCKETS):
            least = np.minimum.reduceat(np.where(bucket == b, value, 2.0)[codes], starts)
            mantissa, exponent = np.frexp(least)
            zeros = np.minimum(-exponent, 62).astype(np.uint16)
            bits = np.minimum((mantissa - 0.5) * 2.0 ** (MANTISSA_BITS + 1), 2**MANTISSA_BITS - 1).astype(np.uint16)
            out[at * BUCKETS + b] = np.where(least > 1, 0, ((zeros + np.uint16(1)) << np.uint16(MANTISSA_BITS)) | bits)
    return out


def _marked_sets(batches: Iterator[pa.RecordBatch], least_words: int) -> Iterator[pa.RecordBatch]:
    """(key, hashes) of sets with enough words, with two sums of hash functions that are equal for equal sets only."""
    with np.errstate(over="ignore"):
        for batch in batches:
            batch = batch.filter(pc.fill_null(pc.greater_equal(pc.list_value_length(batch.column("words")), max(least_words, 1)), False))
            if not batch.num_rows:
                continue
            words = batch.column("words")
            flat, offsets = words.flatten().to_numpy(zero_copy_only=False).view(np.uint64), words.offsets.to_numpy()
            marks = [np.add.reduceat(_mixed(flat, seed), (offsets[:-1] - offsets[0]).astype(np.int64)).view(np.int64) for seed in (101, 102)]
            yield pa.RecordBatch.from_arrays([batch.column("key"), *map(pa.array, marks), words], names=["key", "m0", "m1", "words"])


def _band_rows(batches: Iterator[pa.RecordBatch], common_hashes: np.ndarray, bands: range) -> Iterator[pa.RecordBatch]:
    """(id, hashes) -> one row for each band: key, id and the bitmap with the size, up to 65535, as three longs."""
    with np.errstate(over="ignore"):
        for batch in batches:
            ids = batch.column("id").to_numpy(zero_copy_only=False)
            words = batch.column("words")
            if not len(ids):
                continue
            flat = words.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            offsets = words.offsets.to_numpy()
            vocabulary, codes = np.unique(flat, return_inverse=True)
            starts = (offsets[:-1] - offsets[0]).astype(np.int64)
            common = np.isin(vocabulary, common_hashes)
            place = (_mixed(vocabulary, 103) % np.uint64(BITMAP))[codes]
            bit = np.uint64(1) << (place & np.uint64(63))
            signature = np.stack([np.bitwise_or.reduceat(np.where(place >> np.uint64(6) == k, bit, np.uint64(0)), starts) for k in range(3)], 1)
            signature[:, 2] |= np.minimum(np.diff(offsets), 65535).astype(np.uint64) << np.uint64(48)
            signature = signature.view(np.int64)
            for band in bands:
                regs = sketch(codes, vocabulary, common, starts, range(band, band + 1))
                key = np.full(len(ids), np.uint64(band + 1))
                for r in regs:
                    key = _mixed(key * np.uint64(0x100000001B3) + r.astype(np.uint64), 0)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key.view(np.int64)), pa.array(ids), *[pa.array(np.ascontiguousarray(signature[:, k])) for k in range(3)]],
                    names=["key", "id", *[f"s{k}" for k in range(3)]],
                )


def _close(rows: dict[str, np.ndarray], i: np.ndarray, j: np.ndarray, threshold: float) -> np.ndarray:
    """Pairs whose sizes and bitmaps allow the threshold; none that reaches it is lost.

    Sets of n and m words with a similarity of t differ in (n + m) * (1 - t) / (1 + t) words; bitmaps differ in as many
    bits at most.
    """
    bits = [rows[f"s{k}"].view(np.uint64) for k in range(3)]
    size = (bits[2] >> np.uint64(48)).astype(np.float64)
    near = np.flatnonzero(np.minimum(size[i], size[j]) >= threshold * np.maximum(size[i], size[j]))
    x, y = i[near], j[near]
    differing = sum(np.bitwise_count(b[x] ^ b[y]).astype(np.int64) for b in bits[:2]) + np.bitwise_count((bits[2][x] ^ bits[2][y]) & np.uint64(0xFFFFFFFFFFFF))
    both = size[x] + size[y]
    out = np.zeros(len(i), bool)
    out[near[(differing <= both * (1 - threshold) / (1 + threshold) + 1e-9) | (np.maximum(size[x], size[y]) >= 65535)]] = True
    return out


def _close_columns(left: str, right: str, threshold: float) -> Column:
    """The same test on columns."""
    x = [F.col(f"{left}.s{k}").bitwiseXOR(F.col(f"{right}.s{k}")) for k in range(3)]
    differing = F.bit_count(x[0]) + F.bit_count(x[1]) + F.bit_count(x[2].bitwiseAND(F.lit(0xFFFFFFFFFFFF)))
    sizes = [F.shiftrightunsigned(F.col(f"{side}.s2"), 48) for side in (left, right)]
    may = (differing <= (sizes[0] + sizes[1]) * ((1 - threshold) / (1 + threshold)) + 1e-9) | (F.greatest(*sizes) >= 65535)
    return (F.least(*sizes) >= threshold * F.greatest(*sizes)) & may


def _linked(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Pairs whose exact Jaccard similarity reaches the threshold."""
    a = sets.select(F.col("id").alias("a"), F.col("words").alias("wa"))
    b = sets.select(F.col("id").alias("b"), F.col("words").alias("wb"))
    both = pairs.select("a", "b").distinct().join(a, "a").join(b, "b")
    shared = F.size(F.array_intersect("wa", "wb"))
    return both.select("a", "b", shared.alias("n"), (F.size("wa") + F.size("wb")).alias("m")).where(F.col("n") / (F.col("m") - F.col("n")) >= threshold).select("a", "b")


def near_duplicate_groups(records: DataFrame, key: str, words: str, threshold: float = 0.7, least_words: int = 8) -> DataFrame:
    """(key, class_id, group_id) for each record with at least least_words distinct words.

    Records with one word set form a class. Classes are linked when their Jaccard similarity is at least threshold; a
    group holds all classes linked directly or through others, a class without links is its own group. Null word
    arrays and small sets don't take part; repeated keys with one set count once; no records give no rows.

    class_id and group_id are the least keys of the class and the group, so they don't depend on the partitioning.

    Sketches of BUCKETS * BANDS registers are banded; inside a bucket the sizes and a bitmap of the words leave out
    pairs that can't reach the threshold, the rest is verified exactly. Bands are shuffled BANDS_AT_ONCE at a time. A pair shares some band with a probability of 94 % at a
    weighted similarity of 0.55 (the lowest thousandth of the links in the test data), 99.3 % at 0.61 (the lowest
    hundredth) and 99.98 % at 0.68. Buckets above a block's size first give links to their first row and their
    neighbours; only rows outside such a bucket's largest component are then compared with all of its blocks, so a
    group of near copies with a third of all rows costs time in proportion to its size.
    """
    # Python takes the words, so they are worked out once: a filter on them would evaluate their expression again.
    hashed = records.select(F.col(key).alias("key"), F.transform(words, lambda x: F.xxhash64(x)).alias("words"))
    kind = records.schema[key].dataType.simpleString()
    marked = stored(hashed.mapInArrow(lambda batches: _marked_sets(batches, least_words), f"key {kind}, m0 bigint, m1 bigint, words array<bigint>"))
    classes = marked.groupBy("m0", "m1").agg(F.first("words").alias("words"), F.min("key").alias("least"))
    classes = stored(classes.select(F.monotonically_increasing_id().alias("id"), "m0", "m1", "least", "words"))

    total = classes.count()
    counts = classes.select(F.explode("words").alias("word")).groupBy("word").count()
    common = np.array([r[0] for r in counts.where(F.col("count") > COMMON_SHARE * total).select("word").collect()], np.int64).view(np.uint64)

    def banded(rows: DataFrame, bands: range) -> DataFrame:
        return rows.mapInArrow(lambda batches: _band_rows(batches, common, bands), "key bigint, id bigint, " + ", ".join(f"s{k} bigint" for k in range(3)))

    sets = classes.select("id", "words")
    step = BANDS if total * BANDS <= SMALL_ROWS else BANDS_AT_ONCE
    passes = []
    for first in range(0, BANDS, step):
        bands = range(first, min(first + step, BANDS))
        passes.append(stored(bucket_candidates(banded(sets, bands), lambda rows, i, j: _close(rows, i, j, threshold), near=8).distinct()))
        found = reduce(DataFrame.unionByName, passes)
    links = stored(_linked(found.where("b is not null"), sets, threshold))
    tree = connected_components(links, "a", "b")
    hot = found.where("key is not null")
    if not hot.isEmpty():
        tree = cut(tree)
        links = links.unionByName(_links_between_components(hot, banded, tree, sets, threshold))
        tree = connected_components(links, "a", "b")
    grouped = classes.select("id", "m0", "m1", "least").join(tree.withColumnRenamed("node", "id"), "id", "left").withColumn("root", F.coalesce("root", "id"))
    least = grouped.groupBy("root").agg(F.min("least").alias("group_id"))
    return marked.select("key", "m0", "m1").join(grouped.join(least, "root"), ["m0", "m1"]).select(F.col("key").alias(key), F.col("least").alias("class_id"), "group_id").distinct()


def _links_between_components(hot: DataFrame, banded, tree: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Links inside large buckets between rows that no link has joined yet: those outside the largest component with all."""
    members = hot.select(F.col("a").alias("id"), "key", "block").join(tree.withColumnRenamed("node", "id"), "id", "left")
    members = members.withColumn("root", F.coalesce("root", "id"))
    sizes = members.groupBy("key", "root").agg(F.count("*").alias("n"))
    largest = sizes.groupBy("key").agg(F.max(F.struct("n", "root")).alias("m"), F.count("*").alias("components")).where("components > 1").select("key", F.col("m.root").alias("main"))
    members = stored(members.join(largest, "key"))
    signed = members.join(banded(sets.join(members.select("id").distinct(), "id", "left_semi"), range(1)).drop("key"), "id")
    pairs = block_pairs_with(signed.where("root <> main"), signed, lambda l, r: (F.col(f"{l}.root") != F.col(f"{r}.root")) & _close_columns(l, r, threshold))
    return stored(_linked(stored(pairs.distinct()), sets, threshold))


def decision_word_sets(decisions: DataFrame) -> DataFrame:
    """(decision_id, words) of the row that holds per decision; null texts count as empty."""
    held = latest(decisions.select("decision_id", "sentence_text", "decision_content", "ingested_at"), "decision_id", ["decision_id", "sentence_text", "decision_content"])
    text = F.concat_ws(" ", F.coalesce("sentence_text", F.lit("")), F.coalesce("decision_content", F.lit("")))
    return held.select("decision_id", ascii_words(text).alias("words"))


def pairs_in_groups(groups: DataFrame, key: str, group: str) -> DataFrame:
    """Every unordered pair of keys of one group, the smaller key first. Its size is that of the answer asked for.

    Large groups are dealt to parts of about PAIR_PART members, each pair of parts being a join key of its own, so a
    group with a third of all rows is spread over the tasks.
    """
    own = groups.select(F.col(group).alias("g"), F.col(key).alias("id")).distinct()
    parts = own.groupBy("g").agg(F.ceil(F.count("*") / PAIR_PART).cast("int").alias("parts"))
    dealt = own.join(parts.where("g is not null"), "g").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    left = dealt.select("g", F.col("id").alias("l"), F.col("part").alias("low"), F.explode(F.sequence("part", F.col("parts") - 1)).alias("high"))
    right = dealt.select("g", F.col("id").alias("r"), F.col("part").alias("high"), F.explode(F.sequence(F.lit(0), "part")).alias("low"))
    both = left.join(right, ["g", "low", "high"]).where("low < high or l < r")
    return both.select(F.least("l", "r").alias(f"{key}_a"), F.greatest("l", "r").alias(f"{key}_b"))
