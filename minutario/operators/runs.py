"""Comparisons of runs: same ids in order, best passage of a source, spans that survive trimming, the swap bar."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words that coverage leaves out.
COVERAGE_STOP_WORDS = "a an and are as at be by for from in is it of on or that the to was were with".split()

#: Fixed value: what stands where windows of a text were left out.
ELISION_MARKER = "\n[... source elided to fit the context window ...]\n"


def same_order(a: DataFrame, b: DataFrame, key: str, item: str, place: str) -> DataFrame:
    """(key, a, b, equal): the ids of each run in the order of place, and whether they are the same; equal is false where only one run has the key."""
    ids = lambda df, n: df.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct(place, item))), lambda x: x[item]).alias(n))
    both = ids(a, "a").join(ids(b, "b"), key, "full")
    return both.select(key, "a", "b", F.coalesce(F.col("a") == F.col("b"), F.lit(False)).alias("equal"))


def coverage_terms(text: Column) -> Column:
    """Runs of a-z and digits in lower case without the stop words."""
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))
    return F.array_except(words, F.array(*map(F.lit, COVERAGE_STOP_WORDS)))


def best_passages(pairs: DataFrame, key: str, reference: str, source: str, lines: int = 3, limit: int = 600, terms: Callable[[Column], Column] = coverage_terms) -> DataFrame:
    """(key, passage, coverage): of up to lines consecutive non-empty lines, those with most of the reference's terms, then the shortest, then the earliest.

    Passages over limit characters are cut there, with a sign. Sources without lines give an empty passage.
    """
    split = F.filter(F.transform(F.split(F.coalesce(F.col(source), F.lit("")), r"\r\n|[\n\r\x0b\x0c]"), lambda x: F.regexp_replace(x, r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")), lambda x: x != "")
    base = pairs.select(key, F.array_distinct(terms(F.col(reference))).alias("_w"), split.alias("_l"))
    at = F.explode(F.when(F.size("_l") > 0, F.sequence(F.lit(1), F.size("_l"))).otherwise(F.array(F.lit(1)))).alias("_s")
    sized = base.select(key, "_w", "_l", at).select(key, "_w", "_l", "_s", F.explode(F.sequence(F.lit(1), F.lit(lines))).alias("_n"))
    passage = sized.select(key, "_w", "_s", "_n", F.array_join(F.slice("_l", F.col("_s"), F.col("_n")), " ").alias("_p"))
    share = F.when(F.size("_w") > 0, F.size(F.array_intersect("_w", terms(F.col("_p")))) / F.size("_w")).otherwise(0.0)
    scored = passage.withColumn("_c", share)
    best = scored.groupBy(key).agg(F.min_by(F.struct("_p", "_c"), F.struct(-F.col("_c"), F.length("_p"), F.col("_s"), F.col("_n"))).alias("_b"))
    p = F.col("_b._p")
    return best.select(key, F.when(F.length(p) > limit, F.concat(F.rtrim(F.substring(p, 1, limit - 1)), F.lit("…"))).otherwise(p).alias("passage"), F.col("_b._c").alias("coverage"))


def surviving_spans(blocks: DataFrame, key: str, text: str, start: str, trimmed: str, marker: str = ELISION_MARKER) -> DataFrame:
    """(key, char_start, char_end) of the pieces of trimmed between markers, each looked for behind the last one found; pieces not found are left out."""
    kind = blocks.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for k, body, first, left in zip(batch[key], batch[text], batch[start], batch[trimmed]):
                cursor = 0
                for piece in left.split(marker):
                    at = body.find(piece, cursor) if piece else -1
                    if at >= 0:
                        cursor = at + len(piece)
                        rows.append((k, int(first) + at, int(first) + cursor))
            yield pd.DataFrame(rows, columns=[key, "char_start", "char_end"])

    given = blocks.select(key, text, start, trimmed).na.drop(subset=[text, start, trimmed])
    return given.mapInPandas(run, f"`{key}` {kind}, char_start long, char_end long")


def swap_bar(times: DataFrame, warm_ratio_max: float = 1.5, cold_max_s: float = 30.0, models: tuple[str, str] = ("qwen3:8b", "gemma4:26b-a4b")) -> DataFrame:
    """One row (cold_a, cold_b, warm_a, warm_b, ratio, failed, both_resident_b, questions_b, passes) from times (arm, q, seconds, rc, ps).

    Question 0 of a sequence is cold, the others are warm, pooled over the sequences of an arm. A failed question voids
    the bar, and so does an arm without times.
    """
    cold = F.col("q") == 0
    of = lambda arm, c: F.median(F.when((F.col("arm") == arm) & c, F.col("seconds")))
    b = F.col("arm") == "b"
    resident = b & F.coalesce(F.contains("ps", F.lit(models[0])) & F.contains("ps", F.lit(models[1])), F.lit(False))
    m = times.agg(of("a", cold).alias("cold_a"), of("b", cold).alias("cold_b"), of("a", ~cold).alias("warm_a"), of("b", ~cold).alias("warm_b"), F.count_if(~F.col("rc").eqNullSafe(F.lit(0))).alias("failed"), F.count_if(resident).alias("both_resident_b"), F.count_if(b).alias("questions_b"))
    m = m.withColumn("ratio", F.try_divide("warm_b", "warm_a"))
    passes = F.coalesce((F.col("failed") == 0) & (F.col("ratio") <= warm_ratio_max) & (F.col("cold_b") <= cold_max_s), F.lit(False))
    return m.select("cold_a", "cold_b", "warm_a", "warm_b", "ratio", "failed", "both_resident_b", "questions_b", passes.alias("passes"))
