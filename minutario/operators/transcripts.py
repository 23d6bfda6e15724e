"""Turns and dialogue acts from words and ranges, and their rendering."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def joined_words(words: Column) -> Column:
    """Text of an array of (text, is_punctuation): a blank before each word but not before punctuation; empty words drop out."""
    kept = F.filter(words, lambda w: w["text"] != "")
    return F.trim(F.aggregate(kept, F.lit(""), lambda text, w: F.concat(text, F.when(w["is_punctuation"], "").otherwise(" "), w["text"])))


def acts_of_turns(turns: DataFrame, acts: DataFrame) -> DataFrame:
    """(meeting_id, turn_index, act_ids): acts of the turn's speaker whose inclusive word ranges meet the turn's.

    turns: meeting_id, turn_index, speaker, first, last; acts: meeting_id, speaker, act_id, first, last. Turns without acts
    get an empty array; act ids are in the acts' word order, each once.
    """
    t = turns.select("meeting_id", "speaker", "turn_index", F.col("first").alias("tf"), F.col("last").alias("tl"))
    a = acts.select("meeting_id", "speaker", "act_id", F.col("first").alias("af"), F.col("last").alias("al"))
    met = t.join(a, ["meeting_id", "speaker"]).where("af <= tl and tf <= al")
    ids = met.groupBy("meeting_id", "turn_index").agg(F.array_sort(F.collect_set(F.struct("af", "act_id"))).alias("x"))
    ordered = ids.select("meeting_id", "turn_index", F.array_distinct(F.transform("x", lambda x: x["act_id"])).alias("act_ids"))
    return t.select("meeting_id", "turn_index").join(ordered, ["meeting_id", "turn_index"], "left").withColumn("act_ids", F.coalesce("act_ids", F.array().cast("array<string>")))


def rendered(turns: DataFrame) -> DataFrame:
    """(meeting_id, turn_index, role, text, char_start, char_end, line): places in a body of `ROLE: text` lines a blank line apart.

    The offsets are of the text after its role. Running lengths go over one meeting, the unit of a transcript.
    """
    line = F.concat("role", F.lit(": "), "text")
    w = W.partitionBy("meeting_id").orderBy("turn_index").rowsBetween(W.unboundedPreceding, -1)
    placed = turns.withColumn("line", line).withColumn("_at", F.coalesce(F.sum(F.length("line") + 2).over(w), F.lit(0)))
    start = F.col("_at") + F.length("role") + 2
    return placed.select("meeting_id", "turn_index", "role", "text", start.cast("int").alias("char_start"), (start + F.length("text")).cast("int").alias("char_end"), "line")


def bodies(lines: DataFrame) -> DataFrame:
    """(meeting_id, body, sha256, n_turns): the rendered text of each meeting and its hash for the manifest."""
    ordered = lines.groupBy("meeting_id").agg(F.array_sort(F.collect_list(F.struct("turn_index", "line"))).alias("l"))
    body = F.array_join(F.transform("l", lambda x: x["line"]), "\n\n")
    return ordered.select("meeting_id", body.alias("body"), F.sha2(body, 256).alias("sha256"), F.size("l").alias("n_turns"))


def primary_role(act_roles: DataFrame, key: str) -> DataFrame:
    """(key, role): the most frequent role among (key, role, position), the earlier one on a tie."""
    counts = act_roles.groupBy(key, "role").agg(F.count("*").alias("n"), F.min("position").alias("p"))
    return counts.groupBy(key).agg(F.min(F.struct((-F.col("n")).alias("n"), "p", "role")).alias("b")).select(key, F.col("b.role").alias("role"))


def found_turns(turns: DataFrame, text: str, place: str, term: str | None = None, places: tuple[int, int] | None = None) -> DataFrame:
    """Turns whose text holds the term in any case, within an inclusive range of places if one is given; all turns without either."""
    found = turns if term is None else turns.where(F.contains(F.lower(text), F.lower(F.lit(term))))
    return found if places is None else found.where(F.col(place).between(*places))


def turns_with_acts(turns: DataFrame, acts: str, wanted: Sequence[str]) -> DataFrame:
    """Turns whose array of acts has any of those wanted."""
    return turns.where(F.arrays_overlap(acts, F.array(*map(F.lit, wanted)).cast("array<string>")))
