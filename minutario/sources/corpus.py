"""The annotated corpus: decisions from summary sentences, inventories, turn tables, bundles and caches."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Mapping

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from minutario.operators.locate import locate
from minutario.sources.readers import front_matter

TURNS = "meeting_id string, turn_index int, speaker string, role string, start double, end double, char_start int, char_end int, dialogue_act_ids array<string>, text string"


def decisions_from_sentences(elements: DataFrame) -> DataFrame:
    """(decision_id, meeting_id, series_id, sentence_id, text): the sentences below `decisions`, numbered by meeting in document order.

    elements come from read_xml_elements; the meeting is the file name's first part. Sentences outside `decisions` and
    empty ones don't count.
    """
    inside = F.last(F.when(F.col("tag") != "sentence", F.col("tag") == "decisions"), ignorenulls=True).over(W.partitionBy("path").orderBy("place"))
    meeting = F.regexp_extract("path", r"([^/.]+)[^/]*$", 1)
    own = elements.withColumn("_in", inside).where("tag = 'sentence' and _in and text <> ''").withColumn("meeting_id", meeting)
    number = F.row_number().over(W.partitionBy("meeting_id").orderBy("path", "place"))
    return own.select(F.format_string("%s.d%02d", "meeting_id", number).alias("decision_id"), "meeting_id", F.regexp_extract("meeting_id", r"^([A-Z]+\d+)", 1).alias("series_id"), F.col("id").alias("sentence_id"), "text")


def inventory(elements: DataFrame) -> DataFrame:
    """(path, n_sentences, n_segments, n_external, n_recap): counts of each file's elements and boolean marks."""
    flag = lambda name: F.count_if(F.col("attributes")[name] == "true")
    return elements.groupBy("path").agg(F.count_if(F.col("tag") == "sentence").alias("n_sentences"), F.count_if(F.col("tag") == "decision").alias("n_segments"), flag("external").alias("n_external"), flag("recap").alias("n_recap"))


def read_turns(spark: SparkSession, path: str) -> DataFrame:
    """Frozen turns, one JSON object a line, in files named after their meeting; a row of another meeting is an error."""
    rows = spark.read.schema(TURNS).option("mode", "FAILFAST").json(path)
    stem = F.regexp_extract(F.col("_metadata.file_name"), r"^([^.]+)", 1)
    foreign = F.raise_error(F.concat(F.lit("row of "), F.coalesce("meeting_id", F.lit("null")), F.lit(" in the file of "), stem))
    return rows.withColumn("meeting_id", F.when(F.col("meeting_id") == stem, F.col("meeting_id")).otherwise(foreign.cast("string")))


def turn_numbers(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(turn table without texts, distinct (meeting_id, act_id))."""
    table = turns.select("meeting_id", "turn_index", "speaker", "role", (F.col("end") - F.col("start")).alias("seconds"), F.size(F.split(F.trim("text"), r"(?U)\s+")).alias("n_words"), F.size("dialogue_act_ids").alias("n_acts"))
    return table, turns.select("meeting_id", F.explode("dialogue_act_ids").alias("act_id")).distinct()


def bundle_quotes(text: str, related: str = "## Related", update: str = r"## Update from (\S+)") -> tuple[dict[str, str], list[tuple[str, str]]]:
    """(head, [(source, quote)]): quote lines with the source they stand under, up to the related section."""
    head, body = front_matter(text)
    source, quotes = head.get("source", ""), []
    for line in body.splitlines():
        if line.strip() == related:
            break
        if m := re.match(update, line):
            source = m[1]
        elif line.startswith(">") and line[1:].strip():
            quotes.append((source, line[1:].strip()))
    return head, quotes


def located_bundles(markdown: DataFrame, bodies: DataFrame) -> DataFrame:
    """(path, title, n_quotes, n_found, meeting_id, start, end): concepts with the first quote that stands in its source.

    markdown: path, value (whole files); bodies: meeting_id, body. The first located quote is the evidence, the others
    only count; without one the place is null. Quotes meet their meeting in a join, the text isn't broadcast.
    """

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, value in zip(batch["path"], batch["value"]):
                head, quotes = bundle_quotes(value)
                rows += [(path, head.get("title"), n, s, q) for n, (s, q) in enumerate(quotes)] or [(path, head.get("title"), -1, None, None)]
            yield pd.DataFrame(rows, columns=["path", "title", "n", "meeting_id", "quote"])

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            spots = [locate(b, q) if b is not None and q is not None else (-1, -1, 0) for b, q in zip(batch["body"], batch["quote"])]
            yield batch[["path", "title", "n", "meeting_id"]].assign(start=[s for s, _, _ in spots], end=[e for _, e, _ in spots])

    quotes = markdown.select("path", "value").mapInPandas(read, "path string, title string, n int, meeting_id string, quote string")
    placed = quotes.join(bodies, "meeting_id", "left").select("path", "title", "n", "meeting_id", "quote", "body").mapInPandas(find, "path string, title string, n int, meeting_id string, start int, end int")
    best = F.min(F.when(F.col("start") >= 0, F.struct("n", "meeting_id", "start", "end"))).alias("b")
    return placed.groupBy("path", "title").agg(F.count_if(F.col("n") >= 0).alias("n_quotes"), F.count_if(F.col("start") >= 0).alias("n_found"), best).select("path", "title", "n_quotes", "n_found", "b.meeting_id", "b.start", "b.end")


def cache_key(*columns: str) -> Column:
    """SHA-256 over all inputs of a result, for tables that keep results by it."""
    return F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)


def completed_cache(texts: DataFrame, cache: DataFrame, text: str, embed: Callable[[list[str]], list[list[float]]], batch: int = 32) -> DataFrame:
    """cache (hash, vector) with the missing texts' vectors added: only those are embedded, each distinct text once."""
    hashed = texts.where(F.col(text).isNotNull()).select(F.sha2(text, 256).alias("hash"), F.col(text).alias("text")).dropDuplicates(["hash"])
    missing = hashed.join(cache.select("hash"), "hash", "left_anti")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            vectors: list[list[float]] = []
            for at in range(0, len(frame), batch):
                own = frame["text"].iloc[at : at + batch].tolist()
                got = embed(own)
                if len(got) != len(own):
                    raise ValueError(f"{len(got)} vectors for {len(own)} texts")
                vectors += got
            yield pd.DataFrame({"hash": frame["hash"], "vector": vectors})

    return cache.select("hash", "vector").unionByName(missing.mapInPandas(run, "hash string, vector array<double>"))


def cumulative_states(sources: DataFrame, by: str, order: str, step: Callable[[dict, dict], dict], schema: str) -> DataFrame:
    """One state per group, its rows taken in order: step(state, row) gives the next state. A group is one series' meetings."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        state: dict = {by: frame[by].iloc[0]}
        for row in frame.sort_values(order).to_dict("records"):
            state = step(state, row)
        return pd.DataFrame([state])

    return sources.groupBy(by).applyInPandas(run, schema)


def native_language(raw: Column, aliases: Mapping[str, str]) -> Column:
    """The language with a capital letter, aliases put in; null for blanks."""
    bare = F.lower(F.trim(raw))
    known = F.coalesce(*[F.when(bare == k, v) for k, v in aliases.items()], F.lit(None).cast("string")) if aliases else F.lit(None).cast("string")
    return F.when(bare != "", F.coalesce(known, F.concat(F.upper(F.substring(bare, 1, 1)), F.substr(bare, F.lit(2)))))


def native_status(language: Column, native: str = "English") -> Column:
    return F.when(language.isNull(), "unknown").when(language == native, "native").otherwise("non_native")


def without_labels(text: Column, label: str = "concept_id") -> Column:
    """Leaked `[concept_id: x]` labels taken out, at line starts with their line end first, then inside lines."""
    whole = F.regexp_replace(text, rf"(?m)^\[{label}:[^\]\n]*\]\s*\n?", "")
    return F.regexp_replace(whole, rf" ?\[{label}:[^\]\n]*\]", "")


def turn_range(text: str) -> tuple[int, int]:
    """`12` or `12-18`; anything else and a range that ends before it begins are errors."""
    m = re.fullmatch(r"\s*(\d+)\s*(?:-\s*(\d+)\s*)?", text)
    if not m or m[2] and int(m[2]) < int(m[1]):
        raise ValueError(f"not a turn or a range of turns: {text!r}")
    return int(m[1]), int(m[2] or m[1])


def markdown_table(df: DataFrame, order: list[str], title: str = "") -> str:
    """A report table as Markdown; report tables fit into the driver by their nature."""
    cell = lambda v: "" if v is None else f"{v:.3f}" if isinstance(v, float) else str(v).replace("|", "\\|")
    lines = [f"| {' | '.join(df.columns)} |", "|" + "---|" * len(df.columns)]
    lines += [f"| {' | '.join(map(cell, row))} |" for row in df.orderBy(*order).toLocalIterator()]
    return "\n".join([*([f"**{title}**", ""] if title else []), *lines]) + "\n"
