"""Readers of annotated transcripts, logs and tables with contracts; every one gives a lazy DataFrame."""

from __future__ import annotations

import csv
import io
import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

ELEMENTS = "path string, place int, tag string, id string, parent string, attributes map<string,string>, text string, hrefs array<string>"
_ID_RANGE = r"id\(([^()]+)\)(?:\.\.id\(([^()]+)\))?"


def _local(name: str) -> str:
    return name.rsplit("}", 1)[-1].rsplit(":", 1)[-1]


def _elements(path: str, content: bytes) -> Iterator[tuple]:
    """All elements in document order with local names; a malformed file raises."""
    place = 0
    stack = [(ET.fromstring(content), None)]
    while stack:
        node, parent = stack.pop()
        attributes = {_local(k): v for k, v in node.attrib.items()}
        hrefs = [v for child in node for k, v in child.attrib.items() if _local(k) == "href"]
        yield path, place, _local(node.tag), attributes.get("id"), parent, attributes, (node.text or "").strip(), hrefs
        place += 1
        stack.extend((child, attributes.get("id") or parent) for child in reversed(list(node)))


def read_xml_elements(spark: SparkSession, path: str, pattern: str = "*.xml") -> DataFrame:
    """(path, place, tag, id, parent, attributes, text, hrefs) of every element of every file below a folder.

    place is document order over all siblings, whatever their tag. Files are read as binary and parsed by the tasks.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path).select("path", "content")

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"]):
                yield pd.DataFrame(list(_elements(name, content)), columns=[c.split()[0] for c in ELEMENTS.split(", ")])

    return files.mapInPandas(parse, ELEMENTS)


def word_tokens(elements: DataFrame) -> DataFrame:
    """(path, position, id, text, is_punctuation, start, end): children of a word layer; other tags keep their slot, empty."""
    inside = elements.where("place > 0")
    position = (F.row_number().over(W.partitionBy("path").orderBy("place")) - 1).alias("position")
    word = F.col("tag") == "w"
    number = lambda k: F.col("attributes")[k].try_cast("double")
    return inside.select("path", position, "id", F.when(word, F.col("text")).otherwise("").alias("text"), (F.coalesce(F.col("attributes")["punc"], F.lit("false")) == "true").alias("is_punctuation"), number("starttime").alias("start"), number("endtime").alias("end"))


def id_ranges(elements: DataFrame, tag: str) -> DataFrame:
    """(path, id, file, first, last) of the pointers of a tag's elements; a single id is its own range."""
    pointed = elements.where(F.col("tag") == tag).select("path", "id", F.posexplode("hrefs").alias("n", "href"))
    first, last = F.regexp_extract("href", _ID_RANGE, 1), F.regexp_extract("href", _ID_RANGE, 2)
    return pointed.select("path", "id", "n", F.substring_index("href", "#", 1).alias("file"), first.alias("first"), F.when(last != "", last).otherwise(first).alias("last")).where("first <> ''")


def resolve_ranges(ranges: DataFrame, tokens: DataFrame) -> DataFrame:
    """(path, id, text): the tokens of each range in order, both ends included, swapped ends put right; dangling ones drop out."""
    t = tokens.withColumn("file", F.regexp_extract("path", r"([^/]+)$", 1))
    ends = t.select("file", F.col("id").alias("_id"), F.col("position").alias("_p"))
    r = ranges.join(ends.toDF("file", "first", "a"), ["file", "first"]).join(ends.toDF("file", "last", "b"), ["file", "last"])
    spans = r.select("path", "id", "n", "file", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    words = spans.join(t.select("file", "position", "text"), (spans.file == t.file) & (F.col("position") >= F.col("a")) & (F.col("position") <= F.col("b")))
    ordered = words.where("text <> ''").groupBy(spans.path, "id").agg(F.array_sort(F.collect_list(F.struct("n", "position", "text"))).alias("w"))
    return ordered.select("path", "id", F.array_join(F.transform("w", lambda x: x["text"]), " ").alias("text"))


def front_matter(text: str) -> tuple[dict[str, str], str]:
    """(flat keys, body) of a Markdown text with a head between two --- lines; without one the body is the text."""
    m = re.match(r"---\r?\n(.*?)\r?\n---\r?\n?(.*)\Z", text, re.S)
    if not m:
        return {}, text
    pairs = (line.split(":", 1) for line in m[1].splitlines() if ":" in line and not line.startswith((" ", "\t", "#")))
    return {k.strip(): v.strip().strip("\"'") for k, v in pairs}, m[2]


def read_markdown(spark: SparkSession, path: str) -> DataFrame:
    """(path, head map, body) of Markdown files."""
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.md").text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(p, *front_matter(v)) for p, v in zip(batch["path"], batch["value"])]
            yield pd.DataFrame(rows, columns=["path", "head", "body"])

    return files.mapInPandas(split, "path string, head map<string,string>, body string")


def read_bibliography(spark: SparkSession, path: str) -> DataFrame:
    """(path, kind, key, fields map, keywords array) of BibTeX entries with braced or quoted values."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    entry, field = re.compile(r"@(\w+)\s*\{\s*([^,\s]+)\s*,(.*?)\n\}", re.S), re.compile(r"(\w+)\s*=\s*(?:\{((?:[^{}]|\{[^{}]*\})*)\}|\"([^\"]*)\"|(\d+))")

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for p, text in zip(batch["path"], batch["value"]):
                for kind, key, body in entry.findall(text):
                    fields = {k.lower(): " ".join((a or b or c).replace("{", "").replace("}", "").split()) for k, a, b, c in field.findall(body)}
                    rows.append((p, kind.lower(), key, fields, [w.strip() for w in fields.get("keywords", "").split(",") if w.strip()]))
            yield pd.DataFrame(rows, columns=["path", "kind", "key", "fields", "keywords"])

    return files.mapInPandas(parse, "path string, kind string, key string, fields map<string,string>, keywords array<string>")


def read_records(spark: SparkSession, path: str, schema: str, key: Sequence[str] = ()) -> DataFrame:
    """Append-only JSON lines: malformed lines are passed over; with a key, the last line of each key holds.

    A line's place is its file and its order within it, so the log must not be rewritten in another order.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("_file"), F.monotonically_increasing_id().alias("_at"))
    parsed = lines.withColumn("_r", F.from_json("value", f"{schema}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})).where("_r is not null and _r._bad is null")
    rows = parsed.select("_file", "_at", "_r.*").drop("_bad")
    if not key:
        return rows.drop("_file", "_at")
    fields = [c for c in rows.columns if c not in ("_file", "_at")]
    last = rows.groupBy(*key).agg(F.max(F.struct("_file", "_at", F.struct(*fields).alias("v"))).alias("_l"))
    return last.select("_l.v.*")


def checked_csv(content: bytes, name: str) -> list[dict[str, str]]:
    """Rows of a UTF-8 CSV with or without a mark; short rows are padded, other encodings and ; files are refused."""
    if content[:2] in (b"\xff\xfe", b"\xfe\xff"):
        raise ValueError(f"{name}: UTF-16 is not read")
    try:
        text = content.decode("utf-8-sig")
    except UnicodeDecodeError as e:
        raise ValueError(f"{name}: not UTF-8") from e
    head = text.split("\n", 1)[0]
    if ";" in head and "," not in head:
        raise ValueError(f"{name}: fields are separated by ;")
    return [{k: v or "" for k, v in row.items() if k is not None} for row in csv.DictReader(io.StringIO(text, newline=""), restval="")]


def read_csv_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, row, cells map) of the CSV files below a folder, each checked as a whole."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.csv").load(path).select("path", "content")

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(p, n, r) for p, c in zip(batch["path"], batch["content"]) for n, r in enumerate(checked_csv(c, p))]
            yield pd.DataFrame(rows, columns=["path", "row", "cells"])

    return files.mapInPandas(parse, "path string, row int, cells map<string,string>")


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """(path, sha256) of files, for manifests."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", F.sha2("content", 256).alias("sha256"))


class _Range(InputPartition):
    def __init__(self, low: int, high: int) -> None:
        self.low, self.high = low, high


class _SqliteReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict[str, str]) -> None:
        self.columns = schema.fieldNames()
        self.path, self.table, self.parts = options["path"], options["table"], int(options.get("partitions", "1"))

    def _connect(self):
        import sqlite3

        return sqlite3.connect(f"file:{self.path}?mode=ro", uri=True)

    def partitions(self) -> list[InputPartition]:
        with self._connect() as c:
            there = [r[1] for r in c.execute(f'pragma table_info("{self.table}")')]
            if there != self.columns:
                raise ValueError(f"{self.table} has the columns {there}, not {self.columns}")
            low, high = c.execute(f'select coalesce(min(rowid), 0), coalesce(max(rowid), -1) from "{self.table}"').fetchone()
        step = max(1, -(-(high - low + 1) // self.parts))
        return [_Range(a, min(a + step - 1, high)) for a in range(low, high + 1, step)] or [_Range(0, -1)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        names = ", ".join(f'"{c}"' for c in self.columns)
        with self._connect() as c:
            yield from c.execute(f'select {names} from "{self.table}" where rowid between ? and ?', (partition.low, partition.high))


class SqliteSource(DataSource):
    """spark.read.format("sqlite_table").schema(...).option("path", ...).option("table", ...): read only, exact columns."""

    @classmethod
    def name(cls) -> str:
        return "sqlite_table"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _SqliteReader(schema, self.options)


def read_sqlite(spark: SparkSession, path: str, table: str, schema: str, partitions: int = 1) -> DataFrame:
    spark.dataSource.register(SqliteSource)
    return spark.read.format("sqlite_table").schema(schema).option("path", path).option("table", table).option("partitions", str(partitions)).load()


def write_single_csv(df: DataFrame, path: str, order: Sequence[str]) -> None:
    """One byte-stable CSV file with LF line ends, for report tables that fit into the driver by their nature."""
    rows = df.orderBy(*order).toLocalIterator()
    with open(path, "w", encoding="utf-8", newline="") as out:
        writer = csv.writer(out, lineterminator="\n")
        writer.writerow(df.columns)
        writer.writerows(["" if v is None else v for v in r] for r in rows)
