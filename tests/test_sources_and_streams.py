import datetime as dt
import sqlite3

import pytest

from minutario.sources import readers as R
from minutario.streaming import streams

WORDS = """<?xml version="1.0"?><nite:root xmlns:nite="http://nite" nite:id="x.words">
<w nite:id="w0" starttime="0.1" endtime="0.2">the</w><vocalsound nite:id="w1" type="laugh"/><w nite:id="w2">remote</w><w nite:id="w3" punc="true">.</w></nite:root>"""
ACTS = """<?xml version="1.0"?><nite:root xmlns:nite="http://nite"><dact nite:id="d1"><nite:child href="x.words.xml#id(w2)..id(w0)"/></dact>
<dact nite:id="d2"><nite:child href="x.words.xml#id(w3)"/></dact><dact nite:id="d3"><nite:child href="x.words.xml#id(w9)"/></dact></nite:root>"""


def test_xml_keeps_document_order_and_resolves_ranges(spark, tmp_path):
    (tmp_path / "x.words.xml").write_text(WORDS)
    (tmp_path / "x.acts.xml").write_text(ACTS)
    words = R.read_xml_elements(spark, str(tmp_path), "*.words.xml")
    tokens = R.word_tokens(words)
    assert [(r.position, r.id, r.text, r.is_punctuation, r.start) for r in tokens.orderBy("position").collect()] == [(0, "w0", "the", False, 0.1), (1, "w1", "", False, None), (2, "w2", "remote", False, None), (3, "w3", ".", True, None)]
    acts = R.read_xml_elements(spark, str(tmp_path), "*.acts.xml")
    got = R.resolve_ranges(R.id_ranges(acts, "dact"), tokens).collect()
    assert {(r.id, r.text) for r in got} == {("d1", "the remote"), ("d2", ".")}


def test_malformed_xml_is_an_error(spark, tmp_path):
    (tmp_path / "a.xml").write_text("<a><b></a>")
    with pytest.raises(Exception, match="mismatched tag"):
        R.read_xml_elements(spark, str(tmp_path)).count()


def test_markdown_and_bibliography(spark, tmp_path):
    (tmp_path / "a.md").write_text("---\nmeeting: IS1009a\nrevision: 3\n---\nPM: hello\n")
    (tmp_path / "b.md").write_text("no head")
    got = {r.path[-4:]: (r.head, r.body) for r in R.read_markdown(spark, str(tmp_path)).collect()}
    assert got == {"a.md": ({"meeting": "IS1009a", "revision": "3"}, "PM: hello\n"), "b.md": ({}, "no head")}
    (tmp_path / "r.bib").write_text("@article{key1,\n title = {A {B} c},\n keywords = {x, y},\n year = 2020\n}\n@misc{k2,\n doi = \"10.1\"\n}\n")
    rows = {r.key: r for r in R.read_bibliography(spark, str(tmp_path / "r.bib")).collect()}
    assert rows["key1"].fields == {"title": "A B c", "keywords": "x, y", "year": "2020"} and rows["key1"].keywords == ["x", "y"]
    assert rows["k2"].fields["doi"] == "10.1" and rows["k2"].keywords == []


def test_log_skips_bad_lines_and_keeps_the_last(spark, tmp_path):
    (tmp_path / "log.jsonl").write_text('{"k": 1, "v": "a"}\n{"k": 2, "v": "b"}\nbroken{\n{"k": 1, "v": "c"}\n{"k": 3\n')
    schema = "k int, v string"
    assert R.read_records(spark, str(tmp_path), schema).count() == 3
    assert {tuple(r) for r in R.read_records(spark, str(tmp_path), schema, ["k"]).collect()} == {(1, "c"), (2, "b")}


def test_csv_contract(spark, tmp_path):
    assert R.checked_csv("﻿a,b\n1\n\"x,\ny\",2\n".encode(), "f") == [{"a": "1", "b": ""}, {"a": "x,\ny", "b": "2"}]
    for bad in ("a;b\n1;2\n".encode(), "a,b".encode("utf-16"), "é,b\n".encode("latin-1")):
        with pytest.raises(ValueError):
            R.checked_csv(bad, "f")
    (tmp_path / "a.csv").write_text("a,b\n1,2\n")
    assert [r.cells for r in R.read_csv_files(spark, str(tmp_path)).collect()] == [{"a": "1", "b": "2"}]
    df = spark.createDataFrame([(2, None), (1, "é")], "k int, v string")
    R.write_single_csv(df, str(tmp_path / "out.csv"), ["k"])
    assert (tmp_path / "out.csv").read_bytes() == "k,v\n1,é\n2,\n".encode()


def test_sqlite_source(spark, tmp_path):
    path = str(tmp_path / "f.db")
    with sqlite3.connect(path) as c:
        c.execute("create table t (id integer, v text)")
        c.executemany("insert into t values (?, ?)", [(i, f"v{i}") for i in range(10)])
    assert R.read_sqlite(spark, path, "t", "id bigint, v string", 3).count() == 10
    with pytest.raises(Exception, match="has the columns"):
        R.read_sqlite(spark, path, "t", "id bigint, w string").count()


def _stream(spark, tmp_path, rows, schema):
    spark.createDataFrame(rows, schema).write.mode("append").parquet(str(tmp_path / "in"))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))


def test_windows_of_a_stream(spark, tmp_path):
    at = lambda h, m: dt.datetime(2024, 1, 1, h, m)
    stream = _stream(spark, tmp_path, [(at(1, 5), "a", 1.0), (at(1, 50), "a", 2.0), (at(2, 5), "b", 3.0)], "ts timestamp, kind string, value double")
    q = streams.windowed_totals(stream, "ts", "value", "kind").writeStream.outputMode("complete").format("memory").queryName("w").start()
    q.processAllAvailable()
    q.stop()
    assert {(r.kind, r.n, r.total) for r in spark.table("w").collect()} == {("a", 2, 3.0), ("b", 1, 3.0)}


def test_last_wins_whatever_the_order_of_arrival(spark, tmp_path):
    schema = "k string, o long, v string"
    _stream(spark, tmp_path, [("a", 5, "new"), ("b", 1, "x")], schema)
    stream = _stream(spark, tmp_path, [("a", 2, "old"), ("b", 3, "y")], schema)
    q = streams.last_wins(stream, "k", "o", "v").writeStream.outputMode("update").format("memory").queryName("l").start()
    q.processAllAvailable()
    q.stop()
    seen = spark.table("l").groupBy("k").agg({"o": "max"}).collect()
    assert {tuple(r) for r in seen} == {("a", 5), ("b", 3)}
    assert spark.table("l").where("k = 'a' and v = 'old' and o > 5").count() == 0


def test_resumed_work_and_errors_as_data(spark):
    work = spark.createDataFrame([(1,), (2,), (3,)], "q int")
    log = spark.createDataFrame([(1, None), (2, "timeout")], "q int, error string")
    left = streams.pending(work, log, ["q"])
    assert sorted(r.q for r in left.collect()) == [2, 3]

    def answer(row):
        if row["q"] == 3:
            raise ValueError("no")
        return "yes"

    assert {tuple(r) for r in streams.evaluated(left, answer, ["q"]).collect()} == {(2, "yes", None), (3, None, "ValueError: no")}
