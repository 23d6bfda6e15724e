import json

import pytest
from pyspark.sql import functions as F

from minutario.sources import corpus as C
from minutario.sources.readers import read_xml_elements

SUMMARY = """<r xmlns:nite="n"><abstract><sentence nite:id="a1">no</sentence></abstract><decisions nite:id="d"><sentence nite:id="s1">One.</sentence><sentence nite:id="s2"/>
<sentence nite:id="s3">Two.</sentence></decisions><actions><sentence nite:id="x">no</sentence></actions><decision external="true"/></r>"""


def test_decisions_and_inventory(spark, tmp_path):
    (tmp_path / "IS1009a.abssumm.xml").write_text(SUMMARY)
    elements = read_xml_elements(spark, str(tmp_path))
    assert [tuple(r) for r in C.decisions_from_sentences(elements).orderBy("decision_id").collect()] == [("IS1009a.d01", "IS1009a", "IS1009", "s1", "One."), ("IS1009a.d02", "IS1009a", "IS1009", "s3", "Two.")]
    assert tuple(C.inventory(elements).collect()[0])[1:] == (5, 1, 1, 0)


def test_turns_belong_to_their_file(spark, tmp_path):
    row = {"meeting_id": "m1", "turn_index": 0, "speaker": "A", "role": "PM", "start": 1.0, "end": 3.5, "char_start": 4, "char_end": 12, "dialogue_act_ids": ["a", "b"], "text": "so it is"}
    (tmp_path / "m1.jsonl").write_text(json.dumps(row) + "\n")
    table, acts = C.turn_numbers(C.read_turns(spark, str(tmp_path)))
    assert [(r.seconds, r.n_words, r.n_acts) for r in table.collect()] == [(2.5, 3, 2)] and {r.act_id for r in acts.collect()} == {"a", "b"}
    (tmp_path / "m2.jsonl").write_text(json.dumps(row) + "\n")
    with pytest.raises(Exception, match="row of m1 in the file of m2"):
        C.read_turns(spark, str(tmp_path)).collect()


def test_bundles(spark):
    text = "---\ntitle: T\nsource: m1\n---\nx\n> not there\n## Update from m2\n> The   MOTOR\n> stays\n## Related\n> ignored\n"
    md = spark.createDataFrame([("p", text), ("q", "---\ntitle: U\n---\nnothing")], "path string, value string")
    bodies = spark.createDataFrame([("m1", "PM: hello"), ("m2", "UI: the motor\nstays")], "meeting_id string, body string")
    got = {r.path: tuple(r)[1:] for r in C.located_bundles(md, bodies).collect()}
    assert got == {"p": ("T", 3, 2, "m2", 4, 13), "q": ("U", 0, 0, None, None, None)}


def test_cache_embeds_only_what_is_missing(spark):
    texts = spark.createDataFrame([("a",), ("b",), ("b",), (None,)], "t string")
    cache = texts.where("t = 'a'").select(F.sha2("t", 256).alias("hash"), F.array(F.lit(9.0)).alias("vector"))
    got = sorted(r.vector[0] for r in C.completed_cache(texts, cache, "t", lambda own: [[float(len(x))] for x in own]).collect())
    assert got == [1.0, 9.0]
    with pytest.raises(Exception, match="0 vectors for 1 texts"):
        C.completed_cache(texts, cache, "t", lambda own: []).collect()


def test_states_keys_and_small_functions(spark):
    df = spark.createDataFrame([("s", 2, "b"), ("s", 1, "a"), ("t", 1, "c")], "series string, n int, text string")
    got = C.cumulative_states(df, "series", "n", lambda s, r: s | {"text": s.get("text", "") + r["text"]}, "series string, text string")
    assert {tuple(r) for r in got.collect()} == {("s", "ab"), ("t", "c")}
    assert df.select(C.cache_key("series", "n").alias("k")).distinct().count() == 3
    one = spark.createDataFrame([(" dutch ", "[concept_id: x]\nIt [concept_id: y] stays"), ("", None), ("english us", "plain")], "l string, t string")
    language = C.native_language(F.col("l"), {"english us": "English"})
    assert [tuple(r) for r in one.select(language, C.native_status(language), C.without_labels(F.col("t"))).collect()] == [("Dutch", "non_native", "It stays"), (None, "unknown", None), ("English", "native", "plain")]
    assert C.turn_range("12-18") == (12, 18) and C.turn_range(" 3 ") == (3, 3)
    with pytest.raises(ValueError):
        C.turn_range("9-3")
    assert C.markdown_table(df.where("series = 's'").select("n", "text"), ["n"], "Title") == "**Title**\n\n| n | text |\n|---|---|\n| 1 | a |\n| 2 | b |\n"
