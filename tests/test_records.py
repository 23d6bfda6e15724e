import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from minutario.functions import chunking
from minutario.operators import answering, locate, records, sampling, transcripts


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab \n", max_size=120), st.integers(4, 30), st.integers(0, 3))
def test_chunks_stand_in_the_text_and_keep_every_word(text, size, overlap):
    chunks = chunking.chunk(text, size, overlap)
    assert all(text[a : a + len(c)] == c and 0 < len(c) <= size for a, c in chunks)
    covered = set()
    for a, c in chunks:
        covered |= set(range(a, a + len(c)))
    assert all(i in covered for i, x in enumerate(text) if not x.isspace())


def test_chunks_prefer_coarse_separators(spark):
    assert [c for _, c in chunking.chunk("one two\n\nthree four\nfive", 12)] == ["one two", "three four", "five"]
    df = spark.createDataFrame([(1, "a b"), (2, None), (3, "")], "k int, t string")
    assert [tuple(r) for r in chunking.chunked(df, "k", "t", 10).collect()] == [("1.c000", 1, 0, 3, "a b")]


@pytest.mark.parametrize(("text", "quote", "wanted"), [("The  Straße\nis long", "STRASSE IS", (5, 14, 1)), ("aXaxa", "axa", (0, 3, 1)), ("It was late, he said.", "it was  LATE.", (0, 11, 1)), ("abc", " ", (-1, -1, 0)), ("abc", "d", (-1, -1, 0))])
def test_quotes(text, quote, wanted):
    assert locate.locate(text, quote) == wanted


def test_turns_and_rendering(spark):
    turns = spark.createDataFrame([("m", 0, "A", 0, 3), ("m", 1, "B", 0, 2), ("m", 2, "A", 4, 6)], "meeting_id string, turn_index int, speaker string, first int, last int")
    acts = spark.createDataFrame([("m", "A", "x2", 3, 5), ("m", "A", "x1", 0, 2), ("m", "C", "y", 0, 9)], "meeting_id string, speaker string, act_id string, first int, last int")
    got = {(r.turn_index, tuple(r.act_ids)) for r in transcripts.acts_of_turns(turns, acts).collect()}
    assert got == {(0, ("x1", "x2")), (1, ()), (2, ("x2",))}
    lines = transcripts.rendered(spark.createDataFrame([("m", 1, "UI", "yes"), ("m", 0, "PM", "hello")], "meeting_id string, turn_index int, role string, text string"))
    body = transcripts.bodies(lines).collect()[0].body
    assert body == "PM: hello\n\nUI: yes"
    assert {r.text: body[r.char_start : r.char_end] for r in lines.collect()} == {"hello": "hello", "yes": "yes"}
    words = spark.sql("select array(named_struct('text', 'so', 'is_punctuation', false), named_struct('text', '', 'is_punctuation', false), named_struct('text', 'what', 'is_punctuation', false), named_struct('text', '?', 'is_punctuation', true)) as w")
    assert words.select(transcripts.joined_words(F.col("w")).alias("t")).collect()[0].t == "so what?"
    roles = spark.createDataFrame([("d", "ME", 1), ("d", "UI", 0), ("e", "PM", 3)], "k string, role string, position int")
    assert {tuple(r) for r in transcripts.primary_role(roles, "k").collect()} == {("d", "UI"), ("e", "PM")}


def _records(spark, rows):
    return spark.createDataFrame(rows, "question_id string, condition string, stratum string, run int, correct boolean, error string")


def test_scores_are_means_of_means(spark):
    rows = [("q1", "c1", "E1", r, True, None) for r in range(3)] + [("q2", "c1", "E1", r, False, None) for r in range(3)] + [("q3", "c1", "E1", 0, True, None), ("q3", "c1", "E1", 1, None, None), ("q3", "c1", "E1", 2, True, "boom")]
    cells = {r.stratum: r for r in records.condition_cells(_records(spark, rows), "correct").collect()}
    assert (cells["E1"].n_questions, cells["E1"].n_records, round(cells["E1"].score, 6)) == (3, 7, 0.666667) and cells["ALL"].n_questions == 3
    status = records.resume_status(_records(spark, rows), 12, ["question_id", "run"]).collect()[0]
    assert tuple(status) == (12, 8, 1, 3)


def test_paired_differences(spark):
    rows = [(f"q{i}", c, "E3", 0, (i % 3 == 0) if c == "a" else i % 2 == 0, None) for i in range(12) for c in "ab"] + [("only", "a", "E3", 0, True, None)]
    r = records.paired_differences(_records(spark, rows), "correct", "a", "b", n=200).collect()[0]
    assert r.n_pairs == 12 and abs(r.difference - (6 - 4) / 12) < 1e-9 and r.lower <= r.difference <= r.upper


def test_citations(spark):
    span = "array<struct<meeting_id:string,acts:array<string>>>"
    rows = [("q1", "E1", False, [("m", ["a", "b"]), ("n", ["z"])], [("m", ["b", "c"])]), ("q2", "E4_x", False, [], [("m", ["b"])]), ("q3", "E1", None, [], [("m", ["b"])]), ("q4", "E1", True, [], [("m", ["b"])])]
    df = spark.createDataFrame(rows, f"question_id string, stratum string, abstained boolean, cited {span}, reference {span}")
    got = {r.question_id: tuple(r)[1:] for r in records.citation_scores(df).collect()}
    assert got == {"q1": (True, 0.5, 0.5), "q2": (None, None, None), "q3": (False, None, 0.0), "q4": (None, None, None)}


def test_freeze(spark):
    a, b = (spark.createDataFrame(x, "path string, sha256 string") for x in ([("p", "1"), ("q", "2"), ("r", "3")], [("p", "1"), ("q", "9"), ("s", "4")]))
    assert {tuple(r) for r in records.freeze_differences(a, b).collect()} == {("q", "changed"), ("r", "removed"), ("s", "added")}


def test_answers_and_verdicts(spark):
    def chat(prompt):
        if "fail" in prompt:
            raise RuntimeError("down")
        return "“I don’t know.”" if "?" in prompt else "Steel. [1]"

    df = spark.createDataFrame([(1, "what?"), (2, "tell"), (3, "fail")], "k int, p string")
    assert {tuple(r) for r in answering.answered(df, "k", "p", chat).collect()} == {(1, "“I don’t know.”", True, None), (2, "Steel. [1]", False, None), (3, None, None, "RuntimeError: down")}
    replies = spark.createDataFrame([(1, json.dumps({"correct": True})), (2, "not json"), (3, json.dumps({"correct": "yes"})), (4, None)], "k int, r string")
    judged = answering.verdicts(replies, "k", "r", ["correct"])
    assert {tuple(r) for r in judged.collect()} == {(1, True, None), (2, None, "invalid_json"), (3, None, "schema"), (4, None, "invalid_json")}
    rates = answering.judge_rates(judged, spark.createDataFrame([(1, False), (2, True)], "k int, correct boolean"), "k", "correct").collect()[0]
    assert (rates.n, rates.valid_rate, rates.flip_rate) == (2, 0.5, 1.0)


def test_judge_choice(spark):
    df = spark.createDataFrame([("slow", 0.9, 0.8, 0.95, 9.0, []), ("fast", 0.82, 0.7, 0.85, 2.0, []), ("poor", 0.5, 0.4, 0.6, 1.0, []), ("bad", 0.99, 0.98, 1.0, 0.1, ["json"])], "name string, kappa double, lower double, upper double, seconds double, failed array<string>")
    assert answering.chosen_judge(df).collect()[0].name == "fast"


def test_contexts_share_the_budget(spark):
    df = spark.createDataFrame([(1, 2, "b", "x\n" * 400), (1, 1, "a", "short")], "query int, rank int, doc string, text string")
    r = answering.assembled_contexts(df, 200).collect()[0]
    assert r.context.startswith("[1] a\nshort\n\n[2] b\n") and len(r.context) <= 200 and (r.n_blocks, r.n_cut) == (2, 1)


def test_samples_don_t_depend_on_partitioning(spark):
    df = spark.createDataFrame([(f"k{i:03d}", "ab"[i % 2]) for i in range(300)], "k string, s string")
    a, b = ({tuple(r) for r in sampling.stratified_sample(df.repartition(n), "s", "k", 5, 1).collect()} for n in (1, 6))
    assert a == b and len(a) == 10
    assert sampling.quota({"x": 3, "y": 50}, 20, {"x": 0.5, "y": 0.5}) == {"x": 3, "y": 17}
    screen = spark.createDataFrame([("a", 3.0, 1.0, False), ("b", 2.0, 1.0, True), ("c", 1.0, -1.0, False), ("d", 0.5, 0.1, False)], "n string, g double, u double, v boolean")
    assert {r.n for r in sampling.halving(screen, "n", "g", "u", "v").collect()} == {"a", "d"}


def test_located_quotes_against_brute_force(spark):
    from minutario.operators.locate import located

    data = [("a", "Él abrió la caja. ÉL  ABRIÓ la caja.", "él abrió la caja"), ("b", "short", "short"), ("c", None, "x"), ("d", "aaa", "aa"), ("e", "one two", "three"), ("f", "one", None), ("g", "x  straße y", "STRASSE")]

    def brute(text, quote):
        fold = lambda t: " ".join(t.casefold().split())
        spans = [(i, j) for i in range(len(text)) for j in range(i + 1, len(text) + 1) if fold(text[i:j]) == fold(quote) and text[i:j] == text[i:j].strip()]
        apart, end = 0, 0
        for i, j in spans:
            apart, end = (apart + 1, j) if i >= end else (apart, end)
        return (*spans[0], apart) if spans else (-1, -1, 0)

    df = spark.createDataFrame(data, "k string, t string, q string")
    got = {r.k: (r.start, r.end, r.occurrences) for r in located(df, "k", "t", "q").collect()}
    assert got == {k: brute(t, q) if t and q else (-1, -1, 0) for k, t, q in data}
    assert got["a"] == (0, 16, 2) and got["d"] == (0, 2, 1)


def test_every_decision_has_its_sentence_located(spark, folder):
    from minutario.plans.common import decisions
    from minutario.plans.registry import queries

    got = queries()["j26_sentence_in_evidence"](spark, folder)
    assert got.count() == decisions(spark, folder).count()
    assert set(got.columns) == {"decision_id", "start", "end", "occurrences"}


def test_turn_search_reaches_late_turns_and_acts_are_tested(spark):
    from minutario.operators.transcripts import found_turns, turns_with_acts

    t = spark.createDataFrame([(1, "a Sensor", 10, ["x"]), (2, "the sensor", 35615, ["y", "z"]), (3, "no", 20, []), (4, "sensor", None, None)], "k int, text string, at int, acts array<string>")
    keys = lambda df: {r.k for r in df.collect()}
    assert keys(found_turns(t, "text", "at", "SENSOR")) == {1, 2, 4}
    assert keys(found_turns(t, "text", "at", "sensor", (0, 5000))) == {1}
    assert keys(found_turns(t, "text", "at", None, (10, 20))) == {1, 3}
    assert keys(turns_with_acts(t, "acts", ["z", "q"])) == {2}
    assert keys(turns_with_acts(t, "acts", [])) == set()
