"""Comparisons of runs."""

from minutario.operators import runs


def test_same_order_needs_the_same_ids_in_the_same_order(spark):
    a = spark.createDataFrame([("q1", "x", 1), ("q1", "y", 2), ("q2", "x", 1), ("q2", "y", 2), ("q3", "x", 1), ("q4", "x", 1)], "q string, c string, p int")
    b = spark.createDataFrame([("q1", "x", 1), ("q1", "y", 2), ("q2", "y", 1), ("q2", "x", 2), ("q3", "z", 1), ("q5", "x", 1)], "q string, c string, p int")
    assert {r.q: r.equal for r in runs.same_order(a, b, "q", "c", "p").collect()} == {"q1": True, "q2": False, "q3": False, "q4": False, "q5": False}


def test_best_passage_by_coverage_then_length_then_place(spark):
    text = "red lamp\n\nblue   table\nred lamp\ngreen chair\nlamp red"
    data = [(1, "red lamp", text), (2, "table chair", text), (3, "table lamp chair", text), (4, "the", text), (5, "red", None), (6, "word", "word " * 200), (7, "25 euros", "it costs euros\nit costs 25 euros\n25 euros")]
    got = {r.k: (r.passage, round(r.coverage, 6)) for r in runs.best_passages(spark.createDataFrame(data, "k int, r string, s string"), "k", "r", "s").collect()}
    assert got[1] == ("red lamp", 1.0)
    assert got[2] == ("blue   table red lamp green chair", 1.0)
    assert got[3] == ("blue   table red lamp green chair", 1.0)
    assert got[4] == ("red lamp", 0.0) and got[5] == ("", 0.0)
    assert got[7] == ("25 euros", 1.0)
    assert len(got[6][0]) <= 600 and got[6][0].endswith("word…")


def test_spans_surviving_trimming_move_forward(spark):
    left = runs.ELISION_MARKER.join(["ab", "ab", "zz", "d"])
    df = spark.createDataFrame([(1, "ab cab d", 100, left), (2, "whole", 5, "whole"), (3, None, 0, "x")], "k int, t string, s int, l string")
    assert [tuple(r) for r in runs.surviving_spans(df, "k", "t", "s", "l").orderBy("k", "char_start").collect()] == [(1, 100, 102), (1, 104, 106), (1, 107, 108), (2, 5, 10)]


def test_swap_bar_pools_medians_and_is_void_on_failure(spark):
    both = "qwen3:8b gemma4:26b-a4b"
    rows = [("a", 0, 9.0, 0, None), ("a", 1, 2.0, 0, None), ("a", 2, 4.0, 0, None), ("b", 0, 20.0, 0, both), ("b", 1, 4.0, 0, "qwen3:8b"), ("b", 2, 5.0, 0, None), ("b", 0, 30.0, 0, both)]
    schema = "arm string, q int, seconds double, rc int, ps string"
    bar = runs.swap_bar(spark.createDataFrame(rows, schema)).first()
    assert tuple(bar) == (9.0, 25.0, 3.0, 4.5, 1.5, 0, 2, 4, True)
    assert not runs.swap_bar(spark.createDataFrame(rows + [("a", 3, 3.0, 1, None)], schema)).first().passes
    assert not runs.swap_bar(spark.createDataFrame(rows[:3], schema)).first().passes
