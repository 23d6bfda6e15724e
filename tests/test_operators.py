import itertools
import math
import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from minutario.functions import scalar as S
from minutario.functions.text import ascii_words, decision_id, decision_terms, plain_label
from minutario.operators import agreement, alignment, budget, intervals, pairs, retrieval, spans, stats, validation
from minutario.versions import latest


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column.alias("x")).collect()[0].x


def test_latest_takes_the_newest_and_breaks_ties_by_columns(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("a", 2, "z"), ("b", None, None), (None, 9, "q")], "k string, ingested_at int, v string")
    assert {tuple(r) for r in latest(df, "k", ["k", "v"]).collect()} == {("a", "z"), ("b", None)}


def test_text_functions(spark):
    assert one(spark, decision_id(F.col("t")), t=" \tis1009A.D05 ") == "IS1009a.d05"
    assert one(spark, plain_label(F.col("t"), ["no_decision"]), t=" NO Decisión. ") == "no_decision"
    assert one(spark, ascii_words(F.col("t")), t="Ñandú 2x, café ñandu") == ["2x", "cafe", "nandu"]
    assert one(spark, decision_terms(F.col("t")), t="The control will be the approx.") == ["approx", "control"]


@settings(max_examples=20, deadline=None)
@given(st.lists(st.tuples(st.sampled_from("ABC"), st.sampled_from("abcdx"), st.sets(st.sampled_from("pqrstuv"), max_size=5)), max_size=14), st.sampled_from([(0.3, 2), (0.5, 1), (0.75, 3)]))
def test_candidates_equal_the_scored_universe(spark, rows, point):
    t, m = point
    df = spark.createDataFrame([(f"d{i}", s, s + x, sorted(w)) for i, (s, x, w) in enumerate(rows)], "id string, series_id string, meeting_id string, terms array<string>")
    wanted = {
        (f"d{i}", f"d{j}") for (i, (s, x, w)), (j, (q, y, v)) in itertools.permutations(enumerate(rows), 2)
        if s == q and "x" not in (x, y) and x < y and len(w & v) >= m and len(w & v) / min(len(w), len(v)) >= t
    }
    assert {(r.earlier, r.later) for r in pairs.scored_candidates(df, t, m).collect()} == wanted
    universe = {r.series_id: r.universe for r in pairs.universe_size(df).collect()}
    full = {r.series_id: r["count"] for r in pairs.chronological_pairs(df).groupBy("series_id").count().collect()}
    assert {k: v for k, v in universe.items() if v} == full


def test_candidates_counts_and_members_by_blocks(spark, monkeypatch):
    """Blocks of 7 items, tiles of 5 cells and products of 3 terms give the pairs, counts and members of the universe."""
    for name, value in (("BLOCK", 7), ("TILE", 5), ("TERMS_AT_ONCE", 3)):
        monkeypatch.setattr(pairs, name, value)
    draw = random.Random(3)
    rows = [(f"d{i}", s, s + draw.choice("abcdx"), draw.sample("pqrstuvw", draw.randrange(6))) for s, n in (("A", 50), ("B", 7), ("C", 8), ("D", 1)) for i in range(100 * ord(s), 100 * ord(s) + n)]
    df = spark.createDataFrame([*rows, ("e", None, "Aa", ["p", "q"]), (None, "A", "Aa", ["p", "q"])], "id string, series_id string, meeting_id string, terms array<string>")
    universe = pairs.chronological_pairs(df).where("later is not null").select("series_id", "earlier", "later", F.size(F.array_intersect("ta", "tb")).alias("shared"), F.least(F.size("ta"), F.size("tb")).alias("smaller"))
    for t, m in ((0.3, 2), (0.6, 1)):
        wanted = [r for r in universe.collect() if r.earlier and r.smaller and r.shared >= m and r.shared / r.smaller >= t]
        assert sorted((r.earlier, r.later, r.shared) for r in pairs.scored_candidates(df, t, m).collect()) == sorted((r.earlier, r.later, r.shared) for r in wanted) != []
        counts = Counter((r.series_id, r.smaller, r.shared) for r in wanted)
        assert {(r.series_id, r.smaller, r.shared): r.n for r in pairs.candidate_counts(df, t, m).collect()} == counts
        members = pairs.candidate_members(df, t, m).collect()
        assert {r.id for r in members if r.earlier} == {r.earlier for r in wanted} and {r.id for r in members if r.later} == {r.later for r in wanted}
    assert pairs.candidate_counts(df.where("false")).count() == pairs.scored_candidates(df.where("false")).count() == 0


def test_set_similarity_of_empty_sets(spark):
    df = spark.createDataFrame([(["a", "b"], ["b"]), ([], ["b"]), ([], [])], "a array<string>, b array<string>")
    got = df.select(pairs.overlap_coefficient(F.col("a"), F.col("b")), pairs.jaccard(F.col("a"), F.col("b"))).collect()
    assert [tuple(r) for r in got] == [(1.0, 0.5), (0.0, 0.0), (0.0, 0.0)]


def test_kappa_conventions(spark):
    df = spark.createDataFrame([("x", "x"), ("x", "y"), ("y", "y"), (None, "x")], "a string, b string")
    r = agreement.kappa(df, "a", "b").collect()[0]
    assert (r.n, round(r.kappa, 6)) == (3, 0.4)
    assert agreement.kappa(df.where("a = 'x' and b = 'x'"), "a", "b").collect()[0].kappa is None
    assert agreement.kappa(df.where("false"), "a", "b").count() == 0


def test_wilson_of_five_in_eleven(spark):
    low, high = intervals.wilson(F.lit(5 / 11), F.lit(11))
    r = spark.range(1).select(low.alias("l"), high.alias("h")).collect()[0]
    assert (round(r.l, 4), round(r.h, 4)) == (0.2127, 0.7199) or (round(r.l, 3), round(r.h, 3)) == (0.213, 0.720)


def test_bootstrap_is_the_same_for_any_partitioning(spark):
    rows = [("g", f"u{i % 9}", float(i % 7)) for i in range(60)]
    df = spark.createDataFrame(rows, "g string, u string, v double")
    a, b = (intervals.bootstrap_means(df.repartition(n), "g", "u", "v", n=100).collect() for n in (1, 5))
    assert a == b and a[0].lower <= a[0].point <= a[0].upper


@settings(max_examples=80, deadline=None)
@given(st.integers(0, 4), st.integers(0, 4), st.integers(0, 10_000))
def test_alignment_equals_exhaustive_search(n, m, seed):
    matrix = np.random.default_rng(seed).integers(0, 10, (n, m)) / 10
    got = alignment.aligned(matrix, 0.5)
    best = (0, 0.0)
    for k in range(min(n, m), 0, -1):
        totals = [sum(matrix[i, j] for i, j in zip(r, c)) for r in itertools.combinations(range(n), k) for c in itertools.permutations(range(m), k) if all(matrix[i, j] >= 0.5 for i, j in zip(r, c))]
        if totals:
            best = (k, max(totals))
            break
    assert len(got) == best[0] and math.isclose(sum(s for *_, s in got), best[1], abs_tol=1e-9)
    assert len({i for i, *_ in got}) == len({j for _, j, _ in got}) == len(got)


def test_align_groups(spark):
    df = spark.createDataFrame([("g", 0, 0, 0.95), ("g", 0, 1, 0.1), ("g", 1, 0, 0.9), ("g", 1, 1, 0.85), ("h", 0, 0, None)], "g string, p int, r int, s double")
    got = {tuple(r) for r in alignment.align_groups(df, "g", "p", "r", "s", [0.5]).collect()}
    assert got == {("g", 0.5, 0, 0, 0.95), ("g", 0.5, 1, 1, 0.85)}


def test_bm25_worked_example(spark):
    docs = spark.createDataFrame([("a", "banana apple"), ("b", "banana banana apple"), ("c", "cherry grape melon"), ("d", "kiwi")], "id string, text string")
    asked = spark.createDataFrame([(1, "Cherry")], "q int, text string")
    r = retrieval.bm25(docs, "id", "text", asked, "q", "text").collect()
    assert [(x.query, x.doc) for x in r] == [(1, "c")]
    assert math.isclose(r[0].score, math.log(3.5 / 1.5) * 2.5 / (1 + 1.5 * (0.25 + 0.75 * 3 / 2.25)))


def test_rank_fusion_worked_example(spark):
    channel = lambda ids: spark.createDataFrame([(1, d, n) for n, d in enumerate(ids, 1)], "query int, doc string, rank int")
    fused = retrieval.top_k(retrieval.reciprocal_rank_fusion([channel("abc"), channel("bcd")]), 9, "doc").orderBy("rank").collect()
    assert [r.doc for r in fused] == ["b", "c", "a", "d"] and math.isclose(fused[0].score, 1 / 62 + 1 / 61)


def test_spans(spark):
    df = spark.createDataFrame([("g", 0, 5), ("g", 4, 8), ("g", 8, 9), ("g", 20, 30), ("h", 1, 2), ("h", None, 3)], "g string, s int, e int")
    assert {tuple(r) for r in spans.merged_spans(df, ["g"], "s", "e").collect()} == {("g", 0, 9, 3), ("g", 20, 30, 1), ("h", 1, 2, 1)}
    assert {tuple(r) for r in spans.merged_spans(df, ["g"], "s", "e", -1).collect()} == {("g", 0, 8, 2), ("g", 8, 9, 1), ("g", 20, 30, 1), ("h", 1, 2, 1)}
    runs = spark.createDataFrame([("g", i) for i in (1, 2, 3, 7, 8, 3)], "g string, i int")
    assert {tuple(r) for r in spans.consecutive_runs(runs, ["g"], "i").collect()} == {("g", 1, 3, 3), ("g", 7, 8, 2)}


def test_overlap_join_equals_nested_loops(spark):
    rng = random.Random(2)
    span = lambda: (a := rng.randrange(100), a + rng.randrange(0, 30))
    x, y = [("g", i, *span()) for i in range(40)], [("g", i, *span()) for i in range(40)]
    a, b = spark.createDataFrame(x, "g string, i int, s int, e int"), spark.createDataFrame(y, "g string, j int, t int, f int")
    wanted = {(i, j) for _, i, s, e in x for _, j, t, f in y if s < e and t < f and s < f and t < e}
    got = [(r.i, r.j) for r in spans.overlap_join(a, b, ["g"], ("s", "e"), ("t", "f"), 7).collect()]
    assert set(got) == wanted and len(got) == len(wanted)


def test_nearest(spark):
    a = spark.createDataFrame([("g", 1, 10), ("g", 2, 14), ("g", 3, 15), ("h", 4, 1)], "g string, k int, t int")
    b = spark.createDataFrame([("g", 11), ("g", 17)], "g string, o int")
    assert {(r.k, r.nearest, r.gap) for r in spans.nearest(a, b, ["g"], "k", "t", "o").collect()} == {(1, 11, 1), (2, 11, 3), (3, 17, 2), (4, None, None)}


def test_descriptions(spark):
    df = spark.createDataFrame([(float(v),) for v in (1, 2, 2.5, 4, 9, 9.5, 30)] + [(None,)], "v double")
    r = stats.describe_numeric(df, ["v"]).collect()[0]
    assert (r.n, round(r.skewness, 4), round(r.excess_kurtosis, 4)) == (7, 2.0837, 4.6386)
    assert stats.describe_numeric(df.where("false"), ["v"]).count() == 0


def test_kruskal_and_tail(spark):
    df = spark.createDataFrame([("a", v) for v in (1.0, 2.0, 3.0)] + [("b", v) for v in (4.0, 5.0, 6.0)], "g string, v double")
    assert math.isclose(stats.kruskal(df, "v", "g").collect()[0].h, 27 / 7)
    assert math.isclose(stats.chi_square_tail(3.841458820694124, 1), 0.05, rel_tol=1e-9)
    assert math.isclose(stats.chi_square_tail(40.0, 30), 0.104864, rel_tol=1e-3)


def test_benjamini_hochberg(spark):
    df = spark.createDataFrame([("a", 0.01), ("b", 0.04), ("c", 0.03), ("d", 0.5)], "t string, p double")
    got = {r.t: round(r.q, 4) for r in stats.benjamini_hochberg(df, "t", "p").collect()}
    assert got == {"a": 0.04, "b": 0.0533, "c": 0.0533, "d": 0.5}


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 60), max_size=8), st.integers(-3, 200))
def test_fair_shares(sizes, limit):
    shares = budget.fair_shares(sizes, limit)
    assert sum(shares) == min(sum(sizes), max(limit, 0)) and all(0 <= s <= n for s, n in zip(shares, sizes))
    cut = [s for s, n in zip(shares, sizes) if s < n]
    assert not cut or max(cut) - min(cut) <= 1


def test_budget_worked_examples():
    assert budget.fair_shares([5, 500, 500], 105) == [5, 50, 50] and budget.fair_shares([0, 100], 1) == [0, 1]
    assert budget.line_windows("aaaa\nbbbb\ncccc\n\ndddd", 10) == ["aaaa\nbbbb", "cccc\n", "dddd"]
    assert budget.even_excerpt("aaaa bbbb cccc dddd", 10, ["aaaa", "bbbb", "cccc", "dddd"], "~") == ("aaaa~dddd", True)


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="ab\n", max_size=60), st.integers(1, 15))
def test_line_windows_are_lossless(text, target):
    assert "\n".join(budget.line_windows(text, target)) == text


def test_validation(spark):
    df = spark.createDataFrame([(1, "a", None), (2, None, "x")], "k int, a string, b string")
    assert {tuple(r) for r in validation.issues(df, "k", {"no_a": F.col("a").isNull(), "no_b": F.col("b").isNull()}).collect()} == {(1, "no_b"), (2, "no_a")}
    other = spark.createDataFrame([(1, "a", "z"), (3, None, None)], "k int, a string, b string")
    assert {tuple(r) for r in validation.changed_rows(df, other, "k", ["a", "b"]).collect()} == {(1, "changed", "b"), (2, "missing", None), (3, "added", None)}
    assert {r.k for r in validation.upsert(df, other, "k").collect()} == {1, 2, 3}


@pytest.mark.parametrize(("day", "wanted"), [("2024-07-17", "2024-07-17"), ("01/12/24", "2024-12-01"), ("1-2-2023", "2023-02-01"), ("31-02-2023", None), ("soon", None), (None, None)])
def test_days(spark, day, wanted):
    df = spark.createDataFrame([(day,)], "d string").select(S.parsed_day(F.col("d")).cast("string").alias("x"))
    assert df.collect()[0].x == wanted


def test_evidence_cells_and_citations(spark):
    cell = F.lit("IS1009a:d1;d2 | IS1009b:d3||")
    assert one(spark, S.evidence_cell(S.evidence_spans(cell)), t="") == "IS1009a:d1;d2|IS1009b:d3"
    assert one(spark, S.citation_numbers(F.col("t"), 5), t="a [3, 1] b [9] [1]") == [1, 3]
    assert one(spark, S.href_ids(F.col("t")), t="f.xml#id(a.1)..id(a.4)") == ["a.1", "a.4"]
    assert one(spark, S.bin_low(F.col("t"), 0.05), t=0.15000000000000002) == 0.15


def test_outlier_flags_of_four_methods(spark):
    import numpy as np

    from minutario.operators.stats import line_outliers
    from minutario.plans.more import outlier_flags

    rng = np.random.default_rng(7)
    v = np.round(np.r_[rng.normal(0, 1, 150), rng.normal(9, 0.05, 45), [4.5, 4.6, 30.0, 9.0, 9.0]], 2)
    df = spark.createDataFrame([(i, float(x)) for i, x in enumerate(v)] + [(900, None)], "k long, v double")
    got = {r.k: r for r in outlier_flags(df, "k", "v").collect()}
    assert got[197].methods == "zscore,lof,mcd" or got[197].methods == "zscore,iqr,lof,mcd"
    assert "lof" in got[195].methods and "zscore" not in got[195].methods
    assert 900 not in got and max(r.n_methods for r in got.values()) > 2

    x = (v - v.mean()) / v.std()
    d = np.abs(x[:, None] - x[None])
    np.fill_diagonal(d, np.inf)
    near = np.lexsort((np.broadcast_to(x, d.shape), np.round(d, 12)), axis=1)[:, :20]
    radius = np.take_along_axis(d, near[:, -1:], 1)[:, 0]
    density = 1 / (np.maximum(np.take_along_axis(d, near, 1), radius[near]).mean(1) + 1e-10)
    lof = density[near].mean(1) / density
    h = -(-(len(x) + 2) // 2)
    s = np.sort(x)
    width = s[h:] - s[: len(s) - h]
    at = np.where(np.isclose(width, width.min(), atol=1e-12))[0]
    centre = (0.5 * (s[h + at] + s[at])).mean()
    raw = (x - centre) ** 2
    raw = raw / np.median(raw) * 0.45493642311957283
    core = x[raw < 5.023886187314888]
    robust = (x - core.mean()) ** 2 / core.var()
    by = {r.v: r for r in line_outliers(df, "v").collect()}
    assert np.allclose([by[float(y)].robust_sq for y in v], robust, rtol=1e-6)
    assert np.allclose([by[float(y)].lof for y in v], lof, rtol=0.1)  # neighbours at equal distance differ by rounding
    assert sum(by[float(y)].lof_flag for y in v) == 10


def test_hybrid_modes_dense_search_and_passage_recall(spark):
    docs = spark.createDataFrame([("a", "red lamp on the long wooden table"), ("b", "blue lamp under a chair"), ("c", "nothing of this kind"), ("d", None)], "doc string, text string")
    asked = spark.createDataFrame([(1, "wooden table"), (2, None)], "q long, t string")
    dense = retrieval.dense_search(docs, "doc", "text", asked, "q", "t", lambda texts: [[t.count("table"), t.count("lamp"), 0.0] for t in texts])
    assert [(r.doc, r.score) for r in dense.orderBy("rank").collect()] == [("a", 0.70710678), ("b", 0.0), ("c", 0.0), ("d", 0.0)]
    lexical = spark.createDataFrame([(1, "b", 2.0), (1, "a", 1.0), (1, "c", -1.0)], "query long, doc string, score double")
    rows = {m: [(r.doc, r.lexical_rank, r.dense_rank) for r in retrieval.hybrid(lexical, dense.drop("rank"), 3, m).orderBy("rank").collect()] for m in retrieval.RETRIEVAL_MODES}
    assert rows["hybrid"] == [("a", 2, 1), ("b", 1, 2), ("c", None, 3)]
    assert rows["bm25"] == [("b", 1, None), ("a", 2, None)]
    assert rows["dense"] == [("a", None, 1), ("b", None, 2), ("c", None, 3)]
    with pytest.raises(ValueError):
        retrieval.hybrid(lexical, lexical, 3, "other")
    gold = spark.createDataFrame([(1, "lamp on the long wooden table today"), (2, "never retrieved at all by it")], "q long, p string")
    got = retrieval.passage_recall(retrieval.hybrid(lexical, dense.drop("rank"), 3, "bm25"), docs, "doc", "text", gold, "q", "p", (1, 2))
    assert {(r.k, r.n_queries, r.mean_recall) for r in got.collect()} == {(1, 2, 0.0), (2, 2, 0.333333)}


def test_merged_passages_join_windows_that_meet_and_mark_gaps(spark):
    turns = spark.createDataFrame([(m, i, f"A: {m}{i}") for m in ("m1", "m2") for i in range(10)], "m string, i int, line string")
    hits = spark.createDataFrame([("x", "m1", 0), ("x", "m1", 3), ("x", "m1", 8), ("x", "m2", 5), ("y", "m2", 99)], "k string, m string, i int")
    got = retrieval.merged_passages(turns, hits, "k", "m", "i", "line", 1).collect()
    lines = lambda m, *at: "\n".join(f"A: {m}{i}" for i in at)
    assert [(r.k, r.passage) for r in got] == [("x", f"[m1]\n{lines('m1', 0, 1, 2, 3, 4)}\n[...]\n{lines('m1', 7, 8, 9)}\n\n[m2]\n{lines('m2', 4, 5, 6)}")]


def test_lexical_search_equals_the_best_of_bm25_in_batches(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "DOCUMENTS_AT_ONCE", 3)
    texts = ["table lamp", "lamp lamp chair", "red table", "", None, "table table table lamp", "green chair", "lamp red", "blue", "table lamp"]
    docs = spark.createDataFrame([(f"d{i}", t) for i, t in enumerate(texts)], "doc string, text string")
    asked = spark.createDataFrame([(1, "table lamp lamp"), (2, "blue chair"), (3, "unheard"), (4, None)], "q long, t string")
    got = retrieval.lexical_search(docs, "doc", "text", asked, "q", "t", 4)
    scored = retrieval.bm25(docs, "doc", "text", asked, "q", "t").withColumn("score", F.round("score", 8))
    wanted = retrieval.top_k(scored.where("score > 0"), 4, "doc")
    assert got.columns == wanted.columns
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in wanted.collect()} != set()
    assert retrieval.lexical_search(docs.where("false"), "doc", "text", asked, "q", "t", 4).count() == 0
    assert retrieval.lexical_search(docs, "doc", "text", asked.where("false"), "q", "t", 4).count() == 0


def test_local_outliers_with_ties_whatever_the_order(spark):
    """Equal to all distances with ties by key, for any order of the rows; many points share a place."""
    draw = random.Random(1)
    rows = [(g, f"{g}{i:03d}", float(draw.randrange(6)), float(draw.randrange(4))) for g, n in (("a", 90), ("b", 3), ("c", 1), ("d", 6)) for i in range(n)] + [("a", "far", 40.0, 40.0), ("b", "none", None, 1.0)]
    wanted = {}
    for g in "abcd":
        own = sorted(r for r in rows if r[0] == g and None not in r)
        x = np.array([r[2:] for r in own])
        k = min(5, len(own) - 1)
        if k < 1:
            wanted |= {r[1]: 1.0 for r in own}
            continue
        d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
        np.fill_diagonal(d, np.inf)
        near = np.argsort(d, 1, kind="stable")[:, :k]
        density = 1 / np.maximum(np.maximum(np.take_along_axis(d, near, 1), np.sort(d, 1)[:, k - 1][near]).mean(1), 1e-10)
        wanted |= dict(zip([r[1] for r in own], density[near].mean(1) / density))
    for seed in (1, 2):
        random.Random(seed).shuffle(rows)
        df = spark.createDataFrame(rows, "g string, k string, a double, b double").coalesce(1)
        assert {r.k: round(r.factor, 9) for r in stats.local_outlier_factors(df, "g", "k", ["a", "b"], 5).collect()} == {k: round(v, 9) for k, v in wanted.items()}


def test_kruskal_of_three_million_rows(spark):
    df = spark.range(3_000_000).select((F.col("id") % 3).alias("g"), (F.col("id") % 7).cast("double").alias("v"))
    r = stats.kruskal(df, "v", "g").collect()[0]
    assert (r.n, r.n_groups) == (3_000_000, 3) and abs(r.h) < 1e-3
