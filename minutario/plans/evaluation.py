"""Scores, screens, samples and simulations."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from minutario.functions import scalar as S
from minutario.functions.text import plain_label
from minutario.operators import budget, intervals, power, runs, sampling, stats
from minutario.operators.agreement import precision_recall_f1
from minutario.plans.common import ADJUDICATIONS, CANDIDATES, CHUNKS, DECISIONS, REVIEWS, adjudications, candidates, chunks, decisions, label_sql, reviews, rounded, table
from minutario.plans.registry import query
from minutario.plans.records import DAY_SQL, PARSED, meetings
from minutario.plans.statistics import round_all
from minutario.schemas import RELATION_LABELS, STATUS_LABELS, TYING_RELATIONS

TIED_SQL = f"{label_sql('final_relation')} in ('reafirma', 'refina', 'revierte', 'reemplaza')"
GOLD_SQL = f"{label_sql('final_relation')} in ({', '.join(repr(x) for x in RELATION_LABELS)})"


def _gold(spark: SparkSession, folder: str) -> DataFrame:
    relation = plain_label(F.col("final_relation"), RELATION_LABELS)
    return candidates(spark, folder).withColumn("relation", relation).withColumn("tied", relation.isin(TYING_RELATIONS)).where("relation is not null")


TAUS = [0.1, 0.2, 0.3, 0.4, 0.5]


@query(
    "m36_score_curve",
    f"""with g as (select blocker_score as s, {TIED_SQL} as tied from {CANDIDATES} where {GOLD_SQL} and blocker_score between 0 and 1),
    c as (select t, count(*) filter (s >= t and tied) as tp, count(*) filter (s >= t and not tied) as fp, count(*) filter (s < t and tied) as fn from g cross join (values {', '.join(f'({t}::double)' for t in TAUS)}) as v(t) group by t)
    select t as tau, tp, round(case when tp + fp > 0 then tp / (tp + fp) else 0.0 end, 6) as "precision", round(case when tp + fn > 0 then tp / (tp + fn) else 0.0 end, 6) as recall, round(case when tp > 0 then 2 * (tp / (tp + fp)) * (tp / (tp + fn)) / (tp / (tp + fp) + tp / (tp + fn)) else 0.0 end, 6) as f1 from c""",
)
def m36(spark: SparkSession, folder: str) -> DataFrame:
    g = _gold(spark, folder).where("blocker_score between 0 and 1")
    s = F.col("blocker_score")
    cells = g.agg(*[F.struct(F.lit(t).alias("tau"), F.count_if((s >= t) & F.col("tied")).alias("tp"), F.count_if((s >= t) & ~F.col("tied")).alias("fp"), F.count_if((s < t) & F.col("tied")).alias("fn")).alias(f"c{k}") for k, t in enumerate(TAUS)])
    c = cells.select(F.explode(F.array(*cells.columns)).alias("c")).select("c.*")
    p, r, f1 = precision_recall_f1(F.col("tp"), F.col("fp"), F.col("fn"))
    return c.select("tau", "tp", rounded(p).alias("precision"), rounded(r).alias("recall"), rounded(f1).alias("f1"))


@query("m19_relation_scores", f"select count(*) as n, count(*) filter (g = f) as equal, count(*) filter ((g <> 'no_relacionada') = (f <> 'no_relacionada')) as same_existence, round(count(*) filter (g = f) / count(*), 6) as accuracy, round(count(*) filter (g = f and f <> 'no_relacionada') / nullif(count(*) filter (g <> 'no_relacionada' and f <> 'no_relacionada'), 0), 6) as type_accuracy from (select {label_sql('gm_relation')} as g, {label_sql('final_relation')} as f from {CANDIDATES}) where g in ({', '.join(repr(x) for x in RELATION_LABELS)}) and f in ({', '.join(repr(x) for x in RELATION_LABELS)})")
def m19(spark: SparkSession, folder: str) -> DataFrame:
    x = candidates(spark, folder).select(plain_label(F.col("gm_relation"), RELATION_LABELS).alias("g"), plain_label(F.col("final_relation"), RELATION_LABELS).alias("f")).where("g is not null and f is not null")
    eg, ef = F.col("g") != "no_relacionada", F.col("f") != "no_relacionada"
    equal = F.col("g") == F.col("f")
    return x.agg(F.count("*").alias("n"), F.count_if(equal).alias("equal"), F.count_if(eg == ef).alias("same_existence"), rounded(F.try_divide(F.count_if(equal), F.count("*"))).alias("accuracy"), rounded(F.try_divide(F.count_if(equal & ef), F.count_if(eg & ef))).alias("type_accuracy"))


@query("m13_direction_accuracy", f"select round(avg((d = 'si')::int), 6) as accuracy, count(*) as n from (select lower(trim(gm_direction_ok)) as d from {CANDIDATES}) where d in ('si', 'no')")
def m13(spark: SparkSession, folder: str) -> DataFrame:
    d = candidates(spark, folder).select(F.lower(F.trim("gm_direction_ok")).alias("d")).where("d in ('si', 'no')")
    return d.agg(rounded(F.avg((F.col("d") == "si").cast("int"))).alias("accuracy"), F.count("*").alias("n"))


def _status(p: str) -> str:
    return f"case when {label_sql(p + '_status')} in ({', '.join(repr(x) for x in STATUS_LABELS)}) then {label_sql(p + '_status')} end"


@query("m24_annotator_fields", " union all ".join(f"select '{p}' as annotator, count(*) as n, round(avg((a = f)::int), 6) as accuracy, round(count(*) filter (f <> 'decision' and a <> 'decision') / nullif(count(*) filter (f <> 'decision'), 0), 6) as negative_recall from (select {_status(p)} as a, {_status('final')} as f from {ADJUDICATIONS}) where a is not null and f is not null" for p in ("gm", "gv", "ka")))
def m24(spark: SparkSession, folder: str) -> DataFrame:
    final = plain_label(F.col("final_status"), STATUS_LABELS)
    cells = F.explode(F.array(*[F.struct(F.lit(p).alias("annotator"), plain_label(F.col(f"{p}_status"), STATUS_LABELS).alias("a")) for p in ("gm", "gv", "ka")])).alias("c")
    x = adjudications(spark, folder).select(final.alias("f"), cells).select("f", "c.*").where("a is not null and f is not null")
    negative = F.col("f") != "decision"
    return x.groupBy("annotator").agg(F.count("*").alias("n"), rounded(F.avg((F.col("a") == F.col("f")).cast("int"))).alias("accuracy"), rounded(F.try_divide(F.count_if(negative & (F.col("a") != "decision")), F.count_if(negative))).alias("negative_recall"))


@query("m27_consistency", f"select count(*) as n, count(*) filter (k = 1) as consistent, round(count(*) filter (k = 1) / count(*), 6) as share from (select decision_id, len(list_distinct(list_filter([{_status('gm')}, {_status('gv')}, {_status('ka')}], lambda x: x is not null))) as k, len(list_filter([{_status('gm')}, {_status('gv')}, {_status('ka')}], lambda x: x is not null)) as m from {ADJUDICATIONS}) where m > 1")
def m27(spark: SparkSession, folder: str) -> DataFrame:
    given = F.array_compact(F.array(*[plain_label(F.col(f"{p}_status"), STATUS_LABELS) for p in ("gm", "gv", "ka")]))
    x = adjudications(spark, folder).select(given.alias("g")).where(F.size("g") > 1)
    same = F.size(F.array_distinct("g")) == 1
    return x.agg(F.count("*").alias("n"), F.count_if(same).alias("consistent"), rounded(F.try_divide(F.count_if(same), F.count("*"))).alias("share"))


_FOUND = "list_transform(list_filter(string_split(objetos_de_la_base, ' | '), lambda x: contains(x, ', recuperado')), lambda x: split_part(x, ' ', 1))"
_ALL = "list_transform(string_split(objetos_de_la_base, ' | '), lambda x: split_part(x, ' ', 1))"


@query("m20_retrieved_variants", f"select pregunta_id, len(list_intersect(f, a)) > 0 as any_hit, round(len(list_distinct(f)) / len(list_distinct(a)), 6) as recall from (select pregunta_id, {_FOUND} as f, {_ALL} as a from {REVIEWS} where objetos_de_la_base is not null and objetos_de_la_base <> '')")
def m20(spark: SparkSession, folder: str) -> DataFrame:
    cells = F.split("objetos_de_la_base", r" \| ")
    name = lambda x: F.split_part(x, F.lit(" "), F.lit(1))
    x = reviews(spark, folder).where("objetos_de_la_base is not null and objetos_de_la_base <> ''").select("pregunta_id", F.transform(F.filter(cells, lambda c: c.contains(", recuperado")), name).alias("f"), F.transform(cells, name).alias("a"))
    return x.select("pregunta_id", F.arrays_overlap("f", "a").alias("any_hit"), rounded(F.size(F.array_distinct("f")) / F.size(F.array_distinct("a"))).alias("recall"))


@query("p20_stage_cascade", f"select pregunta_id, case when not in_base then 'extraction' when not found then 'retrieval' else 'synthesis' end as stage from (select pregunta_id, coalesce(objetos_de_la_base, '') <> '' as in_base, contains(coalesce(objetos_de_la_base, ''), ', recuperado') as found from {REVIEWS})")
def p20(spark: SparkSession, folder: str) -> DataFrame:
    base = F.coalesce("objetos_de_la_base", F.lit(""))
    return reviews(spark, folder).select("pregunta_id", F.when(base == "", "extraction").when(~base.contains(", recuperado"), "retrieval").otherwise("synthesis").alias("stage"))


@query("p09_dated_direction", f"with m as (select meeting_id, series_id, min({PARSED}) as d from meetings group by 1, 2) select a.meeting_id as first, b.meeting_id as second, case when a.d is null or b.d is null then 'unknown' when a.d < b.d then 'forward' when a.d > b.d then 'backward' else 'equal' end as direction from m a join m b on a.series_id = b.series_id and a.meeting_id < b.meeting_id")
def p09(spark: SparkSession, folder: str) -> DataFrame:
    m = meetings(spark, folder).groupBy("meeting_id", "series_id").agg(F.min(S.parsed_day(F.col("date_only"))).alias("d"))
    a, b = m.select(F.col("meeting_id").alias("first"), "series_id", F.col("d").alias("x")), m.select(F.col("meeting_id").alias("second"), "series_id", F.col("d").alias("y"))
    direction = F.when(F.col("x").isNull() | F.col("y").isNull(), "unknown").when(F.col("x") < F.col("y"), "forward").when(F.col("x") > F.col("y"), "backward").otherwise("equal")
    return a.join(b, "series_id").where("first < second").select("first", "second", direction.alias("direction"))


@query("r15_context_passages", f"select chunk_id, coalesce(lag(chunk_id) over w || ' > ', '') || chunk_id || coalesce(' > ' || lead(chunk_id) over w, '') as passage from {CHUNKS} window w as (partition by meeting_id order by chunk_id)")
def r15(spark: SparkSession, folder: str) -> DataFrame:
    w = W.partitionBy("meeting_id").orderBy("chunk_id")
    around = F.array_join(F.array_compact(F.array(F.lag("chunk_id").over(w), F.col("chunk_id"), F.lead("chunk_id").over(w))), " > ")
    return chunks(spark, folder).select("chunk_id", around.alias("passage"))


def _texts(df: DataFrame, key: str, function, schema: str) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(k, *r) for k, t in zip(batch[key], batch["text"]) for r in function(t)]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")])

    return df.select(key, "text").where("text is not null").mapInPandas(run, schema)


@query("r03_line_windows")
def r03(spark: SparkSession, folder: str) -> DataFrame:
    """Whole lines packed into windows of 600 characters."""
    return _texts(table(spark, folder, "documents"), "doc_id", lambda t: [(n, len(w), w) for n, w in enumerate(budget.line_windows(t, 600))], "doc_id bigint, place int, n_chars int, window string")


@query("r04_even_excerpts")
def r04(spark: SparkSession, folder: str) -> DataFrame:
    """Excerpts of at most 800 characters that cover the document evenly."""
    return _texts(table(spark, folder, "documents"), "doc_id", lambda t: [budget.even_excerpt(t, 800, budget.line_windows(t, 200))], "doc_id bigint, excerpt string, cut boolean")


R05_SQL = f"""
with c as (
  select meeting_id, chunk_id, length(text) as n, row_number() over (partition by meeting_id order by length(text), chunk_id) as place,
    row_number() over (partition by meeting_id order by length(text) desc, chunk_id) as size_place, count(*) over (partition by meeting_id) as k,
    coalesce(sum(length(text)) over (partition by meeting_id order by length(text), chunk_id rows between unbounded preceding and 1 preceding), 0) as before
  from {CHUNKS} where text is not null
),
level as (select meeting_id, arg_min((2000 - before) // (k - place + 1), place) filter (n * (k - place + 1) + before > 2000) as low from c group by 1),
shared as (select c.*, l.low, least(n, coalesce(l.low, n)) as share, 2000 - sum(least(n, coalesce(l.low, n))) over (partition by meeting_id) as rest from c join level l using (meeting_id))
select meeting_id, chunk_id, n::bigint as asked, (share + case when n > share and size_place <= rest then 1 else 0 end)::bigint as given from shared
"""


@query("r05_fair_shares", R05_SQL)
def r05(spark: SparkSession, folder: str) -> DataFrame:
    """What each chunk gets of a budget of 2,000 characters for its meeting."""
    sized = chunks(spark, folder).where("text is not null").select("meeting_id", "chunk_id", F.length("text").alias("n"))

    def share(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("chunk_id")
        given = budget.fair_shares(frame["n"].tolist(), 2000)
        return pd.DataFrame({"meeting_id": frame["meeting_id"], "chunk_id": frame["chunk_id"], "asked": frame["n"], "given": given})

    return sized.groupBy("meeting_id").applyInPandas(share, "meeting_id string, chunk_id string, asked bigint, given bigint")


@query("l11_stratified_sample")
def l11(spark: SparkSession, folder: str) -> DataFrame:
    """Up to eight pairs of each score bin."""
    c = candidates(spark, folder).where("blocker_score between 0 and 1").select("pair_id", "blocker_score", S.bin_low(F.col("blocker_score"), 0.05).cast("string").alias("bin"))
    return sampling.stratified_sample(c, "bin", "pair_id", 8, 20240501)


@query("l16_nearest_to_centre", f"select centre, pair_id, round(blocker_score, 6) as score from {CANDIDATES} cross join (values (0.1::double), (0.3), (0.5)) as v(centre) where blocker_score between 0 and 1 qualify row_number() over (partition by centre order by round(abs(blocker_score - centre), 9), pair_id) = 1")
def l16(spark: SparkSession, folder: str) -> DataFrame:
    c = candidates(spark, folder).where("blocker_score between 0 and 1")
    gap = lambda centre: F.round(F.abs(F.col("blocker_score") - centre), 9)
    best = c.agg(*[F.min(F.struct(gap(x).alias("g"), "pair_id", "blocker_score")).alias(f"b{k}") for k, x in enumerate((0.1, 0.3, 0.5))])
    return best.select(F.explode(F.array(*[F.struct(F.lit(x).alias("centre"), F.col(f"b{k}.pair_id").alias("pair_id"), rounded(F.col(f"b{k}.blocker_score")).alias("score")) for k, x in enumerate((0.1, 0.3, 0.5))])).alias("r")).select("r.*").where("pair_id is not null")


@query("w11_stage_change", "select event_type, day, n, n - lag(n) over (partition by event_type order by day) as change from (select event_type, dayofmonth(ts) as day, count(*) as n from events group by 1, 2)")
def w11(spark: SparkSession, folder: str) -> DataFrame:
    n = table(spark, folder, "events").groupBy("event_type", F.dayofmonth("ts").cast("long").alias("day")).agg(F.count("*").alias("n"))
    return n.withColumn("change", F.col("n") - F.lag("n").over(W.partitionBy("event_type").orderBy("day")))


@query("w12_lowest_passing_bin", f"with b as (select round(floor(blocker_score / 0.05 + 1e-9) * 0.05, 4) as low, avg(({TIED_SQL})::int) as rate from {CANDIDATES} where blocker_score between 0 and 1 and {GOLD_SQL} group by 1), r as (select *, min((rate >= 0.3)::int) over (order by low desc rows unbounded preceding) as ok from b) select min(low) as low from r where ok = 1")
def w12(spark: SparkSession, folder: str) -> DataFrame:
    """From the top bin down while the majority holds. One row per bin goes through the window."""
    bins = _gold(spark, folder).where("blocker_score between 0 and 1").groupBy(F.round(S.bin_low(F.col("blocker_score"), 0.05), 4).alias("low")).agg(F.avg(F.col("tied").cast("int")).alias("rate"))
    ok = F.min((F.col("rate") >= 0.3).cast("int")).over(W.orderBy(F.desc("low")).rowsBetween(W.unboundedPreceding, 0))
    return bins.withColumn("ok", ok).where("ok = 1").agg(F.min("low").alias("low"))


@query("a72_gain_ranking", "with q as (select l_returnflag || l_linestatus as candidate, l_linenumber as check_, avg(l_discount) - (select avg(l_discount) from lineitem) as gain from lineitem group by 1, 2) select candidate, round(avg(gain), 8) as gain, bool_and(gain > -0.01) as passed from q group by 1")
def a72(spark: SparkSession, folder: str) -> DataFrame:
    line = table(spark, folder, "lineitem")
    mean = line.agg(F.avg("l_discount").alias("m"))
    q = line.groupBy(F.concat("l_returnflag", "l_linestatus").alias("candidate"), "l_linenumber").agg(F.avg("l_discount").alias("a")).crossJoin(mean).withColumn("gain", F.col("a") - F.col("m"))
    return q.groupBy("candidate").agg(rounded(F.avg("gain"), 8).alias("gain"), F.bool_and(F.col("gain") > -0.01).alias("passed"))


@query("a58_worst_cell", "with q as (select l_returnflag as model, l_linenumber as cell, avg(l_tax) as m from lineitem group by 1, 2) select model, round(avg(m), 8) as mean, round(max(m), 8) as worst, round(min(m), 8) as best from q group by 1")
def a58(spark: SparkSession, folder: str) -> DataFrame:
    q = table(spark, folder, "lineitem").groupBy(F.col("l_returnflag").alias("model"), "l_linenumber").agg(F.avg("l_tax").alias("m"))
    return q.groupBy("model").agg(rounded(F.avg("m"), 8).alias("mean"), rounded(F.max("m"), 8).alias("worst"), rounded(F.min("m"), 8).alias("best"))


@query("a50_cells_pivot", "select o_orderstatus as status, round(avg(o_totalprice) filter (o_orderpriority = '1-URGENT'), 5) as urgent, round(avg(o_totalprice) filter (o_orderpriority = '5-LOW'), 5) as low from orders group by 1")
def a50(spark: SparkSession, folder: str) -> DataFrame:
    p = table(spark, folder, "orders").groupBy(F.col("o_orderstatus").alias("status")).pivot("o_orderpriority", ["1-URGENT", "5-LOW"]).agg(rounded(F.avg("o_totalprice"), 5))
    return p.withColumnsRenamed({"1-URGENT": "urgent", "5-LOW": "low"})


@query("a67_children_status", f"select regexp_matches(decision_id, '-\\d+$') as is_child, {_status('final')} as status, count(*) as n from {ADJUDICATIONS} group by 1, 2")
def a67(spark: SparkSession, folder: str) -> DataFrame:
    return adjudications(spark, folder).groupBy(F.col("decision_id").rlike(r"-\d+$").alias("is_child"), plain_label(F.col("final_status"), STATUS_LABELS).alias("status")).agg(F.count("*").alias("n"))


@query("j24_inherited_status", f"select c.pair_id, coalesce(nullif(trim(c.final_relation), ''), d.status) as verdict from {CANDIDATES} c left join {DECISIONS} d on d.decision_id = c.earlier_decision_id")
def j24(spark: SparkSession, folder: str) -> DataFrame:
    """A blank verdict takes the status of the pair's earlier decision."""
    d = decisions(spark, folder).select(F.col("decision_id").alias("earlier_decision_id"), "status")
    return candidates(spark, folder).join(d, "earlier_decision_id", "left").select("pair_id", F.coalesce(F.nullif(F.trim("final_relation"), F.lit("")), F.col("status")).alias("verdict"))


@query("j29_reviews_beside_meetings", f"select r.pregunta_id, r.stratum, m.n as n_meetings from {REVIEWS} r left join (select series_id, count(distinct meeting_id) as n from meetings group by 1) m using (series_id)")
def j29(spark: SparkSession, folder: str) -> DataFrame:
    m = table(spark, folder, "meetings").groupBy("series_id").agg(F.countDistinct("meeting_id").alias("n_meetings"))
    return reviews(spark, folder).join(m, "series_id", "left").select("pregunta_id", "stratum", "n_meetings")


@query("j36_same_text_both_sides", f"select coalesce(a.meeting_id, b.meeting_id) as meeting_id, coalesce(a.n, 0) as n_decisions, coalesce(b.n, 0) as n_adjudicated, a.n is not distinct from b.n as equal from (select meeting_id, count(*) as n from {DECISIONS} group by 1) a full join (select meeting_id, count(*) as n from {ADJUDICATIONS} group by 1) b on a.meeting_id = b.meeting_id")
def j36(spark: SparkSession, folder: str) -> DataFrame:
    a = decisions(spark, folder).groupBy("meeting_id").agg(F.count("*").alias("a"))
    b = adjudications(spark, folder).groupBy("meeting_id").agg(F.count("*").alias("b"))
    both = a.join(b, "meeting_id", "full")
    return both.select("meeting_id", F.coalesce("a", F.lit(0)).alias("n_decisions"), F.coalesce("b", F.lit(0)).alias("n_adjudicated"), F.col("a").eqNullSafe(F.col("b")).alias("equal"))


@query("j36_same_ids_in_order", f"with a as (select meeting_id, list(decision_id order by decision_id) as x from {DECISIONS} group by 1), b as (select meeting_id, list(decision_id order by decision_id) as x from {ADJUDICATIONS} group by 1) select coalesce(a.meeting_id, b.meeting_id) as meeting_id, coalesce(a.x = b.x, false) as equal from a full join b on a.meeting_id = b.meeting_id")
def j36_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Whether a meeting's decisions and adjudications are the same ids in the same order."""
    a, b = (x(spark, folder).select("meeting_id", "decision_id", F.col("decision_id").alias("place")) for x in (decisions, adjudications))
    return runs.same_order(a, b, "meeting_id", "decision_id", "place").select("meeting_id", "equal")


@query("l05_best_passages")
def l05(spark: SparkSession, folder: str) -> DataFrame:
    """The lines of each decision's evidence that say most of its sentence; the evidence's parts are its lines."""
    d = decisions(spark, folder).select("decision_id", "sentence_text", F.regexp_replace("evidence_text", r" \| ", "\n").alias("source"))
    return runs.best_passages(d, "decision_id", "sentence_text", "source")


@query("u09_set_operations", "select 'union' as op, count(*) as n from (select user_id from events where event_type = 'click' union select user_id from events where event_type = 'purchase') union all select 'intersect', count(*) from (select user_id from events where event_type = 'click' intersect select user_id from events where event_type = 'purchase') union all select 'except', count(*) from (select user_id from events where event_type = 'click' except select user_id from events where event_type = 'purchase')")
def u09(spark: SparkSession, folder: str) -> DataFrame:
    own = lambda t: table(spark, folder, "events").where(F.col("event_type") == t).select("user_id")
    a, b = own("click"), own("purchase")
    count = lambda name, df: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("op"), "n")
    return count("union", a.union(b).distinct()).unionByName(count("intersect", a.intersect(b))).unionByName(count("except", a.subtract(b)))


@query("s29_manifest_upsert", "select o_orderkey, o_orderstatus, round(o_totalprice, 2) as price from orders where o_orderdate < timestamp '1997-01-01' and o_orderkey not in (select o_orderkey from orders where o_orderdate >= timestamp '1996-06-01') union all select o_orderkey, o_orderstatus, round(o_totalprice + 1, 2) from orders where o_orderdate >= timestamp '1996-06-01'")
def s29(spark: SparkSession, folder: str) -> DataFrame:
    from minutario.operators.validation import upsert

    o = table(spark, folder, "orders").withColumn("d", F.date_format("o_orderdate", "yyyy-MM-dd"))
    old = o.where("d < '1997-01-01'").select("o_orderkey", "o_orderstatus", rounded("o_totalprice", 2).alias("price"))
    new = o.where("d >= '1996-06-01'").select("o_orderkey", "o_orderstatus", rounded(F.col("o_totalprice") + 1, 2).alias("price"))
    return upsert(old, new, "o_orderkey")


@query("f27_formatted_figures", "select n_regionkey as region, count(*) as n, format('{:.2f}', count(*) / 3) as text from nation group by 1")
def f27(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "nation").groupBy(F.col("n_regionkey").alias("region")).agg(F.count("*").alias("n")).withColumn("text", F.format_string("%.2f", F.col("n") / 3))


@query("f35_threshold_grid", "select n as place, round(0.05 + n * 0.05, 10) as threshold from range(0, 19) as t(n)")
def f35(spark: SparkSession, folder: str) -> DataFrame:
    return spark.range(19).select(F.col("id").alias("place"), F.round(F.lit(0.05) + F.col("id") * 0.05, 10).alias("threshold"))


@query("e11_mosaic", "with c as (select l_returnflag as r, l_linestatus as s, count(*) as n from lineitem group by 1, 2), t as (select r, s, n, sum(n) over () as total, sum(n) over (partition by r) as nr from c), x as (select distinct r, nr, total from t), l as (select r, round(coalesce(sum(nr) over (order by r rows between unbounded preceding and 1 preceding), 0) / total, 6) as left_, round(nr / total, 6) as width from x) select r, s, left_, width, round(coalesce(sum(n) over (partition by r order by s rows between unbounded preceding and 1 preceding), 0) / nr, 6) as bottom, round(n / nr, 6) as height from t join l using (r)")
def e11(spark: SparkSession, folder: str) -> DataFrame:
    """Rectangles of a two-way table; windows run over its cells, not over rows."""
    c = table(spark, folder, "lineitem").groupBy(F.col("l_returnflag").alias("r"), F.col("l_linestatus").alias("s")).agg(F.count("*").alias("n"))
    before = lambda v, w: F.coalesce(F.sum(v).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    rows = c.groupBy("r").agg(F.sum("n").alias("nr")).withColumn("total", F.sum("nr").over(W.partitionBy())).withColumn("before", before("nr", W.orderBy("r")))
    t = c.withColumn("below", before("n", W.partitionBy("r").orderBy("s"))).join(rows, "r")
    return t.select("r", "s", rounded(F.col("before") / F.col("total")).alias("left_"), rounded(F.col("nr") / F.col("total")).alias("width"), rounded(F.col("below") / F.col("nr")).alias("bottom"), rounded(F.col("n") / F.col("nr")).alias("height"))


@query("e13_variance_inflation")
def e13(spark: SparkSession, folder: str) -> DataFrame:
    return round_all(stats.variance_inflation(table(spark, folder, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]))


@query("e15_components")
def e15(spark: SparkSession, folder: str) -> DataFrame:
    return round_all(stats.standardised_components(table(spark, folder, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]))


@query("e14_trend_by_series", f"with c as (select series_id, meeting_id, strpos('abcd', right(meeting_id, 1)) as p, count(*) as n from {DECISIONS} group by 1, 2, 3), x as (select a.series_id, count(*) as n_pairs, sum(sign(a.p - b.p) * sign(a.n - b.n)) as s, count(*) filter (a.p <> b.p) as px, count(*) filter (a.n <> b.n) as py from c a join c b on a.series_id = b.series_id and a.meeting_id < b.meeting_id group by 1) select series_id, n_pairs, round(case when px > 0 and py > 0 then s / sqrt(px * py) end, 6) as tau_b from x")
def e14(spark: SparkSession, folder: str) -> DataFrame:
    c = decisions(spark, folder).groupBy("series_id", "meeting_id", F.instr(F.lit("abcd"), F.right("meeting_id", F.lit(1))).alias("p")).agg(F.count("*").alias("n"))
    return round_all(stats.kendall_by_group(c, "series_id", "p", "n"))


@query("e21_missingness_mechanism", "with x as (select length(text) as v, lang is null as f from documents where text is not null), r as (select f, v, rank() over (order by v) + (count(*) over (partition by v) - 1) / 2 as rk, count(*) over (partition by v) as k from x), t as (select sum(c ** 3 - c) as t from (select count(*) as c from x group by v)), s as (select count(*) filter (f) as n1, count(*) filter (not f) as n0, sum(rk) filter (f) as rs from r) select n1, n0, round(rs - n1 * (n1 + 1) / 2, 4) as u, round((rs - n1 * (n1 + 1) / 2 - n1 * n0 / 2) / sqrt(n1 * n0 / 12 * ((n1 + n0 + 1) - t / ((n1 + n0) * (n1 + n0 - 1)))), 5) as z from s, t")
def e21(spark: SparkSession, folder: str) -> DataFrame:
    x = table(spark, folder, "documents").where("text is not null").select(F.length("text").alias("v"), F.col("lang").isNull().alias("f"))
    r = stats.rank_sum(x, "v", F.col("f"))
    return r.select("n1", "n0", rounded("u", 4).alias("u"), rounded("z", 5).alias("z"))


@query("e06_local_outliers")
def e06(spark: SparkSession, folder: str) -> DataFrame:
    """Density outliers among a meeting's decisions."""
    d = decisions(spark, folder).select("meeting_id", "decision_id", F.length("sentence_text").cast("double").alias("a"), F.length("decision_content").cast("double").alias("b"))
    return round_all(stats.local_outlier_factors(d, "meeting_id", "decision_id", ["a", "b"], 5))


@query("e16_cluster_scan")
def e16(spark: SparkSession, folder: str) -> DataFrame:
    """Silhouettes of k-means over the embeddings for several k."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.evaluation import ClusteringEvaluator
    from pyspark.ml.functions import array_to_vector

    v = table(spark, folder, "embeddings").select(array_to_vector(F.col("embedding").cast("array<double>")).alias("features"))
    rows = [(k, float(ClusteringEvaluator().evaluate(KMeans(k=k, seed=1, maxIter=10).fit(v).transform(v)))) for k in (2, 4)]
    return round_all(spark.createDataFrame(rows, "k int, silhouette double"))


@query("t24_power_grid")
def t24(spark: SparkSession, folder: str) -> DataFrame:
    """Power by both criteria for the sizes, base rates and spreads that the reviews show: questions and found share per stratum."""
    found = F.coalesce("objetos_de_la_base", F.lit("")).contains(", recuperado").cast("int")
    seen = reviews(spark, folder).groupBy("stratum").agg(F.count("*").alias("n"), F.avg(found).alias("rate"))
    base = F.round(F.least(F.lit(0.9), F.greatest(F.lit(0.05), F.col("rate"))), 2)
    steps = [F.explode(F.array(*map(F.lit, v))).alias(c) for c, v in (("difference", (0.0, 0.1, 0.2)), ("spread", (0.5, 1.5)), ("n_questions", (25, 50, 100)))]
    grid = seen.where("stratum is not null").select(base.alias("base")).distinct()
    for step in steps:
        grid = grid.select("*", step)
    return round_all(power.simulate_grid(grid.repartition(8)))


@query("t26_score_correlation")
def t26(spark: SparkSession, folder: str) -> DataFrame:
    """Correlation of simulated conditions over the same base rates."""
    grid = t24(spark, folder).select("base", "difference", "spread").distinct()
    return round_all(power.correlation_grid(grid))


@query("t25_power_pivot")
def t25(spark: SparkSession, folder: str) -> DataFrame:
    return t24(spark, folder).where("spread = 1.5").groupBy("base", "n_questions").pivot("difference", [0.0, 0.1, 0.2]).agg(F.first("power")).withColumnsRenamed({"0.0": "none", "0.1": "small", "0.2": "large"})


@query("t18_channel_benefit", f"select count(*) filter (low and tied) as caught, count(*) filter (low and not tied) as false_alarms, count(*) filter (not low and tied) as beside, round(count(*) filter (low and tied) / nullif(count(*) filter (tied), 0), 6) as share from (select blocker_score < 0.3 as low, {TIED_SQL} as tied from {CANDIDATES} where {GOLD_SQL} and blocker_score is not null)")
def t18(spark: SparkSession, folder: str) -> DataFrame:
    g = _gold(spark, folder).where("blocker_score is not null").select((F.col("blocker_score") < 0.3).alias("low"), "tied")
    return g.agg(F.count_if(F.col("low") & F.col("tied")).alias("caught"), F.count_if(F.col("low") & ~F.col("tied")).alias("false_alarms"), F.count_if(~F.col("low") & F.col("tied")).alias("beside"), rounded(F.try_divide(F.count_if(F.col("low") & F.col("tied")), F.count_if("tied"))).alias("share"))


@query("q19_question_template", "select s as stratum, format('q{:03d}', n) as id from (values ('E1'), ('E2'), ('E3'), ('E4')) as v(s) cross join range(1, 26) as t(n)")
def q19(spark: SparkSession, folder: str) -> DataFrame:
    strata = spark.createDataFrame([(s,) for s in ("E1", "E2", "E3", "E4")], "stratum string")
    return strata.select("stratum", F.explode(F.sequence(F.lit(1), F.lit(25))).alias("n")).select("stratum", F.format_string("q%03d", "n").alias("id"))


@query("q112_formatted_proportions", f"select stratum, format('{{}}/{{}} ({{:.3f}})', k, n, k / n) as text from (select stratum, count(*) filter (abstained) as k, count(abstained) as n from {REVIEWS} group by 1) where n > 0")
def q112(spark: SparkSession, folder: str) -> DataFrame:
    x = reviews(spark, folder).groupBy("stratum").agg(F.count_if("abstained").alias("k"), F.count("abstained").alias("n")).where("n > 0")
    return x.select("stratum", F.format_string("%d/%d (%.3f)", "k", "n", F.col("k") / F.col("n")).alias("text"))
