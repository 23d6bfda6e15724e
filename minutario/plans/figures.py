"""Shares, agreement and intervals of reviews, candidates and adjudications."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from minutario.functions.text import decision_terms, plain_label
from minutario.operators import agreement, intervals
from minutario.plans.common import ADJUDICATIONS, CANDIDATES, REVIEWS, adjudications, candidates, label_sql, reviews, rounded, table, terms_sql
from minutario.plans.evaluation import GOLD_SQL, TIED_SQL, _gold
from minutario.plans.registry import query
from minutario.plans.statistics import round_all
from minutario.schemas import STATUS_LABELS

Z = intervals.z_value()
THRESHOLD = 0.3


def _wilson_sql(k: str, n: str) -> tuple[str, str]:
    """Bounds of the share k of n."""
    rate, z2 = f"({k} / {n})", f"({Z} * {Z})"
    half = f"{Z} * sqrt({rate} * (1 - {rate}) / {n} + {z2} / (4.0 * {n} * {n}))"
    low, high = (f"({rate} + {z2} / (2.0 * {n}) {sign} {half}) / (1 + {z2} / {n})" for sign in "-+")
    return f"greatest(0, {low})", f"least(1, {high})"


FOUND_SQL = "contains(coalesce(objetos_de_la_base, ''), ', recuperado')"


def _found() -> Column:
    return F.coalesce("objetos_de_la_base", F.lit("")).contains(", recuperado")


@query("t06_question_bootstrap")
def t06(spark: SparkSession, folder: str) -> DataFrame:
    """Mean share of found objects over questions, by stratum, with weighted bootstrap intervals."""
    x = reviews(spark, folder).select("stratum", "pregunta_id", _found().cast("double").alias("found"))
    return round_all(intervals.weighted_bootstrap_means(x, "stratum", "pregunta_id", "found", n=400))


_L1, _U1 = _wilson_sql("k1", "n1")
_L3, _U3 = _wilson_sql("k3", "n3")


@query(
    "m37_interval_verdicts",
    f"""with x as (
      select series_id, count(*) filter (stratum like 'E1%') as n1, count(*) filter (stratum like 'E1%' and {FOUND_SQL}) as k1,
        count(*) filter (stratum like 'E3%') as n3, count(*) filter (stratum like 'E3%' and {FOUND_SQL}) as k3 from {REVIEWS} group by 1),
    y as (select series_id, n1, k1, n3, k3, {_L1} as l1, {_U1} as u1, {_L3} as l3, {_U3} as u3 from x where n1 > 0 and n3 > 0)
    select series_id, n1, k1, n3, k3, round(l1, 6) as lower_1, round(u1, 6) as upper_1, round(l3, 6) as lower_3, round(u3, 6) as upper_3,
      case when l1 > u3 then 'above' when u1 < l3 then 'below' else 'overlap' end as verdict from y""",
)
def m37(spark: SparkSession, folder: str) -> DataFrame:
    """Whether a series' found shares in two strata have disjoint intervals."""
    first, third = F.col("stratum").startswith("E1"), F.col("stratum").startswith("E3")
    x = reviews(spark, folder).groupBy("series_id").agg(F.count_if(first).alias("n1"), F.count_if(first & _found()).alias("k1"), F.count_if(third).alias("n3"), F.count_if(third & _found()).alias("k3"))
    l1, u1 = intervals.wilson(F.col("k1") / F.col("n1"), F.col("n1"))
    l3, u3 = intervals.wilson(F.col("k3") / F.col("n3"), F.col("n3"))
    y = x.where("n1 > 0 and n3 > 0")
    return y.select("series_id", "n1", "k1", "n3", "k3", rounded(l1).alias("lower_1"), rounded(u1).alias("upper_1"), rounded(l3).alias("lower_3"), rounded(u3).alias("upper_3"), intervals.apart(l1, u1, l3, u3).alias("verdict"))


_CELLS_SQL = f"select series_id, count(*) filter (high and tied) as a, count(*) filter (high and not tied) as b, count(*) filter (not high and tied) as c, count(*) filter (not high and not tied) as d from (select series_id, coalesce(blocker_score >= {THRESHOLD}, false) as high, {TIED_SQL} as tied from {CANDIDATES} where {GOLD_SQL}) group by 1"


def _cells(spark: SparkSession, folder: str) -> DataFrame:
    high = F.coalesce(F.col("blocker_score") >= THRESHOLD, F.lit(False))
    tied = F.col("tied")
    return _gold(spark, folder).groupBy("series_id").agg(F.count_if(high & tied).alias("a"), F.count_if(high & ~tied).alias("b"), F.count_if(~high & tied).alias("c"), F.count_if(~high & ~tied).alias("d"))


@query("m01_blocker_scores", f"select series_id, a, b, c, round(case when a + b > 0 then a / (a + b) else 0 end, 6) as precision, round(case when a + c > 0 then a / (a + c) else 0 end, 6) as recall, round(case when a > 0 then 2 * a / (2 * a + b + c) else 0 end, 6) as f1 from ({_CELLS_SQL})")
def m01(spark: SparkSession, folder: str) -> DataFrame:
    """Precision, recall and F1 of the blocker's score against the final relations, by series."""
    p, r, f1 = agreement.precision_recall_f1(F.col("a"), F.col("b"), F.col("c"))
    return _cells(spark, folder).select("series_id", "a", "b", "c", rounded(p).alias("precision"), rounded(r).alias("recall"), rounded(f1).alias("f1"))


@query("m04_two_by_two_kappa", f"select series_id, a, b, c, d, round(case when (a + b) * (b + d) + (a + c) * (c + d) > 0 then 2 * (a * d - b * c) / ((a + b) * (b + d) + (a + c) * (c + d)) end, 6) as kappa from ({_CELLS_SQL})")
def m04(spark: SparkSession, folder: str) -> DataFrame:
    """Closed-form kappa of score and final relation, by series."""
    k = agreement.kappa_of_counts(F.col("a"), F.col("b"), F.col("c"), F.col("d"))
    return _cells(spark, folder).select("series_id", "a", "b", "c", "d", rounded(k).alias("kappa"))


_STATUS = ", ".join(f"'{x}'" for x in STATUS_LABELS)


@query(
    "m03_settled_kappa",
    f"""with x as (select series_id, {label_sql("gm_status")} as a, {label_sql("gv_status")} as b from {ADJUDICATIONS}), y as (select * from x where a in ({_STATUS}) and b in ({_STATUS})),
    n as (select series_id, count(*) as n, count(*) filter (a = b) as same from y group by 1),
    e as (select r.series_id, sum(r.k * c.k) as chance from (select series_id, a, count(*) as k from y group by 1, 2) r join (select series_id, b, count(*) as k from y group by 1, 2) c on r.series_id = c.series_id and r.a = c.b group by 1)
    select series_id, n, round(case when same = n then 1 else coalesce((same / n - coalesce(chance, 0) / (n * n)) / nullif(1 - coalesce(chance, 0) / (n * n), 0), 0) end, 6) as kappa from n left join e using (series_id)""",
)
def m03(spark: SparkSession, folder: str) -> DataFrame:
    """Agreement of two annotators on the status by series: 1 where identical, 0 where undefined."""
    x = adjudications(spark, folder).select("series_id", *[plain_label(F.col(f"{p}_status"), STATUS_LABELS).alias(p) for p in ("gm", "gv")])
    return agreement.settled_kappa(x, "gm", "gv", ["series_id"]).select("series_id", "n", rounded("kappa").alias("kappa"))


@query("u02_text_jaccard", f"select pair_id, round(case when len(list_distinct(list_concat(a, b))) > 0 then len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) else 0 end, 6) as jaccard from (select pair_id, {terms_sql('earlier_text')} as a, {terms_sql('later_text')} as b from {CANDIDATES})")
def u02(spark: SparkSession, folder: str) -> DataFrame:
    """Jaccard similarity of each pair's term sets, 0 where both are empty."""
    a, b = decision_terms(F.col("earlier_text")), decision_terms(F.col("later_text"))
    x = candidates(spark, folder).select("pair_id", F.size(F.array_intersect(a, b)).alias("n"), F.size(F.array_union(a, b)).alias("m"))
    return x.select("pair_id", rounded(F.when(F.col("m") > 0, F.col("n") / F.col("m")).otherwise(0.0)).alias("jaccard"))


@query("a26_abstention_causes", f"select stratum, coalesce(pista_automatica, '') as cause, count(*) as n from {REVIEWS} where abstained group by 1, 2")
def a26(spark: SparkSession, folder: str) -> DataFrame:
    """What the automatic hint says of the answers that abstained."""
    return reviews(spark, folder).where("abstained").groupBy("stratum", F.coalesce("pista_automatica", F.lit("")).alias("cause")).agg(F.count("*").alias("n"))


_STAGE_SQL = "nullif(trim(lower(etapa_humana)), '')"


@query("a38_stage_shares", f"with x as (select stratum, {_STAGE_SQL} as stage, count(*) as n from {REVIEWS} where {_STAGE_SQL} is not null group by 1, 2) select stratum, stage, n, round(n / sum(n) over (partition by stratum), 6) as share from x")
def a38(spark: SparkSession, folder: str) -> DataFrame:
    """Share of each failure stage among a stratum's labelled failures."""
    stage = F.nullif(F.trim(F.lower("etapa_humana")), F.lit(""))
    x = reviews(spark, folder).select("stratum", stage.alias("stage")).where("stage is not null").groupBy("stratum", "stage").agg(F.count("*").alias("n"))
    totals = x.groupBy("stratum").agg(F.sum("n").alias("of"))
    return x.join(totals, "stratum").select("stratum", "stage", "n", rounded(F.col("n") / F.col("of")).alias("share"))


_LE, _UE = _wilson_sql("(rate * n_eff)", "n_eff")


@query("t03_effective_wilson", f"with x as (select l_returnflag, sum(l_quantity * (l_discount > 0.05)::int)::double / sum(l_quantity)::double as rate, sum(l_quantity)::double * sum(l_quantity)::double / sum(l_quantity * l_quantity)::double as n_eff from lineitem group by 1) select l_returnflag, round(n_eff, 4) as n_eff, round(rate, 6) as rate, round({_LE}, 6) as lower, round({_UE}, 6) as upper from x")
def t03(spark: SparkSession, folder: str) -> DataFrame:
    """Interval of a share weighted by quantity, with the effective number of rows, which is fractional."""
    q, high = F.col("l_quantity").cast("double"), (F.col("l_discount") > 0.05).cast("int")
    x = table(spark, folder, "lineitem").groupBy("l_returnflag").agg((F.sum(q * high) / F.sum(q)).alias("rate"), (F.sum(q) * F.sum(q) / F.sum(q * q)).alias("n_eff"))
    lower, upper = intervals.wilson(F.col("rate"), F.col("n_eff"))
    return x.select("l_returnflag", rounded("n_eff", 4).alias("n_eff"), rounded("rate").alias("rate"), rounded(lower).alias("lower"), rounded(upper).alias("upper"))


@query("q20_positive_adjudications", f"select series_id, count(*) filter ({label_sql('final_status')} = 'decision') as positive, count(*) filter ({label_sql('final_status')} in ({_STATUS})) as labelled from {ADJUDICATIONS} group by 1")
def q20(spark: SparkSession, folder: str) -> DataFrame:
    """Adjudicated decisions of each series, and how many are decisions."""
    label = plain_label(F.col("final_status"), STATUS_LABELS)
    return adjudications(spark, folder).groupBy("series_id").agg(F.count_if(label == "decision").alias("positive"), F.count_if(label.isNotNull()).alias("labelled"))
