"""Descriptive statistics, tests, intervals and agreement over the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from minutario.functions.text import plain_label
from minutario.operators import agreement, intervals, stats
from minutario.plans.common import ADJUDICATIONS, CANDIDATES, DECISIONS, adjudications, candidates, decisions, label_sql, rounded, table
from minutario.plans.registry import query
from minutario.schemas import RELATION_LABELS, STATUS_LABELS

LINE = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def round_all(df: DataFrame, places: int = 6) -> DataFrame:
    return df.select(*[rounded(c, places).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def _numeric_sql(table_: str, column: str, log: bool = False) -> str:
    v = f"ln(1 + {column})" if log else column
    return f"""select '{column}' as variable, '{"log1p" if log else "none"}' as "transform", count(v) as n, round(avg(v), 5) as mean, round(median(v), 5) as median, round((select v from x group by v order by count(*) desc, v limit 1), 5) as mode,
    round(var_samp(v), 3) as variance, round(stddev_samp(v), 5) as std, round(min(v), 5) as min, round(quantile_cont(v, 0.25), 5) as q1, round(quantile_cont(v, 0.75), 5) as q3, round(quantile_cont(v, 0.75) - quantile_cont(v, 0.25), 5) as iqr, round(max(v), 5) as max,
    round(skewness(v), 5) as skewness, round(kurtosis(v), 5) as excess_kurtosis, round(stddev_samp(v) / avg(v), 5) as cv from x""".replace("from x group", f"from (select {v} as v from {table_}) x group").removesuffix("from x") + f"from (select {v} as v from {table_}) x"


def _numeric(df: DataFrame) -> DataFrame:
    return df.select(*[rounded(c, 3 if c == "variance" else 5).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


@query("e01_describe_numeric", " union all ".join(_numeric_sql("lineitem", c) for c in LINE))
def e01(spark: SparkSession, folder: str) -> DataFrame:
    return _numeric(stats.describe_numeric(table(spark, folder, "lineitem"), LINE))


@query("e01_describe_log", _numeric_sql("lineitem", "l_quantity", True))
def e01_log(spark: SparkSession, folder: str) -> DataFrame:
    return _numeric(stats.describe_numeric(table(spark, folder, "lineitem"), ["l_quantity"], log=True))


@query("e02_describe_categorical", " union all ".join(f"select '{c}' as variable, coalesce({c}, '<missing>') as category, count(*) as count, round(count(*) / sum(count(*)) over (), 6) as share from documents group by 2" for c in ("lang", "source", "doc_kind")))
def e02(spark: SparkSession, folder: str) -> DataFrame:
    return round_all(stats.describe_categorical(table(spark, folder, "documents"), ["lang", "source", "doc_kind"]))


EDGES = [0, 5, 10, 20, 30, 50, 80]


@query("e03_rate_by_bin", "with b(bin, low, high) as (values " + ", ".join(f"({i}, {a}::double, {b}::double)" for i, (a, b) in enumerate(zip(EDGES, EDGES[1:]))) + ") select bin, low, high, count(l_quantity) as n, count(*) filter (l_returnflag = 'R') as n_true, round(case when count(l_quantity) > 0 then count(*) filter (l_returnflag = 'R') / count(l_quantity) end, 6) as rate from b left join lineitem on l_quantity > low and l_quantity <= high group by all")
def e03(spark: SparkSession, folder: str) -> DataFrame:
    return round_all(stats.rate_by_bin(table(spark, folder, "lineitem"), "l_quantity", F.col("l_returnflag") == "R", EDGES))


@query("e04_zscore_outliers", "select event_id, 'value' as variable, round(value, 5) as value, round((value - m) / s, 5) as z from events, (select avg(value) as m, stddev_samp(value) as s from events) where abs((value - m) / s) > 3")
def e04(spark: SparkSession, folder: str) -> DataFrame:
    return round_all(stats.zscore_outliers(table(spark, folder, "events"), "event_id", ["value"]), 5)


@query("e05_iqr_outliers", "select event_id, 'value' as variable, round(value, 5) as value from events, (select quantile_cont(value, 0.25) as a, quantile_cont(value, 0.75) as b from events) where value < a - 1.5 * (b - a) or value > b + 1.5 * (b - a)")
def e05(spark: SparkSession, folder: str) -> DataFrame:
    return round_all(stats.iqr_outliers(table(spark, folder, "events"), "event_id", ["value"]), 5)


@query(
    "e08_kruskal",
    """with r as (select event_type, value, rank() over (order by value) + (count(*) over (partition by value) - 1) / 2 as rk from events where value is not null and event_type is not null),
    g as (select event_type, count(*) as n, sum(rk) as s from r group by 1), t as (select sum(c ** 3 - c) as t from (select count(*) as c from r group by value)), x as (select sum(n) as n, count(*) as k, sum(s * s / n) as q from g)
    select n::bigint as n, k as n_groups, round((12 / (n * (n + 1)) * q - 3 * (n + 1)) / (1 - t / (n ** 3 - n)), 4) as h, round((12 / (n * (n + 1)) * q - 3 * (n + 1)) / (1 - t / (n ** 3 - n)) / (n - 1), 6) as epsilon_squared from x, t""",
)
def e08(spark: SparkSession, folder: str) -> DataFrame:
    k = stats.kruskal(table(spark, folder, "events"), "value", "event_type")
    return k.select("n", "n_groups", rounded("h", 4).alias("h"), rounded("epsilon_squared").alias("epsilon_squared"))


@query("e09_contingency_cube", "select coalesce(l_returnflag, 'ALL') as r, coalesce(l_linestatus, 'ALL') as c, count(*) as n from lineitem group by cube (l_returnflag, l_linestatus)")
def e09(spark: SparkSession, folder: str) -> DataFrame:
    cube = table(spark, folder, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"))
    return cube.select(F.coalesce("l_returnflag", F.lit("ALL")).alias("r"), F.coalesce("l_linestatus", F.lit("ALL")).alias("c"), "n")


@query("e09_contingency_pivot", "select l_returnflag as r, count(*) filter (l_linestatus = 'F') as F, count(*) filter (l_linestatus = 'O') as O from lineitem group by 1")
def e09_pivot(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "lineitem").groupBy(F.col("l_returnflag").alias("r")).pivot("l_linestatus", ["F", "O"]).count().na.fill(0)


@query(
    "e10_chi_square",
    """with c as (select doc_kind as r, source as c, count(*) as o from documents group by 1, 2), r as (select r, sum(o) as nr from c group by 1), k as (select c, sum(o) as nc from c group by 1), t as (select sum(o) as n from c),
    f as (select nr * nc / n as e, coalesce(o, 0) as o, n from r cross join k cross join t left join c using (r, c)),
    s as (select max(n)::bigint as n, sum((o - e) * (o - e) / e) as chi2, min(e) as e from f), d as (select count(distinct r) as kr, count(distinct c) as kc from c)
    select n, round(chi2, 5) as chi2, (kr - 1) * (kc - 1) as dof, round(sqrt(chi2 / (n * (least(kr, kc) - 1))), 6) as cramers_v, round(e, 6) as least_expected from s, d""",
)
def e10(spark: SparkSession, folder: str) -> DataFrame:
    c = stats.chi_square(table(spark, folder, "documents"), "doc_kind", "source")
    return c.select("n", rounded("chi2", 5).alias("chi2"), "dof", rounded("cramers_v").alias("cramers_v"), rounded("least_expected").alias("least_expected"))


def _corr_sql(x: str, y: str) -> str:
    rank = lambda c: f"rank() over (order by {c}) + (count(*) over (partition by {c}) - 1) / 2.0"
    return f"select '{x}' as x, '{y}' as y, count(*) as n, round(corr(x, y), 5) as pearson, round(corr(rx, ry), 5) as spearman from (select {x} as x, {y} as y, {rank(x)} as rx, {rank(y)} as ry from lineitem where {x} is not null and {y} is not null)"


@query("e12_correlations", " union all ".join(_corr_sql(x, y) for i, x in enumerate(LINE) for y in LINE[i + 1 :]))
def e12(spark: SparkSession, folder: str) -> DataFrame:
    return round_all(stats.correlations(table(spark, folder, "lineitem"), LINE), 5)


DECISION_FIELDS = ["sentence_text", "evidence_da_count", "evidence_text", "status", "decision_object", "decision_content", "annotator", "notes", "machine_flags"]


@query("e18_missingness", " union all ".join(f"select '{c}' as variable, count(*) as n, count(*) - count({c}) as n_missing, round((count(*) - count({c})) / count(*), 6) as share from decisions" for c in DECISION_FIELDS))
def e18(spark: SparkSession, folder: str) -> DataFrame:
    return round_all(stats.missingness(table(spark, folder, "decisions").select(*DECISION_FIELDS)))


@query("e19_record_missingness", "select n_missing, count(*) as n from (select " + " + ".join(f"({c} is null)::int" for c in DECISION_FIELDS) + " as n_missing from decisions) group by 1")
def e19(spark: SparkSession, folder: str) -> DataFrame:
    gone = sum((F.col(c).isNull().cast("int") for c in DECISION_FIELDS), F.lit(0))
    return table(spark, folder, "decisions").groupBy(gone.alias("n_missing")).agg(F.count("*").alias("n"))


@query("e17_data_dictionary", " union all ".join(f"select '{c}' as variable, count({c}) as n, count(distinct {c}) as n_distinct, min({c}) as least, max({c}) as greatest from documents" for c in ("text", "lang", "source", "doc_kind", "series_id")))
def e17(spark: SparkSession, folder: str) -> DataFrame:
    df, names = table(spark, folder, "documents"), ["text", "lang", "source", "doc_kind", "series_id"]
    sums = df.agg(*[F.struct(F.lit(c).alias("variable"), F.count(c).alias("n"), F.countDistinct(c).alias("n_distinct"), F.min(c).alias("least"), F.max(c).alias("greatest")).alias(c) for c in names])
    return sums.select(F.explode(F.array(*names)).alias("r")).select("r.*")


@query("w10_benjamini_hochberg", "with m as (select event_type || '-' || day as test, (abs(hash_) % 1000 + 1) / 20000.0 as p from (select event_type, dayofmonth(ts)::varchar as day, count(*) * 7919 + sum(user_id) as hash_ from events group by 1, 2)), r as (select *, row_number() over (order by p, test) as k, count(*) over () as m from m) select test, round(p, 8) as p, round(least(1.0, min(p * m / k) over (order by k rows between current row and unbounded following)), 8) as q, least(1.0, min(p * m / k) over (order by k rows between current row and unbounded following)) <= 0.05 as significant from r")
def w10(spark: SparkSession, folder: str) -> DataFrame:
    """Stand-in p-values by event type and day; the adjustment itself is what is tested."""
    days = table(spark, folder, "events").groupBy("event_type", F.dayofmonth("ts").alias("day")).agg((F.count("*") * 7919 + F.sum("user_id")).alias("h"))
    tests = days.select(F.concat_ws("-", "event_type", F.col("day").cast("string")).alias("test"), ((F.abs("h") % 1000 + 1) / 20000.0).cast("double").alias("p"))
    return round_all(stats.benjamini_hochberg(tests, "test", "p"), 8)


def _kappa_sql(source: str, a: str, b: str, by: str = "") -> str:
    g = f"{by}, " if by else ""
    using = f"using ({g}l)"
    return f"""with x as (select {g}{a} as a, {b} as b from {source}), k as (select * from x where a is not null and b is not null), c as (select {g}a, b, count(*) as n from k group by all),
    r as (select {g}a as l, sum(n) as ra from c group by all), s as (select {g}b as l, sum(n) as cb from c group by all), ch as (select {g}sum(ra * cb) as ch from r join s {using} group by all),
    o as (select {g}sum(n) as n, sum(n) filter (a = b) as same from c group by all)
    select {g}n::bigint as n, round(coalesce(same, 0) / n, 6) as observed, round(coalesce(ch, 0) / (n * n), 6) as expected, round(case when coalesce(ch, 0) / (n * n) < 1 then (coalesce(same, 0) / n - coalesce(ch, 0) / (n * n)) / (1 - coalesce(ch, 0) / (n * n)) end, 6) as kappa from o {f"left join ch using ({by})" if by else "cross join ch"}"""


def _label_if(cell: str, labels: list[str]) -> str:
    return f"case when {label_sql(cell)} in ({', '.join(repr(x) for x in labels)}) then {label_sql(cell)} end"


@query("m02_kappa_relations", _kappa_sql(CANDIDATES, _label_if("gm_relation", RELATION_LABELS), _label_if("gv_relation", RELATION_LABELS)))
def m02(spark: SparkSession, folder: str) -> DataFrame:
    both = candidates(spark, folder).select(*[plain_label(F.col(f"{p}_relation"), RELATION_LABELS).alias(p) for p in ("gm", "gv")])
    return round_all(agreement.kappa(both, "gm", "gv"))


def _existence(cell: str) -> str:
    return f"({_label_if(cell, RELATION_LABELS)}) <> 'no_relacionada'"


@query("m06_kappa_existence_by_series", _kappa_sql(CANDIDATES, _existence("gm_relation"), _existence("gv_relation"), "series_id"))
def m06(spark: SparkSession, folder: str) -> DataFrame:
    both = candidates(spark, folder).select("series_id", *[(plain_label(F.col(f"{p}_relation"), RELATION_LABELS) != "no_relacionada").alias(p) for p in ("gm", "gv")])
    return round_all(agreement.kappa(both, "gm", "gv", ["series_id"]))


@query("m10_kappa_status", _kappa_sql(ADJUDICATIONS, _label_if("gm_status", STATUS_LABELS), _label_if("gv_status", STATUS_LABELS)))
def m10(spark: SparkSession, folder: str) -> DataFrame:
    both = adjudications(spark, folder).select(*[plain_label(F.col(f"{p}_status"), STATUS_LABELS).alias(p) for p in ("gm", "gv")])
    return round_all(agreement.kappa(both, "gm", "gv"))


@query("a64_status_contingency", f"select a, b, count(*) as n from (select {_label_if('gm_status', STATUS_LABELS)} as a, {_label_if('gv_status', STATUS_LABELS)} as b from {ADJUDICATIONS}) where a is not null and b is not null group by 1, 2")
def a64(spark: SparkSession, folder: str) -> DataFrame:
    both = adjudications(spark, folder).select(plain_label(F.col("gm_status"), STATUS_LABELS).alias("a"), plain_label(F.col("gv_status"), STATUS_LABELS).alias("b"))
    return both.where("a is not null and b is not null").groupBy("a", "b").agg(F.count("*").alias("n"))


@query("a65_status_by_annotator", " union all ".join(f"select '{p}' as annotator, {_label_if(p + '_status', STATUS_LABELS)} as status, count(*) as n from {ADJUDICATIONS} where {_label_if(p + '_status', STATUS_LABELS)} is not null group by 2" for p in ("gm", "gv", "ka")))
def a65(spark: SparkSession, folder: str) -> DataFrame:
    cells = F.explode(F.array(*[F.struct(F.lit(p).alias("annotator"), plain_label(F.col(f"{p}_status"), STATUS_LABELS).alias("status")) for p in ("gm", "gv", "ka")])).alias("c")
    return adjudications(spark, folder).select(cells).select("c.*").where("status is not null").groupBy("annotator", "status").agg(F.count("*").alias("n"))


@query("a66_side_taken", f"select side, count(*) as n from (select case when f = a then 'gm' when f = b then 'gv' else 'neither' end as side from (select {_label_if('gm_status', STATUS_LABELS)} as a, {_label_if('gv_status', STATUS_LABELS)} as b, {_label_if('final_status', STATUS_LABELS)} as f from {ADJUDICATIONS}) where a <> b and f is not null) group by 1")
def a66(spark: SparkSession, folder: str) -> DataFrame:
    x = adjudications(spark, folder).select(*[plain_label(F.col(c), STATUS_LABELS).alias(n) for n, c in (("a", "gm_status"), ("b", "gv_status"), ("f", "final_status"))])
    side = F.when(F.col("f") == F.col("a"), "gm").when(F.col("f") == F.col("b"), "gv").otherwise("neither")
    return x.where("a <> b and f is not null").groupBy(side.alias("side")).agg(F.count("*").alias("n"))


Z = intervals.z_value()


@query("t01_wilson_by_series", f"with x as (select series_id, count(*) as n, count(*) filter ({label_sql('status')} = 'decision') as k from {DECISIONS} group by 1) select series_id, n, k, round(k / n, 6) as rate, round(greatest(0, (k / n + {Z}*{Z} / (2 * n) - {Z} * sqrt(k / n * (1 - k / n) / n + {Z}*{Z} / (4 * n * n))) / (1 + {Z}*{Z} / n)), 6) as lower, round(least(1, (k / n + {Z}*{Z} / (2 * n) + {Z} * sqrt(k / n * (1 - k / n) / n + {Z}*{Z} / (4 * n * n))) / (1 + {Z}*{Z} / n)), 6) as upper from x")
def t01(spark: SparkSession, folder: str) -> DataFrame:
    x = decisions(spark, folder).groupBy("series_id").agg(F.count("*").alias("n"), F.count_if(plain_label(F.col("status"), STATUS_LABELS) == "decision").alias("k"))
    lower, upper = intervals.wilson(F.col("k") / F.col("n"), F.col("n"))
    return x.select("series_id", "n", "k", rounded(F.col("k") / F.col("n")).alias("rate"), rounded(lower).alias("lower"), rounded(upper).alias("upper"))


@query("t05_bootstrap_event_means")
def t05(spark: SparkSession, folder: str) -> DataFrame:
    events = table(spark, folder, "events").select("event_type", (F.col("user_id") % 200).alias("user"), "value")
    return round_all(intervals.bootstrap_means(events, "event_type", "user", "value", n=400))


@query(
    "t15_stratified_recall",
    f"""with x as (select series_id, count(*) as pop, count(*) filter (blocker_score < 0.3) as s, count(*) filter (blocker_score < 0.3 and {label_sql('final_relation')} in ('reafirma', 'refina', 'revierte', 'reemplaza')) as m,
    count(*) filter (blocker_score >= 0.3 and {label_sql('final_relation')} in ('reafirma', 'refina', 'revierte', 'reemplaza')) as kept from {CANDIDATES} group by 1), y as (select substr(series_id, 1, 2) as site, * from x where s > 0)
    select site, count(*) as n_strata, sum(s)::bigint as n_sampled, sum(m)::bigint as n_missed, sum(pop)::bigint as population, sum(kept)::bigint as kept, round(sum(pop * m / s) / sum(pop), 6) as rate, round(sum(pop) * sum(pop) / sum(pop * pop / s), 4) as n_eff from y group by 1""",
)
def t15(spark: SparkSession, folder: str) -> DataFrame:
    tying = plain_label(F.col("final_relation"), RELATION_LABELS).isin("reafirma", "refina", "revierte", "reemplaza")
    low, high = F.col("blocker_score") < 0.3, F.col("blocker_score") >= 0.3
    x = candidates(spark, folder).groupBy("series_id").agg(F.count("*").alias("population"), F.count_if(low).alias("n_sampled"), F.count_if(low & tying).alias("n_missed"), F.count_if(high & tying).alias("kept"))
    r = intervals.stratified_recall(x.where("n_sampled > 0").withColumn("site", F.substring("series_id", 1, 2)), ["site"])
    return r.select("site", "n_strata", "n_sampled", "n_missed", "population", "kept", rounded("rate").alias("rate"), rounded("n_eff", 4).alias("n_eff"))


@query("t15_recall_intervals")
def t15_intervals(spark: SparkSession, folder: str) -> DataFrame:
    tying = plain_label(F.col("final_relation"), RELATION_LABELS).isin("reafirma", "refina", "revierte", "reemplaza")
    low, high = F.col("blocker_score") < 0.3, F.col("blocker_score") >= 0.3
    x = candidates(spark, folder).groupBy("series_id").agg(F.count("*").alias("population"), F.count_if(low).alias("n_sampled"), F.count_if(low & tying).alias("n_missed"), F.count_if(high & tying).alias("kept"))
    return round_all(intervals.stratified_recall(x.where("n_sampled > 0")))
