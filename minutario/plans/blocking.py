"""Blocking, pairs and set operations over decisions and candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from minutario.functions.text import decision_terms
from minutario.operators import pairs as P
from minutario.plans.common import CANDIDATES, DECISIONS, candidates, decisions, rounded, terms_sql
from minutario.plans.registry import query
from minutario.session import stored


def items(spark: SparkSession, folder: str) -> DataFrame:
    text = F.trim(F.concat_ws(" ", "decision_object", "decision_content"))
    return decisions(spark, folder).select(F.col("decision_id").alias("id"), "series_id", "meeting_id", decision_terms(text).alias("terms"))


ITEMS = f"""items as (select decision_id as id, series_id, meeting_id, strpos('abcd', right(meeting_id, 1)) as o,
  {terms_sql("trim(concat_ws(' ', decision_object, decision_content))")} as terms from {DECISIONS})"""
SCORED = f"""{ITEMS}, scored as (select a.series_id, a.id as earlier, b.id as later, a.meeting_id as earlier_meeting, b.meeting_id as later_meeting,
  len(list_intersect(a.terms, b.terms)) as shared, len(a.terms) as na, len(b.terms) as nb,
  case when least(len(a.terms), len(b.terms)) > 0 then len(list_intersect(a.terms, b.terms)) / least(len(a.terms), len(b.terms)) else 0.0 end as score
  from items a join items b on a.series_id = b.series_id and a.o < b.o and a.o > 0)"""


@query("f01_decision_terms", f"with {ITEMS} select id, len(terms)::bigint as n_terms, array_to_string(list_sort(terms), ' ') as terms from items")
def f01(spark: SparkSession, folder: str) -> DataFrame:
    return items(spark, folder).select("id", F.size("terms").cast("long").alias("n_terms"), F.array_join("terms", " ").alias("terms"))


@query("w14_meeting_order", f"select meeting_id, (strpos('abcd', right(meeting_id, 1)) - 1)::bigint as place, count(*) as n from {DECISIONS} where strpos('abcd', right(meeting_id, 1)) > 0 group by 1, 2")
def w14(spark: SparkSession, folder: str) -> DataFrame:
    order = P.meeting_order(F.col("meeting_id")).cast("long").alias("place")
    return decisions(spark, folder).groupBy("meeting_id", order).agg(F.count("*").alias("n")).where("place is not null")


@query("j01_pair_universe", f"with {ITEMS} select a.series_id, count(*) as universe from items a join items b on a.series_id = b.series_id and a.o < b.o and a.o > 0 group by 1 union all select series_id, 0 from items where o > 0 group by 1 having count(distinct o) = 1")
def j01(spark: SparkSession, folder: str) -> DataFrame:
    return P.universe_size(items(spark, folder))


@query(
    "j03_candidate_pairs",
    f"""with {SCORED} select series_id || '.p' || lpad(n::varchar, greatest(3, length(n::varchar))::integer, '0') as pair_id, series_id, earlier, later, shared::bigint as shared, round(score, 6) as score from (
    select *, row_number() over (partition by series_id order by earlier_meeting, later_meeting, score desc, earlier, later) as n from scored where score >= 0.3 and shared >= 2)""",
)
def j03(spark: SparkSession, folder: str) -> DataFrame:
    kept = P.numbered_candidates(items(spark, folder))
    return kept.select("pair_id", "series_id", "earlier", "later", F.col("shared").cast("long").alias("shared"), rounded("score").alias("score"))


@query(
    "j04_rejected_population",
    f"with {SCORED} select series_id, count(*) as universe, count(*) filter (score >= 0.3 and shared >= 2) as candidates, count(*) filter (not (score >= 0.3 and shared >= 2)) as rejected from scored group by 1 union all select series_id, 0, 0, 0 from items where o > 0 group by 1 having count(distinct o) = 1",
)
def j04(spark: SparkSession, folder: str) -> DataFrame:
    own = items(spark, folder)
    return P.rejected_population(own, P.candidate_counts(own))


@query(
    "j05_pair_features",
    f"with {SCORED} select earlier, later, least(na, nb)::bigint as smaller, greatest(na, nb)::bigint as larger, shared::bigint as shared, round(score, 6) as score, round(shared / (na + nb - shared), 6) as jaccard, score >= 0.5 as strict from scored where score >= 0.3 and shared >= 2",
)
def j05(spark: SparkSession, folder: str) -> DataFrame:
    s = P.scored_candidates(stored(items(spark, folder)))  # the items are read twice; shuffle files of the decisions are gone by then
    long = lambda c: c.cast("long")
    return s.select("earlier", "later", long(F.least("na", "nb")).alias("smaller"), long(F.greatest("na", "nb")).alias("larger"), long(F.col("shared")).alias("shared"), rounded("score").alias("score"), rounded(F.col("shared") / (F.col("na") + F.col("nb") - F.col("shared"))).alias("jaccard"), (F.col("score") >= 0.5).alias("strict"))


GRID = [(t, m) for t in (0.3, 0.4, 0.5, 0.6) for m in (1, 2, 3)]


@query(
    "a09_blocker_sensitivity",
    f"with {SCORED} select t as threshold, m::bigint as least_shared, count(*) filter (score >= t and shared >= m) as n_candidates, round(100.0 * count(*) filter (score >= t and shared >= m) / count(*), 6) as percent from scored cross join (values {', '.join(f'({t}::double, {m})' for t, m in GRID)}) as g(t, m) group by 1, 2",
)
def a09(spark: SparkSession, folder: str) -> DataFrame:
    """All cells in one pass over the loosest candidates; the universe's size comes from counts."""
    own = items(spark, folder)
    loosest = P.candidate_counts(own, min(t for t, _ in GRID), min(m for _, m in GRID))
    cells = loosest.agg(*[F.coalesce(F.sum(F.when((F.col("score") >= t) & (F.col("shared") >= m), F.col("n"))), F.lit(0)).alias(f"{t}_{m}") for t, m in GRID])
    long = cells.select(F.explode(F.array(*[F.struct(F.lit(float(t)).alias("threshold"), F.lit(m).cast("long").alias("least_shared"), F.col(f"`{t}_{m}`").alias("n_candidates")) for t, m in GRID])).alias("c")).select("c.*")
    total = P.universe_size(own).agg(F.sum("universe").alias("all"))
    return long.crossJoin(total).select("threshold", "least_shared", "n_candidates", rounded(100 * F.col("n_candidates") / F.col("all")).alias("percent"))


@query("a10_candidate_funnel", f"with {SCORED} select count(*) as universe, count(*) filter (score >= 0.3) as by_score, count(*) filter (score >= 0.3 and shared >= 2) as by_both, round(count(*) filter (score >= 0.3 and shared >= 2) * 1.5 / 60, 6) as hours from scored")
def a10(spark: SparkSession, folder: str) -> DataFrame:
    own = items(spark, folder)
    n = lambda least: F.coalesce(F.sum(F.when(F.col("shared") >= least, F.col("n"))), F.lit(0))
    one = P.candidate_counts(own, P.THRESHOLD, 1).agg(n(1).alias("by_score"), n(2).alias("by_both"))
    return P.universe_size(own).agg(F.sum("universe").alias("universe")).crossJoin(one).select("universe", "by_score", "by_both", rounded(F.col("by_both") * 1.5 / 60).alias("hours"))


@query(
    "u01_candidate_set_similarity",
    f"with t as (select pair_id, {terms_sql('earlier_text')} as a, {terms_sql('later_text')} as b from {CANDIDATES}) select pair_id, round(case when least(len(a), len(b)) > 0 then len(list_intersect(a, b)) / least(len(a), len(b)) else 0.0 end, 6) as overlap, round(case when len(a) + len(b) > 0 then len(list_intersect(a, b)) / (len(a) + len(b) - len(list_intersect(a, b))) else 0.0 end, 6) as jaccard from t",
)
def u01(spark: SparkSession, folder: str) -> DataFrame:
    t = candidates(spark, folder).select("pair_id", decision_terms(F.col("earlier_text")).alias("a"), decision_terms(F.col("later_text")).alias("b"))
    return t.select("pair_id", rounded(P.overlap_coefficient(F.col("a"), F.col("b"))).alias("overlap"), rounded(P.jaccard(F.col("a"), F.col("b"))).alias("jaccard"))


@query(
    "p07_machine_flags",
    f"""select decision_id, concat_ws(';', case when evidence_da_count = 0 then 'sin_evidencia' end,
    case when len(string_split(sentence_text, ',')) - 1 >= 2 or (contains(sentence_text, ' and ') and contains(sentence_text, ',')) then 'posible_compuesta' end,
    case when len({terms_sql('sentence_text')}) < 4 then 'frase_corta' end) as flags from {DECISIONS}""",
)
def p07(spark: SparkSession, folder: str) -> DataFrame:
    text = F.coalesce("sentence_text", F.lit(""))
    commas = F.length(text) - F.length(F.replace(text, F.lit(","), F.lit("")))
    flags = F.concat_ws(";", F.when(F.col("evidence_da_count") == 0, "sin_evidencia"), F.when((commas >= 2) | (text.contains(" and ") & (commas >= 1)), "posible_compuesta"), F.when(F.size(decision_terms(text)) < 4, "frase_corta"))
    return decisions(spark, folder).select("decision_id", flags.alias("flags"))


@query("p01_blocking_text", f"select decision_id, trim(concat_ws(' ', decision_object, decision_content)) as blocking_text, decision_object || ': ' || decision_content as pair_text from {DECISIONS}")
def p01(spark: SparkSession, folder: str) -> DataFrame:
    return decisions(spark, folder).select("decision_id", F.trim(F.concat_ws(" ", "decision_object", "decision_content")).alias("blocking_text"), F.concat("decision_object", F.lit(": "), "decision_content").alias("pair_text"))


@query("p04_site_prefix", f"select substr(series_id, 1, 2) as site, count(*) as n, count(distinct series_id) as n_series from {DECISIONS} group by 1")
def p04(spark: SparkSession, folder: str) -> DataFrame:
    return decisions(spark, folder).groupBy(F.substring("series_id", 1, 2).alias("site")).agg(F.count("*").alias("n"), F.countDistinct("series_id").alias("n_series"))


@query("p08_truncated_evidence", f"select decision_id, case when length(evidence_text) > 80 then substr(evidence_text, 1, 80) || ' [...]' else evidence_text end as evidence from {DECISIONS}")
def p08(spark: SparkSession, folder: str) -> DataFrame:
    cut = F.when(F.length("evidence_text") > 80, F.concat(F.substring("evidence_text", 1, 80), F.lit(" [...]"))).otherwise(F.col("evidence_text"))
    return decisions(spark, folder).select("decision_id", cut.alias("evidence"))


@query("p12_decisions_matching", f"select decision_id, decision_content from {DECISIONS} where regexp_matches(decision_content, '(?i)\\b(sensor|motor)\\b')")
def p12(spark: SparkSession, folder: str) -> DataFrame:
    return decisions(spark, folder).where(F.col("decision_content").rlike(r"(?i)\b(sensor|motor)\b")).select("decision_id", "decision_content")


@query("f10_evidence_speakers", f"select speaker, count(*) as n from (select unnest(string_split(evidence_text, ' | ')) as turn from {DECISIONS}) t, lateral (select nullif(regexp_extract(turn, '^([A-Z]): ', 1), '') as speaker) where speaker is not null group by 1")
def f10(spark: SparkSession, folder: str) -> DataFrame:
    turns = decisions(spark, folder).select(F.explode(F.split("evidence_text", r" \| ")).alias("turn"))
    return turns.select(F.regexp_extract("turn", "^([A-Z]): ", 1).alias("speaker")).where("speaker <> ''").groupBy("speaker").agg(F.count("*").alias("n"))
