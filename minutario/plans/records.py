"""Reviews, meetings, events and the star tables: aggregates, windows, validation, functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from minutario.functions import scalar as S
from minutario.functions.text import decision_id, plain_label
from minutario.operators import validation as V
from minutario.operators.pairs import meeting_order
from minutario.plans.common import ADJUDICATIONS, CANDIDATES, CHUNKS, DECISIONS, REVIEWS, adjudications, candidates, chunks, decisions, label_sql, reviews, rounded, table
from minutario.plans.registry import query
from minutario.schemas import RELATION_LABELS, STATUS_LABELS

# Reviews (answer records)


@query("a24_stratum_summary", f"select stratum, count(*) as n, count(*) filter (abstained) as abstained, count(*) filter (abstained is null) as unknown, round(count(*) filter (abstained) / nullif(count(abstained), 0), 6) as rate, round(avg(length(respuesta_c2)), 4) as mean_chars from {REVIEWS} group by 1")
def a24(spark: SparkSession, folder: str) -> DataFrame:
    return reviews(spark, folder).groupBy("stratum").agg(F.count("*").alias("n"), F.count_if("abstained").alias("abstained"), F.count_if(F.col("abstained").isNull()).alias("unknown"), rounded(F.try_divide(F.count_if("abstained"), F.count("abstained"))).alias("rate"), rounded(F.avg(F.length("respuesta_c2")), 4).alias("mean_chars"))


@query("a25_stage_split", f"select stratum, coalesce(nullif(trim(etapa_humana), ''), 'open') as stage, count(*) as n, round(count(*) / sum(count(*)) over (partition by stratum), 6) as share from {REVIEWS} group by 1, 2")
def a25(spark: SparkSession, folder: str) -> DataFrame:
    stage = F.coalesce(F.nullif(F.trim("etapa_humana"), F.lit("")), F.lit("open"))
    counts = reviews(spark, folder).groupBy("stratum", stage.alias("stage")).agg(F.count("*").alias("n"))
    return counts.withColumn("share", rounded(F.col("n") / F.sum("n").over(W.partitionBy("stratum"))))


@query("a39_hint_against_stage", f"select pista_automatica as hint, coalesce(nullif(trim(etapa_humana), ''), 'open') as stage, count(*) as n from {REVIEWS} group by 1, 2")
def a39(spark: SparkSession, folder: str) -> DataFrame:
    return reviews(spark, folder).groupBy(F.col("pista_automatica").alias("hint"), F.coalesce(F.nullif(F.trim("etapa_humana"), F.lit("")), F.lit("open")).alias("stage")).agg(F.count("*").alias("n"))


@query("a40_two_level_means", f"with q as (select stratum, series_id, avg(abstained::int) as m, count(abstained) as k from {REVIEWS} where abstained is not null group by 1, 2) select coalesce(stratum, 'ALL') as stratum, count(*) as n_units, sum(k)::bigint as n_records, round(avg(m), 6) as mean from q group by grouping sets ((stratum), ())")
def a40(spark: SparkSession, folder: str) -> DataFrame:
    unit = reviews(spark, folder).where("abstained is not null").groupBy("stratum", "series_id").agg(F.avg(F.col("abstained").cast("int")).alias("m"), F.count("*").alias("k"))
    sets = unit.groupingSets([[F.col("stratum")], []], "stratum").agg(F.count("*").alias("n_units"), F.sum("k").alias("n_records"), rounded(F.avg("m")).alias("mean"))
    return sets.withColumn("stratum", F.coalesce("stratum", F.lit("ALL")))


@query("f17_citations", f"select pregunta_id, list_sort(list_distinct(list_filter(list_transform(flatten(list_transform(regexp_extract_all(coalesce(respuesta_c2, ''), '\\[([0-9]+(?:\\s*,\\s*[0-9]+)*)\\]', 1), lambda g: string_split(g, ','))), lambda n: try_cast(trim(n) as int)), lambda n: n >= 1 and n <= 9)))::varchar as cited from {REVIEWS}")
def f17(spark: SparkSession, folder: str) -> DataFrame:
    numbers = S.citation_numbers(F.coalesce("respuesta_c2", F.lit("")), 9)
    return reviews(spark, folder).select("pregunta_id", F.concat(F.lit("["), F.array_join(numbers.cast("array<string>"), ", "), F.lit("]")).alias("cited"))


@query("p19_abstentions", f"select pregunta_id from {REVIEWS} where regexp_replace(replace(lower(respuesta_c2), '’', ''''), '^[\\s\".]+|[\\s\".]+$', '', 'g') in ('i don''t know', 'no lo sé')")
def p19(spark: SparkSession, folder: str) -> DataFrame:
    bare = F.regexp_replace(F.replace(F.lower("respuesta_c2"), F.lit("’"), F.lit("'")), '^[\\s".]+|[\\s".]+$', "")
    return reviews(spark, folder).where(bare.isin("i don't know", "no lo sé")).select("pregunta_id")


@query("a36_base_objects", f"select o.kind, count(*) as n, round(avg(o.score), 6) as mean_score, count(*) filter (o.found) as n_found from (select unnest(string_split(objetos_de_la_base, ' | ')) as cell from {REVIEWS}), lateral (select split_part(cell, '/', 1) as kind, try_cast(nullif(regexp_extract(cell, '\\(([0-9.]+)', 1), '') as double) as score, contains(cell, ', recuperado') as found) o where o.score is not null group by 1")
def a36(spark: SparkSession, folder: str) -> DataFrame:
    cells = reviews(spark, folder).select(F.explode(F.split("objetos_de_la_base", r" \| ")).alias("cell"))
    o = cells.select(F.split_part("cell", F.lit("/"), F.lit(1)).alias("kind"), F.regexp_extract("cell", r"\(([0-9.]+)", 1).try_cast("double").alias("score"), F.col("cell").contains(", recuperado").alias("found")).where("score is not null")
    return o.groupBy("kind").agg(F.count("*").alias("n"), rounded(F.avg("score")).alias("mean_score"), F.count_if("found").alias("n_found"))


@query("l04_best_object", f"select pregunta_id, name, score from (select pregunta_id, split_part(cell, ' ', 1) as name, try_cast(nullif(regexp_extract(cell, '\\(([0-9.]+)', 1), '') as double) as score from (select pregunta_id, unnest(string_split(objetos_de_la_base, ' | ')) as cell from {REVIEWS})) where score is not null qualify row_number() over (partition by pregunta_id order by score desc, name) = 1")
def l04(spark: SparkSession, folder: str) -> DataFrame:
    cells = reviews(spark, folder).select("pregunta_id", F.explode(F.split("objetos_de_la_base", r" \| ")).alias("cell"))
    named = cells.select("pregunta_id", F.split_part("cell", F.lit(" "), F.lit(1)).alias("name"), F.regexp_extract("cell", r"\(([0-9.]+)", 1).try_cast("double").alias("score")).where("score is not null")
    best = named.groupBy("pregunta_id").agg(F.min(F.struct((-F.col("score")).alias("s"), "name")).alias("b"))
    return best.select("pregunta_id", "b.name", (-F.col("b.s")).alias("score"))


# Decisions and meetings


@query("a01_dense_counts", f"with d as (select series_id, right(meeting_id, 1) as letter, count(*) as n from {DECISIONS} group by 1, 2) select s.series_id, l.letter, coalesce(n, 0) as n from (select distinct series_id from d) s cross join (values ('a'), ('b'), ('c'), ('d')) as l(letter) left join d on d.series_id = s.series_id and d.letter = l.letter")
def a01(spark: SparkSession, folder: str) -> DataFrame:
    d = decisions(spark, folder).groupBy("series_id", F.right("meeting_id", F.lit(1)).alias("letter")).agg(F.count("*").alias("n"))
    dense = d.select("series_id").distinct().select("series_id", F.explode(F.array(*map(F.lit, "abcd"))).alias("letter"))
    return dense.join(d, ["series_id", "letter"], "left").na.fill(0, ["n"])


@query("a02_by_position", f"with d as (select series_id, right(meeting_id, 1) as letter, count(*) as n from {DECISIONS} group by 1, 2) select letter, count(distinct series_id) as n_series, sum(n)::bigint as n_decisions, round(avg(n), 6) as mean from d where letter in ('a', 'b', 'c', 'd') group by 1")
def a02(spark: SparkSession, folder: str) -> DataFrame:
    d = decisions(spark, folder).groupBy("series_id", F.right("meeting_id", F.lit(1)).alias("letter")).agg(F.count("*").alias("n"))
    return d.where(F.col("letter").isin(*"abcd")).groupBy("letter").agg(F.countDistinct("series_id").alias("n_series"), F.sum("n").alias("n_decisions"), rounded(F.avg("n")).alias("mean"))


@query("a03_sentence_shape", f"select decision_id, length(sentence_text)::bigint as n_chars, len(regexp_extract_all(sentence_text, '\\S+'))::bigint as n_words from {DECISIONS} where sentence_text is not null")
def a03(spark: SparkSession, folder: str) -> DataFrame:
    words = F.size(F.regexp_extract_all("sentence_text", F.lit(r"\S+"), F.lit(0)))
    return decisions(spark, folder).where("sentence_text is not null").select("decision_id", F.length("sentence_text").cast("long").alias("n_chars"), words.cast("long").alias("n_words"))


MARKERS = ["no decision", "should", "will be", "euros", "not"]


@query("a04_markers", " union all ".join(f"select '{m}' as marker, count(*) filter (contains(lower(sentence_text), '{m}')) as n, count(*) as population, round(coalesce(count(*) filter (contains(lower(sentence_text), '{m}')) / nullif(count(*), 0), 0), 6) as rate from {DECISIONS}" for m in MARKERS))
def a04(spark: SparkSession, folder: str) -> DataFrame:
    text = F.lower("sentence_text")
    sums = decisions(spark, folder).agg(F.count("*").alias("p"), *[F.count_if(text.contains(m)).alias(m) for m in MARKERS])
    long = sums.select("p", F.explode(F.array(*[F.struct(F.lit(m).alias("marker"), F.col(f"`{m}`").alias("n")) for m in MARKERS])).alias("c"))
    return long.select("c.marker", "c.n", F.col("p").alias("population"), rounded(F.coalesce(F.try_divide("c.n", "p"), F.lit(0.0))).alias("rate"))


@query("a05_anchoring_rollup", f"select coalesce(series_id, 'ALL') as series_id, coalesce(meeting_id, 'ALL') as meeting_id, count(*) as n, count(*) filter (evidence_da_count > 0) as anchored, round(count(*) filter (evidence_da_count > 0) / count(*), 6) as rate from {DECISIONS} group by rollup (series_id, meeting_id)")
def a05(spark: SparkSession, folder: str) -> DataFrame:
    up = decisions(spark, folder).rollup("series_id", "meeting_id").agg(F.count("*").alias("n"), F.count_if(F.col("evidence_da_count") > 0).alias("anchored"))
    return up.select(F.coalesce("series_id", F.lit("ALL")).alias("series_id"), F.coalesce("meeting_id", F.lit("ALL")).alias("meeting_id"), "n", "anchored", rounded(F.col("anchored") / F.col("n")).alias("rate"))


@query("a06_site_status_sets", f"with d as (select substr(series_id, 1, 2) as site, case when {label_sql('status')} in ({', '.join(repr(x) for x in STATUS_LABELS)}) then {label_sql('status')} else 'none' end as status from {DECISIONS}) select coalesce(site, 'ALL') as site, status, count(*) as n, round(count(*) / sum(count(*)) over (partition by site), 6) as share from d group by grouping sets ((site, status), (status))")
def a06(spark: SparkSession, folder: str) -> DataFrame:
    d = decisions(spark, folder).select(F.substring("series_id", 1, 2).alias("site"), F.coalesce(plain_label(F.col("status"), STATUS_LABELS), F.lit("none")).alias("status"))
    sets = d.groupingSets([[F.col("site"), F.col("status")], [F.col("status")]], "site", "status").agg(F.count("*").alias("n"))
    return sets.select(F.coalesce("site", F.lit("ALL")).alias("site"), "status", "n", rounded(F.col("n") / F.sum("n").over(W.partitionBy("site"))).alias("share"))


@query("a08_series_eligibility", f"select series_id, count(distinct right(meeting_id, 1)) filter (right(meeting_id, 1) in ('a', 'b', 'c', 'd')) = 4 as complete, count(distinct meeting_id) as n_meetings, count(*) as n_decisions, string_agg(distinct right(meeting_id, 1), '' order by right(meeting_id, 1)) as letters from {DECISIONS} group by 1")
def a08(spark: SparkSession, folder: str) -> DataFrame:
    letter = F.right("meeting_id", F.lit(1))
    return decisions(spark, folder).groupBy("series_id").agg((F.countDistinct(F.when(letter.isin(*"abcd"), letter)) == 4).alias("complete"), F.countDistinct("meeting_id").alias("n_meetings"), F.count("*").alias("n_decisions"), F.array_join(F.array_sort(F.collect_set(letter)), "").alias("letters"))


@query("a12_text_length_quantiles", "select source, count(length(text)) as n, round(avg(length(text)), 4) as mean, round(quantile_cont(length(text), 0.25), 4) as q1, round(quantile_cont(length(text), 0.5), 4) as median, round(quantile_cont(length(text), 0.9), 4) as q90, round(quantile_cont(length(text), 0.99), 4) as q99, round(avg((length(text) < 40)::int), 6) as tiny from documents group by 1")
def a12(spark: SparkSession, folder: str) -> DataFrame:
    d = table(spark, folder, "documents").withColumn("l", F.length("text"))
    q = d.groupBy("source").agg(F.count("l").alias("n"), rounded(F.avg("l"), 4).alias("mean"), F.percentile("l", F.array(*map(F.lit, (0.25, 0.5, 0.9, 0.99)))).alias("q"), rounded(F.avg((F.col("l") < 40).cast("int"))).alias("tiny"))
    return q.select("source", "n", "mean", *[rounded(F.col("q")[k], 4).alias(n) for k, n in enumerate(("q1", "median", "q90", "q99"))], "tiny")


@query("a13_mode_annotator", f"select meeting_id, case when count(*) filter (r = 1) > 1 then 'mixed' else max(annotator) filter (r = 1) end as annotator, max(n) as n from (select meeting_id, annotator, count(*) as n, rank() over (partition by meeting_id order by count(*) desc) as r from {DECISIONS} where annotator is not null group by 1, 2) group by 1")
def a13(spark: SparkSession, folder: str) -> DataFrame:
    """The most frequent annotator of a meeting, mixed on a tie."""
    counts = decisions(spark, folder).where("annotator is not null").groupBy("meeting_id", "annotator").agg(F.count("*").alias("n"))
    top = counts.groupBy("meeting_id").agg(F.max("n").alias("n"))
    both = counts.join(top, ["meeting_id", "n"]).groupBy("meeting_id").agg(F.count("*").alias("k"), F.max("annotator").alias("a"), F.max("n").alias("n"))
    return both.select("meeting_id", F.when(F.col("k") > 1, "mixed").otherwise(F.col("a")).alias("annotator"), "n")


@query("a13_duplicate_texts", f"select decision_id, n from (select decision_id, trim(regexp_replace(lower(sentence_text), '\\s+', ' ', 'g')) as t, count(*) over (partition by trim(regexp_replace(lower(sentence_text), '\\s+', ' ', 'g'))) as n from {DECISIONS} where sentence_text is not null) where n > 1 and t <> ''")
def a13_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    """Counts are joined back, so a text with a third of the rows is no window partition."""
    t = decisions(spark, folder).where("sentence_text is not null").select("decision_id", S.collapsed(F.col("sentence_text")).alias("t")).where("t <> ''")
    return t.join(t.groupBy("t").agg(F.count("*").alias("n")).where("n > 1"), "t").select("decision_id", "n")


@query("a14_series_table", f"with m as (select series_id, meeting_id, count(*) as n from {DECISIONS} group by 1, 2), c as (select series_id, count(*) as pairs from {CANDIDATES} group by 1) select m.series_id, sum(n)::bigint as n_decisions, count(*) as n_meetings, round(median(n), 4) as median_per_meeting, coalesce(max(pairs), 0) as n_pairs from m left join c using (series_id) group by 1")
def a14(spark: SparkSession, folder: str) -> DataFrame:
    m = decisions(spark, folder).groupBy("series_id", "meeting_id").agg(F.count("*").alias("n"))
    s = m.groupBy("series_id").agg(F.sum("n").alias("n_decisions"), F.count("*").alias("n_meetings"), rounded(F.median("n"), 4).alias("median_per_meeting"))
    pairs = candidates(spark, folder).groupBy("series_id").agg(F.count("*").alias("n_pairs"))
    return s.join(pairs, "series_id", "left").na.fill(0, ["n_pairs"])


@query("a63_evolution_pairs", f"select {label_sql('final_relation')} as relation, count(*) as n, count(distinct series_id) as n_series from {CANDIDATES} where {label_sql('final_relation')} in ('reafirma', 'refina', 'revierte', 'reemplaza') group by 1")
def a63(spark: SparkSession, folder: str) -> DataFrame:
    r = plain_label(F.col("final_relation"), RELATION_LABELS)
    return candidates(spark, folder).where(r.isin("reafirma", "refina", "revierte", "reemplaza")).groupBy(r.alias("relation")).agg(F.count("*").alias("n"), F.countDistinct("series_id").alias("n_series"))


@query("a60_volumes_rollup", f"select coalesce(site, 'TOTAL') as site, n, round(n / max(n) over (), 6) as share from (select substr(series_id, 1, 2) as site, count(*) as n from {DECISIONS} group by rollup (substr(series_id, 1, 2)))")
def a60(spark: SparkSession, folder: str) -> DataFrame:
    up = decisions(spark, folder).withColumn("site", F.substring("series_id", 1, 2)).rollup("site").agg(F.count("*").alias("n"))
    return up.select(F.coalesce("site", F.lit("TOTAL")).alias("site"), "n", rounded(F.col("n") / F.max("n").over(W.partitionBy())).alias("share"))


@query("w06_share_of_meeting", f"select decision_id, round(length(sentence_text) / sum(length(sentence_text)) over (partition by meeting_id), 6) as share from {DECISIONS} where length(sentence_text) > 0")
def w06(spark: SparkSession, folder: str) -> DataFrame:
    d = decisions(spark, folder).withColumn("l", F.length("sentence_text")).where("l > 0")
    totals = d.groupBy("meeting_id").agg(F.sum("l").alias("s"))
    return d.join(totals, "meeting_id").select("decision_id", rounded(F.col("l") / F.col("s")).alias("share"))


@query("w05_rank_share", f"select pair_id, round(cume_dist() over (partition by series_id order by blocker_score desc), 6) as share from {CANDIDATES} where blocker_score is not null")
def w05(spark: SparkSession, folder: str) -> DataFrame:
    return candidates(spark, folder).where("blocker_score is not null").select("pair_id", rounded(F.cume_dist().over(W.partitionBy("series_id").orderBy(F.desc("blocker_score")))).alias("share"))


@query("a59_rate_by_score_bin", f"select round(floor(blocker_score / 0.05 + 1e-9) * 0.05, 4) as low, count(*) as n, count(*) filter ({label_sql('final_relation')} in ('reafirma', 'refina', 'revierte', 'reemplaza')) as tied from {CANDIDATES} where blocker_score between 0 and 1 group by 1")
def a59(spark: SparkSession, folder: str) -> DataFrame:
    tied = plain_label(F.col("final_relation"), RELATION_LABELS).isin("reafirma", "refina", "revierte", "reemplaza")
    return candidates(spark, folder).where("blocker_score between 0 and 1").groupBy(F.round(S.bin_low(F.col("blocker_score"), 0.05), 4).alias("low")).agg(F.count("*").alias("n"), F.count_if(tied).alias("tied"))


# Meetings


DAY_SQL = "translate(trim(date_only), '/.', '--')"
PARSED = f"case when regexp_matches({DAY_SQL}, '^\\d{{4}}-\\d{{2}}-\\d{{2}}$') then try_strptime({DAY_SQL}, '%Y-%m-%d') when regexp_matches({DAY_SQL}, '^\\d{{1,2}}-\\d{{1,2}}-\\d{{4}}$') then try_strptime({DAY_SQL}, '%d-%m-%Y') when regexp_matches({DAY_SQL}, '^\\d{{1,2}}-\\d{{1,2}}-\\d{{2}}$') then try_strptime({DAY_SQL}, '%d-%m-%y') end"
MINUTES = "case when try_cast(nullif(regexp_extract(start_time, '^\\s*(\\d{1,2})[hH:](\\d{2})\\s*$', 1), '') as int) < 24 and try_cast(nullif(regexp_extract(start_time, '^\\s*(\\d{1,2})[hH:](\\d{2})\\s*$', 2), '') as int) < 60 then try_cast(nullif(regexp_extract(start_time, '^\\s*(\\d{1,2})[hH:](\\d{2})\\s*$', 1), '') as int) * 60 + try_cast(nullif(regexp_extract(start_time, '^\\s*(\\d{1,2})[hH:](\\d{2})\\s*$', 2), '') as int) end"


def meetings(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "meetings").distinct()


@query("f23_meeting_dates", f"select distinct meeting_id, strftime({PARSED}, '%Y-%m-%d') as day, ({MINUTES})::bigint as minute from meetings")
def f23(spark: SparkSession, folder: str) -> DataFrame:
    return meetings(spark, folder).select("meeting_id", F.date_format(S.parsed_day(F.col("date_only")), "yyyy-MM-dd").alias("day"), S.clock_minutes(F.col("start_time")).cast("long").alias("minute")).distinct()


@query("a69_date_availability", f"select count(*) as n, count({PARSED}) as with_day, count({MINUTES}) as with_time, count(distinct {PARSED}) as n_days from (select distinct * from meetings)")
def a69(spark: SparkSession, folder: str) -> DataFrame:
    m = meetings(spark, folder).select(S.parsed_day(F.col("date_only")).alias("d"), S.clock_minutes(F.col("start_time")).alias("t"))
    return m.agg(F.count("*").alias("n"), F.count("d").alias("with_day"), F.count("t").alias("with_time"), F.countDistinct("d").alias("n_days"))


@query("a70_series_dates", f"with m as (select distinct series_id, meeting_id, {PARSED} as d from meetings), g as (select series_id, meeting_id, d, lag(d) over (partition by series_id order by meeting_id, d) as b from m where d is not null) select series_id, count(distinct d) as n_days, count(*) filter (d < b) as backwards, max(date_diff('day', b, d)) as longest_gap from g group by 1")
def a70(spark: SparkSession, folder: str) -> DataFrame:
    m = meetings(spark, folder).select("series_id", "meeting_id", S.parsed_day(F.col("date_only")).alias("d")).where("d is not null").distinct()
    g = m.withColumn("b", F.lag("d").over(W.partitionBy("series_id").orderBy("meeting_id", "d")))
    return g.groupBy("series_id").agg(F.countDistinct("d").alias("n_days"), F.count_if(F.col("d") < F.col("b")).alias("backwards"), F.max(F.datediff("d", "b")).cast("long").alias("longest_gap"))


@query("j20_meeting_table", f"with m as (select meeting_id, max(n_speakers) as speakers, max(duration_sec) as seconds from meetings group by 1), d as (select meeting_id, count(*) as decisions from {DECISIONS} group by 1), c as (select meeting_id, count(*) as chunks, sum(length(text)) as chars from {CHUNKS} group by 1) select m.meeting_id, speakers, round(seconds, 4) as seconds, coalesce(decisions, 0) as decisions, coalesce(chunks, 0) as chunks, coalesce(chars, 0)::bigint as chars from m left join d using (meeting_id) left join c using (meeting_id)")
def j20(spark: SparkSession, folder: str) -> DataFrame:
    m = table(spark, folder, "meetings").groupBy("meeting_id").agg(F.max("n_speakers").alias("speakers"), rounded(F.max("duration_sec"), 4).alias("seconds"))
    d = decisions(spark, folder).groupBy("meeting_id").agg(F.count("*").alias("decisions"))
    c = chunks(spark, folder).groupBy("meeting_id").agg(F.count("*").alias("chunks"), F.sum(F.length("text")).alias("chars"))
    return m.join(d, "meeting_id", "left").join(c, "meeting_id", "left").na.fill(0, ["decisions", "chunks", "chars"])


@query("j18_duration_gap", f"with m as (select meeting_id, max(duration_sec) as seconds from meetings group by 1), c as (select meeting_id, max(char_end) as last from {CHUNKS} group by 1) select meeting_id, round(seconds, 4) as seconds, last, round(last / nullif(seconds, 0), 4) as chars_per_second from m left join c using (meeting_id)")
def j18(spark: SparkSession, folder: str) -> DataFrame:
    m = table(spark, folder, "meetings").groupBy("meeting_id").agg(F.max("duration_sec").alias("s"))
    c = chunks(spark, folder).groupBy("meeting_id").agg(F.max("char_end").alias("last"))
    return m.join(c, "meeting_id", "left").select("meeting_id", rounded("s", 4).alias("seconds"), "last", rounded(F.try_divide("last", F.nullif("s", F.lit(0.0))), 4).alias("chars_per_second"))


# Validation


@query(
    "p30_consistency_checks",
    f"""select 'decision_without_meeting' as "check", count(*) as n from {DECISIONS} where meeting_id not in (select meeting_id from meetings)
    union all select 'adjudication_without_decision', count(*) from {ADJUDICATIONS} where decision_id not in (select decision_id from decisions)
    union all select 'meeting_twice', count(*) from (select meeting_id from (select distinct * from meetings) group by 1 having count(*) > 1)
    union all select 'chunk_without_meeting', count(*) from {CHUNKS} where meeting_id not in (select meeting_id from meetings)
    union all select 'series_of_another_meeting', count(*) from {DECISIONS} where regexp_extract(meeting_id, '^([A-Z]+[0-9]+)', 1) <> series_id
    union all select 'pair_with_itself', count(*) from {CANDIDATES} where earlier_decision_id = later_decision_id""",
)
def p30(spark: SparkSession, folder: str) -> DataFrame:
    d, m = decisions(spark, folder), meetings(spark, folder)
    checks = {
        "decision_without_meeting": V.dangling(d, "decision_id", "meeting_id", m, "meeting_id"),
        "adjudication_without_decision": adjudications(spark, folder).join(d.select("decision_id"), "decision_id", "left_anti"),
        "meeting_twice": V.duplicates(m, "meeting_id"),
        "chunk_without_meeting": V.dangling(chunks(spark, folder), "chunk_id", "meeting_id", m, "meeting_id"),
        "series_of_another_meeting": d.where(S.split_meeting_id(F.col("meeting_id"))[0] != F.col("series_id")),
        "pair_with_itself": candidates(spark, folder).where("earlier_decision_id = later_decision_id"),
    }
    rows = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("check"), "n") for name, df in checks.items()]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


RULES = [("no_text", "coalesce(trim(sentence_text), '') = ''"), ("no_content", "coalesce(trim(decision_content), '') = ''"), ("no_evidence", "evidence_da_count = 0"), ("odd_id", "not regexp_matches(decision_id, '^[A-Z]+[0-9]+[a-d]\\.d[0-9]+$')"), ("other_meeting", "split_part(decision_id, '.', 1) <> meeting_id")]


@query("p24_decision_issues", " union all ".join(f"select decision_id, '{n}' as issue from {DECISIONS} where {c}" for n, c in RULES))
def p24(spark: SparkSession, folder: str) -> DataFrame:
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    return V.issues(decisions(spark, folder), "decision_id", {"no_text": blank("sentence_text"), "no_content": blank("decision_content"), "no_evidence": F.col("evidence_da_count") == 0, "odd_id": ~F.col("decision_id").rlike(r"^[A-Z]+[0-9]+[a-d]\.d[0-9]+$"), "other_meeting": F.split_part("decision_id", F.lit("."), F.lit(1)) != F.col("meeting_id")})


@query("p23_question_minima", f"select stratum, count(*) as n, count(*) filter (length(trim(coalesce(respuesta_referencia, ''))) > 0) as with_reference, count(*) >= 25 as enough from {REVIEWS} group by 1")
def p23(spark: SparkSession, folder: str) -> DataFrame:
    return reviews(spark, folder).groupBy("stratum").agg(F.count("*").alias("n"), F.count_if(F.length(F.trim(F.coalesce("respuesta_referencia", F.lit("")))) > 0).alias("with_reference"), (F.count("*") >= 25).alias("enough"))


@query("p10_leakage", f"select pair_id from {CANDIDATES} where strpos('abcd', substr(split_part(trim(earlier_decision_id), '.', 1), -1)) > strpos('abcd', substr(split_part(trim(later_decision_id), '.', 1), -1))")
def p10(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs whose earlier side lies in a later meeting."""
    order = lambda c: F.instr(F.lit("abcd"), F.right(F.split_part(F.trim(c), F.lit("."), F.lit(1)), F.lit(1)))
    return candidates(spark, folder).where(order("earlier_decision_id") > order("later_decision_id")).select("pair_id")


@query("j22_adjudication_rows", f"select pair_id, gm, gv, gm = gv as agree, case when gm = gv then gm end as verdict from (select pair_id, {label_sql('gm_relation')} as gm, {label_sql('gv_relation')} as gv from {CANDIDATES}) where gm in ({', '.join(repr(x) for x in RELATION_LABELS)}) and gv in ({', '.join(repr(x) for x in RELATION_LABELS)})")
def j22(spark: SparkSession, folder: str) -> DataFrame:
    c = candidates(spark, folder).select("pair_id", *[plain_label(F.col(f"{p}_relation"), RELATION_LABELS).alias(p) for p in ("gm", "gv")])
    return c.where("gm is not null and gv is not null").select("*", (F.col("gm") == F.col("gv")).alias("agree"), F.when(F.col("gm") == F.col("gv"), F.col("gm")).alias("verdict"))


@query("j27_relation_mapping", f"with d as (select decision_id, {label_sql('status')} as s from {DECISIONS}), c as (select pair_id, regexp_replace(earlier_decision_id, '^\\s+|\\s+$', '', 'g') as a, regexp_replace(later_decision_id, '^\\s+|\\s+$', '', 'g') as b from {CANDIDATES}) select coalesce(x.s, 'unknown') as earlier, coalesce(y.s, 'unknown') as later, count(*) as n from c left join d x on x.decision_id = c.a left join d y on y.decision_id = c.b group by 1, 2")
def j27(spark: SparkSession, folder: str) -> DataFrame:
    d = decisions(spark, folder).select("decision_id", F.regexp_replace(F.regexp_replace(plain(F.col("status")), r"\s*\.$", ""), r"[\s_-]+", "_").alias("s"))
    bare = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    c = candidates(spark, folder).select(bare("earlier_decision_id").alias("a"), bare("later_decision_id").alias("b"))
    both = c.join(d.select(F.col("decision_id").alias("a"), F.col("s").alias("x")), "a", "left").join(d.select(F.col("decision_id").alias("b"), F.col("s").alias("y")), "b", "left")
    return both.groupBy(F.coalesce("x", F.lit("unknown")).alias("earlier"), F.coalesce("y", F.lit("unknown")).alias("later")).agg(F.count("*").alias("n"))


def plain(cell):
    from minutario.functions.text import without_accents

    return F.regexp_replace(without_accents(F.lower(cell)), r"^[\s\x{00A0}]+|[\s\x{00A0}]+$", "")


# Functions


@query("f29_pair_ids", f"select pair_id, substr(sha256(earlier_text || chr(31) || later_text), 1, 12) as id from {CANDIDATES} where earlier_text is not null and later_text is not null")
def f29(spark: SparkSession, folder: str) -> DataFrame:
    return candidates(spark, folder).where("earlier_text is not null and later_text is not null").select("pair_id", S.pair_id(F.col("earlier_text"), F.col("later_text")).alias("id"))


@query("f09_split_meeting", "select distinct meeting_id, coalesce(nullif(regexp_extract(meeting_id, '^([A-Z]+[0-9]+)([a-d])?$', 1), ''), meeting_id) as series, nullif(regexp_extract(meeting_id, '^([A-Z]+[0-9]+)([a-d])$', 2), '') as letter from meetings")
def f09(spark: SparkSession, folder: str) -> DataFrame:
    series, letter = S.split_meeting_id(F.col("meeting_id"))
    return table(spark, folder, "meetings").select("meeting_id", series.alias("series"), letter.alias("letter")).distinct()


_EN, _ES = (", ".join(f"'{w}'" for w in own) for own in (S.ENGLISH, S.SPANISH))
_W = "regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}]+')"


@query("a71_language_counts", f"select language, count(*) as n from (select case when es > en then 'es' when en > es then 'en' else 'unknown' end as language from (select len(list_filter({_W}, lambda w: w in ({_EN}))) as en, len(list_filter({_W}, lambda w: w in ({_ES}))) as es from documents)) group by 1")
def a71(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").groupBy(S.language_of(F.col("text")).alias("language")).agg(F.count("*").alias("n"))


@query("f06_collapsed_text", "select doc_id, md5(trim(regexp_replace(lower(text), '[\\s\\x0B\\x{0085}\\p{Z}]+', ' ', 'g'))) as hash from documents where text is not null and regexp_full_match(text, '[\\x00-\\x7F]*')")
def f06(spark: SparkSession, folder: str) -> DataFrame:
    ascii_only = table(spark, folder, "documents").where(F.col("text").rlike(r"^[\x00-\x7F]*$"))
    return ascii_only.select("doc_id", F.md5(S.collapsed(F.col("text"))).alias("hash"))


# Events and the star tables


@query("s31_latest_event", "select user_id, event_type, event_id, round(value, 4) as value from (select *, row_number() over (partition by user_id, event_type order by ts desc, event_id desc) as r from events) where r = 1")
def s31(spark: SparkSession, folder: str) -> DataFrame:
    last = table(spark, folder, "events").groupBy("user_id", "event_type").agg(F.max(F.struct("ts", "event_id", "value")).alias("l"))
    return last.select("user_id", "event_type", "l.event_id", rounded("l.value", 4).alias("value"))


@query("f43_event_props", "select json_extract_string(props, '$.k') as k, count(*) as n, round(sum(value), 2) as total from events group by 1")
def f43(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").groupBy(F.get_json_object("props", "$.k").alias("k")).agg(F.count("*").alias("n"), rounded(F.sum("value"), 2).alias("total"))


@query("c00_tumbling_windows", "select epoch_us(time_bucket(interval '1 hour', ts)) // 1000000 as start, event_type, count(*) as n, round(sum(value), 4) as total from events group by 1, 2")
def c00(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    w = e.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), rounded(F.sum("value"), 4).alias("total"))
    return w.select(F.unix_seconds("w.start").alias("start"), "event_type", "n", "total")


@query("c00_sessions", "with g as (select user_id, ts, case when lag(ts) over (partition by user_id order by ts) >= ts - interval '6 hours' and lag(ts) over (partition by user_id order by ts) + interval '6 hours' > ts then 0 else 1 end as new from events), s as (select user_id, ts, sum(new) over (partition by user_id order by ts range unbounded preceding) as s from g) select user_id, epoch_us(min(ts)) // 1000000 as start, count(*) as n from s group by user_id, s")
def c00_sessions(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    w = e.groupBy("user_id", F.session_window("ts", "6 hours").alias("w")).agg(F.count("*").alias("n"))
    return w.select("user_id", F.unix_seconds("w.start").alias("start"), "n")


@query("a42_cost_by_priority", "select o_orderpriority as priority, count(*) as n, round(avg(o_totalprice), 6) as mean, round(sum(o_totalprice), 2) as total from orders group by 1")
def a42(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "orders").groupBy(F.col("o_orderpriority").alias("priority")).agg(F.count("*").alias("n"), rounded(F.avg("o_totalprice")).alias("mean"), rounded(F.sum("o_totalprice"), 2).alias("total"))


@query("a43_ratio_to_baseline", "with m as (select l_shipmode_ as mode, avg(l_extendedprice) as m from (select l_returnflag || l_linestatus as l_shipmode_, l_extendedprice from lineitem) group by 1) select mode, round(m, 4) as mean, round(m / (select m from m where mode = 'NO'), 6) as ratio from m")
def a43(spark: SparkSession, folder: str) -> DataFrame:
    m = table(spark, folder, "lineitem").groupBy(F.concat("l_returnflag", "l_linestatus").alias("mode")).agg(F.avg("l_extendedprice").alias("m"))
    base = m.where("mode = 'NO'").select(F.col("m").alias("b"))
    return m.join(F.broadcast(base), F.lit(True), "left").select("mode", rounded("m", 4).alias("mean"), rounded(F.col("m") / F.col("b")).alias("ratio"))


@query("m14_break_even", "with c as (select n_regionkey as region, avg(c_acctbal) as c from customer join nation on c_nationkey = n_nationkey group by 1), s as (select n_regionkey as region, avg(s_acctbal) as s from supplier join nation on s_nationkey = n_nationkey group by 1) select r_name as region, case when s - c > 0 then round(10000 / (s - c), 4) end as queries from c join s using (region) join region on r_regionkey = region")
def m14(spark: SparkSession, folder: str) -> DataFrame:
    """Uses until a fixed cost is recovered; null where nothing is saved."""
    nation, region = table(spark, folder, "nation"), table(spark, folder, "region")
    mean = lambda t, k, v: table(spark, folder, t).join(F.broadcast(nation), F.col(k) == F.col("n_nationkey")).groupBy("n_regionkey").agg(F.avg(v).alias(t))
    both = mean("customer", "c_nationkey", "c_acctbal").join(mean("supplier", "s_nationkey", "s_acctbal"), "n_regionkey").join(region, F.col("r_regionkey") == F.col("n_regionkey"))
    saved = F.col("supplier") - F.col("customer")
    return both.select(F.col("r_name").alias("region"), F.when(saved > 0, rounded(10000 / saved, 4)).alias("queries"))


@query("j30_paired_difference", "with p as (select l_partkey, avg(l_quantity) filter (l_returnflag = 'A') as a, avg(l_quantity) filter (l_returnflag = 'R') as b from lineitem group by 1) select count(*) as n, round(avg(b - a), 6) as difference from p where a is not null and b is not null")
def j30(spark: SparkSession, folder: str) -> DataFrame:
    p = table(spark, folder, "lineitem").groupBy("l_partkey").agg(F.avg(F.when(F.col("l_returnflag") == "A", F.col("l_quantity"))).alias("a"), F.avg(F.when(F.col("l_returnflag") == "R", F.col("l_quantity"))).alias("b"))
    return p.where("a is not null and b is not null").agg(F.count("*").alias("n"), rounded(F.avg(F.col("b") - F.col("a"))).alias("difference"))


@query("j33_pairwise_overlap", "with s as (select distinct event_type as run, user_id from events), x as (select a.run as a, b.run as b, count(*) as shared from s a join s b on a.user_id = b.user_id and a.run < b.run group by 1, 2), n as (select run, count(*) as n from s group by 1) select a, b, shared, round(shared / (na.n + nb.n - shared), 6) as jaccard from x join n na on na.run = a join n nb on nb.run = b")
def j33(spark: SparkSession, folder: str) -> DataFrame:
    s = table(spark, folder, "events").select(F.col("event_type").alias("run"), "user_id").distinct()
    x = s.select(F.col("run").alias("a"), "user_id").join(s.select(F.col("run").alias("b"), "user_id"), "user_id").where("a < b").groupBy("a", "b").agg(F.count("*").alias("shared"))
    n = s.groupBy("run").agg(F.count("*").alias("n"))
    both = x.join(n.select(F.col("run").alias("a"), F.col("n").alias("na")), "a").join(n.select(F.col("run").alias("b"), F.col("n").alias("nb")), "b")
    return both.select("a", "b", "shared", rounded(F.col("shared") / (F.col("na") + F.col("nb") - F.col("shared"))).alias("jaccard"))


@query("w15_position_aggregates", "select variable, place, count(v) as n, round(avg(v), 5) as mean from (select l_linenumber as place, unnest(['l_quantity', 'l_discount']) as variable, unnest([l_quantity, l_discount]) as v from lineitem) group by 1, 2")
def w15(spark: SparkSession, folder: str) -> DataFrame:
    long = table(spark, folder, "lineitem").select(F.col("l_linenumber").alias("place"), "l_quantity", "l_discount").unpivot("place", ["l_quantity", "l_discount"], "variable", "v")
    return long.groupBy("variable", "place").agg(F.count("v").alias("n"), rounded(F.avg("v"), 5).alias("mean"))
