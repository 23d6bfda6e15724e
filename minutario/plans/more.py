"""Further rows of the survey, most of them a filter and an aggregate over what other plans prepare."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from minutario.functions import scalar as S
from minutario.functions.text import plain_label
from minutario.operators import intervals, transcripts
from minutario.operators import retrieval as R
from minutario.operators.agreement import kappa
from minutario.operators.stats import line_outliers
from minutario.plans.common import ADJUDICATIONS, CANDIDATES, CHUNKS, DECISIONS, REVIEWS, adjudications, candidates, chunks, decisions, label_sql, reviews, rounded, table
from minutario.plans.evaluation import GOLD_SQL, TIED_SQL, _gold, _status
from minutario.plans.registry import query
from minutario.plans.retrieval import BM25, DENSE, dense, lexical
from minutario.plans.statistics import Z, round_all
from minutario.schemas import RELATION_LABELS, STATUS_LABELS

RELATION = lambda c: f"case when {label_sql(c)} in ({', '.join(repr(x) for x in RELATION_LABELS)}) then {label_sql(c)} end"


# Predicates and validation


@query("p06_decision_test", f"select decision_id, case when evidence_da_count > 0 and {label_sql('status')} = 'decision' and length(sentence_text) > 0 then 'accepted' end as verdict from {DECISIONS}")
def p06(spark: SparkSession, folder: str) -> DataFrame:
    ok = (F.col("evidence_da_count") > 0) & (plain_label(F.col("status"), STATUS_LABELS) == "decision") & (F.length("sentence_text") > 0)
    return decisions(spark, folder).select("decision_id", F.when(ok, "accepted").alias("verdict"))


@query("p11_visible_meetings", f"with m as (select distinct series_id, meeting_id, strpos('abcd', right(meeting_id, 1)) as o from {DECISIONS}) select a.meeting_id, count(*) as n_visible from m a join m b on a.series_id = b.series_id and b.o <= a.o where a.o > 0 and b.o > 0 group by 1")
def p11(spark: SparkSession, folder: str) -> DataFrame:
    m = decisions(spark, folder).select("series_id", "meeting_id", F.instr(F.lit("abcd"), F.right("meeting_id", F.lit(1))).alias("o")).distinct().where("o > 0")
    b = m.select("series_id", F.col("o").alias("p"))
    return m.join(b, "series_id").where("p <= o").groupBy("meeting_id").agg(F.count("*").alias("n_visible"))


@query("p13_found_turns", f"select chunk_id from {CHUNKS} where contains(lower(text), 'sensor') and char_start between 0 and 5000")
def p13(spark: SparkSession, folder: str) -> DataFrame:
    return chunks(spark, folder).where(F.lower("text").contains("sensor") & F.col("char_start").between(0, 5000)).select("chunk_id")


@query("p13_term_search", f"select chunk_id from {CHUNKS} where contains(lower(text), 'sensor')")
def p13_all(spark: SparkSession, folder: str) -> DataFrame:
    """All chunks that name a sensor, wherever they begin."""
    return transcripts.found_turns(chunks(spark, folder), "text", "char_start", "Sensor").select("chunk_id")


@query("p14_with_flags", f"select decision_id from {DECISIONS} where list_has_any(string_split(machine_flags, ';'), ['sin_evidencia', 'posible_compuesta'])")
def p14(spark: SparkSession, folder: str) -> DataFrame:
    """The test on the tables' one list of codes, the flags of a decision."""
    flags = decisions(spark, folder).withColumn("flags", F.split("machine_flags", ";"))
    return transcripts.turns_with_acts(flags, "flags", ["sin_evidencia", "posible_compuesta"]).select("decision_id")


QUESTION_RULES = [("no_reference", "coalesce(trim(respuesta_referencia), '') = '' and stratum not like 'E4%'"), ("reference_unwanted", "coalesce(trim(respuesta_referencia), '') <> '' and stratum like 'E4%'"), ("no_mark", "not regexp_matches(pregunta, '\\?\\s*$')"), ("odd_id", "not regexp_matches(pregunta_id, '^[A-Z]+[0-9]+\\.q[0-9]+$')")]


@query("p21_question_issues", " union all ".join(f"select pregunta_id, '{n}' as issue from {REVIEWS} where {c}" for n, c in QUESTION_RULES))
def p21(spark: SparkSession, folder: str) -> DataFrame:
    from minutario.operators.validation import issues

    blank, e4 = F.coalesce(F.trim("respuesta_referencia"), F.lit("")) == "", F.col("stratum").startswith("E4")
    return issues(reviews(spark, folder), "pregunta_id", {"no_reference": blank & ~e4, "reference_unwanted": ~blank & e4, "no_mark": ~F.col("pregunta").rlike(r"\?\s*$"), "odd_id": ~F.col("pregunta_id").rlike(r"^[A-Z]+[0-9]+\.q[0-9]+$")})


@query("p26_adjudication_issues", f"select decision_id, case when {_status('final')} is null then 'open' else 'final_without_votes' end as issue from {ADJUDICATIONS} where {_status('final')} is null or ({_status('gm')} is null and {_status('gv')} is null and {_status('ka')} is null)")
def p26(spark: SparkSession, folder: str) -> DataFrame:
    x = adjudications(spark, folder).select("decision_id", *[plain_label(F.col(f"{p}_status"), STATUS_LABELS).alias(p) for p in ("gm", "gv", "ka", "final")])
    return x.where("final is null or (gm is null and gv is null and ka is null)").select("decision_id", F.when(F.col("final").isNull(), "open").otherwise("final_without_votes").alias("issue"))


@query("p29_stale_copies", f"select change, count(*) as n from (select case when d.decision_id is null then 'unknown' when c.t is null then 'blank' when lower(c.t) is distinct from lower(d.sentence_text) then 'changed' else 'same' end as change from (select earlier_decision_id as id, earlier_text as t from {CANDIDATES}) c left join {DECISIONS} d on d.decision_id = c.id) group by 1")
def p29(spark: SparkSession, folder: str) -> DataFrame:
    d = decisions(spark, folder).select(F.col("decision_id").alias("id"), F.lit(True).alias("known"), "sentence_text")
    c = candidates(spark, folder).select(F.col("earlier_decision_id").alias("id"), F.col("earlier_text").alias("t"))
    change = F.when(F.col("known").isNull(), "unknown").when(F.col("t").isNull(), "blank").when(~F.lower("t").eqNullSafe(F.lower("sentence_text")), "changed").otherwise("same")
    return c.join(d, "id", "left").groupBy(change.alias("change")).agg(F.count("*").alias("n"))


@query("p33_combined_partition", "select o_custkey % 50 as shard, case when count(distinct o_orderstatus) = 1 then min(o_orderstatus) else 'mixed' end as partition_ from orders group by 1")
def p33(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "orders").groupBy((F.col("o_custkey") % 50).alias("shard")).agg(F.when(F.countDistinct("o_orderstatus") == 1, F.min("o_orderstatus")).otherwise("mixed").alias("partition_"))


@query("p36_failed_criteria", "select l_returnflag as candidate, concat_ws(';', case when avg(l_discount) < 0.05 then 'discount' end, case when avg(l_tax) > 0.039 then 'tax' end, case when count(*) < 100 then 'size' end) as failed from lineitem group by 1")
def p36(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "lineitem").groupBy(F.col("l_returnflag").alias("candidate")).agg(F.concat_ws(";", F.when(F.avg("l_discount") < 0.05, "discount"), F.when(F.avg("l_tax") > 0.039, "tax"), F.when(F.count("*") < 100, "size")).alias("failed"))


# Joins


@query("j19_speaker_shares", f"with t as (select meeting_id, nullif(regexp_extract(turn, '^([A-Z]): ', 1), '') as speaker, length(turn) as l from (select meeting_id, unnest(string_split(evidence_text, ' | ')) as turn from {DECISIONS})), s as (select meeting_id, speaker, sum(l) as chars, count(*) as n from t where speaker is not null group by 1, 2) select meeting_id, speaker, chars::bigint as chars, n, round(chars / sum(chars) over (partition by meeting_id), 6) as share from s")
def j19(spark: SparkSession, folder: str) -> DataFrame:
    t = decisions(spark, folder).select("meeting_id", F.explode(F.split("evidence_text", r" \| ")).alias("turn"))
    s = t.withColumn("speaker", F.regexp_extract("turn", "^([A-Z]): ", 1)).where("speaker <> ''").groupBy("meeting_id", "speaker").agg(F.sum(F.length("turn")).alias("chars"), F.count("*").alias("n"))
    return s.withColumn("share", rounded(F.col("chars") / F.sum("chars").over(W.partitionBy("meeting_id"))))


@query("j21_matched_labels", f"select a, b, count(*) as n, count(*) filter (a = 'no_relacionada' and b = 'no_relacionada') as neither from (select {RELATION('gm_relation')} as a, {RELATION('ka_relation')} as b from {CANDIDATES}) where a is not null and b is not null group by 1, 2")
def j21(spark: SparkSession, folder: str) -> DataFrame:
    x = candidates(spark, folder).select(plain_label(F.col("gm_relation"), RELATION_LABELS).alias("a"), plain_label(F.col("ka_relation"), RELATION_LABELS).alias("b")).where("a is not null and b is not null")
    return x.groupBy("a", "b").agg(F.count("*").alias("n"), F.count_if((F.col("a") == "no_relacionada") & (F.col("b") == "no_relacionada")).alias("neither"))


@query("j25_reference_evidence", f"select d.decision_id, case when d.evidence_da_count > 0 then 'links' when d.evidence_text is not null and d.evidence_text <> '' then 'quote' else 'none' end as source from {DECISIONS} d join {ADJUDICATIONS} a using (decision_id) where {_status('final')} = 'decision'")
def j25(spark: SparkSession, folder: str) -> DataFrame:
    kept = adjudications(spark, folder).where(plain_label(F.col("final_status"), STATUS_LABELS) == "decision").select("decision_id")
    source = F.when(F.col("evidence_da_count") > 0, "links").when(F.col("evidence_text") != "", "quote").otherwise("none")
    return decisions(spark, folder).join(kept, "decision_id").select("decision_id", source.alias("source"))


@query("j28_gold_pairs", f"select pair_id, {RELATION('final_relation')} as relation, 'adjudicated' as source from {CANDIDATES} where {RELATION('final_relation')} is not null union all select pair_id, {RELATION('gm_relation')}, 'single' from {CANDIDATES} where {RELATION('final_relation')} is null and {RELATION('gm_relation')} is not null")
def j28(spark: SparkSession, folder: str) -> DataFrame:
    f, g = plain_label(F.col("final_relation"), RELATION_LABELS), plain_label(F.col("gm_relation"), RELATION_LABELS)
    x = candidates(spark, folder).select("pair_id", f.alias("f"), g.alias("g")).where("f is not null or g is not null")
    return x.select("pair_id", F.coalesce("f", "g").alias("relation"), F.when(F.col("f").isNotNull(), "adjudicated").otherwise("single").alias("source"))


@query("j32_against_baseline", "with m as (select event_type as model, user_id % 10 as series, avg(value) as m from events group by 1, 2) select c.model, count(*) as n_series, count(*) filter (c.m > b.m) as better, round(avg(c.m - b.m), 5) as gain from m c join m b on b.series = c.series and b.model = 'view' where c.model <> 'view' group by 1")
def j32(spark: SparkSession, folder: str) -> DataFrame:
    m = table(spark, folder, "events").groupBy(F.col("event_type").alias("model"), (F.col("user_id") % 10).alias("series")).agg(F.avg("value").alias("m"))
    both = m.where("model <> 'view'").join(m.where("model = 'view'").select("series", F.col("m").alias("b")), "series")
    return both.groupBy("model").agg(F.count("*").alias("n_series"), F.count_if(F.col("m") > F.col("b")).alias("better"), rounded(F.avg(F.col("m") - F.col("b")), 5).alias("gain"))


@query("j35_relabelled", f"select regexp_replace(decision_id, '^[A-Z]+[0-9]+', 'XX0') as relabelled, count(*) as n from {DECISIONS} group by 1")
def j35(spark: SparkSession, folder: str) -> DataFrame:
    return decisions(spark, folder).groupBy(F.regexp_replace("decision_id", "^[A-Z]+[0-9]+", "XX0").alias("relabelled")).agg(F.count("*").alias("n"))


# Aggregates


@query("a07_layer_coverage", f"with l as (select 'decisions' as layer, series_id, meeting_id from {DECISIONS} union select 'chunks', series_id, meeting_id from {CHUNKS} union select 'adjudications', series_id, meeting_id from {ADJUDICATIONS}), s as (select layer, series_id, count(distinct right(meeting_id, 1)) = 4 as whole, count(*) as n from l group by 1, 2) select layer, sum(n)::bigint as n_meetings, count(*) as n_series, count(*) filter (whole) as n_complete from s group by 1")
def a07(spark: SparkSession, folder: str) -> DataFrame:
    own = lambda name, df: df.select(F.lit(name).alias("layer"), "series_id", "meeting_id")
    layers = own("decisions", decisions(spark, folder)).unionByName(own("chunks", chunks(spark, folder))).unionByName(own("adjudications", adjudications(spark, folder))).distinct()
    s = layers.groupBy("layer", "series_id").agg((F.countDistinct(F.right("meeting_id", F.lit(1))) == 4).alias("whole"), F.count("*").alias("n"))
    return s.groupBy("layer").agg(F.sum("n").alias("n_meetings"), F.count("*").alias("n_series"), F.count_if("whole").alias("n_complete"))


@query("a30_distinct_settings", f"select stratum, array_to_string(list_sort(list_distinct(list(pista_automatica) filter (pista_automatica is not null))), '|') as hints from {REVIEWS} group by 1")
def a30(spark: SparkSession, folder: str) -> DataFrame:
    return reviews(spark, folder).groupBy("stratum").agg(F.array_join(F.array_sort(F.collect_set("pista_automatica")), "|").alias("hints"))


@query("a33_tally_by_verdict", f"select abstained, respuesta_referencia is null as no_reference, count(*) as n, round(avg(length(respuesta_c2)), 4) as mean_chars from {REVIEWS} group by 1, 2")
def a33(spark: SparkSession, folder: str) -> DataFrame:
    return reviews(spark, folder).groupBy("abstained", F.col("respuesta_referencia").isNull().alias("no_reference")).agg(F.count("*").alias("n"), rounded(F.avg(F.length("respuesta_c2")), 4).alias("mean_chars"))


@query("a35_presence_two_by_two", f"select count(*) filter (c and p) as with_both, count(*) filter (c and not p) as c_only, count(*) filter (not c and p) as p_only, count(*) filter (not c and not p) as neither from (select coalesce(objetos_de_la_base, '') like '%concepts/%' as c, coalesce(objetos_de_la_base, '') like '%decisions/%' as p from {REVIEWS})")
def a35(spark: SparkSession, folder: str) -> DataFrame:
    base = F.coalesce("objetos_de_la_base", F.lit(""))
    x = reviews(spark, folder).select(base.contains("concepts/").alias("c"), base.contains("decisions/").alias("p"))
    c, p = F.col("c"), F.col("p")
    return x.agg(F.count_if(c & p).alias("with_both"), F.count_if(c & ~p).alias("c_only"), F.count_if(~c & p).alias("p_only"), F.count_if(~c & ~p).alias("neither"))


@query("a46_break_even", "with s as (select o_orderpriority as p, avg(o_totalprice) as c from orders group by 1) select p as priority, case when (select c from s where p = '1-URGENT') - c > 0 then round(1000000 / ((select c from s where p = '1-URGENT') - c), 4) end as uses from s")
def a46(spark: SparkSession, folder: str) -> DataFrame:
    s = table(spark, folder, "orders").groupBy(F.col("o_orderpriority").alias("priority")).agg(F.avg("o_totalprice").alias("c"))
    base = s.where("priority = '1-URGENT'").select(F.col("c").alias("b"))
    saved = F.col("b") - F.col("c")
    return s.join(F.broadcast(base), F.lit(True), "left").select("priority", F.when(saved > 0, rounded(1000000 / saved, 4)).alias("uses"))


@query("a53_dense_by_run", f"with m as (select distinct meeting_id from {DECISIONS}), c as (select meeting_id, annotator, count(*) as n from {DECISIONS} where annotator is not null group by 1, 2) select m.meeting_id, a.annotator, coalesce(n, 0) as n from m cross join (select distinct annotator from c) a left join c on c.meeting_id = m.meeting_id and c.annotator = a.annotator")
def a53(spark: SparkSession, folder: str) -> DataFrame:
    d = decisions(spark, folder)
    c = d.where("annotator is not null").groupBy("meeting_id", "annotator").agg(F.count("*").alias("n"))
    grid = d.select("meeting_id").distinct().crossJoin(c.select("annotator").distinct())  # a handful of people
    return grid.join(c, ["meeting_id", "annotator"], "left").na.fill(0, ["n"])


@query("a57_ceiling_counts", f"select round(median(blocker_score), 6) as median, count(*) filter (blocker_score >= 0.3) as over_3, count(*) filter (blocker_score >= 0.5) as over_5, count(*) filter (blocker_score >= 0.7) as over_7 from {CANDIDATES} where blocker_score between 0 and 1")
def a57(spark: SparkSession, folder: str) -> DataFrame:
    s = F.col("blocker_score")
    return candidates(spark, folder).where("blocker_score between 0 and 1").agg(rounded(F.median(s)).alias("median"), F.count_if(s >= 0.3).alias("over_3"), F.count_if(s >= 0.5).alias("over_5"), F.count_if(s >= 0.7).alias("over_7"))


@query("a61_context_constraints", f"with m as (select meeting_id, sum(length(text)) as chars from {CHUNKS} group by 1) select count(*) as n_meetings, round(median(chars), 4) as median_chars, count(*) filter (chars * 0.25 > 1500) as over_window, round(count(*) filter (chars * 0.25 > 1500) / count(*), 6) as rate from m")
def a61(spark: SparkSession, folder: str) -> DataFrame:
    m = chunks(spark, folder).groupBy("meeting_id").agg(F.sum(F.length("text")).alias("chars"))
    over = F.col("chars") * 0.25 > 1500
    return m.agg(F.count("*").alias("n_meetings"), rounded(F.median("chars"), 4).alias("median_chars"), F.count_if(over).alias("over_window"), rounded(F.try_divide(F.count_if(over), F.count("*"))).alias("rate"))


# Windows, ranking, sets


@query("w03_first_hit_rank", f"with {DENSE} select d.query, min(d.rank) filter (a.label = b.label) as first_hit from dense d join embeddings a on a.vec_id = d.query join embeddings b on b.vec_id = d.doc where d.rank <= 10 group by 1")
def w03(spark: SparkSession, folder: str) -> DataFrame:
    label = table(spark, folder, "embeddings").select("vec_id", "label")
    top = dense(spark, folder).join(label.toDF("query", "a"), "query").join(label.toDF("doc", "b"), "doc")
    return top.groupBy("query").agg(F.min(F.when(F.col("a") == F.col("b"), F.col("rank"))).cast("long").alias("first_hit"))


@query("w13_first_under_ceiling", f"with c as (select t, avg((blocker_score >= t)::int) as share from (select blocker_score from {CANDIDATES} where blocker_score between 0 and 1) cross join (select round(0.05 + n * 0.05, 10) as t from range(0, 19) as r(n)) group by t) select min(t) as tau from c where share <= 0.1 + 1e-12")
def w13(spark: SparkSession, folder: str) -> DataFrame:
    x = candidates(spark, folder).where("blocker_score between 0 and 1")
    grid = [round(0.05 + n * 0.05, 10) for n in range(19)]
    cells = x.agg(*[F.struct(F.lit(t).alias("t"), F.avg((F.col("blocker_score") >= t).cast("int")).alias("share")).alias(f"c{k}") for k, t in enumerate(grid)])
    return cells.select(F.explode(F.array(*cells.columns)).alias("c")).select("c.*").where("share <= 0.1 + 1e-12").agg(F.min("t").alias("tau"))


@query("l01_full_ranking", f"with {BM25} select query, count(*) as n_hits, round(round(max(score), 8), 6) as best, round(round(min(score), 8), 6) as worst from bm25 group by 1")
def l01(spark: SparkSession, folder: str) -> DataFrame:
    return lexical(spark, folder).groupBy("query").agg(F.count("*").alias("n_hits"), rounded(F.max("score")).alias("best"), rounded(F.min("score")).alias("worst"))


@query("l08_screen_winner", "with g as (select l_returnflag || l_linestatus as candidate, l_linenumber as cell, avg(l_discount) as m from lineitem group by 1, 2), w as (select candidate, bool_and(m > 0.04) as ok, avg(m) as gain from g group by 1) select candidate, round(gain, 8) as gain from w where ok order by round(gain, 8) desc, candidate limit 1")
def l08(spark: SparkSession, folder: str) -> DataFrame:
    g = table(spark, folder, "lineitem").groupBy(F.concat("l_returnflag", "l_linestatus").alias("candidate"), "l_linenumber").agg(F.avg("l_discount").alias("m"))
    w = g.groupBy("candidate").agg(F.bool_and(F.col("m") > 0.04).alias("ok"), rounded(F.avg("m"), 8).alias("gain"))
    return w.where("ok").orderBy(F.desc("gain"), "candidate").limit(1).select("candidate", "gain")


@query("u03_match_concordance", f"with a as (select pair_id from {CANDIDATES} where {RELATION('gm_relation')} <> 'no_relacionada'), b as (select pair_id from {CANDIDATES} where {RELATION('gv_relation')} <> 'no_relacionada') select round(case when (select count(*) from (select * from a union select * from b)) = 0 then 1.0 else (select count(*) from (select * from a intersect select * from b)) / (select count(*) from (select * from a union select * from b)) end, 6) as concordance")
def u03(spark: SparkSession, folder: str) -> DataFrame:
    """Equal to set operations, in one pass: both conditions are columns of one row."""
    on = lambda p: F.coalesce(plain_label(F.col(f"{p}_relation"), RELATION_LABELS) != "no_relacionada", F.lit(False))
    x = candidates(spark, folder).agg(F.count_if(on("gm") & on("gv")).alias("i"), F.count_if(on("gm") | on("gv")).alias("u"))
    return x.select(F.when(F.col("u") == 0, 1.0).otherwise(rounded(F.try_divide("i", "u"))).alias("concordance"))


# Functions


@query("f02_retrieval_tokens", f"select chunk_id, len(list_filter(regexp_extract_all(lower(coalesce(text, '')), '[\\p{{L}}]+'), lambda w: w not in ({', '.join(repr(w) for w in R.RETRIEVAL_STOP_WORDS)})))::bigint as n from {CHUNKS}")
def f02(spark: SparkSession, folder: str) -> DataFrame:
    return chunks(spark, folder).select("chunk_id", F.size(R.retrieval_tokens(F.col("text"))).cast("long").alias("n"))


@query("f28_score_bins", f"select pair_id, round(round(floor(blocker_score / 0.05 + 1e-9) * 0.05, 10), 4) as low from {CANDIDATES} where blocker_score between 0 and 1")
def f28(spark: SparkSession, folder: str) -> DataFrame:
    return candidates(spark, folder).where("blocker_score between 0 and 1").select("pair_id", F.round(S.bin_low(F.col("blocker_score"), 0.05), 4).alias("low"))


@query("f30_concept_kinds", f"select kind, count(*) as n from (select case when split_part(cell, '/', 1) in ('decisions', 'concepts', 'events') and contains(cell, '/') then split_part(cell, '/', 1) else 'other' end as kind from (select unnest(string_split(objetos_de_la_base, ' | ')) as cell from {REVIEWS})) group by 1")
def f30(spark: SparkSession, folder: str) -> DataFrame:
    cells = reviews(spark, folder).select(F.explode(F.split("objetos_de_la_base", r" \| ")).alias("cell"))
    head = F.split_part("cell", F.lit("/"), F.lit(1))
    return cells.groupBy(F.when(head.isin("decisions", "concepts", "events") & F.col("cell").contains("/"), head).otherwise("other").alias("kind")).agg(F.count("*").alias("n"))


@query("f36_padded_answers", f"select pregunta_id, length(respuesta_c2 || ' ' || respuesta_c2)::bigint as n_chars from {REVIEWS} where respuesta_c2 is not null")
def f36(spark: SparkSession, folder: str) -> DataFrame:
    return reviews(spark, folder).where("respuesta_c2 is not null").select("pregunta_id", F.length(F.concat("respuesta_c2", F.lit(" "), "respuesta_c2")).cast("long").alias("n_chars"))


# Intervals


@query("t02_scaled_interval", f"with x as (select count(*) as n, count(*) filter ({TIED_SQL}) as k from {CANDIDATES} where {GOLD_SQL}), y as (select *, (select count(*) from {CANDIDATES}) as population from x) select n, k, population, round(k / n * population, 4) as estimate, round(greatest(0, (k / n + {Z}*{Z} / (2 * n) - {Z} * sqrt(k / n * (1 - k / n) / n + {Z}*{Z} / (4 * n * n))) / (1 + {Z}*{Z} / n)) * population, 4) as lower from y where n > 0")
def t02(spark: SparkSession, folder: str) -> DataFrame:
    relation = plain_label(F.col("final_relation"), RELATION_LABELS)
    tied = relation.isin("reafirma", "refina", "revierte", "reemplaza")
    x = candidates(spark, folder).agg(F.count_if(relation.isNotNull()).alias("n"), F.count_if(tied).alias("k"), F.count("*").alias("population")).where("n > 0")
    low, _ = intervals.wilson(F.col("k") / F.col("n"), F.col("n"))
    return x.select("n", "k", "population", rounded(F.col("k") / F.col("n") * F.col("population"), 4).alias("estimate"), rounded(low * F.col("population"), 4).alias("lower"))


@query("t10_cluster_quantiles")
def t10(spark: SparkSession, folder: str) -> DataFrame:
    """Cluster bootstrap of a mean with interpolated quantiles: users of one event type are drawn as wholes."""
    sums = table(spark, folder, "events").groupBy("event_type", (F.col("user_id") % 100).alias("cluster")).agg(F.sum("value").alias("s"), F.count("value").alias("n"))

    def one(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("cluster")
        s, n = frame["s"].to_numpy(), frame["n"].to_numpy()
        draws = np.random.default_rng(0).integers(0, len(s), (500, len(s)))
        means = s[draws].sum(1) / n[draws].sum(1)
        low, high = np.quantile(means, [0.025, 0.975])
        return pd.DataFrame({"event_type": [key[0]], "mean": [s.sum() / n.sum()], "lower": [low], "upper": [high]})

    return round_all(sums.groupBy("event_type").applyInPandas(one, "event_type string, mean double, lower double, upper double"))


@query("t12_kappa_interval")
def t12(spark: SparkSession, folder: str) -> DataFrame:
    """Bootstrap of kappa from the contingency table; resamples without a defined kappa don't count."""
    x = adjudications(spark, folder).select(plain_label(F.col("gm_status"), STATUS_LABELS).alias("a"), plain_label(F.col("gv_status"), STATUS_LABELS).alias("b")).where("a is not null and b is not null")
    cells = sorted((r.a, r.b, r["count"]) for r in x.groupBy("a", "b").count().collect())  # at most 25 cells
    labels = {v: i for i, v in enumerate(sorted({v for a, b, _ in cells for v in (a, b)}))}
    total, drawn = sum(n for *_, n in cells), []
    rng = np.random.default_rng(0)
    for sample in rng.multinomial(total, [n / total for *_, n in cells], 1000) if total else []:
        m = np.zeros((len(labels), len(labels)))
        for (a, b, _), n in zip(cells, sample):
            m[labels[a], labels[b]] = n
        chance = (m.sum(0) * m.sum(1)).sum() / total**2
        if chance < 1:
            drawn.append((np.trace(m) / total - chance) / (1 - chance))
    bounds = np.quantile(drawn, [0.025, 0.975]).tolist() if drawn else [None, None]
    interval = spark.createDataFrame([tuple(bounds)], "lower double, upper double")
    return round_all(kappa(x, "a", "b").crossJoin(interval))


@query("t19_threshold_table", f"with g as (select blocker_score as s, {TIED_SQL} as tied from {CANDIDATES} where {GOLD_SQL} and blocker_score between 0 and 1) select t as threshold, count(*) filter (s >= t) as flagged, count(*) filter (s >= t and tied) as caught, round(count(*) filter (s >= t and not tied) / nullif(count(*) filter (not tied), 0), 6) as false_alarm_rate from g cross join (values (0.1::double), (0.3), (0.5)) as v(t) group by t")
def t19(spark: SparkSession, folder: str) -> DataFrame:
    g, s = _gold(spark, folder).where("blocker_score between 0 and 1"), F.col("blocker_score")
    cells = g.agg(*[F.struct(F.lit(t).alias("threshold"), F.count_if(s >= t).alias("flagged"), F.count_if((s >= t) & F.col("tied")).alias("caught"), rounded(F.try_divide(F.count_if((s >= t) & ~F.col("tied")), F.count_if(~F.col("tied")))).alias("false_alarm_rate")).alias(f"c{k}") for k, t in enumerate((0.1, 0.3, 0.5))])
    return cells.select(F.explode(F.array(*cells.columns)).alias("c")).select("c.*")


# Agreement and scores


@query("m05_chance_agreement", f"with x as (select {_status('gm')} as a, {_status('gv')} as b from {ADJUDICATIONS}), k as (select * from x where a is not null and b is not null), r as (select a as l, count(*) / (select count(*) from k) as p from k group by 1), s as (select b as l, count(*) / (select count(*) from k) as q from k group by 1) select round(coalesce(sum(p * q), 0), 6) as expected from r join s using (l)")
def m05(spark: SparkSession, folder: str) -> DataFrame:
    x = adjudications(spark, folder).select(plain_label(F.col("gm_status"), STATUS_LABELS).alias("a"), plain_label(F.col("gv_status"), STATUS_LABELS).alias("b"))
    return kappa(x, "a", "b").select(rounded("expected").alias("expected"))


@query("m07_axis_profiles", f"select 'type' as axis, count(*) as n, round(avg((a = b)::int), 6) as percent, count(distinct a) as categories from (select {RELATION('gm_relation')} as a, {RELATION('gv_relation')} as b from {CANDIDATES}) where a <> 'no_relacionada' and b <> 'no_relacionada'")
def m07(spark: SparkSession, folder: str) -> DataFrame:
    x = candidates(spark, folder).select(*[plain_label(F.col(f"{p}_relation"), RELATION_LABELS).alias(n) for n, p in (("a", "gm"), ("b", "gv"))]).where("a <> 'no_relacionada' and b <> 'no_relacionada'")
    return x.agg(F.lit("type").alias("axis"), F.count("*").alias("n"), rounded(F.avg((F.col("a") == F.col("b")).cast("int"))).alias("percent"), F.countDistinct("a").alias("categories"))


@query("m08_pooled_by_site", f"select substr(series_id, 1, 2) as site, count(*) as n, count(*) filter (a = b) as same from (select series_id, {RELATION('gm_relation')} as a, {RELATION('gv_relation')} as b from {CANDIDATES}) where a is not null and b is not null group by grouping sets ((1), ())")
def m08(spark: SparkSession, folder: str) -> DataFrame:
    x = candidates(spark, folder).select(F.substring("series_id", 1, 2).alias("site"), *[plain_label(F.col(f"{p}_relation"), RELATION_LABELS).alias(n) for n, p in (("a", "gm"), ("b", "gv"))]).where("a is not null and b is not null")
    return x.groupingSets([[F.col("site")], []], "site").agg(F.count("*").alias("n"), F.count_if(F.col("a") == F.col("b")).alias("same"))


@query("m18_run_spread", "with r as (select event_type, user_id % 3 as run, avg(value) as m from events group by 1, 2) select event_type, count(*) as n_runs, round(avg(m), 5) as mean, round(stddev_samp(m), 5) as spread from r group by 1 having count(*) >= 3")
def m18(spark: SparkSession, folder: str) -> DataFrame:
    r = table(spark, folder, "events").groupBy("event_type", (F.col("user_id") % 3).alias("run")).agg(F.avg("value").alias("m"))
    return r.groupBy("event_type").agg(F.count("*").alias("n_runs"), rounded(F.avg("m"), 5).alias("mean"), rounded(F.stddev_samp("m"), 5).alias("spread")).where("n_runs >= 3")


@query("m44_reproducibility", "with a as (select event_id, event_type, round(value, 2) as v from events), b as (select event_id, event_type, round(value + case when event_id % 97 = 0 then 1 else 0 end, 2) as v from events) select (select count(*) from (select * from a except all select * from b)) + (select count(*) from (select * from b except all select * from a)) as n_changed")
def m44(spark: SparkSession, folder: str) -> DataFrame:
    """Rows that only one of two runs has; the second run changes every 97th event."""
    e = table(spark, folder, "events")
    a = e.select("event_id", "event_type", F.round("value", 2).alias("v"))
    b = e.select("event_id", "event_type", F.round(F.col("value") + F.when(F.col("event_id") % 97 == 0, 1).otherwise(0), 2).alias("v"))
    return a.exceptAll(b).unionAll(b.exceptAll(a)).agg(F.count("*").alias("n_changed"))


@query("e07_outlier_methods", "with m as (select avg(value) as a, stddev_samp(value) as s, quantile_cont(value, 0.25) as q1, quantile_cont(value, 0.75) as q3 from events), f as (select event_id, abs(value - a) / s > 2.5 as z, value < q1 - 1.5 * (q3 - q1) or value > q3 + 1.5 * (q3 - q1) as t from events, m) select event_id, concat_ws(',', case when z then 'zscore' end, case when t then 'iqr' end) as methods, (z::int + t::int)::bigint as n_methods from f where z or t")
def e07(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "events")
    m = e.agg(F.avg("value").alias("a"), F.stddev_samp("value").alias("s"), F.percentile("value", F.array(F.lit(0.25), F.lit(0.75))).alias("q"))
    q1, q3 = F.col("q")[0], F.col("q")[1]
    f = e.crossJoin(F.broadcast(m)).select("event_id", (F.abs(F.col("value") - F.col("a")) / F.col("s") > 2.5).alias("z"), ((F.col("value") < q1 - 1.5 * (q3 - q1)) | (F.col("value") > q3 + 1.5 * (q3 - q1))).alias("t"))
    return f.where("z or t").select("event_id", F.concat_ws(",", F.when(F.col("z"), "zscore"), F.when(F.col("t"), "iqr")).alias("methods"), (F.col("z").cast("long") + F.col("t").cast("long")).alias("n_methods"))


@query("e07_outlier_flags")
def e07_flags(spark: SparkSession, folder: str) -> DataFrame:
    """The events that any of the survey's four methods flags, at the survey's defaults."""
    return outlier_flags(table(spark, folder, "events"), "event_id", "value")


def outlier_flags(df: DataFrame, key: str, column: str, z: float = 3.0, k: float = 1.5) -> DataFrame:
    """(key, methods, n_methods) of the rows flagged by zscore, iqr, lof or mcd over one column."""
    m = df.agg(F.avg(column).alias("a"), F.stddev_samp(column).alias("s"), F.percentile(column, F.array(F.lit(0.25), F.lit(0.75))).alias("q"))
    q1, q3, v = F.col("q")[0], F.col("q")[1], F.col(column)
    fence = k * (q3 - q1)
    f = df.select(key, F.col(column).cast("double").alias(column)).crossJoin(F.broadcast(m)).join(line_outliers(df, column), column, "left")
    tests = {"zscore": F.when(F.col("s") > 0, F.abs(v - F.col("a")) / F.col("s") > z), "iqr": (v < q1 - fence) | (v > q3 + fence), "lof": F.col("lof_flag"), "mcd": F.col("mcd_flag")}
    f = f.select(key, F.array_compact(F.array(*[F.when(t, n) for n, t in tests.items()])).alias("methods"))
    return f.where(F.size("methods") > 0).select(key, F.array_join("methods", ",").alias("methods"), F.size("methods").cast("long").alias("n_methods"))


@query("q06_disagreements", f"select decision_id, a, b, f, case when f = a then 'gm' when f = b then 'gv' else 'neither' end as side from (select decision_id, {_status('gm')} as a, {_status('gv')} as b, {_status('final')} as f from {ADJUDICATIONS}) where a <> b and f is not null")
def q06(spark: SparkSession, folder: str) -> DataFrame:
    x = adjudications(spark, folder).select("decision_id", *[plain_label(F.col(c), STATUS_LABELS).alias(n) for n, c in (("a", "gm_status"), ("b", "gv_status"), ("f", "final_status"))])
    return x.where("a <> b and f is not null").withColumn("side", F.when(F.col("f") == F.col("a"), "gm").when(F.col("f") == F.col("b"), "gv").otherwise("neither"))


@query("q07_disagreement_groups", f"select a, b, count(*) as n, min(decision_id) as example from (select decision_id, {_status('gm')} as a, {_status('gv')} as b from {ADJUDICATIONS}) where a <> b group by 1, 2")
def q07(spark: SparkSession, folder: str) -> DataFrame:
    x = adjudications(spark, folder).select("decision_id", plain_label(F.col("gm_status"), STATUS_LABELS).alias("a"), plain_label(F.col("gv_status"), STATUS_LABELS).alias("b")).where("a <> b")
    return x.groupBy("a", "b").agg(F.count("*").alias("n"), F.min("decision_id").alias("example"))


@query("q09_rows_of_a_status", f"select decision_id from {ADJUDICATIONS} where {_status('final')} = 'compuesta'")
def q09(spark: SparkSession, folder: str) -> DataFrame:
    return adjudications(spark, folder).where(plain_label(F.col("final_status"), STATUS_LABELS) == "compuesta").select("decision_id")


@query("q119_proposed_threshold", f"with a as (select min(blocker_score) as x from {CANDIDATES} where {TIED_SQL} and blocker_score between 0 and 1), b as (select quantile_cont(blocker_score, 0.5) as y from {CANDIDATES} where blocker_score between 0 and 1) select case when x is null or y is null then null else round(greatest(x, y), 6) end as tau from a, b")
def q119(spark: SparkSession, folder: str) -> DataFrame:
    tied = plain_label(F.col("final_relation"), RELATION_LABELS).isin("reafirma", "refina", "revierte", "reemplaza")
    x = candidates(spark, folder).where("blocker_score between 0 and 1").agg(F.min(F.when(tied, F.col("blocker_score"))).alias("x"), F.median("blocker_score").alias("y"))
    return x.select(F.when(F.col("x").isNotNull() & F.col("y").isNotNull(), rounded(F.greatest("x", "y"))).alias("tau"))
