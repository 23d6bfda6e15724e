"""Retrieval, chunks, spans and alignment over the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from minutario.functions.text import decision_terms
from minutario.operators import agreement, alignment, intervals, spans
from minutario.operators import pairs as P
from minutario.operators import retrieval as R
from minutario.plans.blocking import SCORED, items
from minutario.plans.common import CHUNKS, DECISIONS, chunks, decisions, rounded, table
from minutario.plans.registry import query
from minutario.session import stored

STOP = ", ".join(f"'{w}'" for w in R.RETRIEVAL_STOP_WORDS)


def _tokens(text: str) -> str:
    return f"list_filter(regexp_extract_all(lower(coalesce({text}, '')), '[\\p{{L}}]+'), lambda w: w not in ({STOP}))"


BM25 = f"""docs as (select chunk_id as doc, {_tokens("text")} as w from {CHUNKS}), coll as (select count(*) as nd, avg(len(w)) as avgdl from docs),
tf as (select doc, len(w) as dl, term, count(*) as tf from (select doc, w, unnest(w) as term from docs) group by all), raw as (select term, ln((nd - count(*) + 0.5) / (count(*) + 0.5)) as raw from tf, coll group by term, nd),
idf as (select term, case when raw >= 0 then raw else 0.25 * (select avg(raw) from raw) end as idf from raw),
q as (select query, term, count(*) as times from (select item_id as query, unnest({_tokens("question")}) as term from eval_items) group by all),
bm25 as (select query, doc, sum(times * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) as score from q join idf using (term) join tf using (term), coll group by all)"""


def lexical(spark: SparkSession, folder: str) -> DataFrame:
    return R.bm25(chunks(spark, folder), "chunk_id", "text", table(spark, folder, "eval_items"), "item_id", "question").withColumn("score", rounded("score", 8))


@query("r08_bm25_top10", f"with {BM25} select query, doc, round(score, 8) as score, rank from (select *, row_number() over (partition by query order by round(score, 8) desc, doc) as rank from bm25) where rank <= 10")
def r08(spark: SparkSession, folder: str) -> DataFrame:
    top = R.top_k(lexical(spark, folder), 10, "doc")
    return top.select("query", "doc", "score", F.col("rank").cast("long").alias("rank"))


@query("r08_term_weights", f"with {BM25} select term, round(idf, 6) as idf from idf")
def r08_terms(spark: SparkSession, folder: str) -> DataFrame:
    return R.term_statistics(chunks(spark, folder), "chunk_id", "text")[1].select("term", rounded("idf").alias("idf"))


def dense(spark: SparkSession, folder: str, k: int = 10) -> DataFrame:
    """Every vector whose id is divisible by 50 against all vectors; the queries are a bounded share, so they go to all tasks when small."""
    vectors = table(spark, folder, "embeddings")
    asked = vectors.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query"), F.col("embedding").alias("q"))
    scored = asked.join(vectors.select(F.col("vec_id").alias("doc"), "embedding"), F.col("query") != F.col("doc"))
    return R.top_k(scored.select("query", "doc", rounded(R.cosine(F.col("q"), F.col("embedding")), 6).alias("score")), k, "doc")


DENSE = "dense as (select *, row_number() over (partition by query order by score desc, doc) as rank from (select a.vec_id as query, b.vec_id as doc, round(list_cosine_similarity(a.embedding::double[], b.embedding::double[]), 6) as score from embeddings a join embeddings b on a.vec_id <> b.vec_id where a.vec_id % 50 = 0))"


@query("l02_dense_top10", f"with {DENSE} select query, doc, score, rank from dense where rank <= 10")
def l02(spark: SparkSession, folder: str) -> DataFrame:
    return dense(spark, folder).select("query", "doc", "score", F.col("rank").cast("long").alias("rank"))


@query("r16_recall_at_k", f"with {DENSE} select k, round(avg(hit), 6) as same_label from (select k, d.query, count(*) filter (a.label = b.label) / max(k) as hit from dense d join (values (1), (5), (10)) as g(k) on d.rank <= k join embeddings a on a.vec_id = d.query join embeddings b on b.vec_id = d.doc group by k, d.query) group by k")
def r16(spark: SparkSession, folder: str) -> DataFrame:
    label = table(spark, folder, "embeddings").select("vec_id", "label")
    top = dense(spark, folder).join(label.select(F.col("vec_id").alias("query"), F.col("label").alias("a")), "query").join(label.select(F.col("vec_id").alias("doc"), F.col("label").alias("b")), "doc")
    cut = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.when(F.col("rank") <= k, (F.col("a") == F.col("b")).cast("int") / k).alias("s")) for k in (1, 5, 10)])).alias("c")
    return top.select("query", cut).select("query", "c.*").where("s is not null").groupBy("k", "query").agg(F.sum("s").alias("hit")).groupBy("k").agg(rounded(F.avg("hit")).alias("same_label"))


@query(
    "w02_rank_fusion",
    f"""with {BM25}, s as (select query, doc, row_number() over (partition by query order by round(score, 8) desc, doc) as rank from bm25),
    p as (select q.query, d.doc, round((select count(*) from (select distinct term from q as x where x.query = q.query) y where list_contains(d.w, y.term)) / 1.0, 6) as score from (select distinct query from q) q join docs d on true),
    c as (select query, doc, row_number() over (partition by query order by score desc, doc) as rank from p where score > 0),
    u as (select * from s where rank <= 10 union all select * from c where rank <= 10), f as (select query, doc, round(sum(1.0 / (60 + rank)), 10) as score from u group by all)
    select query, doc, score, rank from (select *, row_number() over (partition by query order by score desc, doc) as rank from f) where rank <= 5""",
)
def w02(spark: SparkSession, folder: str) -> DataFrame:
    """Fusion of BM25 with a plain count of the question's distinct terms."""
    first = R.top_k(lexical(spark, folder), 10, "doc")
    asked = table(spark, folder, "eval_items").select(F.col("item_id").alias("query"), F.explode(F.array_distinct(R.retrieval_tokens(F.col("question")))).alias("term"))
    terms = chunks(spark, folder).select(F.col("chunk_id").alias("doc"), F.explode(F.array_distinct(R.retrieval_tokens(F.col("text")))).alias("term"))
    second = R.top_k(asked.join(terms, "term").groupBy("query", "doc").agg(F.count("*").cast("double").alias("score")), 10, "doc")
    fused = R.reciprocal_rank_fusion([first, second]).withColumn("score", rounded("score", 10))
    return R.top_k(fused, 5, "doc").select("query", "doc", "score", F.col("rank").cast("long").alias("rank"))


@query("w09_merged_chunk_spans", f"with c as (select meeting_id, char_start, char_end from {CHUNKS} where char_start is not null and char_end is not null), m as (select *, max(char_end) over (partition by meeting_id order by char_start, char_end rows between unbounded preceding and 1 preceding) as reach from c), r as (select *, sum(case when reach is null or char_start > reach then 1 else 0 end) over (partition by meeting_id order by char_start, char_end rows unbounded preceding) as run from m) select meeting_id, min(char_start) as char_start, max(char_end) as char_end, count(*) as n from r group by meeting_id, run")
def w09(spark: SparkSession, folder: str) -> DataFrame:
    return spans.merged_spans(chunks(spark, folder).select("meeting_id", "char_start", "char_end"), ["meeting_id"], "char_start", "char_end")


_PLACE = "try_cast(regexp_extract(chunk_id, 'c([0-9]+)$', 1) as int)"


@query("w07_chunk_runs", f"select meeting_id, min(place) as first, max(place) as last, count(*) as n from (select *, place - row_number() over (partition by meeting_id order by place) as g from (select distinct meeting_id, {_PLACE} as place from {CHUNKS}) where place is not null) group by meeting_id, g")
def w07(spark: SparkSession, folder: str) -> DataFrame:
    place = F.expr("try_cast(regexp_extract(chunk_id, 'c([0-9]+)$', 1) as int)")
    return spans.consecutive_runs(chunks(spark, folder).select("meeting_id", place.alias("place")), ["meeting_id"], "place")


@query("j08_span_overlap", f"with c as (select * from {CHUNKS} where char_start < char_end), w as (select meeting_id, unnest(range(0, max(char_end) + 1, 700)) as s from c group by meeting_id) select chunk_id, s as window_start, least(char_end, s + 900) - greatest(char_start, s) as shared from c join w using (meeting_id) where char_start < s + 900 and s < char_end")
def j08(spark: SparkSession, folder: str) -> DataFrame:
    c = chunks(spark, folder)
    windows = c.where("char_start < char_end").groupBy("meeting_id").agg(F.max("char_end").alias("m")).select("meeting_id", F.explode(F.sequence(F.lit(0), F.col("m"), F.lit(700))).alias("s")).withColumn("e", F.col("s") + 900)
    both = spans.overlap_join(c.select("chunk_id", "meeting_id", "char_start", "char_end"), windows, ["meeting_id"], ("char_start", "char_end"), ("s", "e"), 1500)
    return both.select("chunk_id", F.col("s").cast("long").alias("window_start"), (F.least("char_end", "e") - F.greatest("char_start", "s")).cast("long").alias("shared"))


@query("j10_span_containment", f"with c as (select * from {CHUNKS} where char_start < char_end), w as (select meeting_id, unnest(range(0, max(char_end) + 1, 700)) as s from c group by meeting_id) select chunk_id, count(*) as n from c join w using (meeting_id) where s <= char_start and char_end <= s + 1500 group by 1")
def j10(spark: SparkSession, folder: str) -> DataFrame:
    c = chunks(spark, folder)
    windows = c.where("char_start < char_end").groupBy("meeting_id").agg(F.max("char_end").alias("m")).select("meeting_id", F.explode(F.sequence(F.lit(0), F.col("m"), F.lit(700))).alias("s")).withColumn("e", F.col("s") + 1500)
    both = spans.overlap_join(c.select("chunk_id", "meeting_id", "char_start", "char_end"), windows, ["meeting_id"], ("char_start", "char_end"), ("s", "e"), 1500)
    return both.where("s <= char_start and char_end <= e").groupBy("chunk_id").agg(F.count("*").alias("n"))


@query(
    "j11_nearest_event",
    "with a as (select event_id, user_id, epoch_us(ts) as t from events where event_type = 'click'), b as (select user_id, epoch_us(ts) as o from events where event_type = 'purchase') select event_id, n as nearest, abs(t - n) as gap from (select event_id, t, (select o from b where b.user_id = a.user_id order by abs(o - t), o limit 1) as n from a)",
)
def j11(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "events").withColumn("t", F.unix_micros(F.col("ts").cast("timestamp")))
    near = spans.nearest(e.where("event_type = 'click'"), e.where("event_type = 'purchase'").select("user_id", F.col("t").alias("o")), ["user_id"], "event_id", "t", "o")
    return near.select("event_id", "nearest", "gap")


TAUS = (0.4, 0.5, 0.6)


@query("m11_alignment")
def m11(spark: SparkSession, folder: str) -> DataFrame:
    """Scored pairs as predictions (earlier decision) against references (later decision), matched by pair of meetings."""
    return alignment.align_candidates(items(spark, folder), TAUS).withColumn("similarity", rounded("similarity"))


@query("m17_pooled_scores")
def m17(spark: SparkSession, folder: str) -> DataFrame:
    """Precision, recall and F1 by threshold over all pairs of meetings; decisions in a candidate pair are predictions and references."""
    tp = stored(alignment.align_candidates(items(spark, folder), TAUS).groupBy("tau").agg(F.count("*").alias("tp")))
    n = P.candidate_members(items(spark, folder)).agg(F.count_if("earlier").alias("np"), F.count_if("later").alias("nr"))
    p, r, f = agreement.precision_recall_f1(F.col("tp"), F.col("np") - F.col("tp"), F.col("nr") - F.col("tp"))
    return tp.crossJoin(n).select("tau", "tp", rounded(p).alias("precision"), rounded(r).alias("recall"), rounded(f).alias("f1"))


@query("t09_cluster_intervals")
def t09(spark: SparkSession, folder: str) -> DataFrame:
    """Intervals that resample meetings: decisions hit by a candidate pair, as predictions and as references."""
    d = decisions(spark, folder).select("decision_id", "series_id", "meeting_id")
    members = P.candidate_members(items(spark, folder)).withColumnRenamed("id", "decision_id")
    hits = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    counts = d.join(members, "decision_id", "left").where("series_id is not null and meeting_id is not null").groupBy("series_id", "meeting_id").agg(hits("later").alias("hits_p"), F.count("*").alias("n_p"), hits("earlier").alias("hits_r"), F.count("*").alias("n_r"))
    out = intervals.cluster_bootstrap_prf(counts, "series_id", "meeting_id", n=200)
    return out.select(*[rounded(c).alias(c) if t == "double" else F.col(c) for c, t in out.dtypes])


@query("f04_reference_coverage", f"select decision_id, round(case when len(a) > 0 then len(list_intersect(a, b)) / len(a) else 0.0 end, 6) as coverage from (select decision_id, list_distinct(regexp_extract_all(lower(coalesce(sentence_text, '')), '[a-z0-9]+')) as a, list_distinct(regexp_extract_all(lower(coalesce(evidence_text, '')), '[a-z0-9]+')) as b from {DECISIONS})")
def f04(spark: SparkSession, folder: str) -> DataFrame:
    runs = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0)))
    t = decisions(spark, folder).select("decision_id", runs("sentence_text").alias("a"), runs("evidence_text").alias("b"))
    return t.select("decision_id", rounded(F.when(F.size("a") > 0, F.size(F.array_intersect("a", "b")) / F.size("a")).otherwise(0.0)).alias("coverage"))


@query("l06_best_threshold", f"with {SCORED}, g as (select t, count(*) filter (score >= t and shared >= 2) as n, avg(shared) filter (score >= t and shared >= 2) as s from scored cross join (values (0.3), (0.4), (0.5), (0.6)) as g(t) group by t) select t::double as threshold, n, round(s, 6) as mean_shared from g where n > 0 and s >= 0.9 * (select max(s) from g where n > 0) order by t limit 1")
def l06(spark: SparkSession, folder: str) -> DataFrame:
    """Of the thresholds within a margin of the best mean overlap, the loosest."""
    s = P.candidate_counts(items(spark, folder))
    over = lambda t, value: F.sum(F.when(F.col("score") >= t, value))
    cells = s.agg(*[F.struct(F.lit(t).alias("threshold"), F.coalesce(over(t, F.col("n")), F.lit(0)).alias("n"), (over(t, F.col("n") * F.col("shared")) / over(t, F.col("n"))).alias("m")).alias(f"c{k}") for k, t in enumerate((0.3, 0.4, 0.5, 0.6))])
    long = cells.select(F.explode(F.array(*cells.columns)).alias("c")).select("c.*").where("n > 0")
    best = long.agg(F.max("m").alias("best"))
    return long.crossJoin(best).where("m >= 0.9 * best").orderBy("threshold").limit(1).select("threshold", "n", rounded("m").alias("mean_shared"))
