"""Chunking, quotes and retrieval evaluation over documents and chunks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from minutario.functions import chunking
from minutario.operators import answering, locate
from minutario.plans.common import DECISIONS, chunks, decisions, reviews, rounded, table
from minutario.plans.registry import query
from minutario.session import cut
from minutario.plans.retrieval import lexical
from minutario.operators import retrieval as R
from minutario.operators.retrieval import top_k


@query("r01_recursive_chunks")
def r01(spark: SparkSession, folder: str) -> DataFrame:
    return chunking.chunked(table(spark, folder, "documents"), "doc_id", "text", 1000, 100)


@query("r13_chunk_grid")
def r13(spark: SparkSession, folder: str) -> DataFrame:
    """Chunks and their mean size for a grid of sizes and overlaps."""
    documents = table(spark, folder, "documents").where("text is not null").select("doc_id", "text")
    cells = None
    for size in (600, 1200):
        for overlap in (0, 100):
            one = chunking.chunked(documents, "doc_id", "text", size, overlap).agg(F.count("*").alias("n"), rounded(F.avg(F.length("text")), 4).alias("mean_chars")).select(F.lit(size).alias("size"), F.lit(overlap).alias("overlap"), "n", "mean_chars")
            cells = one if cells is None else cells.unionByName(one)
    return cells


def _folded_sql(cell: str) -> str:
    return rf"trim(regexp_replace(lower({cell}), '\s+', ' ', 'g'))"


@query("j26_located_quotes", f"with q as (select decision_id, {_folded_sql('evidence_text')} as body, rtrim({_folded_sql('sentence_text')}, '.,;:!?') as quote from {DECISIONS}) select decision_id, coalesce(quote <> '' and strpos(body, quote) > 0, false) as found, coalesce(case when quote <> '' then (length(body) - length(replace(body, quote, ''))) // length(quote) end, 0)::bigint as occurrences from q")
def j26(spark: SparkSession, folder: str) -> DataFrame:
    """Whether and how often each decision's whole sentence stands in its whole evidence, case and spacing aside."""
    spots = locate.located(decisions(spark, folder), "decision_id", "evidence_text", "sentence_text")
    return spots.select("decision_id", (F.col("start") >= 0).alias("found"), F.col("occurrences").cast("bigint").alias("occurrences"))


@query("j26_sentence_in_evidence")
def j26_sentence(spark: SparkSession, folder: str) -> DataFrame:
    """Where each decision's whole sentence stands in its evidence, first place and number of places; (-1, -1, 0) where it doesn't."""
    return locate.located(decisions(spark, folder), "decision_id", "evidence_text", "sentence_text")


@query("j26_reference_in_answer")
def j26_reference(spark: SparkSession, folder: str) -> DataFrame:
    """Where each question's whole reference answer stands in the answer given."""
    return locate.located(reviews(spark, folder), "pregunta_id", "respuesta_c2", "respuesta_referencia")


@query("r07_contexts")
def r07(spark: SparkSession, folder: str) -> DataFrame:
    """The five best chunks of each question under a budget of 3,000 characters."""
    top = top_k(lexical(spark, folder), 5, "doc").join(chunks(spark, folder).select(F.col("chunk_id").alias("doc"), "text"), "doc")
    return answering.assembled_contexts(top, 3000)


def _channels(pieces: DataFrame, items: DataFrame, pool: int = R.MIN_POOL) -> tuple[DataFrame, DataFrame]:
    """Both channels over pieces (doc, text), written once as each mode reads them."""
    lexical = cut(R.lexical_search(pieces, "doc", "text", items, "item_id", "question", pool).drop("rank"))
    return lexical, cut(R.dense_search(pieces, "doc", "text", items, "item_id", "question", pool=pool).drop("rank"))


@query("r10_hybrid_modes")
def r10(spark: SparkSession, folder: str) -> DataFrame:
    """The ten best chunks of each question by mode, with the rank in each channel; vectors are hashed words."""
    lexical, dense = _channels(chunks(spark, folder).select(F.col("chunk_id").alias("doc"), "text"), table(spark, folder, "eval_items"))
    return reduce(DataFrame.unionByName, [R.hybrid(lexical, dense, 10, m).withColumn("mode", F.lit(m)) for m in R.RETRIEVAL_MODES])


@query("r14_channel_ablation")
def r14(spark: SparkSession, folder: str) -> DataFrame:
    """Mean recall of the items' passages by mode and k, over the documents cut at 600 characters."""
    return retrieval_grid(spark, folder, (600,), (0,), (1, 5, 10), R.RETRIEVAL_MODES)


@query("r13_retrieval_grid")
def r13_retrieval(spark: SparkSession, folder: str) -> DataFrame:
    """Mean recall of the items' passages by chunk size, overlap and k."""
    return retrieval_grid(spark, folder, (600, 1200), (0, 100), (1, 5, 10), ("hybrid",))


def retrieval_grid(spark: SparkSession, folder: str, sizes: tuple, overlaps: tuple, ks: tuple, modes: tuple) -> DataFrame:
    """(size, overlap, mode, k, n_queries, mean_recall, n_chunks): chunks and channels are made once for each size and overlap.

    Each cell is finished on its own: the driver plans and keeps one cell at a time, whatever the size of the grid.
    """
    documents, items = table(spark, folder, "documents").where("text is not null").select("doc_id", "text").distinct(), table(spark, folder, "eval_items")
    cells = []
    for size in sizes:
        for overlap in overlaps:
            pieces = chunking.chunked(documents, "doc_id", "text", size, overlap)
            pieces = cut(pieces.select(F.col("chunk_id").alias("doc"), "text"))
            lexical, dense = _channels(pieces, items, max(R.MIN_POOL, *ks))
            n = pieces.agg(F.count("*").alias("n_chunks"))
            for mode in modes:
                scores = R.passage_recall(R.hybrid(lexical, dense, max(ks), mode), pieces, "doc", "text", items, "item_id", "passage", ks)
                cells.append(cut(scores.crossJoin(F.broadcast(n)).select(F.lit(size).alias("size"), F.lit(overlap).alias("overlap"), F.lit(mode).alias("mode"), "k", "n_queries", "mean_recall", "n_chunks")))
    return reduce(DataFrame.unionByName, cells)


@query("r15_merged_passages")
def r15_merged(spark: SparkSession, folder: str) -> DataFrame:
    """Each series' chunks that name a sensor with one chunk on either side, as one text."""
    place = F.expr("try_cast(regexp_extract(chunk_id, 'c([0-9]+)$', 1) as int)")
    turns = chunks(spark, folder).where("text is not null").select("series_id", "meeting_id", place.alias("place"), "chunk_id", "text").where("place is not null")
    turns = turns.withColumn("place", F.struct("place", "chunk_id"))
    return R.merged_passages(turns, turns.where(F.lower("text").contains("sensor")), "series_id", "meeting_id", "place", "text", 1)
