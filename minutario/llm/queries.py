"""Queries of the nine problems over a folder of tables, and their SQL."""

from __future__ import annotations

import os
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from minutario.functions.text import decision_id, plain_label
from minutario.llm import answers, components, consensus, leakage, near_duplicates, overlap_join, packing, residue, splitter
from minutario.schemas import RELATION_LABELS, STATUS_LABELS, TYING_RELATIONS
from minutario.session import cut, stored
from minutario.versions import latest


#: The tokenizer's vocabulary that texts are sized with.
VOCABULARY = os.environ.get("MINUTARIO_VOCABULARY", "/opt/tokenizers/byte_bpe_50k.tiktoken")


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def p1_groups(spark: SparkSession, folder: str) -> DataFrame:
    """Each decision with enough words, its class of equal word sets and its group."""
    words = near_duplicates.decision_word_sets(_table(spark, folder, "decisions"))
    return near_duplicates.near_duplicate_groups(words, "decision_id", "words")


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates.pairs_in_groups(stored(p1_groups(spark, folder)), "decision_id", "group_id")


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return overlap_join.similar_decisions(overlap_join.candidate_decisions(_table(spark, folder, "candidates")))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    columns = ["pair_id", "earlier_decision_id", "later_decision_id", "final_relation"]
    held = latest(_table(spark, folder, "candidates").select(*columns, "ingested_at"), "pair_id", columns)
    tying = held.where(plain_label(F.col("final_relation"), RELATION_LABELS).isin(TYING_RELATIONS))
    ids = tying.select(*[decision_id(F.col(f"{s}_decision_id")).alias(s) for s in ("earlier", "later")])
    return components.tied_groups(ids, "earlier", "later")


def p4_pieces(spark: SparkSession, folder: str) -> DataFrame:
    """The pieces of every chunk, those within the limit as they are."""
    columns = ["chunk_id", "text", "char_start"]
    held = latest(_table(spark, folder, "chunks").select(*columns, "ingested_at"), "chunk_id", columns)
    return splitter.split_pieces(held, "chunk_id")


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    cut_kind = F.when(F.bool_or("forced"), "forced").otherwise("boundary")
    return p4_pieces(spark, folder).where(F.col("n_chars") > splitter.LIMIT).groupBy("chunk_id").agg(cut_kind.alias("cut_kind"))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return answers.defective_answers(_table(spark, folder, "stage_reviews"))


def _votes(spark: SparkSession, folder: str) -> list[tuple[str, DataFrame, consensus.Fit]]:
    out = []
    for table, item, suffix, labels in (("adjudications", "decision_id", "_status", STATUS_LABELS), ("candidates", "pair_id", "_relation", RELATION_LABELS)):
        items, people = consensus.held_items(_table(spark, folder, table), item, suffix, labels)
        items = cut(items)
        out.append((table, items, consensus.fit(items, labels, people)))
    return out


def p6_consensus(spark: SparkSession, folder: str) -> DataFrame:
    """Consensus, its probability and the agreement for each item of both tables."""
    return _union([consensus.consensus(items, model).withColumn("source", F.lit(table)) for table, items, model in _votes(spark, folder)])


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return _union([consensus.doubtless(consensus.consensus(items, model)) for _, items, model in _votes(spark, folder)]).distinct()


def p6_annotators(spark: SparkSession, folder: str) -> DataFrame:
    """Reliability and habit of each person in each table."""
    return _union([consensus.annotator_reliability(spark, model).withColumn("source", F.lit(table)) for table, _, model in _votes(spark, folder)])


def p6_agreement(spark: SparkSession, folder: str) -> DataFrame:
    """Chance-corrected agreement of each table."""
    out = []
    for table, item, suffix, labels in (("adjudications", "decision_id", "_status", STATUS_LABELS), ("candidates", "pair_id", "_relation", RELATION_LABELS)):
        items, people = consensus.held_items(_table(spark, folder, table), item, suffix, labels)
        alpha = consensus.krippendorff_alpha(items, len(people))
        rounded = [F.round(c, 6).alias(c) for c in ("observed_disagreement", "expected_disagreement", "alpha")]
        out.append(alpha.select(F.lit(table).alias("source"), "n_items", "n_labels", *rounded))
    return _union(out)


def p7_containers(spark: SparkSession, folder: str) -> DataFrame:
    """Each container's texts, as places in the documents."""
    return packing.packed_containers(_table(spark, folder, "documents"), VOCABULARY)


def p7_fill(spark: SparkSession, folder: str) -> DataFrame:
    """Containers, tokens, the least number of containers that any packing needs, and the share left unused."""
    each = p7_containers(spark, folder).groupBy("container_id").agg(F.sum("n_tokens").alias("used"))
    total = each.agg(F.count("*").alias("containers"), F.sum("used").alias("tokens"), F.max("used").alias("fullest"))
    least = F.ceil(F.col("tokens") / packing.CAPACITY)
    return total.select("containers", "tokens", "fullest", least.alias("least_containers"), F.round(1 - F.col("tokens") / (F.col("containers") * packing.CAPACITY), 6).alias("unused"))


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return leakage.leaked_items(_table(spark, folder, "documents"), _table(spark, folder, "eval_items")).select("doc_id", "item_id").distinct()


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    return residue.residue_documents(_table(spark, folder, "documents")).select("doc_id").distinct()


def p9_reasons(spark: SparkSession, folder: str) -> DataFrame:
    """Documents to leave out with the rule that caught them."""
    return residue.residue_documents(_table(spark, folder, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        p1_found, p1_groups, p2_found, p3_found, p4_found, p4_pieces, p5_found, p6_found, p6_consensus, p6_annotators,
        p6_agreement, p7_containers, p7_fill, p8_found, p9_found, p9_reasons,
    )
}
