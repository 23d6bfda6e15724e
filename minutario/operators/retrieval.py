"""Lexical, dense and fused retrieval as joins and windows."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType

#: Words that retrieval leaves out.
RETRIEVAL_STOP_WORDS = (
    "a about above after again all also am an and any are as at be because been before being below between both but by "
    "can could did do does doing down during each few for from further had has have having he her here hers herself him "
    "himself his how i if in into is it its itself just me more most my myself no nor not now of off on once only or "
    "other our ours ourselves out over own same she should so some such than that the their theirs them themselves then "
    "there these they this those through to too under until up very was we were what when where which while who whom "
    "why will with would you your yours yourself yourselves"
).split()

K1, B, EPSILON = 1.5, 0.75, 0.25
#: Documents that a task scores in one go against the queries.
DOCUMENTS_AT_ONCE = 256


def retrieval_tokens(text: Column) -> Column:
    """Letter runs in lower case without the stop words, in order and with repetitions."""
    stop = F.array(*[F.lit(w) for w in RETRIEVAL_STOP_WORDS])
    return F.filter(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}]+"), F.lit(0)), lambda w: ~F.array_contains(stop, w))


def term_statistics(documents: DataFrame, key: str, text: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(postings, terms with their weight, collection): weight ln((N - n + .5) / (n + .5)), if negative a share of the mean."""
    tokens = documents.select(F.col(key).alias("doc"), retrieval_tokens(F.col(text)).alias("w"))
    postings = tokens.select("doc", F.size("w").alias("dl"), F.explode("w").alias("term")).groupBy("term", "doc", "dl").agg(F.count("*").alias("tf"))
    collection = tokens.agg(F.count("*").alias("n_docs"), F.avg(F.size("w")).alias("avgdl"))
    n = F.col("n")
    weights = postings.groupBy("term").agg(F.count("*").alias("n")).crossJoin(F.broadcast(collection)).select("term", F.ln((F.col("n_docs") - n + 0.5) / (n + 0.5)).alias("raw"))
    floor = weights.agg((EPSILON * F.avg("raw")).alias("floor"))
    terms = weights.crossJoin(F.broadcast(floor)).select("term", F.when(F.col("raw") >= 0, F.col("raw")).otherwise(F.col("floor")).alias("idf"))
    return postings, terms, collection


def bm25(documents: DataFrame, key: str, text: str, queries: DataFrame, query_key: str, query_text: str) -> DataFrame:
    """(query, doc, score) for documents with a term of the query; repeated query terms count each time.

    Only postings of the queries' terms are joined with them, so the work follows the inverted lists that are asked for.
    """
    postings, terms, collection = term_statistics(documents, key, text)
    asked = queries.select(F.col(query_key).alias("query"), F.explode(retrieval_tokens(F.col(query_text))).alias("term")).groupBy("query", "term").agg(F.count("*").alias("times"))
    tf, norm = F.col("tf"), 1 - B + B * F.col("dl") / F.col("avgdl")
    hits = asked.join(terms, "term").join(postings, "term").crossJoin(F.broadcast(collection))
    return hits.groupBy("query", "doc").agg(F.sum(F.col("times") * F.col("idf") * tf * (K1 + 1) / (tf + K1 * norm)).alias("score"))


def top_k(scored: DataFrame, k: int, *tie: str) -> DataFrame:
    """The k best of each query with their rank; equal scores by the tie columns."""
    order = W.partitionBy("query").orderBy(F.desc("score"), *tie)
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def lexical_search(documents: DataFrame, key: str, text: str, queries: DataFrame, query_key: str, query_text: str, pool: int) -> DataFrame:
    """(query, doc, score, rank): the pool best documents of bm25 for each query, scores above zero rounded to 8 places.

    Neither postings nor scored pairs are shuffled: terms are counted by document before the shuffle, the weights of the
    queries' terms go to the tasks (the queries are an evaluation set), and each batch keeps its own best pool.
    """
    tokens = documents.select(F.col(key).alias("doc"), retrieval_tokens(F.col(text)).alias("w"))
    size = tokens.agg(F.count("*").alias("n"), F.avg(F.size("w")).alias("dl")).collect()[0]
    n = F.col("n")
    raw = tokens.select(F.explode(F.array_distinct("w")).alias("term")).groupBy("term").agg(F.count("*").alias("n")).select("term", F.ln((F.lit(size.n) - n + 0.5) / (n + 0.5)).alias("raw"))
    asked = queries.select(F.col(query_key).alias("query"), F.explode(retrieval_tokens(F.col(query_text))).alias("term")).groupBy("query", "term").agg(F.count("*").alias("times"))
    floor = raw.agg((EPSILON * F.avg("raw")).alias("floor"))
    weighted = asked.join(raw, "term").crossJoin(F.broadcast(floor)).select("query", "term", (F.col("times") * F.when(F.col("raw") >= 0, F.col("raw")).otherwise(F.col("floor"))).alias("weight")).toPandas()
    names, terms = sorted(weighted["query"].unique()), sorted(weighted["term"].unique())
    weights = np.zeros((len(terms), len(names)))
    weights[np.searchsorted(terms, weighted["term"]), np.searchsorted(names, weighted["query"])] = weighted["weight"]
    q_kind, d_kind = queries.schema[query_key].dataType, documents.schema[key].dataType
    out = to_arrow_schema(StructType([StructField("query", q_kind), StructField("doc", d_kind)])).append(pa.field("score", pa.float64()))
    known, ids = pa.array(terms, pa.string()), pa.array(names, out.field("query").type)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows if len(terms) else 0, DOCUMENTS_AT_ONCE):
                batch = whole.slice(at, DOCUMENTS_AT_ONCE)
                batch = batch.take(pc.sort_indices(batch.column("doc")))
                words = batch.column("w")
                code = pc.fill_null(pc.index_in(words.flatten(), known), -1).to_numpy(zero_copy_only=False).astype(np.int64)
                length = pc.list_value_length(words).to_numpy(zero_copy_only=False)
                cell = np.repeat(np.arange(len(length)), length) * len(terms) + code
                cell, tf = np.unique(cell[code >= 0], return_counts=True)
                part = np.zeros((len(length), len(terms)))
                part.flat[cell] = tf * (K1 + 1) / (tf + K1 * (1 - B + B * length[cell // len(terms)] / size.dl))
                score = np.round((part @ weights).T, 8)
                best = np.argsort(-score, 1, kind="stable")[:, :pool]
                value = np.take_along_axis(score, best, 1).ravel()
                kept = value > 0
                query = ids.take(pa.array(np.repeat(np.arange(len(names)), best.shape[1])[kept]))
                yield pa.RecordBatch.from_arrays([query, batch.column("doc").take(pa.array(best.ravel()[kept])), pa.array(value[kept])], schema=out)

    return top_k(tokens.mapInArrow(run, f"query {q_kind.simpleString()}, doc {d_kind.simpleString()}, score double"), pool, "doc")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm).otherwise(0.0)


def reciprocal_rank_fusion(channels: list[DataFrame], k: int = 60) -> DataFrame:
    """(query, doc, score) from ranked channels (query, doc, rank): the sum of 1 / (k + rank)."""
    ranked = [c.select("query", "doc", "rank") for c in channels]
    union = ranked[0]
    for c in ranked[1:]:
        union = union.unionByName(c)
    return union.groupBy("query", "doc").agg(F.sum(1 / (k + F.col("rank"))).alias("score"))


#: Channels of the hybrid retriever and the least number of hits that each channel gives to the fusion.
RETRIEVAL_MODES = ("bm25", "dense", "hybrid")
MIN_POOL = 10


def hashed_vectors(texts: list[str], size: int = 64) -> np.ndarray:
    """Counts of hashed words as vectors, a stand-in where no embedding model is given."""
    import re
    import zlib

    out = np.zeros((len(texts), size))
    for row, text in zip(out, texts):
        for w in re.findall(r"[^\W\d_]+", text.lower()):
            row[zlib.crc32(w.encode()) % size] += 1
    return out


def dense_search(documents: DataFrame, key: str, text: str, queries: DataFrame, query_key: str, query_text: str, embed: Callable[[list[str]], np.ndarray] = hashed_vectors, pool: int = MIN_POOL) -> DataFrame:
    """(query, doc, score, rank): the pool documents of highest cosine for each query among all of them.

    Every document meets every query; each batch keeps its own best pool, of which the best of all are a part. The
    queries are an evaluation set and go to the tasks with the function. Scores are rounded to 8 places, ties by doc.
    """
    asked = queries.select(query_key, query_text).where(F.col(query_text).isNotNull()).toPandas()
    names = asked[query_key].to_numpy()
    q_kind, d_kind = queries.schema[query_key].dataType.simpleString(), documents.schema[key].dataType.simpleString()

    def unit(texts: list[str]) -> np.ndarray:
        x = np.asarray(embed(texts), float)
        norm = np.linalg.norm(x, axis=1, keepdims=True)
        return np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)

    wanted = unit(asked[query_text].tolist()) if len(asked) else None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if wanted is None or not len(batch):
                continue
            batch = batch.sort_values(key, kind="stable")
            docs = batch[key].to_numpy()
            score = np.round(wanted @ unit(batch[text].fillna("").tolist()).T, 8)
            best = np.argsort(-score, 1, kind="stable")[:, :pool]
            yield pd.DataFrame({"query": np.repeat(names, best.shape[1]), "doc": docs[best].ravel(), "score": np.take_along_axis(score, best, 1).ravel()})

    found = documents.select(key, text).mapInPandas(run, f"query {q_kind}, doc {d_kind}, score double")
    return top_k(found, pool, "doc")


def hybrid(lexical: DataFrame, dense: DataFrame, limit: int, mode: str = "hybrid", rrf_k: int = 60) -> DataFrame:
    """(query, doc, score, lexical_rank, dense_rank, rank) of scored channels (query, doc, score), fused by reciprocal ranks.

    Each channel gives its max(limit, MIN_POOL) best, the lexical one only those above zero; bm25 and dense leave the
    other channel out and keep the rest of the rules.
    """
    if mode not in RETRIEVAL_MODES:
        raise ValueError(f"mode must be one of {RETRIEVAL_MODES}, got {mode!r}")
    pool = max(limit, MIN_POOL)
    own = {"lexical": lexical.where("score > 0"), "dense": dense}
    used = [n for n in own if mode in ("hybrid", {"lexical": "bm25"}.get(n, n))]
    by = {n: top_k(scored.select("query", "doc", "score") if n in used else scored.select("query", "doc", "score").where("false"), pool, "doc").select("query", "doc", F.col("rank").alias(f"{n}_rank")) for n, scored in own.items()}
    # A join, since Spark 4.1 takes a union of tables hashed by query as hashed too, though each is coalesced on its own.
    both = by["lexical"].join(by["dense"], ["query", "doc"], "full")
    share = lambda n: F.coalesce(1 / (rrf_k + F.col(f"{n}_rank")), F.lit(0.0))
    fused = both.select("query", "doc", F.round(share("lexical") + share("dense"), 12).alias("score"), "lexical_rank", "dense_rank")
    return top_k(fused, limit, "doc")


def word_sequences(text: Column, n: int = 5) -> Column:
    """The distinct sequences of n words; all words as one where there are fewer."""
    w = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    many = F.transform(F.sequence(F.lit(1), F.size(w) - n + 1), lambda i: F.array_join(F.slice(w, i, n), " "))
    return F.when(F.size(w) >= n, F.array_distinct(many)).when(F.size(w) > 0, F.array(F.array_join(w, " ")))


def passage_recall(ranked: DataFrame, documents: DataFrame, key: str, text: str, evidence: DataFrame, query_key: str, passage: str, ks: Sequence[int]) -> DataFrame:
    """(k, n_queries, mean_recall): the share of the five-word sequences of each query's passage in its k best documents.

    Queries for which nothing was found count with a recall of 0.
    """
    wanted = evidence.select(F.col(query_key).alias("query"), F.explode(word_sequences(F.col(passage))).alias("gram")).distinct()
    best = F.broadcast(ranked.where(F.col("rank") <= max(ks)).select("query", "doc", "rank"))  # at most max(ks) to a query
    texts = best.join(documents.select(F.col(key).alias("doc"), F.col(text).alias("_text")), "doc")
    found = texts.select("query", "rank", F.explode(word_sequences(F.col("_text"))).alias("gram")).groupBy("query", "gram").agg(F.min("rank").alias("rank"))
    hits = wanted.join(found, ["query", "gram"], "left").select("query", "rank", F.explode(F.array(*map(F.lit, sorted(set(ks))))).alias("k"))
    each = hits.groupBy("k", "query").agg(F.avg(F.when(F.col("rank") <= F.col("k"), 1.0).otherwise(0.0)).alias("recall"))
    return each.groupBy("k").agg(F.count("*").alias("n_queries"), F.round(F.avg("recall"), 6).alias("mean_recall"))


def merged_passages(turns: DataFrame, hits: DataFrame, key: str, group: str, place: str, line: str, context: int, gap: str = "[...]") -> DataFrame:
    """(key, passage): the lines within context turns of each hit, windows that meet merged, others set apart by gap.

    turns are (group, place, line), hits (key, group, place). Each group of a key is a block headed by its name in
    brackets; blocks are in order of their names. Hits without a turn give nothing.
    """
    t = turns.select(group, place, line).withColumn("_at", F.row_number().over(W.partitionBy(group).orderBy(place)))
    at = hits.select(key, group, place).distinct().join(t.select(group, place, "_at"), [group, place])
    kept = at.select(key, group, F.explode(F.sequence(F.col("_at") - context, F.col("_at") + context)).alias("_at")).distinct().join(t.select(group, "_at", line), [group, "_at"])
    lag = F.lag("_at").over(W.partitionBy(key, group).orderBy("_at"))
    marked = kept.withColumn("_text", F.when(F.col("_at") > lag + 1, F.concat(F.lit(gap + "\n"), F.col(line))).otherwise(F.col(line)))
    blocks = marked.groupBy(key, group).agg(F.array_sort(F.collect_list(F.struct("_at", "_text"))).alias("_l"))
    blocks = blocks.select(key, group, F.concat(F.lit("["), F.col(group), F.lit("]\n"), F.array_join(F.col("_l._text"), "\n")).alias("_b"))
    return blocks.groupBy(key).agg(F.array_join(F.array_sort(F.collect_list(F.struct(group, "_b"))).getField("_b"), "\n\n").alias("passage"))
