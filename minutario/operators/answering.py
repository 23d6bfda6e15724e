"""Answering and judging with injected model calls; every failure is a row."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from minutario.operators.budget import even_excerpt, fair_shares, line_windows

ABSTENTION = "I don't know"


def is_abstention(reply: str) -> bool:
    """The agreed reply whatever its case, quotes and closing mark."""
    return reply.strip().strip("\"'“”‘’ .!").casefold().replace("’", "'") == ABSTENTION.casefold()


def assembled_contexts(retrieved: DataFrame, budget: int) -> DataFrame:
    """(query, context, n_blocks, n_cut) from (query, rank, doc, text): numbered blocks that share a budget of characters."""

    def one(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("rank")
        texts = frame["text"].tolist()
        labels = [f"[{n}] {d}\n" for n, d in enumerate(frame["doc"], 1)]
        shares = fair_shares([len(t) for t in texts], budget - sum(map(len, labels)) - 2 * (len(texts) - 1))
        blocks = [even_excerpt(t, s, line_windows(t, max(s // 4, 1))) for t, s in zip(texts, shares)]
        context = "\n\n".join(label + text for label, (text, _) in zip(labels, blocks))
        return pd.DataFrame({"query": [key[0]], "context": [context], "n_blocks": [len(blocks)], "n_cut": [sum(cut for _, cut in blocks)]})

    kind = retrieved.schema["query"].dataType.simpleString()
    return retrieved.select("query", "rank", "doc", "text").groupBy("query").applyInPandas(one, f"query {kind}, context string, n_blocks int, n_cut int")


def answered(prompts: DataFrame, key: str, prompt: str, chat: Callable[[str], str]) -> DataFrame:
    """(key, reply, abstained, error): one call per row; an exception is that row's error, the others go on."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for k, p in zip(batch[key], batch[prompt]):
                try:
                    reply = chat(p)
                    rows.append((k, reply, is_abstention(reply), None))
                except Exception as e:  # noqa: BLE001
                    rows.append((k, None, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=[key, "reply", "abstained", "error"])

    kind = prompts.schema[key].dataType.simpleString()
    return prompts.select(key, prompt).mapInPandas(run, f"`{key}` {kind}, reply string, abstained boolean, error string")


def verdicts(replies: DataFrame, key: str, reply: str, fields: Sequence[str]) -> DataFrame:
    """(key, fields..., failure): strict booleans of a judge's JSON reply; failure is invalid_json or schema."""

    def read(text: str | None) -> tuple:
        try:
            value = json.loads(text or "")
        except ValueError:
            return (*[None] * len(fields), "invalid_json")
        good = isinstance(value, dict) and all(isinstance(value.get(f), bool) for f in fields)
        return (*[value[f] for f in fields], None) if good else (*[None] * len(fields), "schema")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([(k, *read(r)) for k, r in zip(batch[key], batch[reply])], columns=[key, *fields, "failure"])

    kind = replies.schema[key].dataType.simpleString()
    return replies.select(key, reply).mapInPandas(run, f"`{key}` {kind}, " + ", ".join(f"`{f}` boolean" for f in fields) + ", failure string")


def judge_rates(judged: DataFrame, padded: DataFrame, key: str, field: str) -> DataFrame:
    """(n, valid_rate, flip_rate): replies that could be read, and verdicts that change when the answer is only padded."""
    both = judged.select(key, F.col(field).alias("a")).join(padded.select(key, F.col(field).alias("b")), key)
    known = F.col("a").isNotNull() & F.col("b").isNotNull()
    return both.agg(F.count("*").alias("n"), F.avg(F.col("a").isNotNull().cast("int")).alias("valid_rate"), F.avg(F.when(known, (F.col("a") != F.col("b")).cast("int"))).alias("flip_rate"))


def chosen_judge(candidates: DataFrame) -> DataFrame:
    """The candidate (name, kappa, lower, upper, seconds, failed) to take: none failed, and of those whose interval reaches the best one's, the fastest."""
    passed = candidates.where(F.size("failed") == 0)
    best = passed.agg(F.max(F.struct("kappa", "lower")).alias("b"))
    return passed.crossJoin(best).where("upper >= b.lower").orderBy("seconds", "name").limit(1).drop("b")
