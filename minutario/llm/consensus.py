"""Consensus from several annotators' labels (problem 6): confusion matrices and posteriors by expectation-maximisation."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from minutario.functions.text import plain_label
from minutario.session import cut
from minutario.versions import latest

#: Up to this many distinct vote patterns are fitted in the driver; beyond it each iteration is a job over patterns.
PATTERNS_IN_DRIVER = 200_000
ITERATIONS, SMOOTHING, DIAGONAL = 50, 0.2, 1.0
#: A label counts as shown beyond reasonable doubt from this posterior probability. One relation is never given by the
#: annotators but is final in some items, which leaves a doubt of about 4 % about every item it is mistaken for.
SURE = 0.9


@dataclass
class Fit:
    """confusion[annotator, real label, given label] and the labels' shares; unused labels have a share of 0."""

    labels: list[str]
    annotators: list[str]
    prior: np.ndarray
    confusion: np.ndarray


def _posterior(votes: np.ndarray, prior: np.ndarray, confusion: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore"):
        score = np.tile(np.log(prior), (len(votes), 1))
        for a in range(votes.shape[1]):
            given = votes[:, a] >= 0
            score[given] += np.log(confusion[a][:, votes[given, a]]).T
    score -= score.max(1, keepdims=True)
    share = np.exp(score)
    return share / share.sum(1, keepdims=True)


def _counts(votes: np.ndarray, known: np.ndarray, weight: np.ndarray, posterior: np.ndarray) -> np.ndarray:
    """Expected counts [annotator, real, given], and in the last slot's diagonal those of the real labels."""
    k = posterior.shape[1]
    share = posterior.copy()
    fixed = known >= 0
    share[fixed] = 0
    share[fixed, known[fixed]] = 1
    share *= weight[:, None]
    out = np.zeros((votes.shape[1] + 1, k, k))
    for a in range(votes.shape[1]):
        for given in range(k):
            out[a, :, given] = share[votes[:, a] == given].sum(0)
    out[-1][np.diag_indices(k)] = share.sum(0)
    return out


def _step(counts: np.ndarray, used: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    k = counts.shape[1]
    confusion = counts[:-1] + SMOOTHING / k + DIAGONAL * np.eye(k)
    confusion /= confusion.sum(2, keepdims=True)
    prior = np.where(used, np.diag(counts[-1]) + SMOOTHING, 0)
    return prior / prior.sum(), confusion


def item_votes(rows: DataFrame, item: str, votes: Sequence[str], final: str, labels: Sequence[str]) -> DataFrame:
    """(item_id, v0.., known): label numbers, -1 where a cell holds no label."""
    place = F.create_map(*[x for n, label in enumerate(labels) for x in (F.lit(label), F.lit(n))])
    number = lambda c: F.coalesce(place[plain_label(F.col(c), list(labels))], F.lit(-1)).cast("int")
    return rows.select(F.col(item).alias("item_id"), *[number(c).alias(f"v{n}") for n, c in enumerate(votes)], number(final).alias("known"))


def fit(items: DataFrame, labels: Sequence[str], annotators: Sequence[str], in_driver: int = PATTERNS_IN_DRIVER, iterations: int = ITERATIONS) -> Fit:
    """Learn every annotator's confusion matrix over all items; items of known label keep it, the others get posteriors.

    Items with the same votes are one pattern with a count, so the shuffle carries at most (labels + 1)^(annotators + 1)
    rows. Labels that nobody gave and that are never final get no share. No items give uniform confusion matrices.
    """
    columns = [f"v{n}" for n in range(len(annotators))]
    patterns = cut(items.groupBy(*columns, "known").agg(F.count("*").alias("n")))
    k = len(labels)

    def arrays(frame: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return frame[columns].to_numpy(np.int64), frame["known"].to_numpy(np.int64), frame["n"].to_numpy(np.float64)

    def first(votes: np.ndarray) -> np.ndarray:
        share = np.stack([(votes == label).sum(1) for label in range(k)], 1) + 1e-6
        return share / share.sum(1, keepdims=True)

    local = patterns.toPandas() if patterns.count() <= in_driver else None

    def counted(prior: np.ndarray | None, confusion: np.ndarray | None) -> np.ndarray:
        def of(frame: pd.DataFrame) -> np.ndarray:
            votes, known, weight = arrays(frame)
            return _counts(votes, known, weight, first(votes) if prior is None else _posterior(votes, prior, confusion))

        if local is not None:
            return of(local)

        def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total = sum((of(b) for b in batches if len(b)), np.zeros((len(annotators) + 1, k, k)))
            yield pd.DataFrame({"place": np.arange(total.size), "value": total.reshape(-1)})

        sums = patterns.mapInPandas(partial, "place int, value double").groupBy("place").agg(F.sum("value").alias("value")).collect()
        flat = np.zeros((len(annotators) + 1) * k * k)
        for place, value in sums:
            flat[place] = value
        return flat.reshape(len(annotators) + 1, k, k)

    counts = counted(None, None)
    used = _given_or_known(patterns, columns, k)
    prior, confusion = _step(counts, used if used.any() else np.ones(k, bool))
    used = prior > 0
    for _ in range(iterations):
        moved = _step(counted(prior, confusion), used)
        change = np.abs(moved[1] - confusion).max()
        prior, confusion = moved
        if change < 1e-4:
            break
    return Fit(list(labels), list(annotators), prior, confusion)


def _given_or_known(patterns: DataFrame, columns: list[str], k: int) -> np.ndarray:
    """Which labels somebody gave or some item is known to have, however few."""
    seen = patterns.select(F.explode(F.array(*columns, "known")).alias("label")).where("label >= 0").distinct()
    used = np.zeros(k, bool)
    used[[r.label for r in seen.collect()]] = True  # at most k rows
    return used


def consensus(items: DataFrame, model: Fit) -> DataFrame:
    """(item_id, n_labels, n_distinct, agreement, consensus_label, probability, known_label) per item with a label.

    agreement is the share of pairs of given labels that are equal, null for a single label. Ties go to the label that
    comes first. Items without any label don't come out.
    """
    columns = [f"v{n}" for n in range(len(model.annotators))]
    labels = np.array(model.labels, object)

    def judged(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            votes = batch[columns].to_numpy(np.int64)
            share = _posterior(votes, model.prior, model.confusion)
            times = np.stack([(votes == label).sum(1) for label in range(len(labels))], 1)
            n = times.sum(1)
            known = batch["known"].to_numpy(np.int64)
            with np.errstate(invalid="ignore", divide="ignore"):
                agreement = (times * (times - 1)).sum(1) / (n * (n - 1))
            frame = pd.DataFrame({
                "item_id": batch["item_id"], "n_labels": n, "n_distinct": (times > 0).sum(1), "agreement": pd.Series(agreement, index=batch.index).where(n > 1),
                "consensus_label": labels[share.argmax(1)], "probability": share.max(1), "known_label": np.where(known >= 0, labels[known], None),
            })
            yield frame[n > 0]

    return items.mapInPandas(judged, "item_id string, n_labels int, n_distinct int, agreement double, consensus_label string, probability double, known_label string")


def krippendorff_alpha(items: DataFrame, n_annotators: int) -> DataFrame:
    """One row (n_items, n_labels, observed_disagreement, expected_disagreement, alpha) over items with two or more labels.

    alpha is null when no two labels can disagree. Pure aggregation: coincidences by label, summed map-side.
    """
    given = F.filter(F.array(*[F.col(f"v{n}") for n in range(n_annotators)]), lambda v: v >= 0)
    paired = items.select(given.alias("g")).where(F.size("g") > 1)
    within = paired.select(
        F.size("g").alias("m"),
        F.aggregate(F.array_distinct("g"), F.lit(0), lambda acc, x: acc + F.pow(F.size(F.filter("g", lambda y: y == x)), 2).cast("int")).alias("sq"),
    ).agg(F.count("*").alias("n_items"), F.sum("m").alias("n"), F.sum((F.col("m") * F.col("m") - F.col("sq")) / (F.col("m") - 1)).alias("o"))
    totals = paired.select(F.explode("g").alias("label")).groupBy("label").count().agg(F.sum(F.col("count") * F.col("count")).alias("same"))
    both = within.crossJoin(totals)  # one row each
    observed = F.col("o") / F.col("n")
    expected = (F.col("n") * F.col("n") - F.col("same")) / (F.col("n") * (F.col("n") - 1))
    return both.select("n_items", F.col("n").alias("n_labels"), observed.alias("observed_disagreement"), expected.alias("expected_disagreement"), F.when(expected > 0, 1 - observed / expected).alias("alpha"))


def annotator_reliability(spark, model: Fit) -> DataFrame:
    """(annotator, reliability, habit, habit_share): the chance of giving the real label, and the label wrongly given most."""
    rows = []
    for a, name in enumerate(model.annotators):
        right = float((model.prior * np.diag(model.confusion[a])).sum())
        wrong = (model.prior[:, None] * model.confusion[a] * (1 - np.eye(len(model.labels)))).sum(0)
        rows.append((name, right, model.labels[int(wrong.argmax())], float(wrong.max())))
    return spark.createDataFrame(rows, "annotator string, reliability double, habit string, habit_share double")


def held_items(table: DataFrame, item: str, suffix: str, labels: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """The vote rows that hold, and the annotators: one for each two-letter column with the suffix."""
    votes = sorted(c for c in table.columns if c.endswith(suffix) and len(c) == len(suffix) + 2)
    final = "final" + suffix
    held = latest(table.select(item, *votes, final, "ingested_at"), item, [item, *votes, final])
    return item_votes(held, item, votes, final, labels), [v[:2] for v in votes]


def doubtless(judged: DataFrame) -> DataFrame:
    """(item_id, consensus_label) of items without a known label, with at least three labels that differ, and a sure one."""
    sure = judged.where(F.col("known_label").isNull() & (F.col("n_labels") >= 3) & (F.col("n_distinct") > 1) & (F.col("probability") >= SURE))
    return sure.select("item_id", "consensus_label")
