"""Answer records of repeated runs: scores per question, conditions beside each other, and what went wrong."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from minutario.operators.intervals import bootstrap


def question_scores(records: DataFrame, by: Sequence[str], metric: str, question: str = "question_id") -> DataFrame:
    """(by..., question, score, n_runs): the mean over runs with a known metric; records with an error don't count."""
    known = records.where(F.col("error").isNull() & F.col(metric).isNotNull())
    return known.groupBy(*by, question).agg(F.avg(F.col(metric).cast("double")).alias("score"), F.count("*").alias("n_runs"))


def condition_cells(records: DataFrame, metric: str) -> DataFrame:
    """(condition, stratum, n_questions, n_records, score) by stratum and over ALL: means of the questions' means."""
    per = question_scores(records, ["condition", "stratum"], metric)
    cells = per.groupingSets([[F.col("condition"), F.col("stratum")], [F.col("condition")]], "condition", "stratum")
    return cells.agg(F.count("*").alias("n_questions"), F.sum("n_runs").alias("n_records"), F.avg("score").alias("score")).withColumn("stratum", F.coalesce("stratum", F.lit("ALL")))


def paired_differences(records: DataFrame, metric: str, first: str, second: str, n: int = 1000, seed: int = 20240501) -> DataFrame:
    """(stratum, n_pairs, difference, lower, upper) of second minus first over questions scored under both."""
    per = question_scores(records, ["condition", "stratum"], metric)
    side = lambda c, name: per.where(F.col("condition") == c).select("stratum", "question_id", F.col("score").alias(name))
    both = side(first, "a").join(side(second, "b"), ["stratum", "question_id"]).select("stratum", "question_id", (F.col("b") - F.col("a")).alias("d"))

    def one(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        values = frame.sort_values("question_id")["d"].tolist()
        point, lower, upper = bootstrap(values, lambda v: sum(v) / len(v), n, seed)
        return pd.DataFrame({"stratum": [key[0]], "n_pairs": [len(values)], "difference": [point], "lower": [lower], "upper": [upper]})

    return both.groupBy("stratum").applyInPandas(one, "stratum string, n_pairs long, difference double, lower double, upper double")


def resume_status(records: DataFrame, expected: int, key: Sequence[str]) -> DataFrame:
    """(expected, complete, errors, pending) over distinct keys; a key that was done once is complete."""
    per = records.groupBy(*key).agg(F.bool_or(F.col("error").isNull()).alias("done"))
    sums = per.agg(F.count_if("done").alias("complete"), F.count_if(~F.col("done")).alias("errors"))
    return sums.select(F.lit(expected).cast("long").alias("expected"), "complete", "errors", (F.lit(expected) - F.col("complete") - F.col("errors")).alias("pending"))


def citation_scores(answers: DataFrame) -> DataFrame:
    """(question_id, any_hit, precision, recall) from arrays of spans (meeting_id, acts): cited and reference.

    Null where citing doesn't apply: abstentions, unanswerable questions and questions without reference.
    """
    applies = ~F.coalesce("abstained", F.lit(False)) & ~F.col("stratum").startswith("E4") & (F.size("reference") > 0)
    acts = lambda c: F.array_distinct(F.flatten(F.transform(c, lambda s: F.transform(s["acts"], lambda a: F.concat(s["meeting_id"], F.lit(":"), a)))))
    own = answers.select("question_id", applies.alias("ok"), acts(F.col("cited")).alias("c"), acts(F.col("reference")).alias("r"), "cited")
    hit = F.size(F.array_intersect("c", "r"))
    spans_hit = F.size(F.filter("cited", lambda s: F.exists(s["acts"], lambda a: F.array_contains(F.col("r"), F.concat(s["meeting_id"], F.lit(":"), a)))))
    return own.select("question_id", F.when(F.col("ok"), hit > 0).alias("any_hit"), F.when(F.col("ok") & (F.size("cited") > 0), spans_hit / F.size("cited")).alias("precision"), F.when(F.col("ok"), hit / F.size("r")).alias("recall"))


def freeze_differences(frozen: DataFrame, current: DataFrame) -> DataFrame:
    """(path, change) of manifests (path, sha256): added, removed or changed files; none when nothing moved."""
    a, b = frozen.select("path", F.col("sha256").alias("x")), current.select("path", F.col("sha256").alias("y"))
    both = a.join(b, "path", "full").where(~F.col("x").eqNullSafe(F.col("y")))
    return both.select("path", F.when(F.col("x").isNull(), "added").when(F.col("y").isNull(), "removed").otherwise("changed").alias("change"))
