"""Simulated power of a paired comparison over a grid of scenarios."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

#: Places and weights that integrate over a standard normal variable.
_NODES, _WEIGHTS = np.polynomial.hermite_e.hermegauss(96)
_WEIGHTS = _WEIGHTS / _WEIGHTS.sum()
#: Resamples of the questions behind each interval.
RESAMPLES = 500


@lru_cache(maxsize=4096)
def intercept(mean: float, spread: float) -> float:
    """The intercept at which logistic(intercept + spread * z) has the mean over normal z.

    Newton's method from the logit of the mean, on quadrature nodes; the mean rises with the intercept everywhere.
    """
    at = float(np.log(mean / (1 - mean)))
    for _ in range(60):
        p = 1 / (1 + np.exp(-(at + spread * _NODES)))
        step = (float(_WEIGHTS @ p) - mean) / float(_WEIGHTS @ (p * (1 - p)))
        at -= float(np.clip(step, -1, 1))
        if abs(step) < 1e-12:
            break
    return at


def _scores(n_questions: int, base: float, difference: float, spread: float, runs: int, rounds: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Mean scores (rounds, questions) of two conditions that share each question's difficulty."""
    z = rng.standard_normal((rounds, n_questions))
    a, b = intercept(base, spread), intercept(min(0.999, base + difference), spread)
    return tuple(rng.binomial(runs, 1 / (1 + np.exp(-(c + spread * z)))) / runs for c in (a, b))


def _generator(seed: int, *scenario: float) -> np.random.Generator:
    return np.random.default_rng([seed, *(int(round(abs(x) * 1000)) for x in scenario)])


def simulate(n_questions: int, base: float, difference: float, spread: float, runs: int, rounds: int, seed: int, level: float = 0.95) -> tuple[float, float]:
    """Shares of rounds that meet the paired criterion and the separate one.

    Paired: the bootstrap interval of the mean difference lies above 0. Separate: the second condition's interval lies
    above the first one's. Questions are resampled by multinomial weights, one matrix for all rounds.
    """
    rng = _generator(seed, n_questions, base, difference, spread)
    a, b = _scores(n_questions, base, difference, spread, runs, rounds, rng)
    weights = rng.multinomial(n_questions, np.full(n_questions, 1 / n_questions), RESAMPLES).T / n_questions
    tail = (1 - level) / 2
    low, high = ((np.quantile(x @ weights, q, axis=1)) for x, q in ((b - a, tail), (a, 1 - tail)))
    above = np.quantile(b @ weights, tail, axis=1)
    return float((low > 0).mean()), float((above > high).mean())


def score_correlation(n_questions: int, base: float, difference: float, spread: float, runs: int, seed: int) -> float:
    """Correlation of the two conditions' scores over simulated questions; 0 where one of them doesn't vary."""
    a, b = (x[0] for x in _scores(n_questions, base, difference, spread, runs, 1, _generator(seed, n_questions, base, difference, spread)))
    return float(np.corrcoef(a, b)[0, 1]) if a.std() > 0 and b.std() > 0 else 0.0


def correlation_grid(scenarios: DataFrame, runs: int = 3, n_questions: int = 5000, seed: int = 20240501) -> DataFrame:
    """scenarios (base, difference, spread) with the score correlation of n_questions simulated questions."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(correlation=[score_correlation(n_questions, r.base, r.difference, r.spread, runs, seed) for r in batch.itertuples()])

    return scenarios.select("base", "difference", "spread").mapInPandas(run, "base double, difference double, spread double, correlation double")


def simulate_grid(scenarios: DataFrame, runs: int = 3, rounds: int = 400, seed: int = 20240501) -> DataFrame:
    """scenarios (n_questions, base, difference, spread) with their power by both criteria; a scenario's result depends on nothing else."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            power = [simulate(int(r.n_questions), r.base, r.difference, r.spread, runs, rounds, seed) for r in batch.itertuples()]
            yield batch.assign(power=[p for p, _ in power], power_separate=[s for _, s in power])

    return scenarios.select("n_questions", "base", "difference", "spread").mapInPandas(run, "n_questions int, base double, difference double, spread double, power double, power_separate double")
