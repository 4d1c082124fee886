"""Intron length model: a mixture of a Poisson part for short introns and a shifted geometric part for long ones.

weight is the share of the Poisson part, rate its mean. The geometric part gives a length n >= shift the probability
(1 - fail) * fail ^ (n - shift): fail is the chance to go on, which is what a model file holds. Each organism's model is
fitted to its histogram of lengths, which is small whatever the number of introns."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from exonia.functions.special import factln_column, minimum, poisson_cumulative

#: Rounds of one-dimensional fits over rate, fail and weight, how closely each is fitted, and where the geometric part begins.
FIT_ROUNDS, TOLERANCE, SHIFT = 5, 1e-7, 1
TINY = 1e-300


def log_density(length: np.ndarray, weight: float, rate: float, fail: float, shift: int = SHIFT) -> np.ndarray:
    lgamma = np.vectorize(math.lgamma, otypes=[float])
    log = lambda x: math.log(max(x, TINY))
    short = log(weight) + length * log(rate) - rate - lgamma(length + 1)
    steps = length - shift
    long = np.where(steps >= 0, log(1 - weight) + log(1 - fail) + steps * log(fail), -np.inf)
    return np.logaddexp(short, long)


def first_guess(length: np.ndarray, n: np.ndarray) -> dict[str, float]:
    """rate is the commonest length (the shortest of several); weight follows from the share of introns that are shorter, of which
    the Poisson part has a known share; fail makes the mixture's mean that of the lengths."""
    total = float(n.sum())
    mean = float((length * n).sum()) / total
    mode = int(length[np.lexsort((length, -n))[0]])
    before = float(n[length < mode].sum()) / total
    rate = float(max(mode, 1))
    weight = before / poisson_cumulative(rate, max(mode, 1))
    rest = mean - weight * rate - (1 - weight) * (SHIFT - 1)
    fail = 1 - (1 - weight) / rest if rest else math.nan
    inside = lambda x: x if 0 <= x <= 1 else 0.5  # noqa: E731 - also where it is nan
    return {"weight": inside(weight), "rate": rate, "fail": inside(fail)}


def kept(length: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Which lengths are fitted: not 0, and not beyond mean + 3 sd."""
    total = float(n.sum())
    mean = float((length * n).sum()) / total
    sd = math.sqrt(max(float((length * length * n).sum()) / total - mean**2, 0.0))
    return (length > 0) & (length <= int(mean + 3 * sd))


def fit(length: np.ndarray, n: np.ndarray) -> dict[str, float]:
    """The parameters of greatest likelihood near the first guess: in each round rate, fail and weight, one after the other."""
    length, n = length.astype(float), n.astype(float)
    if not (length > 0).any():
        return {"weight": math.nan, "rate": math.nan, "fail": math.nan, "shift": SHIFT, "log_likelihood": 0.0}
    at, keep = first_guess(length, n), kept(length, n)
    length, n = length[keep], n[keep]
    half = (int(length.max(initial=0)) + 1) // 2
    bounds = {"rate": (1.0, float(max(half, 1))), "fail": (0.0, 1.0), "weight": (0.0, 1.0)}
    loss = lambda p: -float((n * log_density(length, p["weight"], p["rate"], p["fail"])).sum())
    for _ in range(FIT_ROUNDS):
        for name, (low, high) in bounds.items():
            x, fx = minimum(lambda v, name=name: loss(at | {name: v}), low, min(max(at[name], low), high), high, TOLERANCE)
            if fx <= loss(at):
                at[name] = x
    return at | {"shift": SHIFT, "log_likelihood": -loss(at)}


PARAMETERS = ["organism", "weight", "rate", "fail", "shift", "log_likelihood"]


def _each(histogram: DataFrame, organism: str, value: str, n: str, make) -> DataFrame:
    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        got = make(pdf["value"].to_numpy(), pdf["n"].to_numpy())
        return pd.DataFrame([{"organism": pdf["organism"].iloc[0]} | got])[PARAMETERS].astype({"shift": int})

    rows = histogram.select(F.col(organism).alias("organism"), F.col(value).alias("value"), F.col(n).alias("n"))
    return rows.groupBy("organism").applyInPandas(work, "organism string, weight double, rate double, fail double, shift int, log_likelihood double")


def guessed(histogram: DataFrame, organism: str = "organism", value: str = "value", n: str = "n") -> DataFrame:
    """As fitted, with the first guess and its likelihood over the lengths that a fit takes."""

    def make(length: np.ndarray, count: np.ndarray) -> dict[str, float]:
        length, count = length.astype(float), count.astype(float)
        at, keep = first_guess(length, count), kept(length, count)
        return at | {"shift": SHIFT, "log_likelihood": float((count[keep] * log_density(length[keep], **at)).sum())}

    return _each(histogram, organism, value, n, make)


def fitted(histogram: DataFrame, organism: str = "organism", value: str = "value", n: str = "n") -> DataFrame:
    """(organism, weight, rate, fail, shift, log_likelihood) of a histogram of intron lengths. Organisms without introns have
    no row; one whose lengths are all 0 has NaN for parameters."""
    return _each(histogram, organism, value, n, fit)


def short_log(length: Column, weight: Column, rate: Column) -> Column:
    """ln of the Poisson part's share at a length, in nats."""
    return F.ln(weight) + length * F.ln(rate) - rate - factln_column(length)


def long_log(length: Column, weight: Column, fail: Column, shift: Column) -> Column:
    """ln of the geometric part's share at a length, in nats; null below the shift."""
    steps = length - shift
    return F.when(steps >= 0, F.ln(1 - weight) + F.log1p(-fail) + steps * F.ln(fail))


def open_score(weight: Column, rate: Column) -> Column:
    """What a short intron's score starts with, at length 0."""
    return F.ln(weight) - rate


def advance_score(length: Column, rate: Column) -> Column:
    """What one more base, the length-th, adds to a short intron's score; a long one's grows by ln(fail) each."""
    return F.ln(rate) - F.ln(length)
