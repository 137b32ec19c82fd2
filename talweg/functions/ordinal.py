"""Ordinal win expectation on five outcome levels, 0 (worst) to 4 (best)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def category_probs(eta: Column, c1: float, c2: float) -> Column:
    """Probabilities of the five levels with cutpoints -c2, -c1, c1, c2."""
    below = [sigmoid(F.lit(c) - eta) for c in (-c2, -c1, c1, c2)]
    return F.array(below[0], below[1] - below[0], below[2] - below[1], below[3] - below[2], 1 - below[3])


def outcome_probs(eta: Column, c1: float) -> Column:
    """struct(win, even, loss)."""
    low, high = sigmoid(F.lit(-c1) - eta), sigmoid(F.lit(c1) - eta)
    return F.struct((1 - high).alias("win"), (high - low).alias("even"), low.alias("loss"))


def expected_score(eta: Column, c1: float) -> Column:
    """Probability of a win and half that of an even outcome."""
    return 1 - 0.5 * (sigmoid(F.lit(c1) - eta) + sigmoid(F.lit(-c1) - eta))


def interval_probability(eta: Column, k_lo: Column, k_hi: Column, c1: float, c2: float) -> Column:
    """Probability that the level lies within [k_lo, k_hi]."""
    probs = category_probs(eta, c1, c2)
    return F.aggregate(F.slice(probs, k_lo + 1, k_hi - k_lo + 1), F.lit(0.0), lambda a, p: a + p)


def log_likelihood(eta: Column, k_lo: Column, k_hi: Column, c1: float, c2: float) -> Column:
    return F.log(F.greatest(interval_probability(eta, k_lo, k_hi, c1, c2), F.lit(1e-12)))


def outcome_interval(a: Column, b: Column) -> Column:
    """struct(k_lo, k_hi, reason) from the levels that both sides report.

    The second side's level is mirrored (4 - b). One report stands alone; two of
    the same class (loss, even, win) span an interval; different classes are a
    conflict; no report is no outcome.
    """
    mirrored = 4 - b
    same = F.signum(a - 2) == F.signum(mirrored - 2)
    reason = F.when(a.isNull() & b.isNull(), "no_outcome").when(a.isNotNull() & b.isNotNull() & ~same, "conflict")
    lo, hi = F.least(a, mirrored), F.greatest(a, mirrored)
    return F.struct(F.when(reason.isNull(), lo).alias("k_lo"), F.when(reason.isNull(), hi).alias("k_hi"), reason.alias("reason"))


def score_of_interval(k_lo: Column, k_hi: Column) -> Column:
    """1 for wins, 0 for losses, 0.5 for what is even or open."""
    return F.when(k_lo >= 3, 1.0).when(k_hi <= 1, 0.0).when(k_lo.isNull(), F.lit(None).cast("double")).otherwise(0.5)


def ranked_probability_score(probs: Column, k: Column) -> Column:
    """Squared error of cumulative probabilities over four cuts, divided by 4."""
    total = F.lit(0.0)
    for cut in range(4):
        below = F.aggregate(F.slice(probs, 1, cut + 1), F.lit(0.0), lambda a, p: a + p)
        total = total + F.pow(below - (k <= cut).cast("double"), 2)
    return total / 4
