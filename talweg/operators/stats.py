"""Statistics over draws in long format: a row per (draw, key), never arrays of a whole posterior.

Samplers stay outside: draws come in as a table. Where a closed form stands in
for a sampled model its name says so.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def normal_mixture(df: DataFrame, value: str, rounds: int = 200, tolerance: float = 1e-8) -> dict[str, float]:
    """Two-component normal mixture by expectation-maximisation: weight, mean and sd of each.

    Each round is one aggregation over all rows; six numbers come back. Fewer
    than two distinct values raise.
    """
    start = df.agg(F.percentile(value, F.array(F.lit(0.25), F.lit(0.75))).alias("q"), F.stddev_pop(value).alias("s")).first()
    if not start["s"]:
        raise ValueError("a mixture needs two distinct values")
    w, m, s = 0.5, list(start["q"]), [start["s"], start["s"]]
    x = F.col(value).cast("double")
    last = -np.inf
    for _ in range(rounds):
        density = [F.exp(-F.pow((x - m[k]) / s[k], 2) / 2) / (s[k] * float(np.sqrt(2 * np.pi))) for k in (0, 1)]
        a, b = density[0] * w, density[1] * (1 - w)
        whole = F.greatest(a + b, F.lit(1e-300))
        r = a / whole
        got = df.agg(F.sum(r).alias("n0"), F.count(x).alias("n"), F.sum(r * x).alias("x0"), F.sum(x).alias("x"), F.sum(r * x * x).alias("xx0"), F.sum(x * x).alias("xx"), F.sum(F.log(whole)).alias("l")).first()
        n0, n1 = got["n0"], got["n"] - got["n0"]
        w = n0 / got["n"]
        m = [got["x0"] / n0, (got["x"] - got["x0"]) / n1]
        s = [max(np.sqrt(max(got["xx0"] / n0 - m[0] ** 2, 0)), 1e-6), max(np.sqrt(max((got["xx"] - got["xx0"]) / n1 - m[1] ** 2, 0)), 1e-6)]
        if abs(got["l"] - last) <= tolerance * max(1.0, abs(got["l"])):
            break
        last = got["l"]
    return {"weight": float(w), "mean_0": float(m[0]), "mean_1": float(m[1]), "sd_0": float(s[0]), "sd_1": float(s[1])}


def responsibility(value: Column, fit: dict[str, float]) -> Column:
    """Probability that a value belongs to the first component of a mixture."""
    a, b = (F.exp(-F.pow((value - fit[f"mean_{k}"]) / fit[f"sd_{k}"], 2) / 2) / fit[f"sd_{k}"] for k in (0, 1))
    return F.coalesce(F.try_divide(fit["weight"] * a, F.nullif(fit["weight"] * a + (1 - fit["weight"]) * b, F.lit(0.0))), F.when(value.isNotNull(), 0.5))


def _normal(*keys: Column) -> Column:
    """A standard normal value that depends on its keys alone (Box and Muller, from two hashes)."""
    part: Callable[[int], Column] = lambda k: (F.shiftrightunsigned(F.xxhash64(*keys, F.lit(k)), 11) + 0.5) / float(1 << 53)
    return F.sqrt(-2 * F.log(part(0))) * F.cos(2 * math.pi * part(1))


def conditional_draws(sides: DataFrame, event: str, side: str, mean: str, known: str, tau: float, sigma: float, rounds: int, seed: int) -> DataFrame:
    """(round, event, side, value): missing values drawn given the known ones of their event.

    Values of an event share a normal effect (sd ``tau``) and have their own
    deviation (sd ``sigma``) about their means. Given the known ones, the shared
    effect and each missing value follow in closed form. Draws depend on the
    seed, the round, the event and the side's place in it alone, so that a task
    that runs again draws the same. NaN counts as missing; a missing mean leaves
    what depends on it null.
    """
    of = Window.partitionBy(event)
    got, mu = F.nanvl(F.col(known).cast("double"), F.lit(None).cast("double")), F.coalesce(F.col(mean).cast("double"), F.lit(math.nan))
    told = sides.select(event, side, mu.alias("__mu"), got.alias("__got"), F.row_number().over(of.orderBy(side, mean, known)).alias("__i"))
    told = told.withColumn("__n", F.count("__got").over(of)).withColumn("__s", F.coalesce(F.sum(F.col("__got") - F.col("__mu")).over(of), F.lit(0.0)))
    every = told.withColumn("round", F.explode(F.sequence(F.lit(0), F.lit(rounds - 1))))
    precision = 1 / tau**2 + F.col("__n") / sigma**2
    drawn: Callable[[Column], Column] = lambda place: _normal(F.lit(seed), F.col("round"), F.col(event), place)
    effect = F.col("__s") / sigma**2 / precision + drawn(F.lit(0)) / F.sqrt(precision)
    value = F.coalesce("__got", F.nanvl(F.col("__mu") + effect + sigma * drawn(F.col("__i")), F.lit(None).cast("double")))
    return every.select("round", event, side, value.alias("value"))


def shifted_if_missing(value: Column, imputed: Column, not_at_random: Column, delta: float) -> Column:
    """Imputed values that are missing not at random, moved by ``delta``."""
    return F.when(F.coalesce(imputed & not_at_random, F.lit(False)), value + delta).otherwise(value)


def stratified_pick(draws: DataFrame, value: str, id_col: str, strata: int, seed: int) -> DataFrame:
    """One draw from each of equally likely strata of a statistic (Latin hypercube), numbered in a permuted order."""
    tile = F.ntile(strata).over(Window.partitionBy(F.lit(0)).orderBy(value, id_col))  # draws of one statistic: a fixed number
    picked = draws.withColumn("stratum", tile).groupBy("stratum").agg(F.min_by(id_col, F.struct(F.xxhash64(F.col(id_col), F.lit(seed)), F.col(id_col))).alias(id_col))
    return picked.withColumn("round", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.xxhash64(F.col(id_col), F.lit(seed + 1)), id_col)) - 1)


def slot_draws(chains: int, draws: int, rounds: int) -> list[tuple[int, int]]:
    """(chain, draw) for each round: chains in turn, the middle of equal time slots."""
    per = [sum(1 for j in range(rounds) if j % chains == c) for c in range(chains)]
    return [(j % chains, int((j // chains + 0.5) * draws / per[j % chains])) for j in range(rounds)]


def published_likelihood(low: Column, high: Column, default_sd: float) -> Column:
    """struct(mean, sd) on the log scale from a 95 per cent interval; ``default_sd`` where it has no width."""
    fine = (low > 0) & (high > low)
    return F.struct(((F.log(low) + F.log(high)) / 2).alias("mean"), F.when(fine, (F.log(high) - F.log(low)) / 3.92).otherwise(default_sd).alias("sd"))


def filled_slopes(df: DataFrame, slope: str, weak: Column, era: str) -> DataFrame:
    """``df`` with ``filled``: the slope, else its era's mean, else the overall mean, else 0."""
    own = F.when(~F.coalesce(weak, F.lit(True)), F.col(slope))
    mean = df.withColumn("__own", own)
    per = mean.groupBy(era).agg(F.avg("__own").alias("__era"))
    whole = mean.agg(F.avg("__own").alias("__all"))  # one row
    joined = mean.join(per, mean[era].eqNullSafe(per[era]), "left").drop(per[era]).join(whole, F.lit(True), "left")
    return joined.withColumn("filled", F.coalesce("__own", "__era", "__all", F.lit(0.0))).drop("__own", "__era", "__all")


def order_probability(draws: DataFrame, ranking: DataFrame, draw: str, actor: str, value: str) -> DataFrame:
    """(actor, p_next): how often an actor's draw is above that of the next rank; null for the last.

    ``ranking``: actor and unique rank from 1.
    """
    nxt = ranking.select(F.col(actor).alias("__next"), (F.col("rank") - 1).alias("rank"))
    pairs = ranking.select(actor, "rank").join(nxt, "rank", "left")
    mine = pairs.join(draws.select(actor, draw, F.col(value).alias("__a")), actor)
    both = mine.join(draws.select(F.col(actor).alias("__next"), draw, F.col(value).alias("__b")), ["__next", draw], "left")
    return both.groupBy(actor).agg(F.avg((F.col("__a") > F.col("__b")).cast("double")).alias("p_next"))


def reliability(df: DataFrame, ratio: str, noise_var: str, nu: float | None = None) -> DataFrame:
    """(V - 2 s^2) / V with V the mean squared log ratio and s^2 the mean noise variance, scaled for Student-t noise."""
    factor = 1.0 if nu is None else nu / (nu - 2)
    s = df.agg(F.avg(F.col(ratio) * F.col(ratio)).alias("v"), (F.avg(noise_var) * factor).alias("n"))
    return s.select(F.try_divide(F.col("v") - 2 * F.col("n"), F.nullif(F.col("v"), F.lit(0.0))).alias("reliability"))


def split_rhat(draws: DataFrame, keys: Sequence[str], chain: str, draw: str, value: str) -> DataFrame:
    """Split R-hat of each quantity from half-chain means and variances, and the number of draws."""
    half = draws.withColumn("__h", F.ntile(2).over(Window.partitionBy(*keys, chain).orderBy(draw)))
    parts = half.groupBy(*keys, chain, "__h").agg(F.count("*").alias("n"), F.avg(value).alias("m"), F.var_samp(value).alias("v"))
    s = parts.groupBy(*keys).agg(F.sum("n").alias("draws"), F.avg("n").alias("n"), F.avg("v").alias("w"), F.var_samp("m").alias("b"))
    return s.select(*keys, "draws", F.sqrt(F.try_divide((F.col("n") - 1) / F.col("n") * F.col("w") + F.col("b"), F.nullif(F.col("w"), F.lit(0.0)))).alias("rhat"))


def shrunk_means(df: DataFrame, keys: Sequence[str], value: str, sd: str) -> DataFrame:
    """Empirical-Bayes (method of moments) shrinkage of group means towards the overall mean.

    A closed-form approximation, not the sampled hierarchical model: groups' noise
    variance is that of a precision-weighted mean, the spread between groups what
    the variance of their means has beyond it.
    """
    per = df.groupBy(*keys).agg((F.sum(F.col(value) / F.pow(sd, 2)) / F.sum(1 / F.pow(sd, 2))).alias("mean"), (1 / F.sum(1 / F.pow(sd, 2))).alias("noise"))
    whole = per.agg(F.avg("mean").alias("__m"), F.greatest(F.coalesce(F.var_samp("mean"), F.lit(0.0)) - F.avg("noise"), F.lit(0.0)).alias("__t"))  # one row
    k = F.coalesce(F.try_divide(F.col("__t"), F.nullif(F.col("__t") + F.col("noise"), F.lit(0.0))), F.lit(0.0))
    return per.join(whole, F.lit(True), "left").select(*keys, "mean", (k * F.col("mean") + (1 - k) * F.col("__m")).alias("shrunk"), F.sqrt(k * F.col("noise")).alias("sd"))
