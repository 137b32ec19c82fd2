"""Aggregations: agreement, bins, pooled and weighted statistics, calibration."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def agreement(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Count, mean, sample sd, min, max and coefficient of variation (null unless the mean is positive) of each group."""
    out = df.groupBy(*keys).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"), F.min(value).alias("low"), F.max(value).alias("high"))
    return out.withColumn("cv", F.when(F.col("mean") > 0, F.col("sd") / F.col("mean")))


def null_fractions(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, n_null, n, fraction) for each column, in one pass."""
    n = df.agg(F.count("*").alias("__n"), *[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    long = n.unpivot(["__n"], list(columns), "column", "n_null")
    return long.select("column", "n_null", F.col("__n").alias("n"), F.try_divide("n_null", "__n").alias("fraction"))


def filtered_distinct_share(keys: Sequence[str], df: DataFrame, value: str, cond: Column) -> DataFrame:
    """Distinct values that meet a condition, all distinct values, and their ratio."""
    out = df.groupBy(*keys).agg(F.count_distinct(F.when(cond, F.col(value))).alias("hits"), F.count_distinct(value).alias("n"))
    return out.withColumn("share", F.try_divide("hits", "n"))


def combined(df: DataFrame, keys: Sequence[str], value: str, weight: str) -> DataFrame:
    """Precision-weighted mean, total weight and count; null mean where weights sum to 0."""
    out = df.groupBy(*keys).agg(F.sum(F.col(weight) * F.col(value)).alias("__wx"), F.sum(weight).alias("weight"), F.count("*").alias("n"))
    return out.select(*keys, F.try_divide("__wx", F.nullif(F.col("weight"), F.lit(0.0))).alias("mean"), "weight", "n")


def slope_through_origin(x: str, y: str) -> Column:
    """Least-squares slope of y = b x; null without spread."""
    return F.try_divide(F.sum(F.col(x) * F.col(y)), F.nullif(F.sum(F.col(x) * F.col(x)), F.lit(0.0)))


def ols_slope(x: str, y: str, least: int = 3) -> Column:
    """Least-squares slope; null below ``least`` points."""
    return F.when(F.count(F.when(F.col(x).isNotNull() & F.col(y).isNotNull(), 1)) >= least, F.regr_slope(y, x))


def geometric_ratio(a: str, b: str) -> Column:
    return F.exp(F.avg(F.log(F.col(a)) - F.log(F.col(b))))


def spread_ratio(a: str, b: str) -> Column:
    """Ratio of population standard deviations."""
    return F.try_divide(F.stddev_pop(a), F.nullif(F.stddev_pop(b), F.lit(0.0)))


def whole_quantile(df: DataFrame, value: Column, share: float, bins: int = 4096) -> float | None:
    """The exact quantile of all rows, linear between neighbours; null without a value, NaN above all.

    Each pass counts the values of ``bins`` equal ranges and goes on in the one
    that has the wanted place, so that no task and no buffer holds all values.
    """
    held = df.select(value.cast("double").alias("v")).filter("v is not null")
    finite = ~F.isnan("v") & (F.abs("v") != float("inf"))
    n, low, high, n_low, n_high, n_nan = held.agg(
        F.count("*"), F.min(F.when(finite, F.col("v"))), F.max(F.when(finite, F.col("v"))), F.count_if(F.col("v") == float("-inf")), F.count_if(F.col("v") == float("inf")), F.count_if(F.isnan("v"))
    ).first()
    if not n:
        return None
    place = share * (n - 1)
    want, then = math.floor(place), math.ceil(place)

    def at(r: int) -> float:
        """The value at a place, from 0."""
        if r >= n - n_nan:
            return math.nan
        if r >= n - n_nan - n_high:
            return math.inf
        if r < n_low:
            return -math.inf
        r, a, b = r - n_low, low, high
        while a < b:
            # halves, as the width of all doubles overflows
            part = F.least(F.floor((F.col("v") / 2 - a / 2) / (b / 2 - a / 2) * bins), F.lit(bins - 1)) if b / 2 > a / 2 else F.when(F.col("v") > a, 1).otherwise(0)
            rows = held.filter(finite & F.col("v").between(a, b)).groupBy(part.alias("part")).agg(F.count("*").alias("n"), F.min("v").alias("a"), F.max("v").alias("b")).collect()  # a row per range
            for row in sorted(rows, key=lambda x: x["part"]):
                if r < row["n"]:
                    a, b = row["a"], row["b"]
                    break
                r -= row["n"]
        return a

    below = at(want)
    if want == then:
        return below
    return (then - place) * below + (place - want) * at(then)


def median_abs_deviation(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Median and median absolute deviation of each group."""
    mid = df.withColumn("__m", F.median(value).over(Window.partitionBy(*keys)))
    return mid.groupBy(*keys).agg(F.max("__m").alias("median"), F.median(F.abs(F.col(value) - F.col("__m"))).alias("mad"))


def log_sum_exp(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """log of the sum of exponentials of each group, scaled by its largest value."""
    top = df.withColumn("__top", F.max(value).over(Window.partitionBy(*keys)))
    return top.groupBy(*keys).agg((F.max("__top") + F.log(F.sum(F.exp(F.col(value) - F.col("__top"))))).alias("log_sum"))


def softmax_share(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Each row's softmax share of its group; missing values count as the group's mean, a group of missing ones splits equally."""
    w = Window.partitionBy(*keys)
    filled = df.withColumn("__v", F.coalesce(F.col(value), F.avg(value).over(w), F.lit(0.0)))
    top = filled.withColumn("__e", F.exp(F.col("__v") - F.max("__v").over(w)))
    return top.withColumn("share", F.col("__e") / F.sum("__e").over(w)).drop("__v", "__e")


def delta_sd(df: DataFrame, keys: Sequence[str], share: str, sd: str) -> DataFrame:
    """Root sum of squares of share times sd, and whether every member was measured."""
    return df.groupBy(*keys).agg(F.sqrt(F.sum(F.pow(F.col(share) * F.coalesce(F.col(sd), F.lit(0.0)), 2))).alias("sd"), F.bool_and(F.col(sd).isNotNull()).alias("measured"))


def rubin(draws: DataFrame, key: str, round_col: str, value: str) -> DataFrame:
    """Rubin's rules over rounds of draws: mean, within and between variance, total, sd and fraction of missing information.

    Within: mean of the rounds' sample variances; between: sample variance of
    their means (0 for one round); total = within + (1 + 1/M) between.
    """
    per = draws.groupBy(key, round_col).agg(F.avg(value).alias("m"), F.coalesce(F.var_samp(value), F.lit(0.0)).alias("v"))
    out = per.groupBy(key).agg(F.count("*").alias("rounds"), F.avg("m").alias("mean"), F.avg("v").alias("within"), F.coalesce(F.var_samp("m"), F.lit(0.0)).alias("between"))
    extra = (1 + 1 / F.col("rounds")) * F.col("between")
    out = out.withColumn("total", F.col("within") + extra)
    return out.withColumn("sd", F.sqrt("total")).withColumn("fmi", F.coalesce(F.try_divide(extra, F.nullif(F.col("total"), F.lit(0.0))), F.lit(0.0)))


def widened_interval(draws: DataFrame, pooled: DataFrame, key: str, value: str, level: float = 0.95) -> DataFrame:
    """Quantiles of the pooled draws stretched about their mean by the root of total over mixture variance."""
    tail = (1 - level) / 2
    mix = draws.groupBy(key).agg(F.avg(value).alias("__m"), F.var_samp(value).alias("__v"), F.percentile(value, F.lit(tail)).alias("__lo"), F.percentile(value, F.lit(1 - tail)).alias("__hi"))
    both = mix.join(pooled.select(key, "total"), key)
    factor = F.when(F.col("__v") > 0, F.sqrt(F.col("total") / F.col("__v"))).otherwise(1.0)
    return both.select(key, (F.col("__m") + (F.col("__lo") - F.col("__m")) * factor).alias("low"), (F.col("__m") + (F.col("__hi") - F.col("__m")) * factor).alias("high"))


def worst_case(df: DataFrame, keys: Sequence[str], largest: Sequence[str], smallest: Sequence[str], summed: Sequence[str]) -> DataFrame:
    """Roll-up of diagnostics: maxima, minima and sums, null wherever any part is unknown."""

    def known(f: Column, c: str) -> Column:
        return F.when(F.count_if(F.col(c).isNull() | F.isnan(F.col(c).cast("double"))) == 0, f).alias(c)

    return df.groupBy(*keys).agg(*[known(F.max(c), c) for c in largest], *[known(F.min(c), c) for c in smallest], *[known(F.sum(c), c) for c in summed])


def calibration(df: DataFrame, p: str, y: str, bins: int) -> DataFrame:
    """Equal-width bins of p over 0..1, the top edge closed: bin, n, mean_p, observed; empty bins are listed with n = 0."""
    held = df.withColumn("bin", F.least(F.floor(F.col(p) * bins), F.lit(bins - 1)).cast("int")).groupBy("bin").agg(F.count("*").alias("n"), F.avg(p).alias("mean_p"), F.avg(F.col(y).cast("double")).alias("observed"))
    every = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return every.join(held, "bin", "left").withColumn("n", F.coalesce("n", F.lit(0)))


def binary_scores(df: DataFrame, p: str, y: str) -> DataFrame:
    """n, accuracy (a probability of exactly one half earns half credit), Brier score and the share of y."""
    hit = F.when(F.col(p) == 0.5, 0.5).when((F.col(p) > 0.5) == (F.col(y) == 1), 1.0).otherwise(0.0)
    return df.agg(F.count("*").alias("n"), F.avg(hit).alias("accuracy"), F.avg(F.pow(F.col(p) - F.col(y), 2)).alias("brier"), F.avg(F.col(y).cast("double")).alias("rate"))


def priority_merge(df: DataFrame, key: str, priority: Column, tie: str, fields: Sequence[str]) -> DataFrame:
    """For each key and field the value of the best source that has one (ties to the smaller ``tie``), and how many distinct values dissent."""
    ranked = df.withColumn("__p", priority)
    best = lambda c: F.min_by(F.when(F.col(c).isNotNull(), F.col(c)), F.when(F.col(c).isNotNull(), F.struct((-F.col("__p")).alias("p"), F.col(tie).alias("t"))))
    aggs = reduce(lambda out, c: [*out, best(c).alias(c), F.greatest(F.count_distinct(c) - 1, F.lit(0)).alias(f"{c}_dissent")], fields, [])
    return ranked.groupBy(key).agg(*aggs)


def collapsed(df: DataFrame, keys: Sequence[str], order: Sequence[str], firsts: Sequence[str]) -> DataFrame:
    """One row per key: how often it occurs and, of each column, the first value that isn't null."""
    place = F.struct(*[F.col(c) for c in order])
    return df.groupBy(*keys).agg(F.count("*").alias("mentions"), *[F.min_by(c, F.when(F.col(c).isNotNull(), place)).alias(c) for c in firsts])


def ks_distance(df: DataFrame, keys: Sequence[str], value: str, flag: Column) -> DataFrame:
    """Largest distance of the two empirical distributions that ``flag`` separates, and both counts."""
    w = Window.partitionBy(*keys)
    per = df.groupBy(*keys, F.col(value).alias("__v")).agg(F.count_if(flag).alias("__a"), F.count_if(~flag).alias("__b"))
    up = w.orderBy("__v").rowsBetween(Window.unboundedPreceding, 0)
    ecdf = per.withColumn("__na", F.sum("__a").over(w)).withColumn("__nb", F.sum("__b").over(w)).withColumn("__d", F.abs(F.try_divide(F.sum("__a").over(up), F.col("__na")) - F.try_divide(F.sum("__b").over(up), F.col("__nb"))))
    return ecdf.groupBy(*keys).agg(F.max("__na").alias("n_a"), F.max("__nb").alias("n_b"), F.max("__d").alias("distance"))


def ks_p_value(distance: Column, n_a: Column, n_b: Column, terms: int = 40) -> Column:
    """Asymptotic p-value of the two-sample distance (Kolmogorov's series)."""
    root = F.sqrt(n_a * n_b / (n_a + n_b))
    x = (root + 0.12 + 0.11 / root) * distance
    total = F.lit(0.0)
    for k in range(1, terms + 1):
        total = total + (2.0 if k % 2 else -2.0) * F.exp(-2.0 * k * k * x * x)
    return F.when(x < 0.2, F.lit(1.0)).otherwise(F.least(F.greatest(total, F.lit(0.0)), F.lit(1.0)))


def two_regressor_slopes(df: DataFrame, keys: Sequence[str], y: str, x1: str, x2: str) -> DataFrame:
    """Slopes of y on two regressors with an intercept, from covariances; null where they are collinear."""
    cov = {f"{a}{b}": F.covar_pop(a, b) for a, b in ((x1, x1), (x2, x2), (x1, x2), (x1, y), (x2, y))}
    s = df.groupBy(*keys).agg(*[c.alias(n) for n, c in zip(("s11", "s22", "s12", "s1y", "s2y"), cov.values(), strict=True)])
    det = F.nullif(F.col("s11") * F.col("s22") - F.col("s12") * F.col("s12"), F.lit(0.0))
    return s.select(*keys, F.try_divide(F.col("s1y") * F.col("s22") - F.col("s2y") * F.col("s12"), det).alias("slope_1"), F.try_divide(F.col("s2y") * F.col("s11") - F.col("s1y") * F.col("s12"), det).alias("slope_2"))


def era_effect(df: DataFrame, value: str, early: Column) -> DataFrame:
    """(mean, sd) of early less later values: sd is twice Welch's standard error, at least 0.3; (0, 0.5) below two on either side."""
    a, b = (F.when(early, F.col(value)), F.when(~early, F.col(value)))
    s = df.agg(F.count(a).alias("na"), F.count(b).alias("nb"), F.avg(a).alias("ma"), F.avg(b).alias("mb"), F.var_samp(a).alias("va"), F.var_samp(b).alias("vb"))
    enough = (F.col("na") >= 2) & (F.col("nb") >= 2)
    se = F.sqrt(F.try_divide("va", "na") + F.try_divide("vb", "nb"))
    return s.select(F.when(enough, F.col("ma") - F.col("mb")).otherwise(0.0).alias("mean"), F.when(enough, F.greatest(2 * se, F.lit(0.3))).otherwise(0.5).alias("sd"))
