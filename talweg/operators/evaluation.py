"""Evaluation of fits and completed data: each check gives one row with its figures and ``passed``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from talweg.operators import aggregates, windows


def _verdict(df: DataFrame, passed: Column) -> DataFrame:
    """``passed`` added; an unknown verdict fails."""
    return df.withColumn("passed", F.coalesce(passed, F.lit(False)))


def completeness(values: DataFrame, keys: Sequence[str], value: str, sides: int, rounds: int) -> DataFrame:
    """Every side has a finite value in every round."""
    finite = F.col(value).isNotNull() & ~F.isnan(value) & (F.abs(value) != float("inf"))
    out = values.filter(finite).select(*keys).distinct().agg(F.count("*").alias("found")).withColumn("wanted", F.lit(sides * rounds))
    return _verdict(out, F.col("found") == F.col("wanted"))


def ratio_plausible(values: DataFrame, round_col: str, event: str, value: str, imputed: str, limit: float = 4.0) -> DataFrame:
    """The largest of the events' median ranges over rounds, among events with two sides and an imputed one, is below a limit (none passes)."""
    per = values.groupBy(round_col, event).agg((F.max(value) - F.min(value)).alias("span"), F.count("*").alias("n"), F.max(imputed).alias("any"))
    mid = per.filter("n >= 2 and any").groupBy(event).agg(F.median("span").alias("median"))
    return _verdict(mid.agg(F.count("*").alias("events"), F.max("median").alias("largest")), (F.col("events") == 0) | (F.col("largest") < limit))


def values_plausible(values: DataFrame, value: str, imputed: Column, low: float, high: float) -> DataFrame:
    """No imputed value (log scale) lies outside the bounds."""
    out = values.filter(imputed).agg(F.count("*").alias("n"), F.count_if(~F.exp(value).between(low, high)).alias("outside"))
    return _verdict(out, F.col("outside") == 0)


def distributional(values: DataFrame, round_col: str, era: str, value: str, imputed: Column, alpha: float = 0.01, least: int = 5) -> DataFrame:
    """Per era: median over rounds of the two-sample p-value of imputed against observed values; eras with few on a side are left out and pass."""
    d = aggregates.ks_distance(values, [round_col, era], value, imputed).filter((F.col("n_a") >= least) & (F.col("n_b") >= least))
    p = d.withColumn("p", aggregates.ks_p_value(F.col("distance"), F.col("n_a"), F.col("n_b")))
    return _verdict(p.groupBy(era).agg(F.median("p").alias("median_p")), F.col("median_p") >= alpha)


def pair_slope(values: DataFrame, event: str, side: str, value: str, report: str, least: int = 10, minimum: float = 0.8, reference: float | None = None, tolerance: float = 0.1) -> DataFrame:
    """Slope through the origin of the values' differences on the reports', over events with exactly two reported sides; too few pairs pass."""
    known = values.filter(F.col(report).isNotNull())
    w = known.groupBy(event).agg(F.count("*").alias("n"), (F.min_by(value, side) - F.max_by(value, side)).alias("y"), (F.min_by(report, side) - F.max_by(report, side)).alias("x")).filter("n = 2")
    out = w.agg(F.count("*").alias("pairs"), aggregates.slope_through_origin("x", "y").alias("slope"))
    fine = F.col("slope") >= minimum if reference is None else F.abs(F.col("slope") - reference) <= tolerance
    return _verdict(out, (F.col("pairs") < least) | fine)


def side_slope(values: DataFrame, value: str, report: str, least: int = 10, minimum: float = 0.9) -> DataFrame:
    """Least-squares slope of values on reports over reported sides; too few pass."""
    out = values.filter(F.col(report).isNotNull()).agg(F.count("*").alias("sides"), aggregates.ols_slope(report, value).alias("slope"))
    return _verdict(out, (F.col("sides") < least) | (F.col("slope") >= minimum))


def rank_agreement(a: DataFrame, b: DataFrame, actor: str, score: str, n: int) -> DataFrame:
    """Spearman's rho over the actors that both rank, and overlap of the two full lists' top n."""
    from talweg.operators.relational import top_set_overlap

    both = a.select(actor, F.col(score).alias("__a")).join(b.select(actor, F.col(score).alias("__b")), actor).withColumn("__all", F.lit(1))
    rho = windows.spearman(both, ["__all"], "__a", "__b").select("n", "rho")
    return top_set_overlap(a, b, actor, score, n).join(rho, F.lit(True), "left")


def concentration(entries: DataFrame, actor: str, value: str, extreme: Column, top: DataFrame, most: float = 0.5) -> DataFrame:
    """Top actors more than ``most`` of whose absolute credit comes from extreme entries."""
    s = entries.join(top.select(actor), actor, "left_semi").groupBy(actor).agg(F.try_divide(F.sum(F.when(extreme, F.abs(value)).otherwise(0.0)), F.nullif(F.sum(F.abs(value)), F.lit(0.0))).alias("share"))
    return s.filter(F.col("share") > most)


def uncredited(counts: DataFrame, actor: str, included: str, uncredited: str, top: DataFrame, least: float = 0.5) -> DataFrame:
    """Top actors with less than ``least`` of their events credited."""
    share = F.try_divide(F.col(included), F.col(included) + F.col(uncredited))
    return counts.join(top.select(actor), actor, "left_semi").select(actor, share.alias("credited")).filter(F.coalesce(F.col("credited") < least, F.lit(True)))


def long_careers(entries: DataFrame, actor: str, year: str, most: int = 60) -> DataFrame:
    """Actors whose events span over ``most`` years."""
    s = entries.groupBy(actor).agg(F.min(year).alias("first"), F.max(year).alias("last"))
    return s.withColumn("span", F.col("last") - F.col("first")).filter(F.col("span") > most)


def expert_checks(wanted: DataFrame, ranking: DataFrame, key: str) -> DataFrame:
    """``wanted`` (key, low, high) with the rank found and a status: passed, failed, or not_evaluable for keys without a rank."""
    j = wanted.join(ranking.select(key, "rank"), key, "left")
    return j.withColumn("status", F.when(F.col("rank").isNull(), "not_evaluable").when(F.col("rank").between(F.col("low"), F.col("high")), "passed").otherwise("failed"))


def category_check(simulated: DataFrame, observed: DataFrame, level: str, share: str, seen: str, draw: str, coverage: float = 0.99) -> DataFrame:
    """Per outcome level: whether the observed share (``seen``) lies inside the central interval of the simulated ones."""
    tail = (1 - coverage) / 2
    ci = simulated.groupBy(level).agg(F.percentile(share, F.lit(tail)).alias("low"), F.percentile(share, F.lit(1 - tail)).alias("high"), F.count_distinct(draw).alias("draws"))
    return _verdict(observed.join(ci, level, "left"), F.col(seen).between(F.col("low"), F.col("high")))


def provisional_reasons(results: DataFrame) -> DataFrame:
    """One row: the names of gates that block publication, in order, empty if none does."""
    bad = results.filter((F.col("severity") == "error") & ~F.col("passed"))
    return bad.agg(F.sort_array(F.collect_set("name")).alias("reasons"))


def same_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows that only one of two formulations gives, with the side that has them."""
    return a.exceptAll(b).withColumn("only", F.lit("first")).union(b.exceptAll(a).withColumn("only", F.lit("second")))


def running_share(df: DataFrame, order: str, value: str, keys: Sequence[str]) -> DataFrame:
    """Cumulative share of a value within each key."""
    w = Window.partitionBy(*keys)
    up = w.orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("running", F.try_divide(F.sum(value).over(up), F.nullif(F.sum(value).over(w), F.lit(0.0))))
