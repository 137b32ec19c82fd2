"""Credit of actors for outcomes: weights, expectations, replacement and ranking."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from talweg.functions.ordinal import expected_score
from talweg.operators import windows

#: Shares of actors with other than a leading role, and the most that they may take together.
ROLE_SHARES: Mapping[str, float] = {"sovereign": 0.05, "nominal": 0.05, "supreme": 0.10, "theatre": 0.10, "subordinate": 0.08}
MOST_FIXED = 0.30


def side_weights(df: DataFrame, side: Sequence[str], actor: str, role: str, leader: str = "field", shares: Mapping[str, float] = ROLE_SHARES) -> DataFrame:
    """``df`` with ``weight`` and ``method`` for each actor of a side.

    A lone actor takes 1 (single). A side with a leader whose other members all
    have a known role is consistent: fixed shares, scaled to 0.30 at most, and
    the rest split over the leaders. Any other side splits equally (default_split).
    """
    w = Window.partitionBy(*side)
    fixed = F.lit(0.0)
    for name, share in shares.items():
        fixed = F.when(F.col(role) == name, F.lit(share)).otherwise(fixed)
    leads = F.coalesce(F.col(role) == leader, F.lit(False))
    told = df.withColumn("__n", F.count("*").over(w)).withColumn("__lead", F.count_if(leads).over(w)).withColumn("__known", F.count_if(leads | F.coalesce(F.col(role).isin(*shares), F.lit(False))).over(w))
    told = told.withColumn("__f", F.when(leads, 0.0).otherwise(F.coalesce(fixed, F.lit(0.0)))).withColumn("__sum", F.sum("__f").over(w))
    scale = F.least(F.lit(1.0), F.coalesce(F.try_divide(F.lit(MOST_FIXED), F.nullif(F.col("__sum"), F.lit(0.0))), F.lit(1.0)))
    consistent = (F.col("__lead") > 0) & (F.col("__known") == F.col("__n"))
    weight = F.when(F.col("__n") == 1, 1.0).when(consistent, F.when(leads, (1 - F.col("__sum") * scale) / F.col("__lead")).otherwise(F.col("__f") * scale)).otherwise(1.0 / F.col("__n"))
    method = F.when(F.col("__n") == 1, "single").when(consistent, "rule").otherwise("default_split")
    return told.withColumn("weight", weight).withColumn("method", method).drop("__n", "__lead", "__known", "__f", "__sum")


def invalid_sides(df: DataFrame, side: Sequence[str], weight: str, tolerance: float = 1e-6) -> DataFrame:
    """Sides whose weights don't sum to 1."""
    return df.groupBy(*side).agg(F.sum(weight).alias("total")).filter(F.abs(F.col("total") - 1) > tolerance)


def replacement_level(skills: DataFrame, keys: Sequence[str], skill: str, share: float = 0.4) -> DataFrame:
    """The skill at a percentile of each draw, linear between neighbours."""
    return skills.groupBy(*keys).agg(F.percentile(skill, F.lit(share)).alias("replacement"))


def credit(entries: DataFrame, draw: Sequence[str], actor: str, weight: str, named_weight: str, named_part: str, eta: str, y: str, replacement: str, c1: float) -> DataFrame:
    """Expected and realised credit above replacement of each actor.

    ``entries``: a row per draw, event, side and actor. The side's expectation
    is compared with that after its named part gives way to named weight times
    the replacement skill; an actor has its share of the difference, and of what
    the outcome was above the expectation.
    """
    fitted = expected_score(F.col(eta), c1)
    replaced = expected_score(F.col(eta) - F.col(named_part) + F.col(named_weight) * F.col(replacement), c1)
    share = F.coalesce(F.try_divide(F.col(weight), F.nullif(F.col(named_weight), F.lit(0.0))), F.lit(0.0))
    told = entries.withColumn("__x", share * (fitted - replaced)).withColumn("__r", F.col(weight) * (F.col(y) - fitted) + share * (fitted - replaced))
    return told.groupBy(*draw, actor).agg(F.sum("__x").alias("expected"), F.sum("__r").alias("realised"), F.count("*").alias("n"))


def ranking(df: DataFrame, actor: str, score: str, n: str, least: int, sd: str | None = None, z: float = 1.959963984540054) -> DataFrame:
    """Unique ranks by score (ties by actor), a headline flag for actors with ``least`` events, and an interval."""
    out = windows.ranked_descending(df, score, actor).withColumn("headline", F.col(n) >= least)
    if sd:
        out = out.withColumn("low", F.col(score) - z * F.col(sd)).withColumn("high", F.col(score) + z * F.col(sd))
    return out


def missing_class(field: Column, year: Column, own: Column, other: Column, any_side: Column, lost: Column, closed_state: Column, template: Sequence[str]) -> Column:
    """Why a value is missing (mar, mnar or null for undecided), the first rule that holds deciding."""
    yes = lambda c: F.coalesce(c, F.lit(False))
    return (
        F.when(year.isNull(), F.lit(None).cast("string"))
        .when(field.isin(*template), "mar")
        .when(yes(closed_state), "mnar")
        .when((field == "casualties") & yes(own), F.when(yes(lost), "mnar").otherwise("mar"))
        .when((year < 1500) & ~yes(any_side), "mnar")
        .when(yes(lost) & ~yes(own) & yes(other), "mnar")
        .when(year.between(1700, 1914) & ~yes(own) & yes(other), "mar")
    )
