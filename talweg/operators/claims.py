"""Conflicting claims: copied claims, ranges, regimes and exclusions.

A claim is a row with a group (event side and quantity), a source kind, a value
and flags for lower and upper bounds.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from talweg.functions.maths import values_agree
from talweg.operators import graph


def _near_bands(value: Column, tolerance: float) -> tuple[Column, Column]:
    """A log-scale band of a positive value, and the bands that hold values within the tolerance."""
    width = float(tolerance) * 2
    band = F.floor(F.log(F.greatest(F.abs(value), F.lit(1e-9))) / width)
    return band, F.sequence(band - 1, band + 1)


def lineages(df: DataFrame, keys: Sequence[str], id_col: str, value: str, derived: Column, origin: Column, tolerance: float = 0.01) -> DataFrame:
    """``df`` with ``lineage``: the smallest id among claims that copy each other.

    A derived claim copies an original one of its group whose value agrees
    within the tolerance; two independent sources never link. Values meet by
    bands on the log scale, so a large group isn't paired with itself.
    """
    band, near = _near_bands(F.col(value), tolerance)
    base = df.filter(F.col(value).isNotNull())
    d = base.filter(derived).select(*keys, F.col(id_col).alias("a"), F.col(value).alias("va"), band.alias("band"))
    o = base.filter(origin).select(*keys, F.col(id_col).alias("b"), F.col(value).alias("vb"), F.explode(near).alias("band"))
    edges = d.join(o, [*keys, "band"]).filter(values_agree(F.col("va"), F.col("vb"), tolerance)).select("a", "b")
    found = graph.components(edges)
    return df.join(found, df[id_col] == found["node"], "left").withColumn("lineage", F.coalesce("component", id_col)).drop("node", "component")


def collapse_lineages(df: DataFrame, id_col: str, derived: Column) -> DataFrame:
    """One claim per lineage: an original one before a derived one, then the smallest id."""
    w = Window.partitionBy("lineage").orderBy(F.coalesce(derived, F.lit(False)), id_col)
    return df.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def merge_ranges(df: DataFrame, keys: Sequence[str], id_col: str, value: str, lower: Column, upper: Column) -> DataFrame:
    """Groups with exactly one lower and one upper bound, 0 < A <= B, as one point: sqrt(A B) with variance (ln(B/A) / 4)^2.

    The point takes the lower bound's id. All other rows stay, with variance 0.
    Keys compare null-safely.
    """
    w = Window.partitionBy(*keys)
    one_sided = lower != upper
    told = df.withColumn("__lo", F.when(one_sided & lower, F.col(value))).withColumn("__hi", F.when(one_sided & upper, F.col(value)))
    told = told.withColumn("__nl", F.count("__lo").over(w)).withColumn("__nh", F.count("__hi").over(w)).withColumn("__a", F.max("__lo").over(w)).withColumn("__b", F.max("__hi").over(w))
    pair = (F.col("__nl") == 1) & (F.col("__nh") == 1) & (F.col("__a") > 0) & (F.col("__a") <= F.col("__b"))
    member = F.col("__lo").isNotNull() | F.col("__hi").isNotNull()
    out = told.withColumn("__pair", F.coalesce(pair, F.lit(False)) & member).filter(~(F.col("__pair") & F.col("__hi").isNotNull()))
    out = out.withColumn("range_var", F.when(F.col("__pair"), F.pow(F.log(F.col("__b") / F.col("__a")) / 4, 2)).otherwise(0.0)).withColumn(value, F.when(F.col("__pair"), F.sqrt(F.col("__a") * F.col("__b"))).otherwise(F.col(value)))
    return out.withColumn("merged", F.col("__pair")).drop("__lo", "__hi", "__nl", "__nh", "__a", "__b", "__pair")


def drop_unlabelled_copies(df: DataFrame, keys: Sequence[str], id_col: str, value: str, unlabelled: Column, tolerance: float = 0.01) -> DataFrame:
    """Rows less those unlabelled ones that agree with a labelled one of their group."""
    band, near = _near_bands(F.col(value), tolerance)
    bare = df.filter(unlabelled).select(*keys, F.col(id_col).alias("__id"), F.col(value).alias("__va"), band.alias("__band"))
    told = df.filter(~unlabelled).select(*keys, F.col(value).alias("__vb"), F.explode(near).alias("__band"))
    copies = bare.join(told, [*keys, "__band"]).filter(values_agree(F.col("__va"), F.col("__vb"), tolerance)).select("__id").distinct()
    return df.join(copies, F.col(id_col) == F.col("__id"), "left_anti")


def first_of_source(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """The first row of each key, nulls in keys being equal to each other."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(order))).filter("__n = 1").drop("__n")


def sides_with_range(df: DataFrame, side: str, context: str, lower: Column, upper: Column, point: Column) -> DataFrame:
    """Sides that have a point figure, or a lower and an upper bound in one context."""
    pairs = df.filter(lower).select(side, context).distinct().join(df.filter(upper).select(side, context).distinct(), [side, context]).select(side)
    return df.filter(point).select(side).union(pairs).distinct()


def larger_sum(df: DataFrame, keys: Sequence[str], value: str, arm: str, contingent: Column, upper: Column) -> DataFrame:
    """A derived total for each group: the larger of the contingents' sum and the sum of each arm's largest row, each needing two parts."""
    rows = df.filter(~F.coalesce(upper, F.lit(False)))
    a = rows.filter(contingent).groupBy(*keys).agg(F.sum(value).alias("sa"), F.count("*").alias("na"))
    b = rows.filter(~contingent).groupBy(*keys, arm).agg(F.max(value).alias("v")).groupBy(*keys).agg(F.sum("v").alias("sb"), F.count("*").alias("nb"))
    both = a.join(b, list(keys), "full_outer")
    total = F.greatest(F.when(F.col("na") >= 2, F.col("sa")), F.when(F.col("nb") >= 2, F.col("sb")))
    return both.select(*keys, total.alias("total")).filter("total is not null")
