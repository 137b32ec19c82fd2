"""Window operators: shares, ranks, sessions, gaps, neighbours and group rules."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def with_share(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Each row with its group's total and its share of it (null for a total of 0)."""
    total = F.sum(value).over(Window.partitionBy(*keys))
    return df.withColumn("total", total).withColumn("share", F.try_divide(F.col(value), F.nullif(F.col("total"), F.lit(0.0))))


def first_per_key(df: DataFrame, keys: Sequence[str], *order: Column) -> DataFrame:
    """The first row of each key; the order must be total for the result to be determined."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("__n = 1").drop("__n")


def primary_member(df: DataFrame, keys: Sequence[str], member: str, weight: str) -> DataFrame:
    """The heaviest member of each group, missing weights as 0, ties to the smallest."""
    return df.groupBy(*keys).agg(F.min_by(member, F.struct((-F.coalesce(F.col(weight), F.lit(0.0))).alias("w"), F.col(member).alias("m"))).alias(member))


def ranked_descending(df: DataFrame, value: str, id_col: str, buckets: int = 64) -> DataFrame:
    """Unique ranks by value descending (NaN and null last), ties by id.

    Values are split at approximate quantiles, ranked within each split and
    shifted by the counts ahead, so that no task ranks all rows.
    """
    clean = F.when(~F.isnan(F.col(value).cast("double")), F.col(value).cast("double"))
    told = df.withColumn("__v", clean)
    bounds = sorted(set(told.approxQuantile("__v", [i / buckets for i in range(1, buckets)], 0.2 / buckets)))
    told = told.withColumn("__b", F.when(F.col("__v").isNull(), -1).otherwise(F.size(F.filter(F.lit(bounds), lambda b: b < F.col("__v"))) if bounds else F.lit(0)))
    counts = told.groupBy("__b").agg(F.count("*").alias("__n"))
    ahead = counts.withColumn("__ahead", F.coalesce(F.sum("__n").over(Window.partitionBy(F.lit(0)).orderBy(F.desc("__b")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("__n")
    within = told.withColumn("__r", F.row_number().over(Window.partitionBy("__b").orderBy(F.desc("__v"), F.asc(id_col))))
    return within.join(F.broadcast(ahead), "__b").withColumn("rank", (F.col("__ahead") + F.col("__r")).cast("long")).drop("__v", "__b", "__r", "__ahead")


def average_ranks(df: DataFrame, keys: Sequence[str], value: str, name: str) -> DataFrame:
    """Ascending ranks where tied values share their mean rank."""
    w = Window.partitionBy(*keys)
    return df.withColumn(name, F.rank().over(w.orderBy(value)) + (F.count("*").over(Window.partitionBy(*keys, value)) - 1) / 2)


def spearman(df: DataFrame, keys: Sequence[str], x: str, y: str, least: int = 3) -> DataFrame:
    """Rank correlation of each group; null below ``least`` points or for a constant column."""
    known = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull() & ~F.isnan(F.col(x).cast("double")) & ~F.isnan(F.col(y).cast("double")))
    ranks = average_ranks(average_ranks(known, keys, x, "__rx"), keys, y, "__ry")
    return ranks.groupBy(*keys).agg(F.count("*").alias("n"), F.when(F.count("*") >= least, F.try_divide(F.covar_pop("__rx", "__ry"), F.stddev_pop("__rx") * F.stddev_pop("__ry"))).alias("rho"))


def overlap_with_next(df: DataFrame, keys: Sequence[str], order: str, low: str, high: str, above: float) -> DataFrame:
    """Whether a row's interval overlaps the next row's by a share of the narrower above a limit; null for the last."""
    from talweg.functions.maths import overlap_share

    w = Window.partitionBy(*keys).orderBy(order)
    nxt = df.withColumn("__lo", F.lead(low).over(w)).withColumn("__hi", F.lead(high).over(w))
    return nxt.withColumn("overlaps_next", F.when(F.col("__lo").isNotNull(), overlap_share(F.col(low), F.col(high), F.col("__lo"), F.col("__hi")) > above)).drop("__lo", "__hi")


def sessions(df: DataFrame, keys: Sequence[str], at: str, gap: float, *ties: str) -> DataFrame:
    """Rows with a session number (from 0) that goes up where the step from the row before is above ``gap``.

    Rows without a value go to the largest session of their key, the earliest on ties.
    """
    w = Window.partitionBy(*keys).orderBy(F.asc_nulls_last(at), *ties)
    step = (F.col(at) - F.lag(at).over(w) > gap).cast("int")
    numbered = df.withColumn("session", F.when(F.col(at).isNotNull(), F.sum(F.coalesce(step, F.lit(0))).over(w.rowsBetween(Window.unboundedPreceding, 0))))
    sizes = numbered.filter(F.col("session").isNotNull()).groupBy(*keys, "session").agg(F.count("*").alias("__n"))
    largest = sizes.groupBy(*keys).agg(F.min_by("session", F.struct((-F.col("__n")).alias("n"), F.col("session").alias("s"))).alias("__largest"))
    return numbered.join(largest, list(keys), "left").withColumn("session", F.coalesce("session", "__largest", F.lit(0)).cast("long")).drop("__largest")


def gaps(df: DataFrame, value: str, step: int) -> DataFrame:
    """(after, before): neighbouring distinct values further apart than ``step``."""
    d = df.select(F.col(value).alias("after")).dropna().distinct()
    nxt = d.withColumn("before", F.lead("after").over(Window.partitionBy(F.lit(0)).orderBy("after")))  # distinct bins: few by nature
    return nxt.filter(F.col("before") - F.col("after") > step)


def top_two_margin(df: DataFrame, keys: Sequence[str], id_col: str, score: str, raw: str) -> DataFrame:
    """The best candidate of each key by score, then raw score, then id, with the raw margin to the runner-up (null for a lone one)."""
    w = Window.partitionBy(*keys).orderBy(F.desc(score), F.desc(raw), F.asc(id_col))
    out = df.withColumn("__n", F.row_number().over(w)).withColumn("margin", F.col(raw) - F.lead(raw).over(w))
    return out.filter("__n = 1").drop("__n")


def keep_unless_group(df: DataFrame, keys: Sequence[str], preferred: Column, exempt: Column | None = None) -> DataFrame:
    """Groups with a preferred row keep only such rows and exempt ones; other groups keep all."""
    good = F.coalesce(preferred, F.lit(False))
    spare = F.lit(False) if exempt is None else F.coalesce(exempt, F.lit(False))
    told = df.withColumn("__any", F.max(good).over(Window.partitionBy(*keys))).withColumn("__keep", good | spare)
    return told.filter(~F.col("__any") | F.col("__keep")).drop("__any", "__keep")


def lone_kind(df: DataFrame, keys: Sequence[str], kind: str, total: str, parts: Sequence[str]) -> DataFrame:
    """Rows promoted to ``total`` (flag ``promoted``) in groups that have no total and exactly one of ``parts``."""
    w = Window.partitionBy(*keys)
    has_total = F.max(F.coalesce(F.col(kind) == total, F.lit(False))).over(w)
    part = F.when(F.col(kind).isin(*parts), F.col(kind))
    told = df.withColumn("__t", has_total).withColumn("__k", F.size(F.collect_set(part).over(w))).withColumn("__p", part.isNotNull())
    promoted = ~F.col("__t") & (F.col("__k") == 1) & F.col("__p")
    return told.withColumn("promoted", promoted).withColumn(kind, F.when(promoted, F.lit(total)).otherwise(F.col(kind))).drop("__t", "__k", "__p")


def span_guard(df: DataFrame, keys: Sequence[str], value: str, warn: float = 1.0, error: float = 2.0) -> DataFrame:
    """Groups whose log ratio of largest to smallest positive value is above a limit: log_span and severity."""
    out = df.filter(F.col(value) > 0).groupBy(*keys).agg(F.log(F.max(value) / F.min(value)).alias("log_span"))
    return out.withColumn("severity", F.when(F.col("log_span") > error, "error").when(F.col("log_span") > warn, "warning")).filter("severity is not null")


def forward_filled(df: DataFrame, keys: Sequence[str], order: str, value: Column, name: str) -> DataFrame:
    """The last value that isn't null up to each row."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(name, F.last(value, ignorenulls=True).over(w))


def stride_sample(df: DataFrame, order: str, most: int) -> DataFrame:
    """Every so many-th row in order, at most ``most`` in all (a sampling operator)."""
    n = df.count()
    step = max(1, -(-n // most))
    return ranked_descending(df, order, order).filter((F.col("rank") - 1) % step == 0).drop("rank")


def evenly_spaced(df: DataFrame, keys: Sequence[str], order: str, k: int) -> DataFrame:
    """k rows of each group at evenly spaced places, first and last included (all, if fewer)."""
    w = Window.partitionBy(*keys)
    told = df.withColumn("__i", F.row_number().over(w.orderBy(order)) - 1).withColumn("__n", F.count("*").over(w))
    places = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda j: F.round(j * (F.col("__n") - 1) / max(k - 1, 1)).cast("int"))
    return told.filter((F.col("__n") <= k) | F.array_contains(places, F.col("__i"))).drop("__i", "__n")


def packed(df: DataFrame, keys: Sequence[str], order: str, length: str, limit: int) -> DataFrame:
    """Rows with a chunk number such that a greedy reader fills chunks up to ``limit`` in order.

    Greedy filling depends on all rows before, so each group runs through one fold over its lengths.
    """
    group = df.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(length).alias("n")))).alias("__rows"))
    start = F.struct(F.lit(0).cast("long").alias("chunk"), F.lit(0).cast("long").alias("used"), F.expr("cast(array() as array<bigint>)").alias("out"))

    def step(acc: Column, row: Column) -> Column:
        n = row["n"].cast("long")
        fits = (acc["used"] + n <= limit) | (acc["used"] == 0)
        chunk = F.when(fits, acc["chunk"]).otherwise(acc["chunk"] + 1)
        return F.named_struct(F.lit("chunk"), chunk, F.lit("used"), F.when(fits, acc["used"] + n).otherwise(n), F.lit("out"), F.concat(acc["out"], F.array(chunk)))

    folded = group.withColumn("__chunks", F.aggregate("__rows", start, step)["out"])
    return folded.select(*keys, F.explode(F.arrays_zip("__rows", "__chunks")).alias("z")).select(*keys, F.col("z.__rows.o").alias(order), F.col("z.__rows.n").alias(length), F.col("z.__chunks").alias("chunk"))
