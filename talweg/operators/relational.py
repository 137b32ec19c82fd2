"""Joins, set operations, selections and keyed writes on DataFrames.

Column names are parameters throughout, so the same operator serves any table.
Equi-join keys come first and everything else is a residual predicate, so that
no operator falls back to a nested loop over all pairs.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def year_range(df: DataFrame, col: str, low: int | None, high: int | None) -> DataFrame:
    """Rows within optional bounds; a bound that isn't given leaves no predicate, rows without a value stay unless bounded."""
    if low is not None:
        df = df.filter(F.col(col) >= low)
    return df if high is None else df.filter(F.col(col) <= high)


def first_reason(reasons: Sequence[tuple[Column, str]]) -> Column:
    """The name of the first rule that holds (unknown counts as not), null for none."""
    out = F.when(F.lit(False), "")
    for rule, name in reasons:
        out = out.when(F.coalesce(rule, F.lit(False)), name)
    return out.otherwise(F.lit(None).cast("string"))


def excluded(df: DataFrame, reasons: Sequence[tuple[Column, str]]) -> tuple[DataFrame, DataFrame]:
    """(rows that no rule excludes, counts by the reason that excluded the others)."""
    told = df.withColumn("reason", first_reason(reasons))
    return told.filter("reason is null").drop("reason"), told.filter("reason is not null").groupBy("reason").agg(F.count("*").alias("n"))


def left_with_counts(df: DataFrame, key: str, *counted: tuple[DataFrame, str, str]) -> DataFrame:
    """``df`` with one count column for each (table, its key, name); rows without partners count 0.

    Each table is aggregated before the join.
    """
    for other, other_key, name in counted:
        n = other.groupBy(F.col(other_key).alias(f"__{name}")).agg(F.count("*").alias(name))
        df = df.join(n, F.col(key) == F.col(f"__{name}"), "left").drop(f"__{name}").withColumn(name, F.coalesce(name, F.lit(0)))
    return df


def histogram_of_counts(df: DataFrame, key: str, other: DataFrame, other_key: str) -> DataFrame:
    """(n, keys): how many keys of ``df`` have n rows in ``other``, zeroes too."""
    return left_with_counts(df.select(key).distinct(), key, (other, other_key, "n")).groupBy("n").agg(F.count("*").alias("keys"))


def unreferenced(df: DataFrame, key: str, *others: tuple[DataFrame, str]) -> DataFrame:
    """Rows whose key none of the other tables holds."""
    return reduce(lambda left, o: left.join(o[0].select(F.col(o[1]).alias(key)), key, "left_anti"), others, df)


def banded_pairs(df: DataFrame, id_col: str, keys: Sequence[str], on: str, slack: float) -> DataFrame:
    """(a, b) with a < b, equal keys and values of ``on`` within ``slack``.

    Rows go to the band of their value and to both neighbours' bands, so that a
    hash join on (keys, band) finds every pair once.
    """
    width = float(slack) if slack > 0 else 1.0
    left = df.select(*keys, F.col(id_col).alias("a"), F.col(on).cast("double").alias("va"), F.floor(F.col(on) / width).alias("band"))
    right = df.select(*keys, F.col(id_col).alias("b"), F.col(on).cast("double").alias("vb"), F.explode(F.sequence(F.floor(F.col(on) / width) - 1, F.floor(F.col(on) / width) + 1)).alias("band"))
    return left.join(right, [*keys, "band"]).filter((F.col("a") < F.col("b")) & (F.abs(F.col("va") - F.col("vb")) <= slack)).select(*keys, "a", "b")


def overlapping_pairs(df: DataFrame, id_col: str, keys: Sequence[str], low: str, high: str) -> DataFrame:
    """(a, b) with a < b, equal keys and half-open ranges that overlap; a missing end is compatible with anything."""
    left, right = (df.select(*keys, F.col(id_col).alias(n), F.col(low).alias(f"{n}_low"), F.col(high).alias(f"{n}_high")) for n in ("a", "b"))
    meets = F.coalesce((F.col("a_low") < F.col("b_high")) & (F.col("b_low") < F.col("a_high")), F.lit(True))
    return left.join(right, list(keys)).filter((F.col("a") < F.col("b")) & meets).select(*keys, "a", "b")


#: Rows of one key value that meet all others of it in one piece of work.
SLICE_ROWS = 2048


def either_key_pairs(df: DataFrame, id_col: str, keys: Sequence[str]) -> DataFrame:
    """(a, b) with a < b that agree in at least one key: an equi-join for each key, of pairs that no earlier key gives.

    So pairs need no shuffle to be told apart. A value of many rows is dealt in
    slices of ``SLICE_ROWS``, which meet all of its rows in tasks of their own.
    Ids of several rows are few as a rule; theirs alone are made distinct.
    """
    context = df.sparkSession.sparkContext
    tasks = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 4 * context.defaultParallelism)
    names = [f"k{i}" for i in range(len(keys))]
    rows = df.select(F.col(id_col).alias("id"), *[F.col(k).alias(n) for k, n in zip(keys, names, strict=True)]).filter("id is not null").distinct()
    told = rows.groupBy("id").agg(F.count("*").alias("n"), *[F.first(n).alias(n) for n in names])
    once = told.filter("n = 1").drop("n")
    pairs = []
    for i, k in enumerate(names):
        held = once.filter(F.col(k).isNotNull())
        slices = held.groupBy(k).agg(F.ceil(F.count("*") / SLICE_ROWS).cast("int").alias("slices"))
        held = held.join(slices, k)
        left = held.select(k, F.pmod(F.xxhash64("id"), F.col("slices")).cast("int").alias("slice"), F.col("id").alias("a"), *[F.col(n).alias(f"a_{n}") for n in names[:i]])
        right = held.select(k, F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"), F.col("id").alias("b"), *[F.col(n).alias(f"b_{n}") for n in names[:i]])
        # dealt to a number of tasks that AQE keeps: what is read is small, what comes of it isn't
        met = left.repartition(tasks, k, "slice").hint("shuffle_hash").join(right.repartition(tasks, k, "slice"), [k, "slice"]).filter("a < b")
        pairs.append(reduce(lambda m, n: m.filter(~F.coalesce(F.col(f"a_{n}") == F.col(f"b_{n}"), F.lit(False))), names[:i], met).select("a", "b"))
    several = rows.join(told.filter("n > 1").select("id"), "id", "left_semi")
    ends = [several.select(k, F.col("id").alias("x")).dropna().join(rows.select(k, F.col("id").alias("y")).dropna(), k).filter("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")) for k in names]
    return reduce(DataFrame.union, [*pairs, reduce(DataFrame.union, ends).distinct()])


def opponent_edges(df: DataFrame, event: str, side: str, actor: str) -> DataFrame:
    """(low, high): distinct pairs of actors that stood on different sides of one event."""
    left = df.select(event, F.col(side).alias("sa"), F.col(actor).alias("x"))
    right = df.select(event, F.col(side).alias("sb"), F.col(actor).alias("y"))
    return left.join(right, event).filter((F.col("sa") < F.col("sb")) & (F.col("x") != F.col("y"))).select(F.least("x", "y").alias("low"), F.greatest("x", "y").alias("high")).distinct()


def pairs_of_two(df: DataFrame, event: str, side: str, value: str) -> DataFrame:
    """Events with exactly two sides that have a value: (event, value_a, value_b), a being the smaller side."""
    known = df.filter(F.col(value).isNotNull()).groupBy(event).agg(F.count("*").alias("n"), F.min_by(value, side).alias("value_a"), F.max_by(value, side).alias("value_b"))
    return known.filter("n = 2").drop("n")


def own_minus_other(df: DataFrame, event: str, side: str, value: str) -> DataFrame:
    """Each side's value less that of the other side, in events with two sides."""
    w = Window.partitionBy(event).orderBy(side)
    other = F.coalesce(F.lead(value).over(w), F.lag(value).over(w))
    return df.withColumn("__n", F.count("*").over(Window.partitionBy(event))).withColumn("difference", F.col(value) - other).filter("__n = 2").select(event, side, "difference")


def tokens_contained(a: Column, b: Column) -> Column:
    """Whether the tokens of one label all occur in the other; empty labels match nothing."""
    x, y = (F.array_distinct(F.filter(F.split(v, " "), lambda t: t != "")) for v in (a, b))
    return (F.size(x) > 0) & (F.size(y) > 0) & ((F.size(F.array_except(x, y)) == 0) | (F.size(F.array_except(y, x)) == 0))


def two_step_lookup(df: DataFrame, table: DataFrame, first: tuple[str, str], second: tuple[str, str], value: str) -> DataFrame:
    """``df`` with ``value`` looked up by a first key and, failing that, by a second one that is unambiguous in the table."""
    one = table.select(F.col(first[1]).alias("__k1"), F.col(value).alias("__v1")).dropna().groupBy("__k1").agg(F.min("__v1").alias("__v1"))
    two = table.select(F.col(second[1]).alias("__k2"), F.col(value).alias("__v2")).dropna().groupBy("__k2").agg(F.min("__v2").alias("__v2"), F.count_distinct("__v2").alias("__n")).filter("__n = 1").drop("__n")
    found = df.join(one, F.col(first[0]) == F.col("__k1"), "left").join(two, F.col(second[0]) == F.col("__k2"), "left")
    return found.withColumn(value, F.coalesce("__v1", "__v2")).drop("__k1", "__v1", "__k2", "__v2")


def top_set_overlap(a: DataFrame, b: DataFrame, id_col: str, score: str, n: int) -> DataFrame:
    """One row: sizes of intersection, union and both differences of the two top-n sets, and their Jaccard index."""
    tops = [df.orderBy(F.desc(score), F.asc(id_col)).limit(n).select(F.col(id_col).alias("id")) for df in (a, b)]
    both = tops[0].withColumn("a", F.lit(1)).join(tops[1].withColumn("b", F.lit(1)), "id", "full_outer")
    counts = [F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("shared"), F.count("*").alias("either"), F.count_if(F.col("b").isNull()).alias("only_a"), F.count_if(F.col("a").isNull()).alias("only_b")]
    return both.agg(*counts).withColumn("jaccard", F.try_divide("shared", "either"))


def differing_counts(a: DataFrame, b: DataFrame, key: str, n: str) -> DataFrame:
    """Keys whose counts in two tables differ, a missing one included."""
    left, right = a.select(key, F.col(n).alias("count_a")), b.select(key, F.col(n).alias("count_b"))
    return left.join(right, key, "full_outer").filter(~F.col("count_a").eqNullSafe(F.col("count_b")))


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str], update: Mapping[str, str] | None = None) -> DataFrame:
    """``old`` with the rows of ``new`` inserted or updated by key.

    ``update`` says for each column what an update does: "new" overwrites (the
    default), "old" keeps, "fill" takes the new value only where the old is
    null, "prefer" takes it unless it is null. Running it twice changes nothing.
    """
    update = update or {}
    rest = [c for c in old.columns if c not in keys]
    left = old.select(*keys, F.lit(True).alias("__old"), *[F.col(c).alias(f"__o_{c}") for c in rest])
    right = new.select(*keys, F.lit(True).alias("__new"), *[F.col(c).alias(f"__n_{c}") for c in rest])
    joined = left.join(right, list(keys), "full_outer")

    def merged(c: str) -> Column:
        o, n = F.col(f"__o_{c}"), F.col(f"__n_{c}")
        both = {"new": n, "old": o, "fill": F.coalesce(o, n), "prefer": F.coalesce(n, o)}[update.get(c, "new")]
        return F.when(F.col("__old").isNull(), n).when(F.col("__new").isNull(), o).otherwise(both).alias(c)

    return joined.select(*keys, *[merged(c) for c in rest])


def insert_missing(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``old`` and those rows of ``new`` whose key it lacks."""
    return old.unionByName(new.join(old.select(*keys), list(keys), "left_anti"))


def replace_owned(old: DataFrame, new: DataFrame, owned: Column) -> DataFrame:
    """``old`` with its owned rows replaced by ``new``; foreign rows and unknown owners stay."""
    return old.filter(~F.coalesce(owned, F.lit(False))).unionByName(new)


def remove_stale(old: DataFrame, written: DataFrame, keys: Sequence[str], protected: Column | None = None) -> DataFrame:
    """``old`` without rows that this run didn't write; protected rows stay, and an empty run removes nothing."""
    run = F.lit(False) if protected is None else F.coalesce(protected, F.lit(False))
    told = old.withColumn("__protected", run)
    some = written.select(F.lit(1).alias("__any")).limit(1)
    kept = told.join(written.select(*keys).distinct().withColumn("__written", F.lit(True)), list(keys), "left")
    kept = kept.join(some, F.lit(True), "left")  # one row at most
    return kept.filter(F.col("__any").isNull() | F.col("__protected") | F.col("__written").isNotNull()).select(*old.columns)


def cached_answers(requests: DataFrame, log: DataFrame, key: str, ok: Column, order: str, value: str) -> DataFrame:
    """Requests with the latest good answer of an audit log by hash; null where it has to be asked for."""
    last = log.filter(ok).groupBy(F.col(key)).agg(F.max_by(value, order).alias(value))
    return requests.join(last, key, "left")


def chunked(df: DataFrame, key: str, groups: Sequence[str], order: str, size: int) -> DataFrame:
    """Rows distinct by key (the first in order stays), numbered in chunks of ``size`` within each group."""
    first = df.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(order))).filter("__n = 1").drop("__n")
    return first.withColumn("chunk", F.floor((F.row_number().over(Window.partitionBy(*groups).orderBy(order, key)) - 1) / size).cast("long"))
