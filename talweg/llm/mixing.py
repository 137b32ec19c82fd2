"""Mixing sources to target weights by a time-varying curriculum.

Each source has a weight schedule over training time 0..1. Its integral gives
the source's token demand; documents of a source form a supply line in a fixed
shuffled order, repeated epoch after epoch, and the time at which cumulative
demand reaches a document's place in that line is its training position.
Sorting all taken documents by position (a range sort) gives the mix.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

WORD = r"[^\x20\x09-\x0D]+"
#: A schedule: (time, relative weight) knots from time 0 to time 1, linear in between.
Schedule = Sequence[tuple[float, float]]
FLAT: Schedule = ((0.0, 1.0), (1.0, 1.0))
#: Heavy sources fade out, middling ones stay, light ones come in late.
DEFAULT_SCHEDULES: tuple[Schedule, ...] = (((0.0, 1.5), (0.7, 1.0), (1.0, 0.4)), FLAT, ((0.0, 0.5), (0.6, 1.0), (1.0, 1.8)))

_SEGMENT = T.ArrayType(T.StructType([T.StructField(n, T.DoubleType()) for n in ("t0", "t1", "w0", "w1", "c0", "c1")]))


def water_fill(sizes: Sequence[int], weights: Sequence[float], total: float, cap: float) -> list[float]:
    """Shares of ``total`` by weight, none above ``cap`` times its size; excess goes to the others by weight."""
    order = sorted((i for i in range(len(sizes)) if weights[i] > 0), key=lambda i: (cap * sizes[i] / weights[i], i))
    capped, weight = 0.0, float(sum(weights))
    level = 0.0
    for i in order:
        level = (total - capped) / weight
        if weights[i] * level <= cap * sizes[i]:
            break
        capped += cap * sizes[i]
        weight -= weights[i]
        level = float("inf")
    return [min(w * level, cap * s) if w > 0 else 0.0 for s, w in zip(sizes, weights, strict=True)]


def segments(schedule: Schedule) -> list[tuple[float, ...]]:
    """Linear pieces of a schedule with its integral at both ends, scaled to 1 in all."""
    knots = [(float(t), float(w)) for t, w in schedule]
    if len(knots) < 2 or knots[0][0] != 0 or knots[-1][0] != 1 or any(a[0] >= b[0] for a, b in zip(knots, knots[1:], strict=False)) or any(w < 0 for _, w in knots):
        raise ValueError("a schedule runs from time 0 to time 1 with rising times and weights of 0 or more")
    areas = [(b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(knots, knots[1:], strict=False)]
    whole, at, out = sum(areas), 0.0, []
    if not whole > 0:
        raise ValueError("a schedule needs some weight")
    for (a, b), area in zip(zip(knots, knots[1:], strict=False), areas, strict=True):
        out.append((a[0], b[0], a[1] / whole, b[1] / whole, at, at + area / whole))
        at += area / whole
    return out


def invert(pieces: Column, share: Column) -> Column:
    """The time at which a schedule's integral reaches ``share`` (0..1)."""
    piece = F.coalesce(F.element_at(F.filter(pieces, lambda s: (s["c1"] > share) & (s["c1"] > s["c0"])), 1), F.element_at(pieces, -1))
    slope = (piece["w1"] - piece["w0"]) / (piece["t1"] - piece["t0"])
    rest = F.greatest(share - piece["c0"], F.lit(0.0))
    root = F.sqrt(F.greatest(piece["w0"] * piece["w0"] + 2 * slope * rest, F.lit(0.0)))
    # the stable form of the quadratic's root: no division by the slope
    return F.least(piece["t0"] + F.coalesce(F.try_divide(2 * rest, piece["w0"] + root), F.lit(0.0)), piece["t1"])


def mix_plan(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: Sequence[float] = (5, 2, 1),
    share: float = 1.5,
    max_epochs: float = 2.0,
    schedules: Sequence[Schedule] = DEFAULT_SCHEDULES,
    seed: str = "mix",
    docs_per_bucket: int = 5000,
) -> DataFrame:
    """One row per row of ``docs``: what the mix takes of it.

    Sources in code point order, null last, take ``weights`` and ``schedules``
    in turn. Columns: ``doc`` (the whole input row as a struct), ``size`` (words),
    ``source_size``, ``target``, ``copies`` and ``positions`` (training positions
    0..1, one per copy). A source's line is cut where its target is reached, at
    the nearer end of the document that straddles it.

    Null texts and texts without words have size 0 and take no room; a null
    source is a source of its own; repeated rows are documents of their own; an
    empty table gives an empty plan. Only source totals (a row per source) come
    to the driver. Running sums are taken in hash buckets of about
    ``docs_per_bucket`` documents, so a hot source is spread over many tasks.
    """
    row = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"),
        F.when(F.col(source_col).isNull(), "").otherwise(F.concat(F.lit("="), F.col(source_col).cast("string"))).alias("src"),
        F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.md5(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(seed))).alias("key"),
    )
    totals = sorted(row.groupBy("src").agg(F.sum("size").alias("size"), F.count("*").alias("n")).collect(), key=lambda r: (not r["src"], r["src"].encode()))
    spark = docs.sparkSession
    sizes = [r["size"] for r in totals]
    by = [float(weights[i % len(weights)]) for i in range(len(totals))]
    targets = water_fill(sizes, by, share * sum(sizes), max_epochs)
    info = spark.createDataFrame(
        [(r["src"], s, t, max(1, -(-r["n"] // docs_per_bucket)), segments(schedules[i % len(schedules)])) for i, (r, s, t) in enumerate(zip(totals, sizes, targets, strict=True))],
        T.StructType([T.StructField("of", T.StringType()), T.StructField("source_size", T.LongType()), T.StructField("target", T.DoubleType()), T.StructField("buckets", T.IntegerType()), T.StructField("pieces", _SEGMENT)]),
    )
    known = row.join(F.broadcast(info), F.col("src") == F.col("of"), "left").drop("of")  # the driver's own rows, one a source
    known = known.withColumn("bucket", F.expr("cast(floor(conv(substring(key, 1, 8), 16, 10) * buckets / 4294967296.0D) as int)"))
    sums = known.groupBy("src", "bucket").agg(F.sum("size").alias("held"))
    before = Window.partitionBy("src").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("src", "bucket", F.coalesce(F.sum("held").over(before), F.lit(0)).alias("ahead"))
    inner = Window.partitionBy("src", "bucket").orderBy("key", "size", F.xxhash64("doc")).rowsBetween(Window.unboundedPreceding, -1)
    lined = known.withColumn("within", F.coalesce(F.sum("size").over(inner), F.lit(0)))
    lined = lined.join(sums, ["src", "bucket"], "left")  # dealt by the window's keys, so texts don't move again
    start = F.col("ahead") + F.col("within")
    middle: Callable[[Column], Column] = lambda e: e * F.col("source_size") + start + F.col("size") / 2
    epochs = F.sequence(F.lit(0), F.lit(max(0, int(-(-max_epochs // 1)) - 1)))
    taken = F.filter(epochs, lambda e: middle(e) < F.col("target"))
    positions = F.transform(taken, lambda e: invert(F.col("pieces"), F.coalesce(F.try_divide((e * F.col("source_size") + start).cast("double"), F.col("target")), F.lit(0.0))))
    return lined.select("doc", "size", "source_size", "target", F.size(taken).cast("long").alias("copies"), positions.alias("positions"))


def ordered(plan: DataFrame, *, id_col: str = "doc_id") -> DataFrame:
    """``plan``'s documents range-sorted by their first training position, those that the mix leaves out last.

    Ties go by id (null first) and then by the row's hash, so that reruns agree.
    """
    by = [F.element_at("positions", 1).asc_nulls_last(), F.col("doc").getField(id_col).asc_nulls_first(), F.xxhash64("doc")]
    rows = plan.withColumn("positions", F.when(F.size("positions") > 0, F.col("positions")))
    return rows.repartitionByRange(*by).sortWithinPartitions(*by)


def mixed(plan: DataFrame, *, id_col: str = "doc_id") -> DataFrame:
    """The mix itself: the documents' own columns, repeated as taken, range-sorted by training position, then id, then the row's hash."""
    names = plan.schema["doc"].dataType.names
    by = [F.col("position"), F.col("doc").getField(id_col).asc_nulls_first(), F.xxhash64("doc")]
    rows = plan.select("doc", F.explode("positions").alias("position"))
    rows = rows.repartitionByRange(*by).sortWithinPartitions(*by)
    return rows.select(*[F.col("doc").getField(c).alias(c) for c in names])
