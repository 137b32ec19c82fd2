"""Operators behind reports and inspection: queues, spreads, sweeps, merges and gaps."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def ranks_in_gaps(listed: DataFrame, unlisted: DataFrame, rank: str) -> DataFrame:
    """One row, n: unlisted ranks within the range of the listed ones; 0 where nothing is listed or ranked."""
    span = listed.agg(F.min(rank).alias("__low"), F.max(rank).alias("__high"))  # one row
    return unlisted.join(F.broadcast(span), F.col(rank).between(F.col("__low"), F.col("__high"))).agg(F.count("*").alias("n"))


def round_spread(rounds: DataFrame, key: str, round_col: str, value: str, imputed: Column, most: int) -> DataFrame:
    """(key, rounds, sd): spread between rounds of imputed values, the ``most`` widest (a report's limit), ties by key."""
    per = rounds.filter(imputed).groupBy(key).agg(F.countDistinct(round_col).alias("rounds"), F.stddev_samp(value).alias("sd"))
    return per.filter("rounds > 1").orderBy(F.desc("sd"), key).limit(most)


def two_histograms(df: DataFrame, value: str, imputed: Column, width: float) -> DataFrame:
    """(kind, bin, n): counts of observed and imputed values in bins of one width; null values don't count."""
    kind = F.when(imputed, "imputed").otherwise("observed")
    return df.filter(F.col(value).isNotNull()).groupBy(kind.alias("kind"), (F.floor(F.col(value) / width) * width).alias("bin")).agg(F.count("*").alias("n"))


def reported_and_estimated(reports: DataFrame, estimates: DataFrame, key: str, value: str, estimate: str) -> DataFrame:
    """(key, reported, estimate) of each estimated row with the mean of its reports; null without any."""
    mean = reports.groupBy(key).agg(F.avg(value).alias("reported"))
    return estimates.select(key, F.col(estimate).alias("estimate")).join(mean, key, "left").select(key, "reported", "estimate")


def sweep(cases: DataFrame, score: str, margin: str, truth: Column, scores: Sequence[float], margins: Sequence[float]) -> DataFrame:
    """(min_score, min_margin, linked, right, precision, recall) for each pair of limits.

    A case is linked when its score and its margin (null: no runner-up) reach
    the limits. The grid is written into every row, so that cases are read once.
    """
    grid = F.array(*[F.struct(F.lit(float(s)).alias("min_score"), F.lit(float(m)).alias("min_margin")) for s in scores for m in margins])
    told = cases.select(F.col(score).alias("__s"), F.col(margin).alias("__m"), F.coalesce(truth, F.lit(False)).alias("__t"), F.explode(grid).alias("__g"))
    linked = F.coalesce((F.col("__s") >= F.col("__g.min_score")) & F.coalesce(F.col("__m") >= F.col("__g.min_margin"), F.lit(True)), F.lit(False))
    counts = told.groupBy(F.col("__g.min_score").alias("min_score"), F.col("__g.min_margin").alias("min_margin")).agg(
        F.count_if(linked).alias("linked"), F.count_if(linked & F.col("__t")).alias("right"), F.count_if("__t").alias("__true")
    )
    none = F.lit(0)
    return counts.withColumn("precision", F.try_divide("right", F.nullif("linked", none))).withColumn("recall", F.try_divide("right", F.nullif("__true", none))).drop("__true")


def merged_tags(df: DataFrame, key: str, priority: Column, tie: str, tags: str) -> DataFrame:
    """(key, tags): all tags of a key's rows by priority, then ``tie``, then place; of those that differ in case only the first stays."""
    rows = df.select(key, F.struct((-priority).alias("p"), F.col(tie).alias("t")).alias("__o"), F.posexplode(tags).alias("__i", "__tag")).filter(F.trim("__tag") != "")
    first = rows.groupBy(key, F.lower(F.trim("__tag")).alias("__low")).agg(F.min(F.struct("__o", "__i", F.trim("__tag").alias("tag"))).alias("__first"))
    return first.groupBy(key).agg(F.transform(F.array_sort(F.collect_list("__first")), lambda x: x["tag"]).alias("tags"))


def merged_notes(*groups: Column) -> Column:
    """Notes of several arrays in order, without blanks and repeats; a null array has none."""
    empty = F.expr("cast(array() as array<string>)")
    return F.array_distinct(F.filter(F.concat(*[F.coalesce(g, empty) for g in groups]), lambda x: F.trim(x) != ""))


def query_names(forms: DataFrame, key: str, form: str, k: int) -> DataFrame:
    """(key, names): up to k distinct forms of each key (a query's limit), commonest first, then longest, then in order."""
    counts = forms.filter(F.trim(form) != "").groupBy(key, form).agg(F.count("*").alias("__n"))
    order = F.struct((-F.col("__n")).alias("n"), (-F.length(form)).alias("l"), F.col(form).alias("f"))
    return counts.groupBy(key).agg(F.transform(F.slice(F.array_sort(F.collect_list(order)), 1, k), lambda x: x["f"]).alias("names"))


def superseded(df: DataFrame, keys: Sequence[str], is_override: Column) -> DataFrame:
    """Rows that no curated row of their group replaces: groups with curated rows keep these alone."""
    flag = F.coalesce(is_override, F.lit(False))
    return df.withColumn("__own", flag).withColumn("__any", F.max("__own").over(Window.partitionBy(*keys))).filter("__own or not __any").drop("__own", "__any")


def outcomes(sides: DataFrame, event: str, is_winner: Column, level: str, mirror: Mapping[str, str], given: str | None = None) -> DataFrame:
    """``sides`` with ``outcome``: the event's level for its only winner and the mirrored level for the others.

    An indecisive event gives every side "indecisive" where none is ``given``;
    no winner or several, and events without a level, leave what is given.
    """
    winner = F.coalesce(is_winner, F.lit(False))
    told = sides.withColumn("__w", winner).withColumn("__n", F.sum(F.col("__w").cast("int")).over(Window.partitionBy(event)))
    had = F.col(given) if given else F.lit(None).cast("string")
    other = F.element_at(F.create_map(*[F.lit(x) for pair in mirror.items() for x in pair]), F.col(level))
    out = F.when(F.col(level) == "indecisive", F.coalesce(had, F.lit("indecisive"))).when(F.col(level).isNotNull() & (F.col("__n") == 1), F.when(F.col("__w"), F.col(level)).otherwise(other)).otherwise(had)
    return told.withColumn("outcome", out).drop("__w", "__n")


def missing_fields(df: DataFrame, keys: Sequence[str], notes: Mapping[str, str]) -> DataFrame:
    """(keys, field, note): a row for each field that a row lacks; blank texts count as lacking."""
    lacking = [F.when(F.col(c).isNull() | (F.trim(F.col(c).cast("string")) == ""), F.struct(F.lit(c).alias("field"), F.lit(n).alias("note"))) for c, n in notes.items()]
    found = F.filter(F.array(*lacking), lambda x: x.isNotNull())
    return df.select(*keys, F.explode(found).alias("__x")).select(*keys, "__x.field", "__x.note")


def mostly(texts: DataFrame, key: str, text: str, pattern: str) -> DataFrame:
    """(key, hits, all, mostly): distinct trimmed texts of each key that match, and whether they are half or more, and any."""
    rows = texts.select(key, F.trim(text).alias("__t")).filter("__t <> ''").distinct()
    out = rows.groupBy(key).agg(F.count_if(F.regexp_like("__t", F.lit(pattern))).alias("hits"), F.count("*").alias("all"))
    return out.withColumn("mostly", (F.col("hits") > 0) & (2 * F.col("hits") >= F.col("all")))


def larger_wins(events: DataFrame, difference: Column, won: Column) -> DataFrame:
    """One row (n, accuracy): how often the larger side won where difference and result are known; equal sides count half."""
    known = events.select(difference.alias("__x"), won.alias("__w")).filter(F.col("__w").isNotNull() & F.col("__x").isNotNull() & ~F.isnan(F.col("__x").cast("double")))
    credit = F.when(F.col("__x") == 0, 0.5).otherwise(((F.col("__x") > 0) == F.col("__w")).cast("double"))
    return known.agg(F.count("*").alias("n"), F.avg(credit).alias("accuracy"))


def weighted_means(df: DataFrame, keys: Sequence[str], value: str, precision: str) -> DataFrame:
    """(keys, n, mean, weight): precision-weighted mean of each group; null where its precisions sum to 0."""
    fine = df.filter(F.col(value).isNotNull() & F.col(precision).isNotNull())
    sums = fine.groupBy(*keys).agg(F.count("*").alias("n"), F.sum(F.col(value) * F.col(precision)).alias("__s"), F.sum(precision).alias("weight"))
    return sums.select(*keys, "n", F.try_divide("__s", F.nullif("weight", F.lit(0.0))).alias("mean"), "weight")


def review_queue(df: DataFrame, confidence: str, role: str, id_col: str, below: float = 0.5) -> DataFrame:
    """Rows to look at: confidence below a limit, or an unknown role; least sure first (null first), then by id."""
    return df.filter(F.coalesce(F.col(confidence) < below, F.lit(False)) | (F.col(role) == "unknown")).orderBy(F.asc_nulls_first(confidence), id_col)


def needs_value(df: DataFrame, value: str, source: str, rules: str, manual: str = "manual") -> DataFrame:
    """Rows whose value is unknown or set by the rules, and never by hand; a null source is neither."""
    return df.filter((F.col(value).isNull() | (F.col(value) == "unknown") | F.col(source).eqNullSafe(rules)) & ~F.col(source).eqNullSafe(manual))


def filled_gaps(gaps: DataFrame, rows: DataFrame, key: str, field: str, fields: Sequence[str]) -> DataFrame:
    """Gap rows whose field has a value by now."""
    held = rows.select(F.col(key).alias("__k"), F.array_compact(F.array(*[F.when(F.col(c).isNotNull(), F.lit(c)) for c in fields])).alias("__has"))
    return gaps.join(held, F.col(key) == F.col("__k")).filter(F.array_contains("__has", F.col(field))).drop("__k", "__has")


def cleared(df: DataFrame, fitted: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """``df`` with fitted columns set to null in rows that the fit didn't have."""
    told = df.join(fitted.select(key).distinct().withColumn("__in", F.lit(True)), key, "left")
    return told.select(*[F.when(F.col("__in"), F.col(c)).alias(c) if c in columns else F.col(c) for c in df.columns])


def retired(parents: DataFrame, children: DataFrame, gone: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Parents without the retired ones, and children whose reference to one is null."""
    ids = gone.select(F.col(key).alias("__gone")).dropna().distinct()
    kept = parents.join(ids, F.col(key) == F.col("__gone"), "left_anti")
    told = children.join(ids, F.col(key) == F.col("__gone"), "left")
    return kept, told.select(*[F.when(F.col("__gone").isNull(), F.col(c)).alias(c) if c == key else F.col(c) for c in children.columns])
