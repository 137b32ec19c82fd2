"""Resolving surface names to identities: candidates, decisions, careers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from talweg.functions import text
from talweg.functions.maths import fuzzy_confidence
from talweg.operators import graph, windows


def key_groups(mentions: DataFrame, id_col: str, keys: str) -> DataFrame:
    """(id, group): mentions that share any key, directly or through others, are one group named by its smallest id.

    Grouping is by connected components, so it doesn't depend on row order.
    """
    by_key = mentions.select(F.col(id_col).alias("b"), F.explode(keys).alias("k"))
    first = by_key.groupBy("k").agg(F.min("b").alias("a"))
    found = graph.components(by_key.join(first, "k").select("a", "b"))
    alone = mentions.select(F.col(id_col).alias("node")).distinct()
    return alone.join(found, "node", "left").select(F.col("node").alias(id_col), F.coalesce("component", "node").alias("group"))


def within_window(years: Column, low: Column, high: Column) -> Column:
    """Whether any of the years lies in a window; null (which abstains) without years or window."""
    known = F.size(years) > 0
    return F.when(low.isNull() | high.isNull() | ~known, F.lit(None).cast("boolean")).otherwise(F.exists(years, lambda y: y.between(low, high)))


def decisions(pairs: DataFrame, group: str, candidate: str, exact: Column, dated: Column, score: Column, bonus: Column, threshold: float = 85, margin: float = 6, floor: float = 70) -> DataFrame:
    """One decision per group over its candidates: verdict, candidate and confidence.

    Candidates whose dates contradict (``dated`` false) go; none left is "new"
    (0.6). One exact match, or the only date-confirmed one of several, is
    "linked" (0.95); several are "ambiguous". A score of ``threshold`` with
    enough margin to the runner-up is "linked" by score; a smaller margin or a
    score of ``floor`` is "ambiguous"; anything else is "new".
    """
    told = pairs.withColumn("__exact", F.coalesce(exact, F.lit(False))).withColumn("__dated", dated).withColumn("__raw", score).withColumn("__score", score + bonus)
    every = told.select(group).distinct()
    live = told.filter(F.coalesce(F.col("__dated"), F.lit(True)))
    sure = F.col("__exact") & F.coalesce(F.col("__dated"), F.lit(False))
    facts = live.groupBy(group).agg(
        F.count_if("__exact").alias("exacts"), F.min(F.when(F.col("__exact"), F.col(candidate))).alias("exact_id"), F.count_if(sure).alias("sures"), F.min(F.when(sure, F.col(candidate))).alias("sure_id")
    )
    best = windows.top_two_margin(live, [group], candidate, "__score", "__raw").select(group, F.col(candidate).alias("best_id"), F.col("__raw").alias("best"), "margin")
    j = every.join(facts, group, "left").join(best, group, "left")
    one = (F.col("exacts") == 1) | ((F.col("exacts") > 1) & (F.col("sures") == 1))
    apart = F.coalesce(F.col("margin") >= margin, F.lit(True))
    verdict = (
        F.when(F.col("best_id").isNull(), "new").when(one, "linked").when(F.col("exacts") > 1, "ambiguous").when((F.col("best") >= threshold) & apart, "linked").when(F.col("best") >= floor, "ambiguous").otherwise("new")
    )
    chosen = F.when(one, F.when(F.col("exacts") == 1, F.col("exact_id")).otherwise(F.col("sure_id"))).when((F.col("exacts") == 0) & (F.col("best") >= threshold) & apart, F.col("best_id"))
    confidence = F.when(one, 0.95).when(verdict == "linked", fuzzy_confidence(F.col("best"), threshold)).when(verdict == "new", 0.6)
    return j.select(group, verdict.alias("verdict"), chosen.alias(candidate), confidence.alias("confidence"))


def display_name(mentions: DataFrame, group: str, form: str, title_free: Column) -> DataFrame:
    """The best surface form of each group: without a title, then the commonest, longest and last in order."""
    n = mentions.groupBy(group, form).agg(F.count("*").alias("n"), F.max(title_free).alias("f"))
    return n.groupBy(group).agg(F.max_by(form, F.struct(F.col("f"), F.col("n"), F.length(form).alias("l"), F.col(form).alias("t"))).alias(form))


def career_sessions(mentions: DataFrame, group: str, year: str, id_col: str, gap: int = 60) -> DataFrame:
    """Mentions with the number of the career they belong to: careers of one name lie over ``gap`` years apart."""
    return windows.sessions(mentions, [group], year, gap, id_col)


def detach_outside(mentions: DataFrame, year: str, low: str, high: str) -> DataFrame:
    """``mentions`` with ``outside``: dated beyond the candidate's window (undated ones stay inside)."""
    return mentions.withColumn("outside", F.coalesce(~F.col(year).between(F.col(low), F.col(high)), F.lit(False)))


def unlogged(items: DataFrame, log: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Items that the log doesn't hold yet."""
    return items.join(log.select(*keys).distinct(), list(keys), "left_anti")


def covers(mention: Column, target: Column) -> Column:
    """Whether every token of a mention is a token of the target, or the initial of one."""
    tokens, full = F.split(mention, " "), F.split(target, " ")
    return (mention != "") & F.forall(tokens, lambda a: F.exists(full, lambda b: (a == b) | ((F.length(a) == 1) & F.startswith(b, a))))


def similar_pairs(df: DataFrame, id_col: str, name: str, block: Sequence[str], least: float) -> DataFrame:
    """(a, b, score) with a < b of one block whose names reach a similarity.

    Distinct names of a block are compared, each pair once and only as far as
    ``least`` allows; rows meet through the pairs of names that reach it.
    """
    keys = [f"__{i}" for i in range(len(block))]
    rows = df.select(*[F.col(c).alias(k) for c, k in zip(block, keys, strict=True)], F.col(id_col).alias("id"), F.col(name).alias("x")).filter(F.col("x").isNotNull())
    names = rows.select(*keys, "x").distinct()
    both = names.join(names.withColumnRenamed("x", "y"), keys).filter("x <= y")
    edits = (F.greatest(F.length("x"), F.length("y")) * (1 - least / 100) + 1).cast("int")  # one more than any pair that reaches ``least`` has
    near = both.withColumn("__edits", edits).filter("levenshtein(x, y, __edits) >= 0").withColumn("score", text.levenshtein_ratio(F.col("x"), F.col("y"))).filter(F.col("score") >= least)
    met = near.join(rows.withColumnRenamed("id", "a"), [*keys, "x"]).join(rows.select(*keys, F.col("id").alias("b"), F.col("x").alias("y")), [*keys, "y"])
    return met.filter("x < y and a <> b or a < b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "score")


def first_rows(df: DataFrame, group: str, n: int, *order: Column) -> DataFrame:
    """The first n rows of each group in order, numbered from 1 (a prompt's candidates)."""
    return df.withColumn("place", F.row_number().over(Window.partitionBy(group).orderBy(*order))).filter(F.col("place") <= n)
