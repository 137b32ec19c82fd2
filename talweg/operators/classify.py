"""Rule classification of events by title, categories, branches and text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from talweg.operators.relational import first_reason

#: Words that mark a title as an engagement, a wider conflict, or a conquest.
ENGAGEMENT = r"\b(battle|siege|skirmish|raid)\b"
WIDER = r"\b(war|wars|crisis|campaign|campaigns)\b"
CONQUEST = r"\b(invasion|conquest) of\b"


def campaign_reason(title: Column, span_days: Column, precision: Column) -> Column:
    """Why an event is a campaign rather than a battle; null for a battle.

    In order: a date known to the decade or century only; a title without an
    engagement word that names an operation, a wider conflict, or a conquest; a
    siege of over 730 days; any other event of over 180 days whose title doesn't
    begin "Battle of" or "Siege of".
    """
    low = F.lower(title)
    plain = ~F.regexp_like(low, F.lit(ENGAGEMENT))
    return first_reason(
        [
            (precision.isin("decade", "century"), "date_precision"), (plain & F.regexp_like(low, F.lit(r"^operation\b")), "operation"), (plain & F.regexp_like(low, F.lit(WIDER)), "wider_conflict"), (plain & F.regexp_like(low, F.lit(CONQUEST)), "conquest"),
            (F.regexp_like(low, F.lit(r"\bsiege\b")) & (span_days > 730), "long_siege"), (~F.regexp_like(low, F.lit(r"^(battle|siege) of\b")) & (span_days > 180), "long_span"),
        ]
    )


def event_type(title: Column, categories: Column, branches: Column, article: Column, campaign: Column, ship_strengths: Column, strengths: Column) -> Column:
    """The kind of an event by the first rule that holds; ``categories`` and ``branches`` are arrays of lower-case labels.

    Campaign, siege (title, then category), amphibious (branches, then text),
    naval (category, unless land is named more), aerial without land, naval
    branches alone, strengths mostly of ships, guerrilla; then a field battle
    if there is an article, else unknown.
    """
    has = lambda a, word: F.coalesce(F.exists(a, lambda x: F.contains(x, F.lit(word))), F.lit(False))
    text = F.lower(F.coalesce(article, F.lit("")))
    count = lambda pattern: F.regexp_count(text, F.lit(pattern))
    land = F.coalesce(F.exists(branches, lambda b: b.isin("infantry", "cavalry", "artillery")), F.lit(False))
    naval, air = has(branches, "naval"), has(branches, "air")
    reason = first_reason(
        [
            (campaign.isNotNull(), "campaign"), (F.regexp_like(F.lower(title), F.lit(r"^siege\b")), "siege"), (has(categories, "siege"), "siege"), (naval & land & (count(r"\blanding") > 0), "amphibious"), (count(r"\bamphibious (assault|landing|operation)") > 0, "amphibious"),
            (has(categories, "naval") & (count(r"\b(ship|fleet|vessel)s?\b") >= count(r"\b(infantry|cavalry)\b")), "naval"), (has(categories, "aerial") & ~land, "aerial"), (naval & ~land & ~air, "naval"), (ship_strengths * 2 >= F.greatest(strengths, F.lit(1)), "naval"),
            (count(r"\bguerrilla\b") >= 3, "guerrilla"), (article.isNotNull() & (text != ""), "field"),
        ]
    )
    return F.coalesce(reason, F.lit("unknown"))


def besieged_place(title: Column) -> Column:
    """The place in "Siege of X (...)", null for other titles."""
    return F.nullif(F.trim(F.regexp_extract(title, r"(?i)^siege of ([^(,]+)", 1)), F.lit(""))


def siege_defender(sides: DataFrame, event: str, side: str, label: str, title: str) -> DataFrame:
    """(event, side): the one of exactly two sides that names the besieged place."""
    w = Window.partitionBy(event)
    place = F.lower(besieged_place(F.col(title)))
    told = sides.withColumn("__n", F.count("*").over(w)).withColumn("__hit", F.coalesce((place != "") & F.contains(F.lower(label), place), F.lit(False)))
    return told.withColumn("__hits", F.count_if("__hit").over(w)).filter("__n = 2 and __hits = 1 and __hit").select(event, side)


def excerpt(passages: DataFrame, event: str, order: str, text: str, names: Column, most: int) -> DataFrame:
    """Passages that name one of ``names``, in order, cut at ``most`` characters; all from the top where none does."""
    w = Window.partitionBy(event)
    hit = F.coalesce(F.exists(names, lambda n: (n != "") & F.contains(F.lower(text), F.lower(n))), F.lit(False))
    told = passages.withColumn("__hit", hit).withColumn("__any", F.max(hit).over(w)).filter(F.col("__hit") | ~F.col("__any"))
    ahead = F.coalesce(F.sum(F.length(text)).over(w.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    kept = told.withColumn("__ahead", ahead).filter(F.col("__ahead") < most)
    return kept.withColumn(text, F.substring(F.col(text), F.lit(1), (F.lit(most) - F.col("__ahead")).cast("int"))).drop("__hit", "__any", "__ahead")
