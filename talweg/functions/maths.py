"""Numeric, date and era functions: Column in, Column out."""

from __future__ import annotations

from collections.abc import Sequence
from statistics import NormalDist

from pyspark.sql import Column
from pyspark.sql import functions as F


def safe_ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is 0."""
    return F.try_divide(a, b)


def floor_bin(value: Column, width: float) -> Column:
    """The lower end of the bin of ``width`` that holds a value; negative values bin downwards too."""
    return (F.floor(value / F.lit(float(width))) * int(width)).cast("long")


def roundness(value: Column) -> Column:
    """Trailing zeros over digits less one, of the rounded magnitude; 0 for one digit or no finite number."""
    whole = F.round(F.abs(value)).cast("decimal(38,0)").cast("string")
    zeros = F.length(whole) - F.length(F.rtrim(whole, F.lit("0")))
    fine = value.isNotNull() & ~F.isnan(value.cast("double")) & (F.abs(value.cast("double")) < 1e18)
    return F.when(fine & (F.length(whole) > 1), F.least(zeros, F.length(whole) - 1) / (F.length(whole) - 1)).otherwise(F.lit(0.0))


def values_agree(a: Column, b: Column, tolerance: float) -> Column:
    """Whether two values lie within a relative tolerance."""
    return F.abs(a - b) / F.greatest(F.abs(a), F.abs(b), F.lit(1e-9)) <= tolerance


def flag_before(year: Column, cutoff: int) -> Column:
    """1.0 before the cutoff, 0.0 from it on, null for no year."""
    return (year < cutoff).cast("double")


def right_open_bin(year: Column, edges: Sequence[int]) -> Column:
    """0 below the first edge, 1 from it on, and so on; the number of edges plus 1 for no year."""
    out = F.when(year.isNull(), len(edges) + 1)
    for i, e in enumerate(edges):
        out = out.when(year < e, i)
    return out.otherwise(len(edges))


def named_era(year: Column, eras: Sequence[tuple[int, str]], last: str, undated: str) -> Column:
    """The name of the first era whose (exclusive) end lies above the year."""
    out = F.when(year.isNull(), undated)
    for end, name in eras:
        out = out.when(year < end, name)
    return out.otherwise(last)


def widen(low: Column, high: Column, margin_low: float, margin_high: float) -> Column:
    """struct(low, high) widened on the log scale."""
    return F.struct(F.exp(F.log(low) - margin_low).alias("low"), F.exp(F.log(high) + margin_high).alias("high"))


def wilson(successes: Column, n: Column, z: float = 1.959963984540054) -> Column:
    """struct(low, high) of the Wilson score interval; nulls for n = 0."""
    p = F.try_divide(successes.cast("double"), n)
    mid = F.try_divide(p + z * z / (2 * n), 1 + z * z / n)
    half = F.try_divide(z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)), 1 + z * z / n)
    fine = n > 0
    return F.struct(F.when(fine, mid - half).alias("low"), F.when(fine, mid + half).alias("high"))


def overlap_share(a_low: Column, a_high: Column, b_low: Column, b_high: Column) -> Column:
    """Overlap of two intervals over the narrower width; an interval without width counts 1 inside the other, 0 outside."""
    shared = F.least(a_high, b_high) - F.greatest(a_low, b_low)
    narrow = F.least(a_high - a_low, b_high - b_low)
    return F.when(narrow > 0, F.greatest(shared, F.lit(0.0)) / narrow).otherwise((shared >= 0).cast("double"))


def intervals_meet(a_low: Column, a_high: Column, b_low: Column, b_high: Column, slack: float = 0) -> Column:
    """Whether two closed intervals meet within ``slack``; intervals without both ends meet everything."""
    return F.coalesce((a_low <= b_high + slack) & (b_low <= a_high + slack), F.lit(True))


def command_window(birth: Column, birth_slack: Column, death: Column, death_slack: Column) -> Column:
    """struct(low, high): the years in which a person can have acted.

    From 15 after birth to death, each by its slack; a missing end lies 100
    years off; both ends are widened by 2. No dates give nulls, which abstain.
    """
    low = F.when(birth.isNotNull(), birth - F.coalesce(birth_slack, F.lit(0)) + 15).otherwise(death - F.coalesce(death_slack, F.lit(0)) - 100)
    high = F.when(death.isNotNull(), death + F.coalesce(death_slack, F.lit(0))).otherwise(birth + F.coalesce(birth_slack, F.lit(0)) + 100)
    return F.struct((low - 2).alias("low"), (high + 2).alias("high"))


def fuzzy_confidence(score: Column, threshold: float) -> Column:
    """A score from the threshold to 100 as a confidence from 0.5 to 0.92, to three places."""
    return F.round(0.5 + 0.42 * (score - threshold) / (100 - threshold), 3)


def fisher_information(sd: Column, nu: float) -> Column:
    """Information of one Student-t report about its centre."""
    return F.try_divide(F.lit((nu + 1) / (nu + 3)), sd * sd)


def contraction(after: Column, before: Column) -> Column:
    """1 less the ratio of variances; null for no spread before."""
    return 1 - F.pow(F.try_divide(after, before), 2)


def astronomical_year(literal: Column) -> Column:
    """The year of "YYYY-MM-DD" or "YYYY-MM-DD BC" with 1 BC as 0."""
    year = F.regexp_extract(literal, r"^\s*(\d{1,6})", 1).try_cast("int")
    return F.when(F.regexp_like(literal, F.lit(r"(?i)\bBC\b")), 1 - year).otherwise(year)


def signed_time_year(value: Column) -> Column:
    """The year of a signed ISO time such as "-0044-03-15T00:00:00Z", whose year 1 BC is -1."""
    year = F.regexp_extract(value, r"^([+-]?\d{1,6})-", 1).try_cast("int")
    return F.when(year < 0, year + 1).otherwise(year)


def date_slack(precision: Column) -> Column:
    """Years by which a date of a precision may be off; null for unknown precisions."""
    return F.when(precision.isin("day", "month", "year"), 0).when(precision == "decade", 10).when(precision == "century", 100)


def title_years(title: Column) -> Column:
    """struct(first, last) from years in a closing bracket, one year standing for both."""
    first = F.regexp_extract(title, r"\((\d{3,4})(?:\s*[-–]\s*\d{2,4})?\)\s*$", 1).try_cast("int")
    raw = F.regexp_extract(title, r"\(\d{3,4}\s*[-–]\s*(\d{2,4})\)\s*$", 1)
    last = F.when(F.length(raw) == 2, F.concat(F.substring(first.cast("string"), 1, 2), raw)).otherwise(raw).try_cast("int")
    return F.struct(first.alias("first"), F.coalesce(last, first).alias("last"))


def normalised_weights(weights: Column) -> Column:
    """An array of weights scaled to sum 1; equal shares where they sum to 0; the last takes the rounding remainder."""
    n = F.size(weights)
    total = F.aggregate(weights, F.lit(0.0), lambda a, w: a + F.coalesce(w, F.lit(0.0)))
    shares = F.transform(weights, lambda w: F.when(total > 0, F.coalesce(w, F.lit(0.0)) / total).otherwise(1.0 / n))
    head = F.slice(shares, 1, F.greatest(n - 1, F.lit(0)))
    return F.when(n == 0, shares).otherwise(F.concat(head, F.array(1.0 - F.aggregate(head, F.lit(0.0), lambda a, w: a + w))))


def linear_predictor(score_a: Column, score_b: Column, x_diff: Column, defender_diff: Column, beta_force: Column | float, beta_def: Column | float) -> Column:
    """Score of A less that of B, plus force and defender terms; null where a part is."""
    return score_a - score_b + beta_force * x_diff + beta_def * defender_diff


def paired_flags(a: Column, b: Column) -> Column:
    """struct(a, b, status) of two opposite flags as 1 or 0: a lone one fills the other; status both, filled or none (neither stated, or alike)."""
    one, two = a.cast("int"), b.cast("int")
    status = F.when(a.isNull() & b.isNull(), "none").when(a.isNull() | b.isNull(), "filled").when(a == b, "none").otherwise("both")
    return F.struct(F.coalesce(one, 1 - two, F.lit(0)).alias("a"), F.coalesce(two, 1 - one, F.lit(0)).alias("b"), status.alias("status"))


def z_for_level(level: float) -> float:
    """The two-sided normal quantile of a central interval, 1.96 for 0.95."""
    return NormalDist().inv_cdf(0.5 + level / 2)


def stored_or_normal(low: Column, high: Column, mean: Column, sd: Column, z: float) -> Column:
    """struct(low, high): the stored interval where both ends are, else mean and z times sd either way; null without these."""
    stored = low.isNotNull() & high.isNotNull()
    known = mean.isNotNull() & sd.isNotNull()
    return F.when(stored, F.struct(low.alias("low"), high.alias("high"))).when(known, F.struct((mean - z * sd).alias("low"), (mean + z * sd).alias("high")))


def scaled_minimum(n: Column, base_n: int = 20, base_least: int = 12) -> Column:
    """The least overlap for a list of n, in proportion to that for ``base_n``, rounded up."""
    return F.ceil(base_least * n / base_n)


def call_cost(tokens_in: Column, tokens_out: Column, cached: Column, written: Column, price_in: Column, price_out: Column, read_share: Column, write_share: Column) -> Column:
    """The price of a call from prices per million tokens; cached input and cache writes at shares of the input price. Null without prices."""
    fresh = F.greatest(tokens_in - cached, F.lit(0))
    return (fresh * price_in + cached * price_in * read_share + written * price_in * write_share + tokens_out * price_out) / 1e6
