"""Quality gates: one number, one threshold, one verdict.

A gate's number comes from a one-row DataFrame. No number (null) fails, whatever
the threshold. All gates of a run are one DataFrame.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talweg.operators import aggregates

TOLERANCE = 1e-9
_THRESHOLD = re.compile(r"^\s*(?:p\s+)?(>=|<=|!=|=|>|<)\s*(-?\d+(?:\.\d+)?(?:[eE]-?\d+)?|true|false)\s*$", re.IGNORECASE)


@dataclass(frozen=True)
class Gate:
    """``threshold`` is an operator and a number, or the name of a parameter in braces for the number; ``measure`` gives a one-row frame whose first column is the actual value."""

    name: str
    threshold: str
    severity: str
    measure: Callable[[Mapping[str, DataFrame]], DataFrame]
    stage: str = ""


def parse_threshold(raw: str, params: Mapping[str, float] | None = None) -> tuple[str, float]:
    """("<=", 0.05) from "<= 0.05", "p <= 0.05" or "<= {params.limit}"; "= true" and "= false" compare with 1 and 0."""
    for name, value in (params or {}).items():
        raw = raw.replace("{params." + name + "}", str(value))
    found = _THRESHOLD.match(raw)
    if not found:
        raise ValueError(f"not a threshold: {raw}")
    return found[1], {"true": 1.0, "false": 0.0}.get(found[2].lower()) if found[2].isalpha() else float(found[2])


def passes(actual: Column, op: str, limit: float) -> Column:
    """Whether a value meets a limit; equality within a small tolerance; null fails."""
    test = {">=": actual >= limit, "<=": actual <= limit, ">": actual > limit, "<": actual < limit, "=": F.abs(actual - limit) <= TOLERANCE, "!=": F.abs(actual - limit) > TOLERANCE}[op]
    return F.coalesce(test, F.lit(False))


def rows(df: DataFrame) -> DataFrame:
    """The number of rows as a measure."""
    return df.agg(F.count("*").alias("actual"))


def share(df: DataFrame, cond: Column, empty: float | None = None) -> DataFrame:
    """The share of rows that meet a condition; ``empty`` for no rows."""
    out = F.try_divide(F.count_if(cond), F.count("*"))
    return df.agg((out if empty is None else F.coalesce(out, F.lit(empty))).alias("actual"))


def whole_quantile(df: DataFrame, value: Column, share: float) -> DataFrame:
    """The exact quantile of all rows as a measure; it is found ahead, in passes that count ranges."""
    return df.sparkSession.range(1).select(F.lit(aggregates.whole_quantile(df, value, share)).cast("double").alias("actual"))


def newest_json(runs: DataFrame, kind: str, path: str, missing: float | None = None, where: Column | None = None) -> DataFrame:
    """A number from the diagnostics of the newest completed run of a kind."""
    some = runs.filter((F.col("model_type") == kind) & F.col("completed_at").isNotNull())
    some = some if where is None else some.filter(where)
    found = F.get_json_object(F.max_by("diagnostics", "run_id"), path).try_cast("double")
    return some.agg((found if missing is None else F.coalesce(found, F.lit(missing))).alias("actual"))


def stored_verdict(runs: DataFrame, kind: str, name: str) -> DataFrame:
    """1 where the newest run of a kind stores that a named check passed, 0 where it stores that it failed."""
    flag = F.lower(F.get_json_object(F.max_by("diagnostics", "run_id"), f"$.gates.{name}.passed"))
    return runs.filter(F.col("model_type") == kind).agg(F.when(flag == "true", 1.0).when(flag == "false", 0.0).alias("actual"))


def run(gates: Sequence[Gate], tables: Mapping[str, DataFrame], params: Mapping[str, float] | None = None) -> DataFrame:
    """(stage, name, actual, threshold, severity, passed) of all gates, in one plan."""
    out = []
    for g in gates:
        op, limit = parse_threshold(g.threshold, params)
        measured = g.measure(tables)
        actual = F.col(measured.columns[0]).cast("double")
        out.append(measured.select(F.lit(g.stage).alias("stage"), F.lit(g.name).alias("name"), actual.alias("actual"), F.lit(f"{op} {limit}").alias("threshold"), F.lit(g.severity).alias("severity"), passes(actual, op, limit).alias("passed")))
    return reduce(DataFrame.union, out)


def blocking(results: DataFrame) -> DataFrame:
    """Gates that stop a run: errors that didn't pass."""
    return results.filter((F.col("severity") == "error") & ~F.col("passed"))
