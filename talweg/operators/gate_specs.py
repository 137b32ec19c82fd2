"""The declared gates of each stage, over tables of events, sides and actors.

Tables are given by name: battles, battle_sides, battle_commanders, generals,
general_aliases, troop_reports, missing_data_log, crawl_log, model_runs,
general_skill_estimates, battle_war_details, overrides (stage, label, matched)
and stage_verdicts (stage, gate, passed), the last holding what a stage's own
report says of its checks. ``model_runs.diagnostics`` and ``config`` are JSON.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talweg.functions.text import fold_accents
from talweg.operators.gates import Gate, newest_json, rows, share

Tables = Mapping[str, DataFrame]

#: Limits that thresholds name.
PARAMS: Mapping[str, float] = {
    "max_low_precision_frac": 0.05, "max_median_ci_log_width": 4.5, "max_multi_claim_identified_width": 2.2, "max_noise_ratio": 1.5, "max_prior_predictive_outside_frac": 0.05, "max_wb_reliability_gap": 0.1,
    "min_calibration_sides": 20, "min_estimate_coverage": 0.99, "min_ppc_tail_p": 0.05, "min_s_d_median": 0.25, "min_singleton_ci_log_width": 0.8, "min_singleton_identified_width": 0.8, "min_singleton_slope": 0.85,
    "min_spread_ratio": 0.85, "min_within_battle_slope": 0.5,
}
#: Model types, the note of a split and the prefix of plan rows in the crawl log.
SOURCES, SKILL, IMPUTED = "source_disagreement", "bradley_terry_hierarchical", "imputation"
SPLIT_NOTE, PLAN, NOTE, WITHHELD = "kept separate after an uncertain match", "crawl-plan://", "reconcile: ", "reconcile: estimate withheld"


def _one(df: DataFrame, value: Column) -> DataFrame:
    return df.agg(value.alias("actual"))


def _plan(t: Tables, value: Callable[[Callable[[str], Column]], Column]) -> DataFrame:
    """A number from the counts in the URL of the newest plan row; null without one."""
    plans = t["crawl_log"].filter(F.startswith("url", F.lit(PLAN + "battle-articles?")))
    newest = plans.agg(F.max_by("url", F.struct("fetched_at", "crawl_id")).alias("url"))
    return newest.select(value(lambda name: F.regexp_extract("url", name + "=([0-9]+)", 1).try_cast("double")).alias("actual"))


def _count_per(t: Tables, of: str, key: str) -> DataFrame:
    """Mean number of rows of a table for each battle, battles without any included."""
    n = t["battles"].select("battle_id").join(t[of].select("battle_id", F.col(key).alias("__k")), "battle_id", "left").groupBy("battle_id").agg(F.count("__k").alias("n"))
    return _one(n, F.avg("n"))


def _completed(t: Tables, kind: str) -> DataFrame:
    """At most one row: diagnostics and config of the newest completed run of a kind."""
    runs = t["model_runs"].filter((F.col("model_type") == kind) & F.col("completed_at").isNotNull())
    newest = runs.agg(F.max_by(F.struct("diagnostics", "config"), "run_id").alias("r"))
    return newest.filter("r is not null").select("r.diagnostics", "r.config")


def _number(path: str, of: str = "diagnostics") -> Column:
    return F.get_json_object(of, path).try_cast("double")


def _from_run(t: Tables, value: Column, missing: float | None = None) -> DataFrame:
    """A value of the newest source run; ``missing`` for no run or no value."""
    found = _one(_completed(t, SOURCES), F.max(value))
    return found if missing is None else found.select(F.coalesce("actual", F.lit(missing)).alias("actual"))


def _both(name: str) -> list[Column]:
    """A recovery statistic of the published and of the neutral fit."""
    return [_number(f"$.{fit}.recovery.{name}") for fit in ("troops", "troops_neutral")]


def _lower(*values: Column) -> Column:
    return F.array_min(F.array(*values))


def _upper(*values: Column) -> Column:
    return F.array_max(F.array(*values))


def _converged(t: Tables, kind: str, rhat: float, ess: float, divergences: float) -> DataFrame:
    """Limits that the newest run breaks; a run without the figures breaks them, no run gives null."""
    d = _completed(t, kind)
    worst = lambda name: F.coalesce(_number(f"$.worst.{name}"), _number(f"$.{name}"))
    broken = [F.coalesce(worst("max_rhat") > rhat, F.lit(True)), F.coalesce(worst("min_ess_bulk") < ess, F.lit(True)), F.coalesce(worst("divergences") > divergences, F.lit(True))]
    return _one(d, F.max(sum((b.cast("int") for b in broken[1:]), broken[0].cast("int"))))


def _reported(t: Tables) -> DataFrame:
    """The run that rankings come from: the newest skill run that converged and wrote its estimates."""
    flag = lambda name: F.get_json_object("diagnostics", f"$.{name}") == "true"
    return t["model_runs"].filter((F.col("model_type") == SKILL) & flag("converged") & flag("estimates_written")).agg(F.max("run_id").alias("run_id"))


def _estimates(t: Tables) -> DataFrame:
    return t["general_skill_estimates"].join(_reported(t), "run_id")


def _verdict(stage: str, gate: str) -> Callable[[Tables], DataFrame]:
    return lambda t: _one(t["stage_verdicts"].filter((F.col("stage") == stage) & (F.col("gate") == gate)), F.max(F.col("passed").cast("int")))


def _overrides(stage: str) -> Callable[[Tables], DataFrame]:
    return lambda t: _one(t["overrides"].filter(F.col("stage") == stage), F.count_if(~F.coalesce(F.col("matched"), F.lit(False))))


def _active(t: Tables) -> DataFrame:
    """Generals that command anywhere, with folded names and whether they were split off uncertainly."""
    name = F.trim(F.regexp_replace(F.regexp_replace(fold_accents(F.col("canonical_name")), "[^a-z0-9 ]+", ""), " +", " "))
    g = t["generals"].join(t["battle_commanders"].select("general_id"), "general_id", "left_semi")
    return g.select("general_id", "wikidata_id", F.col("years_active.lo").alias("lo"), F.col("years_active.hi").alias("hi"), name.alias("name"), F.replace(name, F.lit(" "), F.lit("")).alias("key"), F.coalesce(F.contains("notes", F.lit(SPLIT_NOTE)), F.lit(False)).alias("split"))


def _pairs(g: DataFrame, on: list[str]) -> DataFrame:
    """Pairs of generals that agree in ``on``, might have lived at once, and aren't both identified."""
    a = g.select(*on, *[F.col(c).alias(f"a_{c}") for c in g.columns if c not in on])
    b = g.select(*on, *[F.col(c).alias(f"b_{c}") for c in g.columns if c not in on])
    apart = F.coalesce((F.col("a_lo") >= F.col("b_hi")) | (F.col("b_lo") >= F.col("a_hi")), F.lit(False))
    return a.join(b, on).filter((F.col("a_general_id") < F.col("b_general_id")) & ~apart & (F.col("a_wikidata_id").isNull() | F.col("b_wikidata_id").isNull()))


def _told_apart() -> Column:
    """Whether a person without an id was deliberately split from one with an id."""
    one = lambda x, y: F.col(f"{x}_wikidata_id").isNull() & F.col(f"{y}_wikidata_id").isNotNull() & F.col(f"{x}_split")
    return one("a", "b") | one("b", "a")


def _same_name(t: Tables) -> DataFrame:
    return rows(_pairs(_active(t), ["key"]).filter(~_told_apart()))


def _like_name(t: Tables) -> DataFrame:
    g = _active(t).withColumn("first", F.element_at(F.split("name", " "), 1)).withColumn("last", F.element_at(F.split("name", " "), -1))
    ends = _pairs(g, ["first", "last"]).filter("first <> last")
    squashed = _pairs(g, ["key"]).filter(_told_apart())
    return rows(ends.select("a_general_id", "b_general_id").union(squashed.select("a_general_id", "b_general_id")).distinct())


def _sides(t: Tables) -> DataFrame:
    return t["battle_sides"]


def _reported_sides(t: Tables) -> DataFrame:
    return _sides(t).join(t["troop_reports"].select("side_id"), "side_id", "left_semi")


def _logged(t: Tables) -> DataFrame:
    return t["missing_data_log"].filter(F.col("field_name") == "troop_total")


def _log_width(methods: tuple[str, ...]) -> Callable[[Tables], DataFrame]:
    fine = F.col("est_troops_method").isin(*methods) & F.col("est_troops_run_id").isNotNull() & (F.col("est_troops_total_lo") > 0) & (F.col("est_troops_total_hi") > 0)
    return lambda t: _sides(t).filter(fine).select(F.log(F.col("est_troops_total_hi") / F.col("est_troops_total_lo")).alias("w"))


def _stale(t: Tables, value: str, run: str) -> DataFrame:
    """Sides whose estimate comes from another than the newest source run."""
    newest = t["model_runs"].filter(F.col("model_type") == SOURCES).agg(F.max("run_id").alias("__newest"))  # one row
    some = _sides(t).filter(F.col(value).isNotNull())
    fresh = newest.filter("__newest is not null")
    return some.join(fresh, F.col(run) == F.col("__newest"), "left_anti")


def _skipped() -> Column:
    keys = [F.coalesce(F.size(F.json_object_keys(F.get_json_object("diagnostics", f"$.{fit}.recovery.gates_skipped"))), F.lit(0)) for fit in ("troops", "troops_neutral")]
    return keys[0] + keys[1]


def _outside(path: str) -> Column:
    at = lambda name: F.get_json_object("diagnostics", f"$.{path}.{name}")
    return F.when(at("status") == "failed", 1.0).otherwise(F.coalesce(at("share_outside").try_cast("double"), F.when(at("skipped").isNotNull(), 0.0)))


def _neutral_unfit() -> Column:
    """1 for a published fit whose neutral fit is missing or breaks its own write limits."""
    worst = lambda name: _number(f"$.troops_neutral.worst.{name}")
    limit = lambda name, default: F.coalesce(_number(f"$.write_thresholds.{name}", "config"), F.lit(default))
    bad = F.get_json_object("diagnostics", "$.troops_neutral").isNull() | (F.coalesce(worst("max_rhat"), F.lit(float("inf"))) > limit("max_rhat", 1.05))
    bad = bad | (F.coalesce(worst("min_ess_bulk"), F.lit(0.0)) < limit("min_ess_bulk", 400.0)) | (F.coalesce(worst("divergences"), F.lit(1.0)) > limit("max_divergences", 0.0))
    return (F.get_json_object("diagnostics", "$.troops").isNotNull() & bad).cast("int")


def _low_precision() -> Column:
    parts = [F.coalesce(F.try_divide(_number(f"$.{q}.n_sides_low_precision"), _number(f"$.{q}.n_sides")), F.lit(0.0)) for q in ("troops", "troops_neutral", "casualties")]
    return _upper(*parts)


def _spread() -> Column:
    published = F.when(F.get_json_object("diagnostics", "$.troops.recovery").isNotNull(), _number("$.troops.recovery.gate_spread_ratio")).otherwise(_number("$.troops.spread_ratio"))
    return F.when(F.get_json_object("diagnostics", "$.troops").isNotNull(), _lower(published, _number("$.troops_neutral.recovery.gate_spread_ratio")))


def _singleton_width() -> Column:
    return F.coalesce(_number("$.troops.identified_width.singleton.min"), F.when(_number("$.troops.identified_width.singleton.n") == 0, 1000.0))


def _off_total(t: Tables) -> DataFrame:
    e = _estimates(t).select("run_id", "general_id", "total_war")
    parts = t["battle_war_details"].groupBy("run_id", "general_id").agg(F.sum("war_contribution").alias("parts"))
    return e.join(parts, ["run_id", "general_id"], "left").filter(F.abs(F.col("total_war") - F.coalesce("parts", F.lit(0.0))) > 0.01)


GATES: tuple[Gate, ...] = (
    Gate("min_battles_crawled", ">= 0", "error", lambda t: _plan(t, lambda n: n("fetched") - n("floor")), "crawl"),
    Gate("battle_articles_fetched_ratio", ">= 0.95", "error", lambda t: _plan(t, lambda n: F.try_divide(n("fetched"), n("targets"))), "crawl"),
    Gate("error_rate_below_threshold", "< 0.10", "warning", lambda t: share(t["crawl_log"].filter(~F.startswith("url", F.lit(PLAN))), F.coalesce(F.col("http_status") >= 400, F.lit(True))), "crawl"),
    Gate("wikidata_coverage", ">= 0.9", "warning", lambda t: _plan(t, lambda n: F.try_divide(n("entities"), n("fetched"))), "crawl"),
    Gate("extraction_coverage", ">= 0.85", "warning", lambda t: share(t["battles"], F.col("n_sources") > 0), "extract"),
    Gate("sides_per_battle", ">= 2.0", "warning", lambda t: _count_per(t, "battle_sides", "side_id"), "extract"),
    Gate("no_empty_extractions", "< 0.05", "warning", lambda t: share(t["battles"].join(_sides(t).select("battle_id", F.lit(1).alias("__s")).distinct(), "battle_id", "left"), F.col("date_start").isNull() & F.col("__s").isNull(), 1.0), "extract"),
    Gate("overrides_applied", "= 0", "error", _overrides("extract"), "extract"),
    Gate("resolution_rate", ">= 0.90", "warning", lambda t: _one(t["battle_commanders"].select(F.lit(1).alias("x")).union(t["missing_data_log"].filter(F.col("field_name") == "commander_general_id").select(F.lit(0))), F.avg("x")), "resolve"),
    Gate("no_duplicate_generals", "= 0", "error", _same_name, "resolve"),
    Gate("probable_duplicate_generals", "= 0", "warning", _like_name, "resolve"),
    Gate("wikidata_link_rate", ">= 0.60", "warning", lambda t: share(t["generals"], F.col("wikidata_id").isNotNull()), "resolve"),
    Gate("commanders_per_battle", ">= 2.0", "warning", lambda t: _count_per(t, "battle_commanders", "bc_id"), "resolve"),
    Gate("alias_coverage", ">= 0.70", "warning", lambda t: share(t["generals"].select("general_id").join(t["general_aliases"].select("general_id", F.lit(1).alias("__a")).distinct(), "general_id", "left"), F.col("__a").isNotNull()), "resolve"),
    Gate("overrides_applied", "= 0", "error", _overrides("resolve"), "resolve"),
    Gate("model_convergence", "= 0", "error", lambda t: _converged(t, SOURCES, 1.05, 400, 0), "reconcile"),
    Gate("neutral_fit_converged", "= 0", "error", lambda t: _from_run(t, _neutral_unfit(), 0.0), "reconcile"),
    Gate("troop_span_guard", "= 0", "error", lambda t: _from_run(t, _number("$.troop_span_guard.n_errors"), -1.0), "reconcile"),
    Gate("troop_span_warnings", "= 0", "warning", lambda t: _from_run(t, _number("$.troop_span_guard.n_warnings"), 0.0), "reconcile"),
    Gate("sides_low_precision", "<= {params.max_low_precision_frac}", "error", lambda t: _from_run(t, _low_precision(), 0.0), "reconcile"),
    Gate("estimates_not_collapsed", ">= {params.min_spread_ratio}", "error", lambda t: _from_run(t, _spread(), 1.0), "reconcile"),
    Gate("singleton_slope_recovers", ">= {params.min_singleton_slope}", "error", lambda t: _from_run(t, _lower(*_both("gate_singleton_slope")), 1.0), "reconcile"),
    Gate("within_battle_ratio_recovers", ">= {params.min_within_battle_slope}", "error", lambda t: _from_run(t, _lower(*_both("gate_within_battle_slope")), 1.0), "reconcile"),
    Gate("post1800_ratio_in_band", "= 0", "warning", lambda t: _from_run(t, _both("gate_post1800_band_violation")[0], 0.0), "reconcile"),
    Gate("between_battle_variance_is_plausible", ">= {params.min_ppc_tail_p}", "error", lambda t: _from_run(t, _lower(*_both("gate_ppc_tail_p")), 1.0), "reconcile"),
    Gate("side_deviation_not_collapsed", ">= {params.min_s_d_median}", "error", lambda t: _from_run(t, _lower(*_both("gate_s_d_median")), 1.0), "reconcile"),
    Gate("noise_not_leaking", "<= {params.max_noise_ratio}", "error", lambda t: _from_run(t, _upper(*_both("gate_noise_ratio")), 0.0), "reconcile"),
    Gate("wb_matches_reliability", "<= {params.max_wb_reliability_gap}", "warning", lambda t: _from_run(t, _upper(*_both("gate_wb_reliability_gap")), 0.0), "reconcile"),
    Gate("recovery_gates_skipped", "= 0", "warning", lambda t: _from_run(t, _skipped(), 0.0), "reconcile"),
    Gate("neutral_post1800_level_relative", "= 0", "warning", lambda t: _from_run(t, _both("gate_relative_level_violation")[1], 0.0), "reconcile"),
    Gate("neutral_all_sides_level_in_band", "= 0", "warning", lambda t: _from_run(t, _both("gate_all_ratio_violation")[1], 0.0), "reconcile"),
    Gate("reports_honoured", "= 0", "error", lambda t: _from_run(t, (F.coalesce(_number("$.troops.reports_honoured.n_violations"), F.lit(0.0)) > 0).cast("int"), 0.0), "reconcile"),
    Gate(
        "estimates_populated", ">= {params.min_estimate_coverage}", "error",
        lambda t: share(_reported_sides(t).join(_logged(t).filter(F.startswith("notes", F.lit(NOTE)) & ~F.startswith("notes", F.lit(WITHHELD))), "side_id", "left_anti"), F.col("est_troops_total").isNotNull()), "reconcile",
    ),
    Gate("unfillable_sides_are_logged", "= 0", "error", lambda t: rows(_reported_sides(t).filter("est_troops_total is null").join(_logged(t), "side_id", "left_anti")), "reconcile"),
    Gate("ci_width_reasonable", "< {params.max_median_ci_log_width}", "warning", lambda t: _one(_log_width(("source_disagreement",))(t), F.percentile("w", F.lit(0.5))), "reconcile"),
    Gate("singleton_estimates_are_honestly_uncertain", ">= {params.min_singleton_ci_log_width}", "error", lambda t: _one(_log_width(("single_report_debiased", "bound_only"))(t), F.coalesce(F.min("w"), F.lit(1000.0))), "reconcile"),
    Gate("singleton_identified_width_is_honest", ">= {params.min_singleton_identified_width}", "error", lambda t: _from_run(t, _singleton_width()), "reconcile"),
    Gate("multi_claim_identified_width_is_tight", "<= {params.max_multi_claim_identified_width}", "warning", lambda t: _from_run(t, _number("$.troops.identified_width.multi_claim.median")), "reconcile"),
    Gate("prior_predictive_is_plausible", "<= {params.max_prior_predictive_outside_frac}", "warning", lambda t: _from_run(t, _outside("troops.prior_predictive")), "reconcile"),
    Gate("prior_predictive_neutral_is_plausible", "<= {params.max_prior_predictive_outside_frac}", "warning", lambda t: _from_run(t, _outside("troops_neutral.prior_predictive_neutral")), "reconcile"),
    Gate("calibration_set_is_not_empty", ">= {params.min_calibration_sides}", "warning", lambda t: rows(t["troop_reports"].filter("branch = 'total' and reported_value > 0").groupBy("side_id").agg(F.count_distinct("source_id").alias("n")).filter("n >= 2")), "reconcile"),
    Gate("neutral_estimates_are_not_stale", "= 0", "warning", lambda t: rows(_stale(t, "est_troops_neutral", "est_troops_neutral_run_id")), "reconcile"),
    Gate("model_run_recorded", ">= 1", "error", lambda t: rows(t["model_runs"].filter((F.col("model_type") == SOURCES) & F.col("completed_at").isNotNull() & F.col("diagnostics").isNotNull())), "reconcile"),
    Gate("estimates_are_not_stale", "= 0", "warning", lambda t: rows(_stale(t, "est_troops_total", "est_troops_run_id").join(t["troop_reports"].select("side_id"), "side_id", "left_semi")), "reconcile"),
    Gate("all_commanders_classified", "< 200", "warning", lambda t: rows(t["battle_commanders"].filter("command_role = 'unknown'")), "classify"),
    Gate("attribution_weights_sum", "< 50", "warning", lambda t: rows(t["battle_commanders"].groupBy("side_id").agg(F.sum("attribution_weight").alias("w")).filter(F.abs(F.col("w") - 1) > 0.15)), "classify"),
    Gate("battle_type_unknown_share", "< 0.10", "warning", lambda t: share(t["battles"].filter("source_slug is not null"), F.col("battle_type") == "unknown", 0.0), "classify"),
    Gate("missing_data_all_logged", "= 0", "error", lambda t: rows(_sides(t).filter("est_troops_total is null").join(_logged(t), "side_id", "left_anti")), "classify"),
    Gate("overrides_applied", "= 0", "error", _overrides("classify"), "classify"),
    *(Gate(n, "= 1", s, _verdict("impute", n), "impute") for n, s in (("imputation_completeness", "error"), ("imputed_ratio_plausible", "error"), ("imputed_values_plausible", "error"), ("distributional_check", "warning"), ("kept_pair_ratio_slope", "error"), ("kept_side_slope", "error"))),
    Gate("model_convergence", "= 0", "error", lambda t: _converged(t, IMPUTED, 1.05, 400, 0), "impute"),
    Gate("convergence", "= 0", "error", lambda t: _converged(t, SKILL, 1.02, 800, 0), "model"),
    Gate("no_divergences", "= 0", "warning", lambda t: _converged(t, SKILL, 1000.0, 0, 9), "model"),
    Gate(
        "top_generals_have_intervals", "= 0", "error",
        lambda t: _one(t["general_skill_estimates"].join(t["model_runs"].filter(F.col("model_type") == SKILL).agg(F.max("run_id").alias("run_id")), "run_id"), F.when(F.count("*") == 0, -1).otherwise(F.count_if((F.col("rank") <= 50) & F.col("skill_ci_lo").isNull()))), "model",
    ),
    *(
        Gate(n, "= 1", "warning", _verdict("model", n), "model")
        for n in ("posterior_predictive_category_check", "fmi_top_generals", "circularity_check", "exclusion_concentration", "extreme_ratio_dependence", "implausible_career_span", "prior_predictive_sensible", "top_generals_cross_component", "exclusions_reported")
    ),
    Gate("held_out_accuracy", "> 0.55", "warning", lambda t: newest_json(t["model_runs"], "evaluation", "$.held_out_accuracy"), "evaluate"),
    Gate("calibration", "< 0.25", "warning", lambda t: newest_json(t["model_runs"], "evaluation", "$.brier"), "evaluate"),
    *(Gate(n, "= 1", "warning", _verdict("evaluate", n), "evaluate") for n in ("cv_converged", "ranking_stability", "named_checks")),
    Gate("top_rankings_have_intervals", "= 0", "error", lambda t: rows(_estimates(t).filter("rank <= 100 and (skill_ci_lo is null or skill_ci_hi is null or war_sd is null)")), "report"),
    Gate("export_non_empty", "> 0", "error", lambda t: rows(_estimates(t).filter("n_battles >= 3")), "report"),
    Gate("no_orphaned_war_details", "= 0", "error", lambda t: rows(t["battle_war_details"].join(_reported(t), "run_id").join(t["general_skill_estimates"].select("run_id", "general_id"), ["run_id", "general_id"], "left_anti")), "report"),
    Gate("war_decomposition_reconciles", "= 0", "error", lambda t: rows(_off_total(t)), "report"),
    Gate("reported_run_converged", "> 0", "error", lambda t: _one(_reported(t), F.count("run_id")), "report"),
    Gate("exclusion_concentration", "= 1", "error", _verdict("report", "exclusion_concentration"), "report"),
    Gate("rank_ties_are_resolved", "= 0", "warning", lambda t: rows(_estimates(t).groupBy("run_id", "rank").agg(F.count("*").alias("n")).filter("n > 1")), "report"),
    *(Gate(n, "= 1", "error", _verdict("report", n), "report") for n in ("export_matches_db", "disclosures_match_db", "coverage_figures_written", "evaluation_current")),
)
