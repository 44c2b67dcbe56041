"""Claim gate: named boolean rules over result tables, each with its evidence, and their AND."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Rule = Callable[[], DataFrame]


def rule(name: str, table: DataFrame, passed: Column, evidence: Column) -> DataFrame:
    """One aggregate over one table gives the verdict and the text that backs it."""
    return table.agg(F.coalesce(passed, F.lit(False)).alias("passed"), F.coalesce(evidence.cast("string"), F.lit("none")).alias("evidence")).select(
        F.lit(name).alias("gate"), "passed", "evidence")


def empty(name: str, violations: DataFrame) -> DataFrame:
    n = F.count(F.lit(1))
    return rule(name, violations, n == 0, F.concat(F.lit("violations="), n.cast("string")))


def gate(rules: list[DataFrame], required: list[str] | None = None, name: str = "all_required") -> DataFrame:
    """All rules and one further row: whether every required rule passed."""
    out = rules[0]
    for r in rules[1:]:
        out = out.unionByName(r)
    wanted = F.lit(True) if required is None else F.col("gate").isin(*required)
    verdict = out.agg(
        F.bool_and(F.when(wanted, F.col("passed"))).alias("passed"),
        F.concat(F.sum(F.when(wanted, F.col("passed").cast("int"))).cast("string"), F.lit("/"), F.count(F.when(wanted, 1)).cast("string")).alias("evidence"))
    return out.unionByName(verdict.select(F.lit(name).alias("gate"), "passed", "evidence"))


def evaluation_rules(records: DataFrame, predictions: DataFrame, metrics: DataFrame, paired: DataFrame, folds: DataFrame,
                     clusters: DataFrame, candidates: DataFrame, proposed: str, n_folds: int) -> list[DataFrame]:
    """The rules of an evaluation: data, folds, coverage, scores, gains, selection, duplicates."""
    from evenfold.operators import contracts as C

    c = F.col
    event = c("is_event")
    models = [r["model"] for r in predictions.select("model").distinct().collect()]
    expected = records.select("row_id", F.explode(F.array(*[F.lit(m) for m in models])).alias("model"))
    ours = F.max(F.when(c("model") == proposed, c("gb_rmse")))
    others = F.min(F.when(c("model") != proposed, c("gb_rmse")))
    low = F.min(F.when(c("effect") == "rmse", c("lo")))
    text = lambda *p: F.concat_ws(";", *[x.cast("string") for x in p])
    return [
        empty("unique_row_ids", C.duplicates(records, ["row_id"])),
        empty("labels_complementary", C.Contract(("row_id",), "row_id", C.label_rules()).violations(records)),
        empty("one_fold_per_group", C.functional_dependency(folds, "group_id", "fold")),
        empty("each_row_predicted_once", C.coverage(expected, predictions, ["model", "row_id"])),
        empty("prediction_table_valid", C.prediction_contract().violations(predictions)),
        empty("temperature_has_one_bin", C.functional_dependency(records, "temp_c", "temp_bin")),
        rule("expected_folds_present", folds, F.countDistinct("fold") == n_folds, F.countDistinct("fold")),
        rule("events_present", records, F.sum(event.cast("long")) > 0, F.sum(event.cast("long"))),
        rule("censored_rows_present", records, F.sum((~event).cast("long")) > 0, F.sum((~event).cast("long"))),
        rule("enough_groups", records, F.countDistinct("group_id") >= n_folds, F.countDistinct("group_id")),
        rule("predictions_finite", predictions, F.bool_and(~F.isnan("pred") & c("pred").isNotNull()), F.count(F.lit(1))),
        rule("scales_positive", predictions, F.min("scale") > 0, F.round(F.min("scale"), 6)),
        rule("proposed_has_lowest_rmse", metrics, ours < others, text(F.round(ours, 6), F.round(others, 6))),
        rule("proposed_r2_positive", metrics, F.max(F.when(c("model") == proposed, c("gb_r2"))) > 0, F.round(F.max(F.when(c("model") == proposed, c("gb_r2"))), 6)),
        rule("rmse_gain_interval_above_zero", paired, low > 0, F.round(low, 6)),
        rule("paired_groups_complete", paired, F.min("n_groups") == F.max("n_groups"), F.max("n_groups")),
        rule("clusters_labelled", clusters, F.bool_and(c("label_conflict").isNotNull()), F.count(F.lit(1))),
        rule("no_label_conflict", clusters, F.sum(c("label_conflict").cast("long")) == 0, F.sum(c("label_conflict").cast("long"))),
        rule("cross_source_clusters_named", clusters, F.bool_and(c("cluster_sources") >= 1), F.sum(c("cross_source").cast("long"))),
        rule("one_choice_per_fold", candidates, F.sum(c("selected").cast("long")) == F.countDistinct("fold"), F.sum(c("selected").cast("long"))),
        rule("choice_within_budget", candidates, F.bool_and(~c("selected") | c("within")), F.count(F.when(c("within"), 1))),
        rule("candidate_scores_finite", candidates, F.bool_and(~F.isnan("inner_rmse") & c("inner_rmse").isNotNull()), F.count(F.lit(1))),
    ]


# ------------------------------------------------------------------ rules over result tables

@dataclass(frozen=True)
class Claim:
    """A rule over the result table named ``origin``: two aggregates, the verdict and what backs it."""

    name: str
    origin: str
    passed: Column
    evidence: Column


def judged(tables: dict[str, DataFrame], claims: list[Claim]) -> DataFrame:
    """(gate, passed, evidence, origin) of all claims; every table is read once, by one aggregate that holds all its rules.

    A verdict that is null, as on an empty table, fails. A claim on a table that is not there is an error.
    """
    missing = sorted({c.origin for c in claims} - set(tables))
    if missing:
        raise ValueError(f"claims on tables that are not given: {missing}")
    out = None
    for origin in dict.fromkeys(c.origin for c in claims):
        rules = [
            F.struct(F.lit(c.name).alias("gate"), F.coalesce(c.passed, F.lit(False)).alias("passed"), F.coalesce(c.evidence.cast("string"), F.lit("none")).alias("evidence")).alias(f"r{i}")
            for i, c in enumerate(claims) if c.origin == origin]
        one = tables[origin].agg(*rules)
        part = one.select(F.inline(F.array(*one.columns)), F.lit(origin).alias("origin"))
        out = part if out is None else out.unionByName(part)
    return out


def overall(verdicts: DataFrame, required: list[str], name: str = "overall_claim") -> DataFrame:
    """``verdicts`` and one row more: whether every required rule is there and passed."""
    wanted = F.col("gate").isin(*required)
    n = F.count(F.when(wanted & F.col("passed"), 1))
    total = verdicts.agg((n == len(required)).alias("passed"), F.concat(n.cast("string"), F.lit(f"/{len(required)}")).alias("evidence"))
    return verdicts.unionByName(total.select(F.lit(name).alias("gate"), "passed", "evidence", F.lit("all").alias("origin")))


def four_digits(x: Column) -> Column:
    return x.cast("decimal(18,4)").cast("string")


def share(condition: Column) -> Column:
    """How many of the rows meet ``condition``, as text."""
    return F.concat(F.count(F.when(condition, 1)).cast("string"), F.lit("/"), F.count(F.lit(1)).cast("string"))


def every(condition: Column) -> Column:
    return F.bool_and(F.coalesce(condition, F.lit(False)))


def study_claims(proposed: str, reference: str, comparators: list[str], scenarios: list[str], n_folds: int, n_candidates: int, nominal: float,
                 slope: str = "slope") -> list[Claim]:
    """What a finished study must show before it may claim to be better.

    Tables: ``effects`` (model, effect, estimate, lo), ``holdouts`` (scenario, model, estimate, lo), ``coverage``
    (model, coverage_lo, coverage_hi), ``intervals`` (model, interval_completeness), ``losses`` (model, censored_nll),
    ``parameters`` (fold, a slope, any_boundary_hit), ``selection`` (fold, candidate, within, selected), ``folds`` (fold, is_event).
    """
    c = F.col
    out = []
    for m in comparators:
        mine = (c("model") == m) & (c("effect") == "rmse")
        gain, low = F.max(F.when(mine, c("estimate"))), F.max(F.when(mine, c("lo")))
        out += [Claim(f"beats_{m}_point", "effects", gain > 0, four_digits(gain)), Claim(f"beats_{m}_interval", "effects", low > 0, four_digits(low))]
    known, above = c("model").isin(*comparators), c("lo") > 0
    rmse = c("effect") == "rmse"
    pairs, kinds = len(comparators), F.countDistinct("effect")
    held = c("scenario").isin(*scenarios) & known
    loss = {m: F.max(F.when(c("model") == m, c("censored_nll"))) for m in (proposed, reference)}
    inside = (c("coverage_lo") <= nominal) & (c("coverage_hi") >= nominal)
    ours = c("model") == proposed
    finite = c(slope).isNotNull() & ~F.isnan(slope) & (F.abs(slope) < float("inf"))
    chosen = c("selected") & c("within")
    return [
        *out,
        Claim("rmse_superiority", "effects", F.count(F.when(known & rmse & above, 1)) == pairs, F.count(F.when(known & rmse & above, 1))),
        Claim("multimetric_superiority", "effects", F.count(F.when(known & above, 1)) == pairs * kinds, F.count(F.when(known & above, 1))),
        Claim("holdout_scenarios_complete", "holdouts", F.count(F.when(held, 1)) == len(scenarios) * pairs, F.count(F.when(held, 1))),
        Claim("holdout_point_superiority", "holdouts", F.count(F.when(held & (c("estimate") > 0), 1)) == len(scenarios) * pairs, F.count(F.when(held & (c("estimate") > 0), 1))),
        Claim("holdout_interval_superiority", "holdouts", F.count(F.when(held & above, 1)) == len(scenarios) * pairs, F.count(F.when(held & above, 1))),
        Claim("interval_coverage_nominal", "coverage", F.bool_and(F.when(ours, inside)), F.concat_ws(",", four_digits(F.max(F.when(ours, c("coverage_lo")))), four_digits(F.max(F.when(ours, c("coverage_hi")))))),
        Claim("intervals_complete", "intervals", every(c("interval_completeness") == 1.0), share(c("interval_completeness") == 1.0)),
        Claim("survival_noninferiority", "losses", loss[proposed] <= loss[reference], F.concat_ws(",", four_digits(loss[proposed]), four_digits(loss[reference]))),
        Claim("parameters_in_all_folds", "parameters", F.countDistinct("fold") == n_folds, F.countDistinct("fold")),
        Claim("parameters_finite", "parameters", every(finite), share(finite)),
        Claim("slope_positive", "parameters", every(c(slope) > 0), four_digits(F.min(slope))),
        Claim("parameters_interior", "parameters", every(~c("any_boundary_hit")), share(c("any_boundary_hit"))),
        Claim("all_candidates_scored", "selection", F.countDistinct("fold", "candidate") == n_folds * n_candidates, F.countDistinct("fold", "candidate")),
        Claim("budget_never_relaxed", "selection", F.count(F.when(chosen, 1)) == n_folds, F.count(F.when(chosen, 1))),
        Claim("every_training_set_has_censored_rows", "folds", F.countDistinct(F.when(~c("is_event"), c("fold"))) > 1, F.countDistinct(F.when(~c("is_event"), c("fold")))),
    ]
