"""Studies that put the operators together; each returns plain result tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evenfold.functions import families as L
from evenfold.operators import contracts as C
from evenfold.operators import folds as FO
from evenfold.operators import metrics as M
from evenfold.operators import resample as B
from evenfold.operators import scores as SC
from evenfold.operators.fit.closed_form import line_of
from evenfold.operators.joins import side_by_side
from evenfold.operators.reshape import long, wide
from evenfold.roles import DEFAULT, Roles
from evenfold.session import settle, with_scalars

CARD_METRICS = ("gb_rmse", "gb_mae", "gb_r2", "joint_nll")


def ablation_deltas(metrics: DataFrame, key: str, reference: str, columns: tuple[str, ...] = ("gb_rmse", "gb_mae", "gb_r2")) -> DataFrame:
    return SC.against_reference(metrics, [], key, reference, {m: f"delta_{m}" for m in columns})


def family_audit(oof: DataFrame, test: DataFrame, families: tuple[str, ...], keys: list[str], fold: str, roles: Roles = DEFAULT) -> DataFrame:
    """Other families at the same locations: scale anew per family on development rows only,
    then scored on the test rows. ``oof`` holds development predictions keyed by the outer fold."""
    from evenfold.operators.fit.trunk import calibrate_scales

    parts = []
    for name in families:
        scales = calibrate_scales(oof, [*keys, fold], name, roles).select(*keys, fold, F.col("scale").alias("_scale"), "at_bound")
        rows = test.join(settle(scales, "scales"), [*keys, fold])
        loss = L.row_loss(name, F.col(roles.y), F.col(roles.pred), F.col("_scale"), F.col(roles.event))
        low, high = (L.quantile(name, F.col(roles.pred), F.col("_scale"), p) for p in (0.05, 0.95))
        parts.append(rows.withColumns({"distribution": F.lit(name), "row_nll": loss, "low90": low, "high90": high}))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return M.score_card(out, [*keys, "distribution"], roles, intervals={"p90": ("low90", "high90")})


def development_rows(pred: DataFrame, k: int, fold: str = "fold", outer: str = "outer") -> DataFrame:
    """Out-of-fold rows that an outer fold may use: every row once per other fold."""
    others = F.filter(F.sequence(F.lit(1), F.lit(k)), lambda x: x != F.col(fold))
    return pred.withColumn(outer, F.explode(others))


def strict_lines(df: DataFrame, factors: dict[str, str], x: str, y: str, unit: str, roles: Roles = DEFAULT) -> DataFrame:
    """Line refits of a leave-one-level-out plan that train on no unit seen in the held-out level.

    The training sums of a level are the total less the sums of the units it touches, so all
    levels are refitted from one table of unit sums and the (level, unit) cells; records are
    read once. The scale is the spread of the training residuals. A level whose units leave
    fewer than three training events has null parameters.
    """
    cx, cy = F.col(x), F.col(y)
    moments = {"n": F.lit(1.0), "sx": cx, "sy": cy, "sxx": cx * cx, "sxy": cx * cy, "syy": cy * cy}
    rows = df.where(F.col(roles.event)).groupBy(F.col(unit).alias("_u")).agg(*[F.sum(c).alias(n) for n, c in moments.items()])
    units = settle(rows, "units")
    touched = FO.long_factors(df, factors, [unit]).groupBy("scenario", "level", F.col(unit).alias("_u")).agg(F.count(F.lit(1)).alias("n_rows"))
    gone = touched.join(units, "_u", "left").groupBy("scenario", "level").agg(*[F.coalesce(F.sum(n), F.lit(0.0)).alias(f"_{n}") for n in moments])
    left = with_scalars(gone, units.agg(*[F.sum(n).alias(n) for n in moments])).select("scenario", F.col("level").alias("holdout"), *[(F.col(n) - F.col(f"_{n}")).alias(n) for n in moments])
    slope, intercept = line_of(*[F.when(F.col("n") >= 3, F.col(n)) for n in ("n", "sx", "sy", "sxx", "sxy")])
    fitted = left.withColumns({"slope": slope, "intercept": intercept})
    error = (F.col("syy") - F.col("intercept") * F.col("sy") - F.col("slope") * F.col("sxy")) / F.col("n")
    return fitted.select("scenario", "holdout", F.col("n").cast("long").alias("n_train"), "slope", "intercept", F.sqrt(F.greatest(error, F.lit(0.0))).alias("scale"))


def matched_comparison(strict: DataFrame, original: DataFrame, scope: list[str], roles: Roles = DEFAULT) -> tuple[DataFrame, DataFrame]:
    """Strict and original predictions on the same test rows: score cards and differences."""
    same = original.join(strict.select(*scope, roles.row).distinct(), [*scope, roles.row], "left_semi")
    both = strict.withColumn("evaluation", F.lit("strict")).unionByName(same.withColumn("evaluation", F.lit("original_same_rows")), allowMissingColumns=True)
    cards = settle(M.score_card(both, [*scope, "evaluation"], roles), "cards")
    tall = long(cards.select(*scope, "evaluation", *CARD_METRICS), [*scope, "evaluation"], list(CARD_METRICS))
    pivoted = wide(tall, [*scope, "metric"], "evaluation", "value", ["strict", "original_same_rows"])
    return cards, pivoted.select(*scope, "metric", (F.col("strict") - F.col("original_same_rows")).alias("strict_minus_original"))


def raw_variants(raw: DataFrame, representatives: DataFrame, restored: list[str], keep: list[str], roles: Roles = DEFAULT) -> DataFrame:
    """Duplicate and source-quality variants of a record table, in one long table.

    ``expanded`` puts the raw rows of every cluster back, with fields of the raw row where it
    has them and of its representative elsewhere; the others drop rows from the records.
    """
    rep = representatives.select(*dict.fromkeys([roles.row, roles.equiv, roles.group, *restored, *keep]))
    back = raw.select(F.col(roles.equiv), F.col(roles.row).cast("string").alias("_raw_row"), *[F.col(c).alias(f"_raw_{c}") for c in restored if c in raw.columns])
    expanded = back.join(rep, roles.equiv).select(
        F.lit("expanded").alias("variant"), F.col("_raw_row").alias("variant_row"), roles.equiv, roles.group,
        *[(F.coalesce(F.col(f"_raw_{c}"), F.col(c)) if c in raw.columns else F.col(c)).alias(c) for c in restored])
    parts = [expanded]
    base = lambda df, name: df.select(
        F.lit(name).alias("variant"), F.col(roles.row).cast("string").alias("variant_row"), roles.equiv, roles.group, *restored)
    parts.append(base(rep, "reference"))
    if "secondary" in representatives.columns:
        parts.append(base(representatives.where(~F.col("secondary")), "no_secondary"))
    if "high_evidence" in representatives.columns:
        parts.append(base(representatives.where("high_evidence"), "high_evidence_only"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def exclusion_variant(df: DataFrame, test, name: str) -> DataFrame:
    """Records twice: all of them, and without the rows where ``test`` holds."""
    labels = F.array_compact(F.array(F.lit("all_rows"), F.when(~test, F.lit(name))))
    return df.withColumn("variant", F.explode(labels))


def variant_comparison(pred: DataFrame, key: str, reference: str, reps: int, seed: int, roles: Roles = DEFAULT) -> DataFrame:
    """Difference of each variant to the reference: balanced point scores and intervals."""
    cards = settle(M.score_card(pred, [key], roles), "cards")
    point = SC.against_reference(cards, [], key, reference, {m: f"d_{m}" for m in CARD_METRICS})
    bounds = B.difference_intervals(pred, [], key, reference, reps, seed, roles)
    return point.where(F.col(key) != reference).select(key, *[f"d_{m}" for m in CARD_METRICS]).join(bounds, key)


def model_comparison(pred: DataFrame, models: tuple[str, ...], scope: list[str], low: str, high: str, level: float, roles: Roles = DEFAULT) -> DataFrame:
    """Point scores and empirical intervals of a few models side by side."""
    rows = pred.where(F.col(roles.model).isin(*models))
    keys = [*scope, roles.model]
    point = M.point_metrics(rows, keys, roles)
    intervals = M.empirical_interval_summary(rows, keys, low, high, level, roles).drop("n_events", "n_groups")
    return point.join(intervals, keys)


def scope_table(parts: dict[str, DataFrame], metric: str, models: list[str], roles: Roles = DEFAULT) -> DataFrame:
    """One row per validation scope, one column per model."""
    out = None
    for name, df in parts.items():
        part = M.point_metrics(df, [roles.model], roles).select(F.lit(name).alias("scope"), roles.model, metric)
        out = part if out is None else out.unionByName(part)
    return wide(out, ["scope"], roles.model, metric, models)


def recompute_audit(pred: DataFrame, saved: DataFrame, scope: list[str], tolerance: float = 1e-9, roles: Roles = DEFAULT) -> DataFrame:
    """Scores of a finished result set once more from its rows, against the saved table."""
    fresh = M.point_metrics(pred, scope, roles)
    names = ["gb_rmse", "gb_mae", "gb_r2", "gb_f5"]
    joined = side_by_side(fresh.select(*scope, *names), saved, scope, names, ("_new", "_saved"))
    gap = F.greatest(*[F.abs(F.col(f"{n}_new") - F.col(f"{n}_saved")) for n in names])
    return joined.select(*scope, gap.alias("max_abs_difference"), (gap <= tolerance).alias("passed"))


def leakage_audit(df: DataFrame, k: int, roles: Roles = DEFAULT) -> DataFrame:
    """Per outer fold: keys of each kind that are in both training and test."""
    members = FO.membership(df, k, [roles.row, roles.group, roles.equiv])
    return C.role_overlap(members, [roles.row, roles.group, roles.equiv]).groupBy("rule").agg(F.count(F.lit(1)).alias("n"))


def factor_study(pred: DataFrame, proposed: str, reps: int, seed: int, roles: Roles = DEFAULT) -> dict[str, DataFrame]:
    """Holdout predictions by scenario: scores, per level scores, paired gains."""
    return {
        "scenario": M.point_metrics(pred, [roles.scenario, roles.model], roles),
        "level": SC.unweighted_metrics(pred, [roles.scenario, roles.holdout, roles.model], roles),
        "paired": B.paired_effects(pred, [roles.scenario], proposed, reps, seed, roles, composite=False)}
