"""Frozen scoring of new conditions and their later evaluation."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evenfold.functions import damage as D
from evenfold.functions import families as L
from evenfold.functions import text as X
from evenfold.operators import contracts as C
from evenfold.operators.quantiles import value_bucket
from evenfold.operators.reshape import issue_list
from evenfold.operators.scores import two_weightings
from evenfold.roles import DEFAULT, Roles
from evenfold.session import settle, with_scalars

# Environment classes a new condition may name.
ALLOWED_ENVIRONMENTS = ("air_or_oxygen", "water_oxygen", "vacuum")


def condition_frame(raw: DataFrame, sigma: str = "sigma_max", uts: str = "uts") -> DataFrame:
    """Derived columns of rows whose outcome is not known yet; rules are checked separately."""
    c = F.col
    d = raw.withColumn("env_class", X.label(c("env_class"))).withColumn("s_ratio", c(sigma) / c(uts))
    d = d.withColumns(D.loading_features(c("s_ratio"), c("r_ratio"), c("freq"), c(uts), c("temp_c")))
    return d.withColumns({
        "exposure": X.exposure(c("env_class")), "drive": D.thermal_drive(c("temp_c")),
        "env_allowed": c("env_class").isin(*ALLOWED_ENVIRONMENTS)})


@dataclass(frozen=True)
class Frozen:
    """Small tables of a model trained once: parameters, ranges, levels and condition cells.

    ``parameters`` has one row with the coefficients, ``scale`` and the empirical half-widths.
    """

    parameters: DataFrame
    ranges: DataFrame
    levels: dict[str, DataFrame]
    cells: DataFrame
    groups: DataFrame


NUMERIC = ("temp_c", "r_ratio", "freq", "s_ratio", "uts")
CATEGORIES = ("architecture", "env_class")
MATCH = ("temp_c", "r_ratio", "freq")


def freeze(train: DataFrame, parameters: DataFrame, numeric: tuple[str, ...] = NUMERIC, categories: tuple[str, ...] = CATEGORIES,
           match: tuple[str, ...] = MATCH, stress: str = "s_ratio", roles: Roles = DEFAULT) -> Frozen:
    """Keep what scoring needs from the training rows; the rows themselves are not kept."""
    ranges = train.agg(*[a for n in numeric for a in (F.min(n).alias(f"lo_{n}"), F.max(n).alias(f"hi_{n}"))])
    levels = {c: settle(train.select(c).distinct(), "levels") for c in categories}
    cells = train.groupBy(*categories, *match).agg(F.min(stress).alias("_s_lo"), F.max(stress).alias("_s_hi"))
    return Frozen(settle(parameters, "frozen"), settle(ranges, "ranges"), levels, settle(cells, "cells"),
                  settle(train.select(roles.group).distinct(), "groups"))


def _tolerance(v: Column) -> Column:
    return 1e-8 + 1e-5 * F.abs(v)


def domain_flags(frozen: Frozen, rows: DataFrame, key: str, stress: str = "s_ratio", numeric: tuple[str, ...] = NUMERIC,
                 categories: tuple[str, ...] = CATEGORIES, match: tuple[str, ...] = MATCH, out: str = "support_status") -> DataFrame:
    """Issue codes of every row against the training support, or a text for none.

    Conditions match within a relative tolerance. Values are put in buckets wider than it,
    and a row looks in the one or two buckets its tolerance reaches, so the match is an
    equi-join whatever the number of conditions.
    """
    d = with_scalars(rows, frozen.ranges)
    for c in categories:
        d = d.join(frozen.levels[c].withColumn(f"_has_{c}", F.lit(True)), c, "left")
    cells = frozen.cells.select(
        *categories, "_s_lo", "_s_hi", *[F.col(m).alias(f"_c_{m}") for m in match],
        *[value_bucket(F.col(m), 12).alias(f"_b_{m}") for m in match])
    look = d.select(key, *categories, *match)
    for m in match:
        tol = 1.1 * _tolerance(F.col(m))
        reach = F.array_distinct(F.array(value_bucket(F.col(m) - tol, 12), value_bucket(F.col(m), 12), value_bucket(F.col(m) + tol, 12)))
        look = look.withColumn(f"_b_{m}", F.explode(reach))
    hit = look.join(cells, [*categories, *[f"_b_{m}" for m in match]])
    for m in match:
        hit = hit.where(F.abs(F.col(m) - F.col(f"_c_{m}")) <= _tolerance(F.col(f"_c_{m}")))
    matched = hit.groupBy(key).agg(F.min("_s_lo").alias("_m_lo"), F.max("_s_hi").alias("_m_hi"))
    d = d.join(matched, key, "left")
    rules = {f"unseen_{c}": F.col(f"_has_{c}").isNull() for c in categories}
    rules |= {f"outside_{n}": (F.col(n) < F.col(f"lo_{n}")) | (F.col(n) > F.col(f"hi_{n}")) for n in numeric}
    rules["unseen_joint_conditions"] = F.col("_m_lo").isNull()
    rules["outside_matched_stress_range"] = (F.col(stress) < F.col("_m_lo")) | (F.col(stress) > F.col("_m_hi"))
    status = issue_list(rules, "within_recorded_support")
    return d.withColumn(out, status).drop(
        *[f"_has_{c}" for c in categories], *[f"{e}_{n}" for n in numeric for e in ("lo", "hi")], "_m_lo", "_m_hi")


def with_prediction(frozen: Frozen, rows: DataFrame, location: Column, family: str = "normal") -> DataFrame:
    """Location, scale, empirical and parametric intervals, and their back-transform.

    Only column expressions, so it serves batches and streams. ``location`` may use the
    parameter columns by name.
    """
    d = with_scalars(rows, frozen.parameters).withColumn("pred", location)
    cols: dict[str, Column] = {}
    for tag, tail in (("80", 0.1), ("90", 0.05)):
        low, high = L.interval(F.col("pred"), F.col(f"half{tag}"))
        cols |= {f"empirical_lower{tag}": low, f"empirical_upper{tag}": high,
                 f"prob_lower{tag}": L.quantile(family, F.col("pred"), F.col("scale"), tail),
                 f"prob_upper{tag}": L.quantile(family, F.col("pred"), F.col("scale"), 1.0 - tail)}
    d = d.withColumns(cols)
    clipped = F.abs("pred") > 300
    for n in cols:
        clipped = clipped | (F.abs(n) > 300)
    return d.withColumns({"median_life": D.power_of_ten(F.col("pred")), "conversion_clipped": clipped,
                          **{f"{n}_life": D.power_of_ten(F.col(n)) for n in cols}})


def score_conditions(frozen: Frozen, conditions: DataFrame, location: Column, key: str, outcome_columns: list[str],
                     roles: Roles = DEFAULT) -> DataFrame:
    """Batch scoring of new conditions: leak guard, prediction, support flags."""
    C.require(C.outcome_leak(conditions, outcome_columns, frozen.groups, key, roles), "conditions")
    return domain_flags(frozen, with_prediction(frozen, conditions, location), key)


def evaluate_outcomes(predictions: DataFrame, outcomes: DataFrame, key: str, life: str = "life", family: str = "normal",
                      roles: Roles = DEFAULT, check: bool = True) -> tuple[DataFrame, DataFrame]:
    """Join frozen predictions with what was observed; rows and scores with both weightings."""
    if check:
        C.require(C.outcome_table(outcomes, predictions, key, life), "outcomes")
    seen = outcomes.select(key, F.log10(life).alias(roles.y), X.parse_bool(F.col(roles.censored)).alias(roles.censored))
    rows = predictions.join(seen, key).withColumn(roles.event, ~F.col(roles.censored))
    rows = rows.withColumn("row_nll", L.row_loss(family, F.col(roles.y), F.col(roles.pred), F.col(roles.scale), F.col(roles.event)))
    intervals = {f"{kind}_coverage{t}": (f"{kind}_lower{t}", f"{kind}_upper{t}") for kind in ("empirical", "prob") for t in ("80", "90")}
    summary = two_weightings(rows, [], intervals, roles)
    pending = predictions.agg(F.count(F.lit(1)).alias("n_predicted"))
    return rows, with_scalars(summary, pending).withColumn("n_pending", F.col("n_predicted") - F.col("n_rows")).drop("n_predicted")
