"""Group-balanced scores.

A row weighs 1 / (rows of its equivalence within the group x equivalences of the group), so
every group has weight 1. A weighted mean is therefore the mean over groups of the mean over
equivalences of the row mean: three aggregations with map-side combine, no window and no
join, and the weights are by construction those of the scope and subset at hand.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evenfold.functions import families
from evenfold.operators.quantiles import linear_quantiles
from evenfold.roles import DEFAULT, Roles

LOG3 = math.log10(3.0)
LOG5 = math.log10(5.0)
VARIANCE_FLOOR = 1e-15


@dataclass(frozen=True)
class Term:
    """A value to average over the rows where ``member`` holds (all rows if None)."""

    value: Column
    member: Column | None = None

    def column(self) -> Column:
        return self.value if self.member is None else F.when(self.member, self.value)


def group_means(df: DataFrame, scope: list[str], terms: dict[str, Term], roles: Roles = DEFAULT) -> DataFrame:
    """Per scope and group: means over equivalences of row means, and row counts."""
    event = F.col(roles.event)
    pairs = df.groupBy(*scope, roles.group, roles.equiv).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.sum(event.cast("long")).alias("n_events"),
        *[F.avg(t.column()).alias(name) for name, t in terms.items()],
    )
    return pairs.groupBy(*scope, roles.group).agg(
        F.sum("n_rows").alias("n_rows"),
        F.sum("n_events").alias("n_events"),
        F.count(F.lit(1)).alias("n_equivs"),
        *[F.avg(name).alias(name) for name in terms],
    )


def across_groups(groups: DataFrame, scope: list[str], names: list[str]) -> DataFrame:
    has_event = F.col("n_events") > 0
    has_censored = F.col("n_rows") > F.col("n_events")
    return groups.groupBy(*scope).agg(
        F.sum("n_rows").alias("n_rows"),
        F.sum("n_events").alias("n_events"),
        F.sum(F.col("n_rows") - F.col("n_events")).alias("n_censored"),
        F.count(F.lit(1)).alias("n_groups"),
        F.count(F.when(has_event, 1)).alias("n_event_groups"),
        F.count(F.when(has_censored, 1)).alias("n_censored_groups"),
        F.sum("n_equivs").alias("n_equivs"),
        *[F.avg(name).alias(name) for name in names],
    )


def balanced_means(df: DataFrame, scope: list[str], terms: dict[str, Term], roles: Roles = DEFAULT) -> DataFrame:
    return across_groups(group_means(df, scope, terms, roles), scope, list(terms))


COUNTS = ("n_rows", "n_events", "n_censored", "n_groups", "n_event_groups", "n_censored_groups", "n_equivs")


def point_terms(roles: Roles = DEFAULT) -> dict[str, Term]:
    event = F.col(roles.event)
    err = F.col(roles.pred) - F.col(roles.y)
    return {
        "e2": Term(err * err, event),
        "e1": Term(F.abs(err), event),
        "f5": Term((F.abs(err) <= LOG5).cast("double"), event),
        "y1": Term(F.col(roles.y), event),
        "y2": Term(F.col(roles.y) * F.col(roles.y), event),
    }


def r2_of(e2: Column, y1: Column, y2: Column, floor: float = 0.0) -> Column:
    variance = y2 - y1 * y1
    return F.when(variance > floor, 1.0 - e2 / variance)


def point_columns(floor: float = 0.0) -> dict[str, Column]:
    return {
        "gb_rmse": F.sqrt("e2"),
        "gb_mae": F.col("e1"),
        "gb_r2": r2_of(F.col("e2"), F.col("y1"), F.col("y2"), floor),
        "gb_f5": F.col("f5"),
    }


def point_metrics(df: DataFrame, scope: list[str], roles: Roles = DEFAULT) -> DataFrame:
    """RMSE, MAE, R2 and share within a factor of five, on events."""
    means = balanced_means(df.where(F.col(roles.event)), scope, point_terms(roles), roles)
    return means.select(
        *scope, "n_events", "n_groups", *[c.alias(n) for n, c in point_columns().items()]
    )


def group_composites(df: DataFrame, scope: list[str], roles: Roles = DEFAULT) -> DataFrame:
    """Composite error of every group in [0, 1]; rows are unweighted inside a group."""
    events = df.where(F.col(roles.event))
    err = F.col(roles.pred) - F.col(roles.y)
    keys = [*scope, roles.group]
    sums = events.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"),
        F.avg(err * err).alias("_e2"),
        F.avg(F.abs(err)).alias("_e1"),
        F.avg((F.abs(err) > LOG3).cast("double")).alias("_t3"),
        F.avg((F.abs(err) > LOG5).cast("double")).alias("_t5"),
        F.avg(err).alias("_b"),
    )
    ends = linear_quantiles(events, keys, F.col(roles.y), (0.05, 0.95))
    spread = ends.groupBy(*keys).agg(
        (F.max(F.when(F.col("q") == 0.95, F.col("value"))) - F.max(F.when(F.col("q") == 0.05, F.col("value")))).alias("_range")
    )
    width = F.when(F.col("_n") > 1, F.col("_range")).otherwise(1.0)
    scale = F.greatest(width, F.lit(LOG5))
    one = F.lit(1.0)
    composite = (
        F.least(F.sqrt("_e2") / scale, one) + F.least(F.col("_e1") / scale, one)
        + F.col("_t3") + F.col("_t5") + F.least(F.abs("_b") / scale, one)
    ) / 5.0
    return sums.join(spread, keys).select(*keys, composite.alias("composite"))


def score_card(df: DataFrame, scope: list[str], roles: Roles = DEFAULT,
               loss: str | None = "row_nll", intervals: dict[str, tuple[str, str]] | None = None) -> DataFrame:
    """Point scores on events, interval coverage, and the loss split that adds up.

    Event metrics use weights of the event subset; the joint loss and its event and censored
    parts use the weights of all rows, so the parts add up to the joint loss.
    """
    event = F.col(roles.event)
    err = F.col(roles.pred) - F.col(roles.y)
    terms = point_terms(roles)
    terms["bias"] = Term(err, event)
    terms["over10"] = Term((err > 1.0).cast("double"), event)
    extra: dict[str, Column] = {
        "gb_bias": F.col("bias"),
        "gb_over_factor10": F.col("over10"),
        "geometric_factor": F.pow(F.lit(10.0), F.col("e1")),
    }
    for name, (low, high) in (intervals or {}).items():
        terms[f"{name}_coverage"] = Term(families.covered(F.col(roles.y), F.col(low), F.col(high)).cast("double"), event)
        terms[f"{name}_width"] = Term(F.col(high) - F.col(low), event)
        extra |= {f"{name}_coverage": F.col(f"{name}_coverage"), f"{name}_width": F.col(f"{name}_width")}
    if loss is not None:
        terms["joint_nll"] = Term(F.col(loss))
        terms["event_nll_part"] = Term(F.when(event, F.col(loss)).otherwise(0.0))
        terms["censored_nll_part"] = Term(F.when(event, 0.0).otherwise(F.col(loss)))
        extra |= {n: F.col(n) for n in ("joint_nll", "event_nll_part", "censored_nll_part")}
    means = balanced_means(df, scope, terms, roles)
    return means.select(
        *scope, "n_rows", "n_events", "n_censored", "n_groups", "n_event_groups",
        *[c.alias(n) for n, c in point_columns(VARIANCE_FLOOR).items()],
        *[c.alias(n) for n, c in extra.items()],
    )


# ---------------------------------------------------------------- probability summaries

def probability_terms(roles: Roles, loss: str) -> dict[str, Term]:
    event, censored = F.col(roles.event), ~F.col(roles.event)
    terms = point_terms(roles)
    terms |= {
        "joint_nll": Term(F.col(loss)),
        "event_part": Term(F.when(event, F.col(loss)).otherwise(0.0)),
        "censored_part": Term(F.when(censored, F.col(loss)).otherwise(0.0)),
        "event_mass": Term(event.cast("double")),
        "event_nll": Term(F.col(loss), event),
        "censored_nll": Term(F.col(loss), censored),
    }
    return terms


def _probability_columns() -> dict[str, Column]:
    censored_mass = 1.0 - F.col("event_mass")
    return {
        "joint_nll": F.col("joint_nll"),
        "event_part_nll": F.col("event_part"),
        "censored_part_nll": F.col("censored_part"),
        "event_mass": F.col("event_mass"),
        "censored_mass": censored_mass,
        "conditional_event_nll": F.when(F.col("n_events") > 0, F.col("event_part") / F.col("event_mass")),
        "conditional_censored_nll": F.when(F.col("n_censored") > 0, F.col("censored_part") / censored_mass),
        "rebalanced_event_nll": F.col("event_nll"),
        "rebalanced_censored_nll": F.col("censored_nll"),
        "gb_mse": F.col("e2"),
        **point_columns(),
    }


def probability_summary(df: DataFrame, scope: list[str], roles: Roles = DEFAULT, loss: str = "row_nll") -> DataFrame:
    """Joint loss, parts that add up, conditional and re-balanced losses, masses, counts."""
    means = balanced_means(df, scope, probability_terms(roles, loss), roles)
    return means.select(*scope, *COUNTS, *[c.alias(n) for n, c in _probability_columns().items()])


def probability_by_group(df: DataFrame, scope: list[str], roles: Roles = DEFAULT, loss: str = "row_nll") -> DataFrame:
    """The same summary inside every group."""
    means = group_means(df, scope, probability_terms(roles, loss), roles)
    means = means.withColumn("n_censored", F.col("n_rows") - F.col("n_events"))
    return means.select(
        *scope, roles.group, "n_rows", "n_events", "n_censored", "n_equivs",
        *[c.alias(n) for n, c in _probability_columns().items()],
    )


def level_terms(levels: tuple[float, ...], roles: Roles) -> dict[str, Term]:
    terms: dict[str, Term] = {}
    event, y = F.col(roles.event), F.col(roles.y)
    for level in levels:
        tag = f"{100 * level:g}"
        tail = (1.0 - level) / 2.0
        args = (F.col(roles.family), F.col(roles.pred), F.col(roles.scale))
        low, high = families.quantile_by_name(*args, tail), families.quantile_by_name(*args, 1.0 - tail)
        terms[f"coverage_{tag}"] = Term(families.covered(y, low, high).cast("double"), event)
        terms[f"width_all_{tag}"] = Term(high - low)
        terms[f"width_events_{tag}"] = Term(high - low, event)
    return terms


def interval_summary(df: DataFrame, scope: list[str], levels: tuple[float, ...] = (0.8, 0.9),
                     roles: Roles = DEFAULT) -> DataFrame:
    """Central parametric intervals: coverage on events, width on all rows and on events."""
    if not levels or len(set(levels)) != len(levels) or not all(0 < level < 1 for level in levels):
        raise ValueError("levels must be distinct and lie between 0 and 1")
    means = balanced_means(df, scope, level_terms(levels, roles), roles)
    per_level = F.array(*[
        F.struct(
            F.lit(float(level)).alias("nominal"),
            F.col(f"coverage_{100 * level:g}").alias("coverage"),
            F.col(f"width_all_{100 * level:g}").alias("width_all"),
            F.col(f"width_events_{100 * level:g}").alias("width_events"),
        )
        for level in levels
    ])
    return means.select(
        *scope, "n_rows", "n_events", "n_censored", "n_groups", "n_event_groups", F.explode(per_level).alias("_l")
    ).select("*", "_l.*").drop("_l")


def with_row_loss(df: DataFrame, roles: Roles = DEFAULT, out: str = "row_nll") -> DataFrame:
    return df.withColumn(out, families.row_loss_by_name(
        F.col(roles.family), F.col(roles.y), F.col(roles.pred), F.col(roles.scale), F.col(roles.event)))


# ---------------------------------------------------------------- other scores

def hinge_rmse(df: DataFrame, scope: list[str], roles: Roles = DEFAULT) -> DataFrame:
    """How far predictions fall below the limits of censored rows; 0 without such rows."""
    short = F.greatest(F.col(roles.y) - F.col(roles.pred), F.lit(0.0))
    means = balanced_means(df, scope, {"h2": Term(short * short, ~F.col(roles.event))}, roles)
    return means.select(*scope, "n_censored", F.sqrt(F.coalesce("h2", F.lit(0.0))).alias("hinge_rmse"))


def censored_audit(df: DataFrame, scope: list[str], flags: list[str], roles: Roles = DEFAULT,
                   loss: str = "row_nll") -> DataFrame:
    """Censored rows only: balanced survival loss, share of predictions below the limit
    (row share inside a group, then mean over groups), and whether flags hold for all rows."""
    rows = df.where(~F.col(roles.event))
    below = (F.col(roles.pred) < F.col(roles.y)).cast("double")
    # The rate weighs rows, the loss weighs equivalences: one pass over pairs serves both.
    pairs = rows.groupBy(*scope, roles.group, roles.equiv).agg(
        F.count(F.lit(1)).alias("_n"), F.avg(loss).alias("_loss"), F.sum(below).alias("_below"),
        *[F.bool_and(f).alias(f) for f in flags])
    groups = pairs.groupBy(*scope, roles.group).agg(
        F.sum("_n").alias("_n"), F.avg("_loss").alias("_loss"), (F.sum("_below") / F.sum("_n")).alias("_rate"),
        *[F.bool_and(f).alias(f) for f in flags])
    return groups.groupBy(*scope).agg(
        F.sum("_n").alias("n_censored"), F.count(F.lit(1)).alias("n_groups"),
        F.avg("_loss").alias("survival_nll"), F.avg("_rate").alias("below_limit_rate"),
        *[F.bool_and(f).alias(f) for f in flags])


def plain_losses(df: DataFrame, scope: list[str], loss: str = "row_nll", weight: str | None = None,
                 censored_power: float = 1.0, roles: Roles = DEFAULT) -> DataFrame:
    """Record-weighted joint, event and censored loss, the objective of the location fits."""
    if censored_power < 0:
        raise ValueError("censored_power must not be negative")
    event = F.col(roles.event)
    value = F.when(event, F.col(loss)).otherwise(F.col(loss) * censored_power)
    w = F.lit(1.0) if weight is None else F.col(weight)
    def mean(member: Column | None) -> Column:
        if member is None:
            return F.sum(w * value) / F.sum(w)
        return F.sum(F.when(member, w * value)) / F.sum(F.when(member, w))
    return df.groupBy(*scope).agg(
        mean(None).alias("joint_nll"), mean(event).alias("event_nll"), mean(~event).alias("censored_nll"))


def empirical_interval_summary(df: DataFrame, scope: list[str], low: str, high: str, level: float,
                               roles: Roles = DEFAULT) -> DataFrame:
    """Coverage, width and interval score on events: row means inside groups, then over groups."""
    return across_interval_groups(empirical_interval_groups(df, scope, low, high, level, roles), scope)


def empirical_interval_groups(df: DataFrame, scope: list[str], low: str, high: str, level: float,
                              roles: Roles = DEFAULT) -> DataFrame:
    y, lo, hi = F.col(roles.y), F.col(low), F.col(high)
    return df.where(F.col(roles.event)).groupBy(*scope, roles.group).agg(
        F.count(F.lit(1)).alias("n_events"),
        F.count(F.when(lo.isNotNull() & hi.isNotNull(), 1)).alias("n_intervals"),
        F.avg(families.covered(y, lo, hi).cast("double")).alias("coverage"),
        F.avg(hi - lo).alias("width"),
        F.avg(families.interval_score(y, lo, hi, level)).alias("interval_score"),
    )


def across_interval_groups(groups: DataFrame, scope: list[str]) -> DataFrame:
    return groups.groupBy(*scope).agg(
        F.sum("n_events").alias("n_events"), F.count(F.lit(1)).alias("n_groups"),
        (F.sum("n_intervals") / F.sum("n_events")).alias("interval_completeness"),
        F.avg("coverage").alias("coverage"), F.avg("width").alias("width"),
        F.avg("interval_score").alias("interval_score"))
