"""Probability study: summaries by scope, intervals and paired loss gains."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evenfold.operators import contracts as C
from evenfold.operators import metrics as M
from evenfold.operators.resample import mean_intervals, require_pairs
from evenfold.roles import DEFAULT, Roles
from evenfold.session import settle

OVERALL, LEVEL = "overall", "factor_level"


def by_scope(df: DataFrame, summary, roles: Roles = DEFAULT) -> DataFrame:
    """``summary(rows, keys)`` of all rows in their overall scope and, where they have a holdout, in that factor level too.

    A scope after the other: a task holds the sums of one and not those of both.
    """
    has_level = F.trim(F.coalesce(F.col(roles.holdout), F.lit(""))) != ""
    whole = df.withColumns({"level": F.lit(OVERALL), roles.holdout: F.lit("")})
    levels = df.where(has_level).withColumn("level", F.lit(LEVEL))
    if roles.holdout != "holdout":
        whole, levels = (d.withColumnRenamed(roles.holdout, "holdout") for d in (whole, levels))
    keys = ["level", roles.scenario, "holdout", roles.model]
    return summary(whole, keys).unionByName(summary(levels, keys))


def scoped_summaries(df: DataFrame, roles: Roles = DEFAULT, loss: str = "row_nll") -> DataFrame:
    """Probability summaries overall and per factor level; weights are those of each scope."""
    return by_scope(df, lambda rows, keys: M.probability_summary(rows, keys, roles, loss), roles)


def scoped_intervals(df: DataFrame, levels: tuple[float, ...] = (0.8, 0.9), roles: Roles = DEFAULT) -> DataFrame:
    return by_scope(df, lambda rows, keys: M.interval_summary(rows, keys, levels, roles), roles)


def paired_loss_gains(df: DataFrame, proposed: str, reps: int, seed: int, roles: Roles = DEFAULT,
                      loss: str = "row_nll") -> DataFrame:
    """Gain in balanced loss over each other model: mean over groups and its bootstrap interval."""
    groups = M.group_means(df, [roles.scenario, roles.model], {"nll": M.Term(F.col(loss))}, roles)
    groups = settle(groups.select(roles.scenario, roles.model, roles.group, "nll"), "nll")
    ours = groups.where(F.col(roles.model) == proposed).select(roles.scenario, roles.group, F.col("nll").alias("_p"))
    others = groups.where(F.col(roles.model) != proposed)
    require_pairs(others, ours, [roles.scenario], [roles.model], roles.group)
    both = others.join(ours, [roles.scenario, roles.group])
    delta = both.withColumn("gain", F.col("nll") - F.col("_p"))
    return mean_intervals(delta, [roles.scenario, roles.model], roles.group, ["gain"], reps, seed)


def probability_study(df: DataFrame, proposed: str, reps: int, seed: int, roles: Roles = DEFAULT) -> dict[str, DataFrame]:
    """All probability tables of a prediction fact table, after its contract holds."""
    C.require(C.prediction_contract(roles).violations(df), "prediction table")
    scored = M.with_row_loss(df, roles)
    return {
        "metrics": scoped_summaries(scored, roles), "intervals": scoped_intervals(scored, roles=roles),
        "groups": M.probability_by_group(scored, [roles.scenario, roles.model], roles),
        "paired": paired_loss_gains(scored, proposed, reps, seed, roles), "predictions": scored}
