"""Score tables built from the balanced means."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from evenfold.functions import families
from evenfold.operators import metrics as M
from evenfold.operators.quantiles import weighted_quantiles
from evenfold.operators.ranks import label_ranks
from evenfold.operators.weights import attach_stats
from evenfold.roles import DEFAULT, Roles
from evenfold.session import settle, with_scalars


def repeat_summary(df: DataFrame, keys: list[str], repeat: str, roles: Roles = DEFAULT) -> DataFrame:
    """Metrics per repeat, then their mean and sample deviation."""
    per = M.point_metrics(df, [*keys, repeat], roles)
    return per.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_repeats"),
        *[a for m in ("rmse", "mae") for a in (F.avg(f"gb_{m}").alias(f"{m}_mean"), F.stddev_samp(f"gb_{m}").alias(f"{m}_sd"))])


def unweighted_metrics(df: DataFrame, scope: list[str], roles: Roles = DEFAULT) -> DataFrame:
    err = F.col(roles.pred) - F.col(roles.y)
    return df.where(F.col(roles.event)).groupBy(*scope).agg(
        F.count(F.lit(1)).alias("n_events"), F.sqrt(F.avg(err * err)).alias("rmse"), F.avg(F.abs(err)).alias("mae"))


def source_gains(df: DataFrame, proposed: str, other: str, roles: Roles = DEFAULT) -> DataFrame:
    """RMSE of two models per source (equivalences equal within the source) with a short label."""
    err = F.col(roles.pred) - F.col(roles.y)
    rows = df.where(F.col(roles.event) & F.col(roles.model).isin(proposed, other))
    pairs = rows.groupBy(roles.source, roles.equiv).agg(
        F.count(F.when(F.col(roles.model) == proposed, 1)).alias("_n"),
        F.avg(F.when(F.col(roles.model) == proposed, err * err)).alias("_p"),
        F.avg(F.when(F.col(roles.model) == other, err * err)).alias("_o"))
    per = pairs.groupBy(roles.source).agg(
        F.sum("_n").alias("n_events"), F.sqrt(F.avg("_o")).alias("rmse_other"), F.sqrt(F.avg("_p")).alias("rmse_proposed"))
    per = settle(per, "gains")
    labels = label_ranks(per, roles.source, "S")
    return per.join(labels, roles.source).withColumn("gain", F.col("rmse_other") - F.col("rmse_proposed"))


def empirical_halfwidths(df: DataFrame, scope: list[str], levels: tuple[float, ...], roles: Roles = DEFAULT) -> DataFrame:
    """Weighted quantiles of absolute errors of events, every group weighing the same."""
    rows = df.where(F.col(roles.event)).select(
        *scope, roles.group, roles.row, F.abs(F.col(roles.y) - F.col(roles.pred)).alias("_v"))
    sizes = rows.groupBy(*scope, roles.group).agg(F.count(F.lit(1)).alias("_n"))
    weighted = attach_stats(rows, [*scope, roles.group], sizes).withColumn("_w", 1.0 / F.col("_n"))
    return weighted_quantiles(weighted, scope, F.col("_v"), F.col("_w"), F.col(roles.row), levels)


def fold_loss_margins(df: DataFrame, candidate: str, reference: str, fold: str, roles: Roles = DEFAULT,
                      loss: str = "row_nll", scope: list[str] | None = None) -> DataFrame:
    """Mean censored loss over folds against a reference, with the paired standard error."""
    scope = scope or []
    per = df.where(~F.col(roles.event)).groupBy(*scope, candidate, fold).agg(F.avg(loss).alias("_l"))
    base = per.where(F.col(candidate) == reference).select(*scope, fold, F.col("_l").alias("_r"))
    both = per.join(base, [*scope, fold])
    out = both.groupBy(*scope, candidate).agg(
        F.avg("_l").alias("loss"), F.avg("_r").alias("reference_loss"),
        F.when(F.count(F.lit(1)) > 1, F.stddev_samp(F.col("_l") - F.col("_r")) / F.sqrt(F.count(F.lit(1)))).otherwise(0.0).alias("margin"),
        F.count(F.lit(1)).alias("n_folds"))
    return out.withColumn("feasible", F.col("loss") <= F.col("reference_loss") + F.col("margin") + 1e-12)


def loss_decomposition(summary: DataFrame, scope: list[str], proposed: str, roles: Roles = DEFAULT) -> DataFrame:
    """Loss difference to every other model, split into its event and censored part."""
    parts = {"joint_nll": "joint_difference", "event_part_nll": "event_difference", "censored_part_nll": "censored_difference"}
    summary = settle(summary, "summary")
    ours = summary.where(F.col(roles.model) == proposed).select(*scope, *[F.col(c).alias(f"_p_{c}") for c in parts])
    both = summary.where(F.col(roles.model) != proposed).join(ours, scope)
    out = both.select(*scope, F.col(roles.model).alias("reference"), *[(F.col(f"_p_{c}") - F.col(c)).alias(n) for c, n in parts.items()])
    gap = F.abs(F.col("joint_difference") - F.col("event_difference") - F.col("censored_difference"))
    return out.withColumn("adds_up", gap <= 1e-12)


def subgroup_scores(df: DataFrame, factors: list[str], scope: list[str], roles: Roles = DEFAULT, loss: str | None = "row_nll",
                    intervals: dict[str, tuple[str, str]] | None = None) -> DataFrame:
    """Score card per level of each factor, long form, weights made anew in every level.

    The rows are settled, so that their losses are worked out once, and summed a factor after the
    other: a task holds the sums of one factor's levels and not those of all.
    """
    ends = [end for pair in (intervals or {}).values() for end in pair]
    used = dict.fromkeys([*factors, *scope, roles.group, roles.equiv, roles.event, roles.y, roles.pred, *([loss] if loss else []), *ends])
    rows = settle(df.select(*used), "subgroups")
    cards = [
        M.score_card(rows.withColumns({"factor": F.lit(f), "level": F.col(f).cast("string")}), ["factor", "level", *scope], roles, loss, intervals)
        for f in factors]
    return reduce(DataFrame.unionByName, cards)


def attribution(new: DataFrame, old: DataFrame, keys: list[str], roles: Roles = DEFAULT) -> DataFrame:
    """Where a lower squared error comes from: group-balanced gain of every cell and its share."""
    gain = F.pow(F.col("_old") - F.col(roles.y), F.lit(2.0)) - F.pow(F.col(roles.pred) - F.col(roles.y), F.lit(2.0))
    both = new.where(F.col(roles.event)).join(old.select(roles.row, F.col(roles.pred).alias("_old")), roles.row)
    cells = both.groupBy(*dict.fromkeys([*keys, roles.group])).agg(F.count(F.lit(1)).alias("n_events"), F.sum(gain).alias("_g"))
    cells = settle(cells, "gain")
    sizes = cells.groupBy(roles.group).agg(F.sum("n_events").alias("_m"))
    total = sizes.agg(F.count(F.lit(1)).alias("_k"))
    weighted = with_scalars(cells.join(sizes, roles.group), total).withColumn("gain_part", F.col("_g") / F.col("_m") / F.col("_k"))
    all_gain = weighted.agg(F.sum("gain_part").alias("_all"))
    return with_scalars(weighted, all_gain).select(*keys, "n_events", "gain_part", (F.col("gain_part") / F.col("_all")).alias("share"))


def response_summary(df: DataFrame, scope: list[str], response: str, roles: Roles = DEFAULT) -> DataFrame:
    """Balanced mean and mean size of a response, and its largest size."""
    r = F.col(response)
    pairs = df.groupBy(*scope, roles.group, roles.equiv).agg(
        F.avg(r).alias("_m"), F.avg(F.abs(r)).alias("_a"), F.max(F.abs(r)).alias("_x"))
    groups = pairs.groupBy(*scope, roles.group).agg(F.avg("_m").alias("_m"), F.avg("_a").alias("_a"), F.max("_x").alias("_x"))
    return groups.groupBy(*scope).agg(
        F.avg("_m").alias("mean_response"), F.avg("_a").alias("mean_abs_response"), F.max("_x").alias("max_abs_response"))


def interaction(wide: DataFrame, scope: list[str], both: str, first: str, second: str, base: str, roles: Roles = DEFAULT) -> DataFrame:
    """Balanced mean of both - first - second + base over already pivoted variants."""
    value = F.col(both) - F.col(first) - F.col(second) + F.col(base)
    means = M.balanced_means(wide, scope, {"contrast": M.Term(value)}, roles)
    return means.select(*scope, "n_rows", "contrast")


def two_weightings(df: DataFrame, scope: list[str], intervals: dict[str, tuple[str, str]], roles: Roles = DEFAULT,
                   loss: str = "row_nll") -> DataFrame:
    """Scores with equal rows and with equal groups, from one pass over the rows."""
    event, y = F.col(roles.event), F.col(roles.y)
    err = F.col(roles.pred) - y
    values = {"_l": F.col(loss)}
    on_events = {"_e2": err * err, "_e1": F.abs(err), "_f5": (F.abs(err) <= M.LOG5).cast("double"), "_y1": y, "_y2": y * y}
    for name, (low, high) in intervals.items():
        on_events[f"_c_{name}"] = families.covered(y, F.col(low), F.col(high)).cast("double")
    sums = df.groupBy(*scope, roles.group).agg(
        F.count(F.lit(1)).alias("_n"), F.sum(event.cast("long")).alias("_e"),
        *[F.sum(v).alias(n) for n, v in values.items()], *[F.sum(F.when(event, v)).alias(n) for n, v in on_events.items()])
    def row_equal(n: str, size: str):
        return F.sum(n) / F.sum(size)
    def group_equal(n: str, size: str):
        return F.avg(F.when(F.col(size) > 0, F.col(n) / F.col(size)))
    parts = []
    for label, mean in (("row_equal", row_equal), ("group_equal", group_equal)):
        m = {n: mean(n, "_n") for n in values} | {n: mean(n, "_e") for n in on_events}
        parts.append(F.struct(
            F.lit(label).alias("weighting"), m["_l"].alias("joint_nll"), F.sqrt(m["_e2"]).alias("rmse"), m["_e1"].alias("mae"),
            M.r2_of(m["_e2"], m["_y1"], m["_y2"]).alias("r2"), m["_f5"].alias("f5"), *[m[f"_c_{n}"].alias(n) for n in intervals]))
    out = sums.groupBy(*scope).agg(
        F.sum("_n").alias("n_rows"), F.sum("_e").alias("n_events"), F.count(F.lit(1)).alias("n_groups"), F.array(*parts).alias("_w"))
    return out.select(*scope, "n_rows", "n_events", "n_groups", F.explode("_w").alias("_x")).select("*", "_x.*").drop("_x")


def against_reference(df: DataFrame, scope: list[str], key: str, reference: str, columns: dict[str, str]) -> DataFrame:
    """Difference of each row to the row of a named reference in the same scope."""
    w = Window.partitionBy(*scope) if scope else Window.partitionBy(F.lit(0))
    is_ref = F.col(key) == reference
    return df.withColumns({out: F.col(c) - F.max(F.when(is_ref, F.col(c))).over(w) for c, out in columns.items()})
