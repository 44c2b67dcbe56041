"""Cluster bootstrap over per-group statistics, never over rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evenfold.functions.hashing import draw
from evenfold.operators.metrics import Term, group_composites, group_means, point_columns, point_terms
from evenfold.operators.ranks import hash_row_number
from evenfold.roles import DEFAULT, Roles
from evenfold.session import parallelism, settle

LOW, HIGH = 0.025, 0.975


def numbered(stats: DataFrame, scope: list[str], group: str, seed: int) -> DataFrame:
    """Number the groups of every scope from 0, in md5 order, ready for drawing."""
    ranked = hash_row_number(stats, scope, seed, group, "_rn")
    return settle(ranked.withColumn("_slot", F.col("_rn") - 1).drop("_rn"), "boot")


def replicates(stats: DataFrame, scope: list[str], group: str, values: list[str], reps: int, seed: int,
               prepared: bool = False) -> DataFrame:
    """Means of ``values`` over the groups drawn in each replicate.

    Every scope draws as many groups as it has, with replacement; a group drawn twice counts
    twice and a null value is left out of its mean. Scopes with the same number of groups
    get the same draws, so differences are paired.
    """
    spark = stats.sparkSession
    pool = stats if prepared else numbered(stats, scope, group, seed)
    sizes = pool.groupBy(*scope).agg(F.count(F.lit(1)).alias("_g"))
    # An explicit partition count keeps adaptive execution from merging the generator into one task.
    seats = (
        sizes.withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(reps))))
        .repartition(parallelism(spark), *scope, "rep")
        .withColumn("_seat", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_g") - 1)))
        .withColumn("_slot", F.pmod(draw(F.lit(seed), F.col("rep"), F.col("_seat")), F.col("_g")))
    )
    drawn = seats.select(*scope, "rep", "_slot").join(pool.select(*scope, "_slot", *values), [*scope, "_slot"])
    return drawn.groupBy(*scope, "rep").agg(*[F.avg(v).alias(v) for v in values])


def percentile_bounds(reps: DataFrame, scope: list[str], columns: dict[str, Column]) -> DataFrame:
    """2.5 % and 97.5 % linear quantiles over replicates; null draws are left out.

    A scope holds one row per replicate, a number the caller sets.
    """
    derived = reps.select(*scope, *[c.alias(n) for n, c in columns.items()])
    return derived.groupBy(*scope).agg(*[
        agg
        for n in columns
        for agg in (
            F.percentile(n, F.lit(LOW)).alias(f"{n}_lo"), F.percentile(n, F.lit(HIGH)).alias(f"{n}_hi"),
            F.count(n).alias(f"{n}_draws"))
    ])


def metric_groups(df: DataFrame, scope: list[str], roles: Roles = DEFAULT, composite: bool = True) -> DataFrame:
    events = df.where(F.col(roles.event))
    groups = group_means(events, scope, point_terms(roles), roles)
    if composite:
        groups = groups.join(group_composites(df, scope, roles), [*scope, roles.group])
    return groups


def _metric_columns(composite: bool) -> dict[str, Column]:
    return point_columns() | ({"gb_composite": F.col("composite")} if composite else {})


def metric_intervals(df: DataFrame, scope: list[str], reps: int, seed: int, roles: Roles = DEFAULT,
                     composite: bool = True) -> DataFrame:
    """Point metrics with cluster-bootstrap intervals."""
    groups = numbered(metric_groups(df, scope, roles, composite), scope, roles.group, seed)
    values = [*point_terms(roles), *(["composite"] if composite else [])]
    columns = _metric_columns(composite)
    means = groups.groupBy(*scope).agg(
        F.sum("n_events").alias("n_events"), F.count(F.lit(1)).alias("n_groups"), *[F.avg(v).alias(v) for v in values])
    point = means.select(*scope, "n_events", "n_groups", *[c.alias(n) for n, c in columns.items()])
    bounds = percentile_bounds(replicates(groups, scope, roles.group, values, reps, seed, prepared=True), scope, columns)
    bounds = bounds.drop(*[f"{n}_draws" for n in columns])
    return point.join(bounds, scope)


def require_pairs(others: DataFrame, base: DataFrame, scope: list[str], key: list[str], group: str) -> None:
    """Raise unless, in every scope, each key of ``others`` has the same groups as ``base``."""
    marked = others.select(*scope, *key, group).join(base.select(*scope, group, F.lit(1).alias("_base")), [*scope, group], "left")
    per_key = marked.groupBy(*scope, *key).agg(F.count(F.lit(1)).alias("_own"), F.count("_base").alias("_shared"))
    sizes = base.groupBy(*scope).agg(F.count(F.lit(1)).alias("_all"))
    joined = per_key.join(sizes, scope, "left") if scope else _beside(per_key, sizes)
    bad = joined.where((F.col("_own") != F.col("_shared")) | (F.coalesce("_all", F.lit(0)) != F.col("_shared"))).limit(3).collect()
    if bad:
        raise ValueError(f"groups without a partner: {[r.asDict() for r in bad]}")


def paired_effects(df: DataFrame, scope: list[str], proposed: str, reps: int, seed: int,
                   roles: Roles = DEFAULT, composite: bool = True,
                   metrics: tuple[str, ...] | None = None) -> DataFrame:
    """Gains of one model over each other model with paired cluster-bootstrap intervals.

    Error metrics: other minus proposed; R2 and share within 5: proposed minus other, so a
    positive gain always favours the proposed model. All pairs are drawn in one pass.
    """
    groups = metric_groups(df, [*scope, roles.model], roles, composite)
    values = [*point_terms(roles), *(["composite"] if composite else [])]
    groups = settle(groups.select(*scope, roles.model, roles.group, *values), "pairs")
    ours = groups.where(F.col(roles.model) == proposed).select(
        *scope, roles.group, *[F.col(v).alias(f"p_{v}") for v in values])
    others = groups.where(F.col(roles.model) != proposed)
    require_pairs(others, ours, scope, [roles.model], roles.group)
    both = others.join(ours, [*scope, roles.group])
    names = values + [f"p_{v}" for v in values]
    keys = [*scope, roles.model]
    pool = numbered(both, keys, roles.group, seed)

    def gains() -> dict[str, Column]:
        def of(prefix: str) -> dict[str, Column]:
            c = lambda v: F.col(prefix + v)
            variance = c("y2") - c("y1") * c("y1")
            out = {"rmse": F.sqrt(c("e2")), "mae": c("e1"),
                   "r2": F.when(variance > 0, 1.0 - c("e2") / variance), "f5": c("f5")}
            return out | ({"composite": c("composite")} if composite else {})
        other, mine = of(""), of("p_")
        higher_better = {"r2", "f5"}
        out = {n: (mine[n] - other[n]) if n in higher_better else (other[n] - mine[n]) for n in other}
        return {n: c for n, c in out.items() if metrics is None or n in metrics}

    columns = gains()
    point = pool.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_groups"), *[F.avg(v).alias(v) for v in names])
    point = point.select(*keys, "n_groups", *[c.alias(n) for n, c in columns.items()])
    bounds = percentile_bounds(replicates(pool, keys, roles.group, names, reps, seed, prepared=True), keys, columns)
    wide = point.join(bounds, keys)
    long = F.array(*[
        F.struct(F.lit(n).alias("effect"), F.col(n).alias("estimate"), F.col(f"{n}_lo").alias("lo"), F.col(f"{n}_hi").alias("hi"))
        for n in columns
    ])
    return wide.select(*keys, "n_groups", F.explode(long).alias("_e")).select(*keys, "n_groups", "_e.*")


def mean_intervals(groups: DataFrame, scope: list[str], group: str, values: list[str], reps: int, seed: int) -> DataFrame:
    """Interval of the plain mean over groups of already reduced values."""
    pool = numbered(groups, scope, group, seed)
    point = pool.groupBy(*scope).agg(F.count(F.lit(1)).alias("n_groups"), *[F.avg(v).alias(v) for v in values])
    bounds = percentile_bounds(
        replicates(pool, scope, group, values, reps, seed, prepared=True), scope, {v: F.col(v) for v in values})
    bounds = bounds.drop(*[f"{v}_draws" for v in values])
    joined = point.join(bounds, scope) if scope else _beside(point, bounds)
    if len(values) == 0:
        return joined
    # One group allows no interval.
    return joined.select(
        *scope, "n_groups", *values,
        *[F.when(F.col("n_groups") > 1, F.col(f"{v}_{e}")).alias(f"{v}_{e}") for v in values for e in ("lo", "hi")])


def _beside(a: DataFrame, b: DataFrame) -> DataFrame:
    from evenfold.session import with_scalars

    return with_scalars(a, b)


def difference_intervals(df: DataFrame, scope: list[str], key: str, reference: str, reps: int, seed: int,
                         roles: Roles = DEFAULT, loss: str = "row_nll") -> DataFrame:
    """Variant minus reference by plain row means inside groups (``group_mean`` scores).

    Point differences use the balanced weights of the score card. Event means are averaged
    over the drawn groups that have events; R2 is null without variance and such draws are
    left out of the quantiles.
    """
    event, err = F.col(roles.event), F.col(roles.pred) - F.col(roles.y)
    stats = df.groupBy(*scope, key, roles.group).agg(
        F.avg(F.when(event, err * err)).alias("e2"), F.avg(F.when(event, F.abs(err))).alias("e1"),
        F.avg(F.when(event, F.col(roles.y))).alias("y1"), F.avg(F.when(event, F.col(roles.y) * F.col(roles.y))).alias("y2"),
        F.avg(loss).alias("nll"))
    stats = settle(stats, "diff")
    values = ["e2", "e1", "y1", "y2", "nll"]
    base = stats.where(F.col(key) == reference).select(*scope, roles.group, *[F.col(v).alias(f"r_{v}") for v in values])
    others = stats.where(F.col(key) != reference)
    require_pairs(others, base, scope, [key], roles.group)
    both = others.join(base, [*scope, roles.group])

    def of(p: str) -> dict[str, Column]:
        c = lambda v: F.col(p + v)
        variance = c("y2") - c("y1") * c("y1")
        return {"gb_rmse": F.sqrt(c("e2")), "gb_mae": c("e1"),
                "gb_r2": F.when(variance > 1e-15, 1.0 - c("e2") / variance), "joint_nll": c("nll")}

    new, old = of(""), of("r_")
    columns = {n: new[n] - old[n] for n in new}
    keys = [*scope, key]
    reps_df = replicates(both, keys, roles.group, values + [f"r_{v}" for v in values], reps, seed)
    return percentile_bounds(reps_df, keys, columns)
