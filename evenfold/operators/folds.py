"""Group-disjoint folds, record folds, holdout plans and their memberships."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evenfold.operators.ranks import bucketed_row_number, hash_row_number
from evenfold.roles import DEFAULT, Roles
from evenfold.session import local_table, settle, with_scalars

SEGMENTS = T.StructType([
    T.StructField("n", T.LongType()), T.StructField("first", T.LongType()),
    T.StructField("last", T.LongType()), T.StructField("folds", T.ArrayType(T.IntegerType())),
])


def deal_equal_sizes(runs: list[tuple[int, int]], k: int) -> list[tuple[int, int, int, list[int]]]:
    """Where the greedy least-loaded rule puts each of ``count`` groups of size ``size``.

    ``runs`` lists (size, count), largest size first. While groups of one size are dealt, a
    fold takes its j-th group when the smallest load is load + j * size, so the folds join in
    a fixed rotation: first the lightest alone, then the two lightest in turn, and so on.
    Each run needs at most ``k`` rotations, given as (size, first, last, folds in turn) with
    positions counted from 0 inside the run.
    """
    load = [0] * k
    out = []
    for size, count in runs:
        level = [f // size for f in load]
        turn = sorted(range(k), key=lambda f: (load[f] % size, f))
        steps = sorted(set(level))
        done = 0
        for i, start in enumerate(steps):
            if done == count:
                break
            active = [f for f in turn if level[f] <= start]
            room = count - done
            if i + 1 < len(steps):
                room = min(room, (steps[i + 1] - start) * len(active))
            out.append((size, done, done + room - 1, active))
            whole, rest = divmod(room, len(active))
            for pos, f in enumerate(active):
                load[f] += size * (whole + (pos < rest))
            done += room
    return out


def greedy_group_folds(df: DataFrame, k: int, seed: int, roles: Roles = DEFAULT, scope: list[str] | None = None) -> DataFrame:
    """Group to fold: groups by size, largest first, each to the least loaded fold.

    Groups of equal size are ordered by md5(seed|group), equal loads go to the lowest fold.
    The driver only sees the histogram of group sizes, which has at most sqrt(2 x rows)
    entries; groups are ranked and looked up in parallel.
    """
    scope = scope or []
    sizes = df.groupBy(*scope, roles.group).agg(F.count(F.lit(1)).alias("n_rows"))
    return deal_sized_groups(sizes, "n_rows", k, seed, scope, roles)


def deal_sized_groups(groups: DataFrame, size: str, k: int, seed: int, scope: list[str],
                      roles: Roles = DEFAULT) -> DataFrame:
    """The greedy rule for a table of one row per group, separately in every scope."""
    groups = settle(groups.withColumnRenamed(size, "n"), "sizes")
    runs: dict[tuple, list[tuple[int, int]]] = {}
    for r in groups.groupBy(*scope, "n").agg(F.count(F.lit(1)).alias("c")).toLocalIterator():
        runs.setdefault(tuple(r[s] for s in scope), []).append((r["n"], r["c"]))
    rows = []
    for key, part in runs.items():
        part.sort(reverse=True)
        rows += [(*key, *seg) for seg in deal_equal_sizes(part, min(k, sum(c for _, c in part)))]
    plan = local_table(groups.sparkSession, rows, T.StructType([groups.schema[s] for s in scope] + SEGMENTS.fields))
    tagged = groups.withColumn("_h", F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(roles.group).cast("string"))))
    part = [*scope, "n"]
    ranked = bucketed_row_number(tagged, part, F.substring("_h", 1, 3), [F.col("_h"), F.col(roles.group)], "_rank")
    at = F.col("_rank") - 1
    hit = ranked.join(plan, part).where((at >= F.col("first")) & (at <= F.col("last")))
    pick = F.element_at("folds", (F.pmod(at - F.col("first"), F.size("folds")) + 1).cast("int"))
    return (hit.withColumn("fold", pick + 1).drop("_h", "_rank", "first", "last", "folds")
            .withColumnRenamed("n", size))


def with_folds(df: DataFrame, fold_map: DataFrame, roles: Roles = DEFAULT) -> DataFrame:
    """Put the fold of its group on every row; a group without a fold stays null."""
    return df.join(fold_map.select(roles.group, "fold"), roles.group, "left")


def fold_problems(df: DataFrame, roles: Roles = DEFAULT) -> DataFrame:
    """Folds without events inside or outside, which cannot be evaluated."""
    per = df.groupBy("fold").agg(F.sum(F.col(roles.event).cast("long")).alias("inside"))
    total = per.agg(F.sum("inside").alias("total"))
    both = per.withColumn("total", total.scalar())
    return both.where((F.col("inside") == 0) | (F.col("inside") == F.col("total"))).select(
        "fold", F.when(F.col("inside") == 0, "no_events_in_test").otherwise("no_events_in_training").alias("reason"))


def record_folds(df: DataFrame, k: int, seed: int, roles: Roles = DEFAULT) -> DataFrame:
    """Shuffle records by md5(seed|row) and deal them round robin."""
    ranked = hash_row_number(df, [], seed, roles.row, "_rn")
    return ranked.withColumn("fold", (F.pmod(F.col("_rn") - 1, F.lit(k)) + 1).cast("int")).drop("_rn")


def unknown_groups(df: DataFrame, fold_map: DataFrame, roles: Roles = DEFAULT) -> DataFrame:
    """Groups of ``df`` that a fixed fold map does not name."""
    return df.select(roles.group).distinct().join(fold_map.select(roles.group), roles.group, "left_anti")


def membership(df: DataFrame, k: int, keep: list[str]) -> DataFrame:
    """(task, row, role): every record once per outer fold, as test or train."""
    tasks = F.explode(F.sequence(F.lit(1), F.lit(k)))
    return df.select(*keep, "fold", tasks.alias("task")).select(
        "task", *keep, F.when(F.col("fold") == F.col("task"), "test").otherwise("train").alias("role"))


def long_factors(df: DataFrame, factors: dict[str, str], keep: list[str]) -> DataFrame:
    """One row per record and factor; ``factors`` maps a scenario name to a column."""
    levels = F.array(*[
        F.struct(F.lit(s).alias("scenario"), F.lit(c).alias("factor"), F.col(c).cast("string").alias("level"))
        for s, c in factors.items()
    ])
    return df.select(*keep, F.explode(levels).alias("_f")).select(*keep, "_f.*")


def level_holdouts(df: DataFrame, factors: dict[str, str], roles: Roles = DEFAULT) -> DataFrame:
    """Leave-one-level-out plan; levels without events on either side are dropped."""
    long = long_factors(df, factors, [roles.group, roles.event])
    per = long.groupBy("scenario", "factor", "level").agg(
        F.count(F.lit(1)).alias("n_test"), F.sum(F.col(roles.event).cast("long")).alias("test_events"))
    total = per.groupBy("scenario").agg(F.sum("n_test").alias("_n"), F.sum("test_events").alias("_e"))
    both = per.join(total, "scenario")
    return both.where((F.col("test_events") > 0) & (F.col("_e") > F.col("test_events"))).select(
        "scenario", "factor", "level", "n_test", "test_events",
        (F.col("_n") - F.col("n_test")).alias("n_train"), (F.col("_e") - F.col("test_events")).alias("train_events"))


def strict_holdouts(df: DataFrame, factors: dict[str, str], min_groups: int = 4, inner_folds: int = 4,
                    seed: int = 0, roles: Roles = DEFAULT) -> DataFrame:
    """Holdout plan that also drops training rows of every group seen in the test part.

    All counts come from the reduced (factor, level, group) table, so the records are read
    once. Action: ``refit`` if rows were dropped, ``reuse`` if not, ``not_estimable`` with a
    reason otherwise; tasks are never left out.
    """
    cells = long_factors(df, factors, [roles.group, roles.event]).groupBy(
        "scenario", "factor", "level", roles.group).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col(roles.event).cast("long")).alias("e"))
    cells = settle(cells, "cells")
    groups = df.groupBy(roles.group).agg(F.count(F.lit(1)).alias("gn"), F.sum(F.col(roles.event).cast("long")).alias("ge"))
    groups = settle(groups, "groups")
    whole = groups.agg(F.sum("gn").alias("all_n"), F.sum("ge").alias("all_e"), F.count(F.lit(1)).alias("all_g"))
    seen = cells.join(groups, roles.group).groupBy("scenario", "factor", "level").agg(
        F.sum("n").alias("n_test"), F.sum("e").alias("test_events"),
        F.sum("gn").alias("_gn"), F.sum("ge").alias("_ge"), F.count(F.lit(1)).alias("n_test_groups"))
    plan = with_scalars(seen, whole).select(
        "scenario", "factor", "level", "n_test", "test_events", "n_test_groups",
        (F.col("all_n") - F.col("n_test")).alias("n_train_original"),
        (F.col("all_n") - F.col("_gn")).alias("n_train"),
        (F.col("all_e") - F.col("_ge")).alias("train_events"),
        (F.col("all_g") - F.col("n_test_groups")).alias("n_train_groups"))
    infeasible = _inner_problems(plan, cells, groups, inner_folds, seed, min_groups, roles)
    plan = plan.join(infeasible, ["scenario", "level"], "left")
    reason = (
        F.when(F.col("n_train_groups") < min_groups, "too_few_training_groups")
        .when((F.col("train_events") == 0) | (F.col("test_events") == 0), "no_events_on_a_side")
        .when(F.col("_inner_bad"), "inner_folds_not_feasible")
    )
    removed = F.col("n_train_original") - F.col("n_train")
    return plan.select(
        "scenario", "factor", "level", "n_test", "n_test_groups", "n_train_original", "n_train", "n_train_groups",
        removed.alias("n_removed"), F.coalesce(reason, F.lit("")).alias("reason"),
        F.when(reason.isNotNull(), "not_estimable").when(removed > 0, "refit").otherwise("reuse").alias("action"))


def _inner_problems(plan: DataFrame, cells: DataFrame, groups: DataFrame, k: int, seed: int, min_groups: int,
                    roles: Roles) -> DataFrame:
    """Tasks whose greedy inner folds have no events on some side.

    A task trains on the groups that its level does not touch. The list of (task, group) is
    the complement of the observed cells, so it is as long as tasks x groups.
    """
    tasks = plan.where(F.col("n_train_groups") >= min_groups).select("scenario", "level")
    task_array = tasks.agg(F.collect_list(F.struct("scenario", "level")).alias("_tasks"))
    members = with_scalars(groups, task_array).select(
        roles.group, "gn", "ge", F.explode("_tasks").alias("_t")).select(roles.group, "gn", "ge", "_t.*")
    members = members.join(cells.select("scenario", "level", roles.group), ["scenario", "level", roles.group], "left_anti")
    inner = deal_sized_groups(members, "gn", k, seed, ["scenario", "level"], roles)
    per = inner.groupBy("scenario", "level", "fold").agg(F.sum("ge").alias("inside"))
    # A fold without events, or one that holds all of them, cannot be used.
    return per.groupBy("scenario", "level").agg(
        ((F.min("inside") == 0) | (F.max("inside") == F.sum("inside"))).alias("_inner_bad"))


def repeated_splits(df: DataFrame, strategies: dict[str, str | None], k: int, seeds: list[int],
                    roles: Roles = DEFAULT) -> DataFrame:
    """(strategy, repeat, row, fold) for each strategy and seed.

    A strategy names the column whose values stay together, or None for single records.
    What the splits need of the records is settled first, so that they are read and joined once.
    """
    parts = []
    df = settle(df.select(*dict.fromkeys([roles.row, *[c for c in strategies.values() if c is not None]])), "splits")
    for strategy, column in strategies.items():
        for repeat, seed in enumerate(seeds, 1):
            if column is None:
                part = record_folds(df.select(roles.row), k, seed, roles)
            else:
                sub = roles.but(group=column)
                fold_map = greedy_group_folds(df.select(roles.row, column), k, seed, sub)
                part = with_folds(df.select(roles.row, column), fold_map, sub)
            parts.append(part.select(
                F.lit(strategy).alias("strategy"), F.lit(repeat).alias("repeat"), roles.row, F.col("fold").cast("int").alias("fold")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
