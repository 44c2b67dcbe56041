"""Support counts, grids, overlap reports and audit tables."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evenfold.functions import text as X
from evenfold.operators.joins import left_zero, nearest_point_distance
from evenfold.operators.weights import attach_stats
from evenfold.roles import DEFAULT, Roles
from evenfold.session import settle, with_scalars

COUNT_COLUMNS = ("n_rows", "n_events", "n_censored", "n_groups", "n_sources", "n_event_groups", "n_censored_groups")


def reduced_cells(df: DataFrame, keys: list[str], roles: Roles = DEFAULT) -> DataFrame:
    """Rows and events per (keys, group, source): all distinct counts are taken from this."""
    return df.groupBy(*keys, roles.group, roles.source).agg(
        F.count(F.lit(1)).alias("_n"), F.sum(F.col(roles.event).cast("long")).alias("_e"))


def _counts_of(cells: DataFrame, keys: list[str], roles: Roles) -> DataFrame:
    has_event, has_censored = F.col("_e") > 0, F.col("_n") > F.col("_e")
    out = cells.groupBy(*keys).agg(
        F.sum("_n").alias("n_rows"), F.sum("_e").alias("n_events"), F.sum(F.col("_n") - F.col("_e")).alias("n_censored"),
        F.countDistinct(roles.group).alias("n_groups"), F.countDistinct(roles.source).alias("n_sources"),
        F.countDistinct(F.when(has_event, F.col(roles.group))).alias("n_event_groups"),
        F.countDistinct(F.when(has_censored, F.col(roles.group))).alias("n_censored_groups"))
    return out.withColumns({
        "censored_fraction": F.col("n_censored") / F.col("n_rows"),
        "single_group": F.col("n_groups") == 1, "few_rows": F.col("n_rows") < 10})


def support_counts(df: DataFrame, keys: list[str], roles: Roles = DEFAULT) -> DataFrame:
    return _counts_of(reduced_cells(df, keys, roles), keys, roles)


def factor_tables(df: DataFrame, factors: list[str], ways: int = 2, roles: Roles = DEFAULT) -> DataFrame:
    """Support counts for every combination of ``ways`` factors, in long form.

    The records are read once; the combinations work on the reduced cells of all factors.
    """
    cells = settle(reduced_cells(df, factors, roles), "cells")
    sets = [list(s) for s in combinations(factors, ways)]
    parts = F.array(*[
        F.struct(F.lit(",".join(s)).alias("factors"), F.concat_ws("|", *[F.col(c).cast("string") for c in s]).alias("levels"))
        for s in sets])
    long = cells.select(roles.group, roles.source, "_n", "_e", F.explode(parts).alias("_f")).select("*", "_f.*")
    # Cells of several source-group pairs may fall together now.
    merged = long.groupBy("factors", "levels", roles.group, roles.source).agg(F.sum("_n").alias("_n"), F.sum("_e").alias("_e"))
    return _counts_of(merged, ["factors", "levels"], roles)


def full_grid(df: DataFrame, factors: list[str], counts: DataFrame) -> DataFrame:
    """All combinations of observed levels, with zeros and a flag for the empty ones."""
    levels = df.agg(*[F.collect_set(f).alias(f"_{f}") for f in factors])
    grid = levels
    for f in factors:
        grid = grid.select("*", F.explode(f"_{f}").alias(f))
    grid = grid.select(*factors)
    numbers = [c for c in counts.columns if c.startswith("n_")]
    return left_zero(grid, counts.select(*factors, *numbers), factors, numbers).withColumn("observed", F.col("n_rows") > 0)


def ranges(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(*[
        a for c in columns for a in (F.min(c).alias(f"{c}_min"), F.max(c).alias(f"{c}_max"))])


def split_overlap(members: DataFrame, roles: Roles = DEFAULT) -> DataFrame:
    """Per task: sizes, groups on both sides, their list, and training rows after a purge.

    ``members`` is a (task, row, role) relation with the group. The list of overlapping
    groups is built from sorted distinct group names of one task.
    """
    test = (F.col("role") == "test").cast("long")
    per = members.groupBy("task", roles.group).agg(F.sum(test).alias("_te"), F.sum(1 - test).alias("_tr"))
    both = (F.col("_te") > 0) & (F.col("_tr") > 0)
    return per.groupBy("task").agg(
        F.sum("_tr").alias("n_train"), F.sum("_te").alias("n_test"),
        F.count(F.when(F.col("_tr") > 0, 1)).alias("n_train_groups"), F.count(F.when(F.col("_te") > 0, 1)).alias("n_test_groups"),
        F.count(F.when(both, 1)).alias("n_overlapping"),
        X.joined_labels(F.when(both, F.col(roles.group)), " | ").alias("groups_to_purge"),
        F.sum(F.when(both, 0).otherwise(F.col("_tr"))).alias("n_train_after_purge"))


# ------------------------------------------------------------------ support of test rows

def support_rows(df: DataFrame, numeric: list[str], categories: list[str], joint: list[str], roles: Roles = DEFAULT) -> DataFrame:
    """How far each row is supported by the records of the other folds.

    Ranges, levels, joint cells and spreads of a training set all follow from sums per fold:
    a level is seen in training if its rows are not all in the row's own fold.
    """
    per = df.groupBy(roles.fold).agg(
        F.count(F.lit(1)).alias("_n"),
        *[a for c in numeric for a in (F.min(c).alias(f"_lo_{c}"), F.max(c).alias(f"_hi_{c}"), F.sum(c).alias(f"_s1_{c}"),
                                       F.sum(F.col(c) * F.col(c)).alias(f"_s2_{c}"))])
    per = settle(per, "perfold")
    folds = per.select(F.col(roles.fold).alias("_k"))
    others = per.select("*", F.explode(F.sequence(F.lit(1), F.lit(1))).alias("_x")).drop("_x")
    task = per.agg(F.collect_list(F.col(roles.fold)).alias("_ks"))
    spread = with_scalars(others, task).withColumn("_k", F.explode("_ks")).where(F.col("_k") != F.col(roles.fold))
    train = spread.groupBy("_k").agg(
        F.sum("_n").alias("_n"),
        *[a for c in numeric for a in (F.min(f"_lo_{c}").alias(f"_lo_{c}"), F.max(f"_hi_{c}").alias(f"_hi_{c}"),
                                       F.sum(f"_s1_{c}").alias(f"_s1_{c}"), F.sum(f"_s2_{c}").alias(f"_s2_{c}"))])
    sds = []
    for c in numeric:
        mean = F.col(f"_s1_{c}") / F.col("_n")
        sd = F.sqrt(F.greatest(F.col(f"_s2_{c}") / F.col("_n") - mean * mean, F.lit(0.0)))
        sds.append(F.when(sd > 0, sd).otherwise(1.0).alias(f"_sd_{c}"))
    train = settle(train.select(F.col("_k").alias(roles.fold), *[f"_lo_{c}" for c in numeric], *[f"_hi_{c}" for c in numeric], *sds), "train")

    out = df.join(train, roles.fold)
    for c in categories:
        level = df.groupBy(c, roles.fold).agg(F.count(F.lit(1)).alias("_own"))
        total = level.groupBy(c).agg(F.sum("_own").alias("_all"))
        seen = level.join(total, c).select(c, roles.fold, (F.col("_all") > F.col("_own")).alias(f"_seen_{c}"))
        out = attach_stats(out, [c, roles.fold], seen)
    cell_groups = df.groupBy(*joint, roles.fold, roles.group).agg(
        F.count(F.lit(1)).alias("_n"), F.sum(F.col(roles.event).cast("long")).alias("_e"))
    # A group lies in one fold, so the groups of the other folds are those of all folds less the own.
    own = cell_groups.groupBy(*joint, roles.fold).agg(
        F.sum("_n").alias("_on"), F.sum("_e").alias("_oe"), F.count(F.lit(1)).alias("_og"))
    whole = own.groupBy(*joint).agg(F.sum("_on").alias("_an"), F.sum("_oe").alias("_ae"), F.sum("_og").alias("_ag"))
    cells = own.join(whole, joint).select(
        *joint, roles.fold, (F.col("_an") - F.col("_on")).alias("cell_rows"),
        (F.col("_ae") - F.col("_oe")).alias("cell_events"), (F.col("_ag") - F.col("_og")).alias("cell_groups"))
    out = attach_stats(out, [*joint, roles.fold], cells)

    z = {f"_z_{c}": F.col(c) / F.col(f"_sd_{c}") for c in numeric}
    out = out.withColumns(z)
    unseen = F.array_compact(F.array(*[F.when(~F.col(f"_seen_{c}"), F.lit(c)) for c in categories]))
    outside = F.array_compact(F.array(*[
        F.when((F.col(c) < F.col(f"_lo_{c}")) | (F.col(c) > F.col(f"_hi_{c}")), F.lit(c)) for c in numeric]))
    label = (
        F.when(F.size(unseen) > 0, "unseen_category").when(F.size(outside) > 0, "outside_numeric_range")
        .when(F.col("cell_rows") == 0, "unseen_joint_cell").otherwise("within_support"))
    # The join on points comes last and takes finished columns along. It is settled: of distinct points there may be few.
    nearest = settle(_fold_nearest(df.join(train, roles.fold).withColumns(z), train, numeric, list(z), roles), "nearest")
    out = out.select(
        roles.row, roles.fold, *z, "cell_rows", "cell_events", "cell_groups",
        F.array_join(unseen, "|").alias("unseen_categories"), F.array_join(outside, "|").alias("outside_ranges"), label.alias("support_class"))
    return out.join(nearest, [roles.fold, *z], "left").select(
        roles.row, roles.fold, "cell_rows", "cell_events", "cell_groups", "unseen_categories", "outside_ranges", "nearest_distance", "support_class")


def _fold_nearest(rows: DataFrame, train: DataFrame, numeric: list[str], z: list[str], roles: Roles) -> DataFrame:
    """Nearest standardised training point of the distinct points of every fold.

    Each fold scales by its own training spread, so the training points of fold k are the
    distinct points of the other folds in the scale of k.
    """
    points = rows.select(roles.fold, *numeric).distinct().withColumnRenamed(roles.fold, "_own")
    task = train.agg(F.collect_list(F.struct(F.col(roles.fold).alias("k"), *[F.col(f"_sd_{c}").alias(c) for c in numeric])).alias("_ks"))
    spread = with_scalars(points, task).withColumn("_k", F.explode("_ks")).where(F.col("_k.k") != F.col("_own"))
    training = spread.select(F.col("_k.k").alias(roles.fold), *[(F.col(c) / F.col(f"_k.{c}")).alias(f"_z_{c}") for c in numeric])
    queries = rows.select(roles.fold, *z).distinct()
    return nearest_point_distance(queries, training, [roles.fold], z, "nearest_distance")


# ------------------------------------------------------------------ selection audits

def selection_frequency(candidates: DataFrame, selected: DataFrame, keys: list[str]) -> DataFrame:
    """How often each candidate of a model was chosen, zero included."""
    folds = selected.groupBy("model").agg(F.countDistinct("fold").alias("n_folds"))
    pool = candidates.groupBy("model").agg(F.countDistinct(*keys).alias("n_candidates"))
    chosen = selected.groupBy("model", *keys).agg(F.count(F.lit(1)).alias("selected_count"))
    every = candidates.select("model", *keys).distinct()
    out = left_zero(every, chosen, ["model", *keys], ["selected_count"]).join(folds, "model").join(pool, "model")
    return out.withColumn("selected_fraction", F.col("selected_count") / F.col("n_folds"))


def parameter_frequency(candidates: DataFrame, selected: DataFrame, parameters: list[str]) -> DataFrame:
    """Chosen values per parameter, folds where it applies, and whether it was searched at all."""
    def long(df: DataFrame) -> DataFrame:
        pairs = F.array(*[F.struct(F.lit(p).alias("parameter"), F.col(p).cast("string").alias("value")) for p in parameters])
        cols = [c for c in ("model", "fold") if c in df.columns]
        return df.select(*cols, F.explode(pairs).alias("_p")).select(*cols, "_p.*").where("value IS NOT NULL")

    counts = long(selected).groupBy("model", "parameter", "value").agg(F.count(F.lit(1)).alias("n"))
    applies = long(selected).groupBy("model", "parameter").agg(F.countDistinct("fold").alias("applicable_folds"))
    searched = long(candidates).groupBy("model", "parameter").agg((F.countDistinct("value") > 1).alias("_s"))
    return counts.join(applies, ["model", "parameter"]).join(searched, ["model", "parameter"], "left").select(
        "model", "parameter", "value", "n", "applicable_folds", F.when(F.col("_s"), "searched").otherwise("fixed").alias("role"))


def development_support(df: DataFrame, roles: Roles = DEFAULT) -> DataFrame:
    """Records available for training per outer fold: totals less the fold's own."""
    groups = df.groupBy(roles.fold, roles.group).agg(F.count(F.lit(1)).alias("_n"), F.sum(F.col(roles.event).cast("long")).alias("_e"))
    per = groups.groupBy(roles.fold).agg(
        F.sum("_n").alias("n"), F.sum("_e").alias("e"), F.count(F.lit(1)).alias("g"), F.count(F.when(F.col("_e") > 0, 1)).alias("ge"))
    total = per.agg(*[F.sum(c).alias(f"_t_{c}") for c in ("n", "e", "g", "ge")])
    both = with_scalars(per, total)
    left = {c: F.col(f"_t_{c}") - F.col(c) for c in ("n", "e", "g", "ge")}
    return both.select(
        roles.fold, left["n"].alias("n_train"), left["e"].alias("n_train_events"), (left["n"] - left["e"]).alias("n_train_censored"),
        left["g"].alias("n_train_groups"), left["ge"].alias("n_train_event_groups"))


# ------------------------------------------------------------------ other tables

def temperature_support(df: DataFrame, supported: str, keys: list[str], roles: Roles = DEFAULT) -> DataFrame:
    ok, event = F.col(supported), F.col(roles.event)
    return df.groupBy(*keys).agg(
        F.avg(F.when(event, ok.cast("double"))).alias("event_support_rate"),
        F.count(F.when(event & ~ok, 1)).alias("n_events_unsupported"),
        F.avg(ok.cast("double")).alias("support_rate"), F.count(F.when(~ok, 1)).alias("n_unsupported"))


def boundary_hits(parameters: DataFrame, bounds: dict[str, tuple[float | None, float | None]], tolerance: float = 1e-6) -> DataFrame:
    """Flag parameters that ended on a bound of their search range."""
    flags = {}
    for name, (low, high) in bounds.items():
        for side, limit in (("lower", low), ("upper", high)):
            if limit is not None:
                flags[f"{name}_at_{side}"] = F.abs(F.col(name) - limit) <= tolerance
    out = parameters.withColumns(flags)
    any_hit: Column = F.lit(False)
    for f in flags:
        any_hit = any_hit | F.coalesce(F.col(f), F.lit(False))
    return out.withColumn("any_boundary_hit", any_hit)


def audit_items(df: DataFrame, items: dict[str, Column]) -> DataFrame:
    """One aggregate per item, as (item, value) rows."""
    one = df.agg(*[c.cast("string").alias(n) for n, c in items.items()])
    return one.unpivot([], list(items), "item", "value")


def review_extract(df: DataFrame, rules: dict[str, tuple[Column, str]], columns: list[str]) -> DataFrame:
    """Rows that need a look, with the reason and what to do."""
    hits = F.array_compact(F.array(*[
        F.when(test, F.struct(F.lit(n).alias("finding"), F.lit(action).alias("action"))) for n, (test, action) in rules.items()]))
    return df.select(*columns, F.explode(hits).alias("_h")).select(*columns, "_h.*")
