"""Fits with closed-form sums: the training sums of a fold are the total minus its own sums,
so all folds are fitted in one aggregation of the records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evenfold.session import with_scalars


def complement_sums(df: DataFrame, fold: str, scope: list[str], sums: dict[str, Column]) -> DataFrame:
    """For every fold the sums over the other folds of the same scope."""
    per = df.groupBy(*scope, fold).agg(*[F.sum(c).alias(n) for n, c in sums.items()])
    total = per.groupBy(*scope).agg(*[F.sum(n).alias(f"_t_{n}") for n in sums])
    both = per.join(total, scope) if scope else with_scalars(per, total)
    return both.select(*scope, fold, *[(F.col(f"_t_{n}") - F.col(n)).alias(n) for n in sums])


def line_of(n: Column, sx: Column, sy: Column, sxx: Column, sxy: Column) -> tuple[Column, Column]:
    slope = (n * sxy - sx * sy) / (n * sxx - sx * sx)
    return slope, (sy - slope * sx) / n


def complement_line(df: DataFrame, fold: str, x: str, y: str, scope: list[str] | None = None) -> DataFrame:
    """Least-squares line, and the plain mean, per fold on the other folds."""
    cx, cy = F.col(x), F.col(y)
    sums = complement_sums(df, fold, scope or [], {
        "n": F.lit(1.0), "sx": cx, "sy": cy, "sxx": cx * cx, "sxy": cx * cy})
    slope, intercept = line_of(*[F.col(c) for c in ("n", "sx", "sy", "sxx", "sxy")])
    return sums.select(*(scope or []), fold, slope.alias("slope"), intercept.alias("intercept"),
        (F.col("sy") / F.col("n")).alias("mean"))


def complement_means(df: DataFrame, fold: str, by: list[str], y: str, out: str, scope: list[str] | None = None) -> DataFrame:
    """Mean per fold and category on the other folds, null when no other fold has the category."""
    scope = scope or []
    cells = df.groupBy(*scope, fold, *by).agg(F.count(F.lit(1)).alias("n"), F.sum(y).alias("sy"))
    if not by:
        both = complement_sums(df, fold, scope, {"n": F.lit(1.0), "sy": F.col(y)})
        return both.select(*scope, fold, (F.col("sy") / F.col("n")).alias(out))
    total = cells.groupBy(*scope, *by).agg(F.sum("n").alias("_n"), F.sum("sy").alias("_sy"))
    # A category without rows in a fold still has a mean there: pair categories with the fold list.
    fold_list = cells.agg(F.collect_set(fold).alias("_folds"))
    grid = with_scalars(total, fold_list).withColumn(fold, F.explode("_folds")).drop("_folds")
    both = grid.join(cells, [*scope, *by, fold], "left").fillna(0, ["n"]).fillna(0.0, ["sy"])
    left = F.col("_n") - F.col("n")
    return both.select(*scope, fold, *by, F.when(left > 0, (F.col("_sy") - F.col("sy")) / left).alias(out))


def complement_spread(df: DataFrame, scope: list[str], fold: str, value: str, out: str) -> DataFrame:
    """Population standard deviation of the other folds."""
    v = F.col(value)
    sums = complement_sums(df, fold, scope, {"n": F.lit(1.0), "s1": v, "s2": v * v})
    mean = F.col("s1") / F.col("n")
    return sums.select(*scope, fold, F.sqrt(F.col("s2") / F.col("n") - mean * mean).alias(out))
