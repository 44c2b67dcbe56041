"""Small user-supplied fits, one per task, on statistics that were reduced before."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evenfold.operators.fit.closed_form import complement_sums
from evenfold.session import settle


def dealt(rows: DataFrame, keys: list[str], rows_per_part: int) -> DataFrame:
    """``rows`` with ``_part``: the rows of each task in as many parts of equal size as ``rows_per_part`` asks for.

    A row's part comes from its position in the written table and not from its content, so equal
    rows are spread too, and a task that runs again reads the same rows at the same positions.
    """
    held = settle(rows, "task_rows")
    # Few tasks or many: the join is broadcast or shuffled by the size of the written counts.
    counts = settle(held.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / rows_per_part).alias("_parts")), "task_parts")
    names = {k: f"_k{i}" for i, k in enumerate(keys)}
    same = F.lit(True)
    for k, n in names.items():
        same = same & F.col(k).eqNullSafe(F.col(n))
    placed = held.withColumn("_at", F.monotonically_increasing_id()).join(counts.withColumnsRenamed(names), same)
    return placed.withColumn("_part", F.pmod(F.col("_at"), F.col("_parts"))).drop(*names.values(), "_at", "_parts")


def map_tasks(stats: DataFrame, keys: list[str], part: Callable[[pd.DataFrame], pd.DataFrame], part_schema: str,
              finish: Callable[[pd.DataFrame], pd.DataFrame], schema: str, rows_per_part: int = 50_000) -> DataFrame:
    """A user's own fit per task: ``part`` reduces some rows of a task to a state, ``finish`` turns its states into the result.

    A worker sees about ``rows_per_part`` rows of a task of any size; the states of a task, one per
    that many rows, meet in one worker. Null keys are tasks of their own; an empty table gives an empty result.
    """
    columns = stats.columns
    reduced = dealt(stats, keys, rows_per_part).groupBy(*keys, "_part").applyInPandas(lambda pdf: part(pdf[columns]), part_schema)
    return reduced.groupBy(*keys).applyInPandas(finish, schema)


def complement_ridge(events: DataFrame, fold: str, inputs: list[str], y: str, alphas: tuple[float, ...]) -> list[dict]:
    """Ridge regression with a free intercept per held-out fold and penalty.

    One aggregation gives the cross products of all folds; the driver solves k small systems.
    """
    c = F.col
    sums = {"n": F.lit(1.0), "sy": c(y)}
    for i, a in enumerate(inputs):
        sums |= {f"s_{i}": c(a), f"sy_{i}": c(a) * c(y)}
        sums |= {f"s_{i}_{j}": c(a) * c(inputs[j]) for j in range(i, len(inputs))}
    out = []
    for r in complement_sums(events, fold, [], sums).collect():
        n, k = r["n"], len(inputs)
        mean = np.array([r[f"s_{i}"] for i in range(k)]) / n
        ybar = r["sy"] / n
        gram = np.array([[r[f"s_{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)]) - n * np.outer(mean, mean)
        cross = np.array([r[f"sy_{i}"] for i in range(k)]) - n * mean * ybar
        for alpha in alphas:
            beta = np.linalg.solve(gram + alpha * np.eye(k), cross)
            out.append({"fold": r[fold], "alpha": float(alpha), "intercept": float(ybar - beta @ mean), **{x: float(b) for x, b in zip(inputs, beta, strict=True)}})
    return out
