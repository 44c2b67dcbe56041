"""Matern-3/2 kernel ridge of many tasks at once, on landmarks and summed Gram blocks.

A task learns f(x) = mean + k(x, Z) w from its training points. Its landmarks Z are
chosen greedily: each round reads the points once, ranks them by the part of k(x, x)
that Z does not explain, and takes the largest ones in turn (a blocked pivoted
Cholesky). With L L' = k(Z, Z) and features p(x) = inv(L) k(Z, x), the weights need only
the sums of p p' and p y over the rows. Every partition adds up its own blocks, Spark
adds the blocks by row of the matrix, and each task is solved where its matrix lies.
Where many points of a task are equal they are added up before, with count and sums of
targets; and a round leaves a point as soon as some of its landmarks explain more of it
than counts for the choice, since further ones only explain more.

Accuracy is stated with each model: ``gap_mean`` and ``gap_max`` are the unexplained
part of k(x, x), and ``bound`` bounds the root mean square difference to the dense
solve over the training rows,

    |f - f_dense| <= trace(K - K_Z) |y - f| / alpha.

All are 0, and the solve is the dense one, once every distinct point is a landmark.

Sizes: an executor holds tasks x lengths x landmarks^2 numbers, the driver tasks x
landmarks points; neither grows with the rows.

Defined results: points with a null or NaN coordinate or a null target are not learned
from and get a null prediction; repeated points count each; a task without points has
no model, and its rows get null; without centring, far from all points the
prediction is 0, the mean otherwise.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from evenfold.session import settle, spread

LEAST_GAP = 1e-8
#: Points whose kernels are evaluated at once, and landmarks after which points are left out of a round (doubled from there).
CHUNK, FIRST_LANDMARKS = 512, 32
#: Points are added up if at most this share of them is distinct.
WORTH_ADDING = 0.7


@dataclass(frozen=True)
class KernelTask:
    """Settings of a fit on the points of ``task``; fits of one task and length share their sums."""

    task: int
    length: float
    alpha: float
    centred: bool = False


def matern(a: np.ndarray, b: np.ndarray, length: float) -> np.ndarray:
    out, twice, aa, bb = np.empty((len(a), len(b))), 2.0 * a, (a * a).sum(1), (b * b).sum(1)
    for lo in range(0, len(a), CHUNK):
        # In place, on pieces that stay in the cache.
        r = out[lo:lo + CHUNK]
        np.add(aa[lo:lo + CHUNK, None], bb[None, :], out=r)
        r -= twice[lo:lo + CHUNK] @ b.T
        np.maximum(r, 0.0, out=r)
        np.sqrt(r, out=r)
        r *= math.sqrt(3.0) / length
        fade = np.exp(-r)
        r += 1.0
        r *= fade
    return out


class Landmarks:
    """Points of one task and the map of other points to features in which their kernel is an inner product."""

    def __init__(self, points: np.ndarray, length: float) -> None:
        self.points, self.length = points, length
        self.back = np.linalg.inv(np.linalg.cholesky(matern(points, points, length) + LEAST_GAP * np.eye(len(points)))) if len(points) else np.zeros((0, 0))

    def features(self, x: np.ndarray) -> np.ndarray:
        return matern(x, self.points, self.length) @ self.back.T if len(self.points) else np.zeros((len(x), 0))

    def gaps(self, x: np.ndarray, least: float = -1.0) -> np.ndarray:
        """The part of k(x, x) that is not explained; of points below ``least`` some number below it."""
        gap, at, k, done, m = np.ones(len(x)), np.arange(len(x)), np.zeros((len(x), 0)), 0, len(self.points)
        while done < m and len(at):
            upto = min(m, max(FIRST_LANDMARKS, 2 * done))
            k = np.hstack([k, matern(x[at], self.points[done:upto], self.length)])
            p = k @ self.back[done:upto, :upto].T
            gap[at] -= (p * p).sum(1)
            done = upto
            stay = gap[at] >= least
            if not stay.all():
                at, k = at[stay], k[stay]
        return np.maximum(gap, 0.0)

    def extended(self, candidates: np.ndarray, room: int, tolerance: float) -> "Landmarks":
        """With up to ``room`` candidates more, each the one least explained by those before it."""
        p = self.features(candidates)
        gap = np.maximum(1.0 - (p * p).sum(1), 0.0)
        taken: list[int] = []
        while len(taken) < min(room, len(candidates)):
            j = int(np.argmax(gap))
            if gap[j] <= tolerance:
                break
            step = (matern(candidates, candidates[j:j + 1], self.length)[:, 0] - p @ p[j]) / math.sqrt(gap[j])
            p = np.column_stack([p, step])
            gap = np.maximum(gap - step * step, 0.0)
            gap[j] = 0.0
            taken.append(j)
        return Landmarks(np.vstack([self.points.reshape(-1, candidates.shape[1]), candidates[taken]]), self.length)


def usable(x: Column) -> Column:
    return x.isNotNull() & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v))


def matrix(column: pa.ListArray) -> np.ndarray:
    """The lists of a column, of one length and without nulls, as rows."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def by_task(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
    """Row numbers of every task of a batch."""
    tasks = batch.column("task").to_numpy(zero_copy_only=False)
    for t in np.unique(tasks):
        yield int(t), np.flatnonzero(tasks == t)


def candidates(points: DataFrame, marks: dict[int, Landmarks], block: int) -> DataFrame:
    """(task, gap, h, x): per task the ``block`` distinct points that its landmarks explain least; ties by hash."""
    def least_explained(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, dict[int, tuple[float, list[float]]]] = {}
        for batch in batches:
            x, h = matrix(batch.column("x")), batch.column("h").to_numpy()
            for t, at in by_task(batch):
                own = best.setdefault(t, {})
                # Of the points so far the one that just counts; rounding is far smaller than what is left to it.
                least = min(gap for gap, _ in own.values()) - 1e-8 if len(own) >= block else -1.0
                gap = marks[t].gaps(x[at], least) if t in marks else np.ones(len(at))
                at, gap = at[gap >= least], gap[gap >= least]
                # Digits beyond the ninth depend on how rows fall into batches.
                gap = np.round(gap, 9)
                for j in np.lexsort((h[at], -gap))[:4 * block]:
                    own[int(h[at][j])] = (float(gap[j]), x[at][j].tolist())
                if len(own) > block:
                    best[t] = dict(sorted(own.items(), key=lambda e: (-e[1][0], e[0]))[:block])
        rows = [(t, gap, h, x) for t, own in best.items() for h, (gap, x) in own.items()]
        if rows:
            task, gap, h, x = zip(*rows)
            yield pa.RecordBatch.from_arrays([pa.array(task, pa.int32()), pa.array(gap, pa.float64()), pa.array(h, pa.int64()), pa.array(x, pa.list_(pa.float64()))], names=["task", "gap", "h", "x"])

    found = points.select("task", "x", "h").mapInArrow(least_explained, "task int, gap double, h bigint, x array<double>").dropDuplicates(["task", "h"])
    return found.withColumn("_r", F.row_number().over(Window.partitionBy("task").orderBy(F.desc("gap"), "h"))).where(F.col("_r") <= block).drop("_r")


def choose(points: DataFrame, tasks: list[KernelTask], count: int, block: int, tolerance: float) -> dict[int, Landmarks]:
    """Up to ``count`` landmarks per task, ``block`` a round, until no point's gap is above ``tolerance``; one pass over the points a round.

    The shortest length of a task decides: at any other its landmarks explain more.
    """
    shortest = {t: min(k.length for k in tasks if k.task == t) for t in {k.task for k in tasks}}
    marks: dict[int, Landmarks] = {}
    while True:
        # tasks x 4 x block points at most.
        found = candidates(points, marks, 4 * block).where(F.col("gap") > tolerance).orderBy("task", F.desc("gap"), "h").collect()
        grown = False
        for t in sorted({r["task"] for r in found} & set(shortest)):
            pool = np.array([r["x"] for r in found if r["task"] == t], dtype=float)
            old = marks.get(t, Landmarks(np.zeros((0, pool.shape[1])), shortest[t]))
            new = old.extended(pool, min(block, count - len(old.points)), tolerance)
            grown |= len(new.points) > len(old.points)
            marks[t] = new
        if not grown or all(len(marks[t].points) >= count for t in shortest if t in marks):
            return marks


def block_sums(points: DataFrame, marks: dict[tuple[int, float], Landmarks]) -> DataFrame:
    """(task, length, i, v): row i of the summed features' products, followed by their sums with the target and alone; i = -1 holds the totals.

    ``points`` hold how many were added up, and the sums of their targets and of their squares.
    """
    def added(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, float], list[np.ndarray]] = {}
        for batch in batches:
            x = matrix(batch.column("x"))
            n, y, yy = (batch.column(c).to_numpy() for c in ("n", "y", "yy"))
            for t, at in by_task(batch):
                for key in (k for k in marks if k[0] == t):
                    p = marks[key].features(x[at])
                    gap = np.maximum(1.0 - (p * p).sum(1), 0.0)
                    q = p if (n[at] == 1).all() else p * np.sqrt(n[at])[:, None]
                    rows = np.column_stack([q.T @ q, p.T @ y[at], p.T @ n[at]])
                    total = np.array([n[at].sum(), y[at].sum(), yy[at].sum(), gap @ n[at], gap.max()])
                    if key in sums:
                        sums[key][0] += rows
                        sums[key][1] = np.append(sums[key][1][:4] + total[:4], max(sums[key][1][4], total[4]))
                    else:
                        sums[key] = [rows, total]
        for (t, length), (rows, total) in sums.items():
            lists = [total, *rows]
            yield pa.RecordBatch.from_arrays([
                pa.array([t] * len(lists), pa.int32()), pa.array([length] * len(lists), pa.float64()), pa.array(range(-1, len(rows)), pa.int32()),
                pa.array([r.tolist() for r in lists], pa.list_(pa.float64()))], names=["task", "length", "i", "v"])

    def joined(pdf: pd.DataFrame) -> pd.DataFrame:
        v = np.stack(pdf["v"].to_numpy())
        total = v.sum(0)
        if pdf["i"].iloc[0] < 0:
            total[4] = v[:, 4].max()
        return pd.DataFrame({**{c: pdf[c].iloc[:1] for c in pdf.columns if c != "v"}, "v": [total.tolist()]}, index=pdf.index[:1])

    schema = "task int, length double, i int, v array<double>"
    parts = points.select("task", "x", "n", "y", "yy").mapInArrow(added, schema).withColumn("part", F.spark_partition_id())
    # Two turns: a group holds about the square root of the number of partitions.
    turns = max(1, math.isqrt(points.rdd.getNumPartitions()))
    first = parts.withColumn("part", F.col("part") % turns).groupBy("task", "length", "i", "part").applyInPandas(joined, "task int, length double, i int, part int, v array<double>")
    return first.drop("part").groupBy("task", "length", "i").applyInPandas(joined, schema)


MODEL = ("task int, length double, alpha double, mean double, weights array<double>, landmarks array<array<double>>, n_rows bigint, n_landmarks int, "
         "rmse double, gap_mean double, gap_max double, bound double")


def solved(sums: DataFrame, tasks: list[KernelTask], marks: dict[tuple[int, float], Landmarks]) -> DataFrame:
    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        key = (int(pdf["task"].iloc[0]), float(pdf["length"].iloc[0]))
        pdf = pdf.sort_values("i")
        n, s1, s2, gap, most = pdf["v"].iloc[0]
        rows = np.stack(pdf["v"].iloc[1:].to_numpy())
        m = len(rows)
        gram, by_y, alone = rows[:, :m], rows[:, m], rows[:, m + 1]
        out = []
        for k in tasks:
            if (k.task, float(k.length)) != key:
                continue
            mean = s1 / n if k.centred else 0.0
            b = by_y - mean * alone
            u = np.linalg.solve(gram + k.alpha * np.eye(m), b)
            rmse = math.sqrt(max(s2 - 2 * mean * s1 + n * mean * mean - 2 * u @ b + u @ gram @ u, 0.0) / n)
            out.append((*key, k.alpha, mean, (marks[key].back.T @ u).tolist(), marks[key].points.tolist(), int(n), m, rmse, gap / n, most, gap * rmse / k.alpha))
        return pd.DataFrame(out, columns=[c.split()[0] for c in MODEL.split(", ")])

    return sums.groupBy("task", "length").applyInPandas(solve, MODEL)


def added_up(points: DataFrame) -> DataFrame:
    """The points with equal ones of a task as one, if there are enough of them."""
    seen = points.agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct(F.xxhash64("task", "h")).alias("d")).first()
    if seen["d"] > WORTH_ADDING * seen["n"]:
        return points
    return spread(points.groupBy("task", "x", "h").agg(*[F.sum(c).alias(c) for c in ("n", "y", "yy")]), "kernel_points")


def fit(points: DataFrame, tasks: list[KernelTask], count: int = 256, block: int = 64, tolerance: float = 1e-6) -> DataFrame:
    """A stored table of models, one row per task and setting, from ``points`` (task, x, y); ``count`` bounds the landmarks of a task."""
    ready = points.where(usable(F.col("x")) & F.col("y").isNotNull() & ~F.isnan("y"))
    ready = ready.select(F.col("task").cast("int").alias("task"), F.col("x").cast("array<double>").alias("x"), F.col("y").cast("double").alias("y"), F.xxhash64("x").alias("h"))
    ready = added_up(spread(ready.withColumns({"n": F.lit(1.0), "yy": F.col("y") * F.col("y")}), "kernel_points"))
    chosen = choose(ready, tasks, count, block, tolerance)
    marks = {(k.task, float(k.length)): Landmarks(chosen[k.task].points, float(k.length)) for k in tasks if k.task in chosen}
    return settle(solved(block_sums(ready, marks), tasks, marks), "kernel_models")


def predict(rows: DataFrame, models: DataFrame, out: str = "pred") -> DataFrame:
    """``rows`` (task, x, other columns) once per model of their task, with length, alpha and the prediction; rows of a task without model come once, with nulls."""
    # Tasks x settings models of bounded size; those on the same landmarks share the kernel.
    kept: dict[int, dict[tuple, list]] = {}
    for r in models.select("task", "length", "alpha", "mean", "weights", "landmarks").orderBy("task", "length", "alpha").collect():
        points = np.array(r["landmarks"])
        kept.setdefault(r["task"], {}).setdefault((r["length"], points.tobytes()), []).append((r["length"], r["alpha"], r["mean"], np.array(r["weights"]), points))
    names = [c for c in rows.columns if c != "x"]
    data = rows.withColumn("task", F.col("task").cast("int")).withColumn("x", F.when(usable(F.col("x")), F.col("x").cast("array<double>")))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in data.drop("x").schema) + f", length double, alpha double, `{out}` double"

    def apply(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t, at in by_task(batch):
                part = batch.take(pa.array(at))
                known = part.column("x").is_valid().to_numpy(zero_copy_only=False)
                for alike in kept.get(t, {None: [(None, None, None, None, None)]}).values():
                    length, points = alike[0][0], alike[0][4]
                    near = matern(matrix(part.column("x").filter(pa.array(known))), points, length) if points is not None and known.any() else None
                    for _, alpha, mean, weights, _ in alike:
                        value = np.full(len(at), np.nan)
                        if near is not None:
                            value[known] = mean + near @ weights
                        added = [pa.array([length] * len(at), pa.float64()), pa.array([alpha] * len(at), pa.float64()), pa.array(value, mask=np.isnan(value))]
                        yield pa.RecordBatch.from_arrays([part.column(n) for n in names] + added, names=[*names, "length", "alpha", out])

    return data.mapInArrow(apply, schema)
