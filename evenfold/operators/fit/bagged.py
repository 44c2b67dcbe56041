"""Bagged regression trees on binned inputs, a forest per held-out fold, grown from sums of cells.

A tree that cuts its inputs at no more than ``bins`` - 1 places sees of a row only its bins.
Rows of equal bins, a cell, are therefore added up once, for all trees of all forests: one
pass over the rows, and one table of (held-out fold, cell) with the bagged count and sum of
every tree. A tree is grown from its cells in one task, level by level, and gives the cells
of its held-out rows their values; what it holds is bounded by the product of the bins, and
by the rows where inputs are many. No model passes through the driver.

The draws of a row (Poisson with mean 1, a number for every tree) follow from its key, so
that they do not depend on how the rows are partitioned (approximate cuts may, slightly). Splits
take the largest gain in squared error over the tried inputs, the first input and cut on
ties, and leave ``leaf`` drawn rows on both sides. Cuts are those of the training rows: all
values of an input that has no more than ``bins`` of them, or else approximate quantiles.

Defined results: a null or NaN input is an error; rows without a target train nothing; a
fold without training rows gets nulls.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evenfold.session import settle

#: Rows added up at once, cells held before they are added up again, and sums of a histogram.
MOST_ROWS, MOST_HELD, MOST_SUMS = 200_000, 400_000, 4_000_000
#: Gains below this share of the node's own sum are rounding.
LEAST_GAIN = 1e-12


@dataclass(frozen=True)
class Forest:
    trees: int
    leaf: int = 3
    features: float = 0.85
    seed: int = 0
    depth: int = 30
    bins: int = 32


def mixed(h: np.ndarray) -> np.ndarray:
    """64 well mixed bits of each number (the finaliser of splitmix64)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


POISSON = np.cumsum([math.exp(-1.0) / math.factorial(k) for k in range(18)])


def bag(keys: np.ndarray, trees: int) -> np.ndarray:
    """How often every tree draws every row."""
    h = keys.astype(np.int64).view(np.uint64)
    steps = np.arange(1, trees + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    uniform = (mixed(h[:, None] + steps) >> np.uint64(11)) / float(1 << 53)
    return np.searchsorted(POISSON, uniform, side="right").astype(float)


def tried(path: np.ndarray, width: int, most: int, seed: int) -> np.ndarray:
    """(node, input): whether the node tries the input; the ``most`` inputs with the smallest hashes are."""
    if most >= width:
        return np.ones((len(path), width), dtype=bool)
    at = mixed(path.astype(np.uint64) + np.array([seed & 0xFFFFFFFF], dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    h = mixed(at[:, None] + np.arange(1, width + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
    return np.argsort(np.argsort(h, axis=1, kind="stable"), axis=1) < most


def grown(bins: np.ndarray, n: np.ndarray, s: np.ndarray, forest: Forest, seed: int) -> np.ndarray:
    """The value of every cell under the tree of the cells' counts ``n`` and sums ``s``; cells of count 0 follow the splits."""
    value, width = np.full(len(n), np.nan), bins.shape[1]
    if not n.sum() > 0:
        return value
    ks = bins.max(axis=0).astype(np.int64) + 1
    at, node, path = np.arange(len(n)), np.zeros(len(n), dtype=np.int64), np.ones(1, dtype=np.int64)
    for level in range(forest.depth + 1):
        m = len(path)
        wn, ws = np.bincount(node, n[at], m), np.bincount(node, s[at], m)
        value[at] = (ws / wn)[node]
        if level == forest.depth:
            break
        own = ws * ws / wn
        best, feature, cut = own * (1 + LEAST_GAIN), np.full(m, -1), np.zeros(m, dtype=np.int64)
        tries = tried(path, width, math.ceil(forest.features * width), seed)
        # Cells are in order of their nodes, so a block of nodes is a slice of them.
        step = max(1, MOST_SUMS // int(ks.max()))
        for lo in range(0, m, step):
            hi = min(lo + step, m)
            rows = slice(*np.searchsorted(node, [lo, hi]))
            for f in range(width):
                if ks[f] < 2 or not tries[lo:hi, f].any():
                    continue
                key, size = (node[rows] - lo) * ks[f] + bins[at[rows], f], (hi - lo) * ks[f]
                nl, sl = (np.bincount(key, v[at[rows]], size).reshape(-1, ks[f]).cumsum(axis=1)[:, :-1] for v in (n, s))
                nr, sr = wn[lo:hi, None] - nl, ws[lo:hi, None] - sl
                fits = (nl >= forest.leaf) & (nr >= forest.leaf) & tries[lo:hi, f, None]
                with np.errstate(divide="ignore", invalid="ignore"):
                    gain = np.where(fits, sl * sl / nl + sr * sr / nr, -1.0)
                k = gain.argmax(axis=1)
                top = gain[np.arange(hi - lo), k]
                better = lo + np.flatnonzero(top > best[lo:hi] * (1 + LEAST_GAIN) + 1e-300)
                best[better], feature[better], cut[better] = top[better - lo], f, k[better - lo]
        go = feature[node] >= 0
        at, node = at[go], node[go]
        if not len(at):
            break
        key = 2 * node + (bins[at, feature[node]] > cut[node])
        order = np.argsort(key, kind="stable")
        at, key = at[order], key[order]
        keys, node = np.unique(key, return_inverse=True)
        path = 2 * path[keys >> 1] + (keys & 1)
    return value


def cuts_of(train: DataFrame, inputs: list[str], bins: int, fold: str, folds: list[int]) -> dict[int, list[np.ndarray]]:
    """Per held-out fold the cuts of each input over the rows of the other folds; a row's bin is the number of cuts below it."""
    shares = [i / bins for i in range(1, bins)]
    sketch = [F.percentile_approx(F.when(F.col(fold) != h, F.col(x)), shares, 10_000).alias(f"q_{h}_{f}") for h in folds for f, x in enumerate(inputs)]
    found = train.agg(*sketch, *[F.approx_count_distinct(x).alias(f"d_{f}") for f, x in enumerate(inputs)]).first()
    few = [f for f in range(len(inputs)) if found[f"d_{f}"] <= 2 * bins]
    values: dict[int, list[tuple[int, float]]] = {f: [] for f in few}
    if few:
        each = F.explode(F.array(*[F.struct(F.lit(f).alias("f"), F.col(inputs[f]).alias("v")) for f in few])).alias("_e")
        for r in train.select(fold, each).select(fold, "_e.f", "_e.v").distinct().collect():
            values[r["f"]].append((r[fold], r["v"]))
    out = {}
    for h in folds:
        cuts = []
        for f in range(len(inputs)):
            seen = np.unique([v for o, v in values.get(f, ()) if o != h])
            cuts.append(seen[:-1] if f in values and len(seen) <= bins else np.unique(np.array(found[f"q_{h}_{f}"] or [], dtype=float)))
        out[h] = cuts
    return out


def binned(columns: list[np.ndarray], cuts: list[np.ndarray]) -> np.ndarray:
    return np.column_stack([np.searchsorted(c, x, side="left") for x, c in zip(columns, cuts, strict=True)]).astype(np.uint8)


def added(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Cells and their sums, each cell once."""
    keys, sums = (np.concatenate(c) for c in zip(*held, strict=True))
    distinct, where = np.unique(keys, return_inverse=True)
    return distinct, np.column_stack([np.bincount(where, c, len(distinct)) for c in sums.T])


def cell_sums(rows: DataFrame, width: int, cuts: dict[int, list[np.ndarray]], forest: Forest) -> DataFrame:
    """(hold, cell, tested, n_0, s_0, n_1, ...) from rows (fold, trains, h, y, x_0, x_1, ...)."""
    names = [f"{v}_{t}" for t in range(forest.trees) for v in "ns"]

    def sent(hold: int, held: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        keys, sums = added(held)
        columns = [pa.array(np.full(len(keys), hold, dtype=np.int32)), pa.array([k.tobytes() for k in keys], pa.binary()), pa.array(sums[:, 0] > 0), *[pa.array(c) for c in sums.T[1:]]]
        return pa.RecordBatch.from_arrays(columns, names=["hold", "cell", "tested", *names])

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        kept: list[pa.RecordBatch] = []
        for batch in batches:
            kept.append(batch)
            if sum(b.num_rows for b in kept) >= MOST_ROWS:
                yield pa.Table.from_batches(kept)
                kept = []
        if kept:
            yield pa.Table.from_batches(kept)

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {h: [] for h in cuts}
        for block in blocks(batches):
            fold, trains, h, y, *xs = (block.column(i).to_numpy() for i in range(block.num_columns))
            drawn = bag(h, forest.trees) * trains[:, None]
            what = np.zeros((len(fold), 1 + 2 * forest.trees))
            what[:, 1::2], what[:, 2::2] = drawn, drawn * y[:, None]
            for hold, own in cuts.items():
                tested = fold == hold
                used = np.flatnonzero(tested | (trains & ~tested))
                if not len(used):
                    continue
                cells = np.ascontiguousarray(binned([x[used] for x in xs], own)).view(np.dtype((np.void, width))).ravel()
                sums = np.where(tested[used, None], 0.0, what[used])
                sums[:, 0] = tested[used]
                held[hold].append(added([(cells, sums)]))
                if sum(len(k) for k, _ in held[hold]) > MOST_HELD:
                    held[hold] = [added(held[hold])]
                    # What stays is the sums themselves; a limit near their number would add them again and again.
                    if len(held[hold][0][0]) > MOST_HELD // 2:
                        yield sent(hold, held[hold])
                        held[hold] = []
        for hold, own in held.items():
            if own:
                yield sent(hold, own)

    sums = rows.mapInArrow(part, f"hold int, cell binary, tested boolean, {', '.join(f'{n} double' for n in names)}")
    return sums.groupBy("hold", "cell").agg(F.max("tested").alias("tested"), *[F.sum(n).alias(n) for n in names])


def cell_values(cells: DataFrame, forest: Forest) -> DataFrame:
    """(hold, cell, value): the mean over the trees of every cell with held-out rows."""
    each = F.explode(F.array(*[F.struct(F.lit(t).alias("tree"), F.col(f"n_{t}").alias("n"), F.col(f"s_{t}").alias("s")) for t in range(forest.trees)])).alias("_t")

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        # In order of the cells, so that sums and ties do not depend on the shuffle.
        pdf = pdf.sort_values("cell")
        bins = np.frombuffer(b"".join(pdf["cell"]), dtype=np.uint8).reshape(len(pdf), -1)
        seed = forest.seed * 1_000_003 + int(pdf["hold"].iloc[0]) * 1_009 + int(pdf["tree"].iloc[0])
        pdf["value"] = grown(bins, pdf["n"].to_numpy(), pdf["s"].to_numpy(), forest, seed)
        return pdf.loc[pdf["tested"], ["hold", "cell", "value"]]

    trees = cells.select("hold", "cell", "tested", each).select("hold", "cell", "tested", "_t.*").where("tested OR n > 0")
    values = trees.groupBy("hold", "tree").applyInPandas(grow, "hold int, cell binary, value double")
    return values.groupBy("hold", "cell").agg(F.avg(F.nanvl("value", F.lit(None).cast("double"))).alias("value"))


def fold_forests(rows: DataFrame, inputs: list[str], forest: Forest, target: str, folds: list[int], fold: str, event: str, key: str, out: str) -> DataFrame:
    """``rows`` of the named folds with ``out``: the forest of the other folds' events."""
    def checked(name: str):
        x = F.col(name).cast("double")
        return F.when(x.isNull() | F.isnan(x), F.raise_error(F.lit(f"null or NaN in input {name}")).cast("double")).otherwise(x)

    xs = [f"x_{f}" for f in range(len(inputs))]
    # Sums are about a centre, which keeps their digits.
    centre = rows.where(F.col(event)).agg(F.avg(target)).first()[0] or 0.0
    trains = F.coalesce(F.col(event) & F.col(target).isNotNull(), F.lit(False))
    read = settle(rows.where(F.col(fold).isNotNull()).select(
        F.col(fold).cast("int").alias("fold"), trains.alias("trains"), F.xxhash64(F.lit(forest.seed), key).alias("h"), F.coalesce(F.col(target).cast("double") - centre, F.lit(0.0)).alias("y"),
        *[checked(n).alias(x) for n, x in zip(inputs, xs, strict=True)]), "forest_rows")
    cuts = cuts_of(read.where("trains"), xs, forest.bins, "fold", folds)
    values = settle(cell_values(settle(cell_sums(read, len(inputs), cuts, forest), "cells"), forest), "cell_values")

    @F.pandas_udf("binary")
    def cell(own: pd.Series, *columns: pd.Series) -> pd.Series:
        hold, result = own.to_numpy(), np.empty(len(own), dtype=object)
        for h in np.unique(hold):
            at = np.flatnonzero(hold == h)
            if h in cuts:
                result[at] = [b.tobytes() for b in binned([c.to_numpy()[at] for c in columns], cuts[h])]
        return pd.Series(result)

    found = values.select(F.col("hold").alias("_hold"), F.col("cell").alias("_own"), (F.col("value") + centre).alias(out))
    data = rows.where(F.col(fold).isin(folds)).withColumn("_cell", cell(F.col(fold).cast("int"), *[checked(n) for n in inputs]))
    return data.join(found, (F.col("_hold") == F.col(fold)) & (F.col("_own") == F.col("_cell")), "left").drop("_hold", "_own", "_cell")
