"""Forests grown from sums of cells against trees grown row by row in plain Python."""

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from evenfold.operators.fit import bagged as BG
from evenfold.operators.fit import learners as LN

SCHEMA = "row_id long, fold int, is_event boolean, a double, b double, c double, y double"
INPUTS = ["a", "b", "c"]


def rows_of(n=600, seed=3):
    rng = np.random.default_rng(seed)
    out = []
    for i in range(n):
        a, b, c = round(float(rng.normal()), 2), float(rng.integers(0, 5)), float(rng.random() < 0.02)
        out.append((i, i % 3 + 1, bool(rng.random() < 0.8), a, b, c, float((a > 0.3) * 2 + b * 0.5 + 3 * c + rng.normal(scale=0.2))))
    return out


def plain_value(train, weight, x, leaf, depth, cuts, level=0):
    """The value of ``x`` under one tree; ``train`` holds (bins, y)."""
    n, y = weight, np.array([t[1] for t in train])
    value, best = (n @ y) / n.sum(), None
    for f in range(len(x)):
        b = np.array([t[0][f] for t in train])
        for k in range(len(cuts[f])):
            left = b <= k
            if level < depth and min(n[left].sum(), n[~left].sum()) >= leaf:
                gain = sum((n[m] @ y[m]) ** 2 / n[m].sum() for m in (left, ~left))
                if gain > (n @ y) ** 2 / n.sum() * (1 + 1e-9) and (best is None or gain > best[0] * (1 + 1e-9)):
                    best = (gain, f, k, left)
    if best is None:
        return value
    side = best[3] if x[best[1]] <= best[2] else ~best[3]
    return plain_value([t for t, m in zip(train, side, strict=True) if m], n[side], x, leaf, depth, cuts, level + 1)


@pytest.mark.parametrize("depth,most", [(3, 4_000_000), (30, 40)])
def test_forest_is_that_grown_row_by_row(spark, monkeypatch, depth, most):
    monkeypatch.setattr(BG, "MOST_SUMS", most)
    rows = rows_of()
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    forest = LN.forest(2, leaf=5, features=1.0, seed=9, depth=depth)
    got = {r["row_id"]: r["pred"] for r in LN.fold_predictions(df, INPUTS, forest, "y", [1, 2, 3]).collect()}
    assert sorted(got) == [r[0] for r in rows]
    cuts = BG.cuts_of(df.where("is_event"), INPUTS, 32, "fold", [1, 2, 3])
    keys = {r["row_id"]: r["h"] for r in df.select("row_id", F.xxhash64(F.lit(9), "row_id").alias("h")).collect()}
    centre = np.mean([r[6] for r in rows if r[2]])
    bins = {h: BG.binned([np.array([r[3 + f] for r in rows]) for f in range(3)], cuts[h]) for h in cuts}
    for i in range(0, 60):
        h = rows[i][1]
        train = [r for r in rows if r[2] and r[1] != h]
        drawn = BG.bag(np.array([keys[r[0]] for r in train]), 2)
        values = []
        for t in range(2):
            own = [(bins[h][r[0]], r[6] - centre) for r, w in zip(train, drawn[:, t], strict=True) if w]
            values.append(plain_value(own, drawn[drawn[:, t] > 0, t], bins[h][i], 5, depth, cuts[h]))
        assert got[i] == pytest.approx(np.mean(values) + centre)


def test_partitions_do_not_change_a_forest(spark):
    df = spark.createDataFrame(rows_of(), SCHEMA)
    got = [{r["row_id"]: r["pred"] for r in LN.fold_predictions(df.repartition(p), INPUTS, LN.forest(3, seed=1), "y", [1, 2]).collect()} for p in (1, 7)]
    assert len(got[0]) == 400 and got[0] == pytest.approx(got[1])


def test_work_is_bounded_by_cells_not_rows(spark):
    rows = spark.range(40_000).selectExpr("id AS row_id", "cast(id % 2 + 1 AS int) AS fold", "true AS is_event", "cast(id % 7 AS double) AS x_0", "cast(id % 3 AS double) AS x_1", "id * 1.0D AS y")
    read = rows.select("fold", F.lit(True).alias("trains"), F.xxhash64("row_id").alias("h"), "y", "x_0", "x_1")
    cuts = BG.cuts_of(read, ["x_0", "x_1"], 32, "fold", [1, 2])
    cells = BG.cell_sums(read, 2, cuts, BG.Forest(4))
    assert cells.count() == 2 * 21 and all(len(c) == k for own in cuts.values() for c, k in zip(own, (6, 2), strict=True))


def test_draws_are_poisson_and_inputs_are_shared_out():
    drawn = BG.bag(np.arange(200_000), 2)
    assert drawn.mean() == pytest.approx(1.0, abs=0.01) and drawn.var() == pytest.approx(1.0, abs=0.02)
    assert abs(np.corrcoef(drawn.T)[0, 1]) < 0.01
    tries = BG.tried(np.arange(1, 6_001), 6, 2, 4)
    assert (tries.sum(axis=1) == 2).all() and tries.mean(axis=0) == pytest.approx([1 / 3] * 6, abs=0.03)


def test_edges(spark):
    df = spark.createDataFrame([(1, 1, True, 1.0, 0.0, 0.0, 2.0), (2, 2, False, 1.0, 0.0, 0.0, 5.0), (3, 2, True, 2.0, 0.0, 0.0, None)], SCHEMA)
    assert {r["row_id"]: r["pred"] for r in LN.fold_predictions(df, INPUTS, LN.forest(40), "y", [1, 2]).collect()} == {1: None, 2: 2.0, 3: 2.0}
    assert LN.fold_predictions(df.limit(0), INPUTS, LN.forest(2), "y", [1, 2]).count() == 0
    bad = spark.createDataFrame([(1, 1, True, None, 0.0, 0.0, 2.0), (2, 2, True, 1.0, 0.0, 0.0, 1.0)], SCHEMA)
    with pytest.raises(PySparkException, match="null or NaN"):
        LN.fold_predictions(bad, INPUTS, LN.forest(2), "y", [1, 2]).collect()
