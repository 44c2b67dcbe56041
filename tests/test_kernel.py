"""Kernel ridge on landmarks against the dense solve, and hybrids over the fitted trunk against a plain replay."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from evenfold.operators.fit import kernel as KR


def dense(x, y, at, length, alpha, centred):
    mean = y.mean() if centred else 0.0
    def k(a, b):
        r = np.sqrt(((a[:, None, :] - b[None, :, :]) ** 2).sum(2)) * math.sqrt(3) / length
        return (1 + r) * np.exp(-r)
    return mean + k(at, x) @ np.linalg.solve(k(x, x) + alpha * np.eye(len(x)), y - mean)


def table(spark, tasks):
    rows = [(t, p.tolist(), float(v)) for t, (x, y) in tasks.items() for p, v in zip(x, y)]
    return spark.createDataFrame(rows, "task int, x array<double>, y double").repartition(5)


def draw(n, d, seed):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d))
    return x, np.sin(x[:, 0]) + 0.3 * x[:, 1] ** 2 + 0.1 * rng.normal(size=n) + 4


@pytest.mark.parametrize("centred", [False, True])
def test_all_points_as_landmarks_give_the_dense_solve(spark, centred):
    a, b = draw(60, 3, 1), draw(45, 3, 2)
    # Repeated points count each.
    a = (np.vstack([a[0], a[0][:20]]), np.append(a[1], a[1][:20] + 1))
    tasks = [KR.KernelTask(t, length, alpha, centred) for t in (0, 1) for length in (1.0, 2.0) for alpha in (0.5, 2.0)]
    models = KR.fit(table(spark, {0: a, 1: b}), tasks, count=200, block=16)
    assert models.agg(F.max("gap_max"), F.max("bound")).first() == pytest.approx((0, 0), abs=1e-4)
    assert {r["n_landmarks"] for r in models.where("task = 0").collect()} == {60}
    new = draw(10, 3, 3)[0]
    for r in KR.predict(table(spark, {0: (new, new[:, 0]), 1: (new, new[:, 0])}).withColumn("i", F.col("x")[0]), models).collect():
        x, y = (a, b)[r["task"]]
        at = new[np.argmin(np.abs(new[:, 0] - r["i"]))][None, :]
        assert r["pred"] == pytest.approx(dense(x, y, at, r["length"], r["alpha"], centred)[0], abs=1e-5)


def test_stated_accuracy_on_two_thousand_rows(spark):
    x, y = draw(2000, 4, 7)
    models = KR.fit(table(spark, {0: (x, y)}), [KR.KernelTask(0, 2.0, 1.0, True)], count=384, block=64)
    rows = spark.createDataFrame([(0, p.tolist(), i) for i, p in enumerate(x)], "task int, x array<double>, i int")
    got = np.array([r["pred"] for r in KR.predict(rows, models).orderBy("i").collect()])
    apart = math.sqrt(np.mean((got - dense(x, y, x, 2.0, 1.0, True)) ** 2))
    stated = models.first()
    assert apart < 0.02 < np.std(y) / 10
    assert apart <= stated["bound"] and 0 < stated["gap_mean"] < stated["gap_max"] < 0.2
    assert stated["rmse"] == pytest.approx(math.sqrt(np.mean((got - y) ** 2)), rel=1e-6)


def test_nulls_and_tasks_without_points(spark):
    rows = spark.createDataFrame([(0, [0.0, 1.0], 1.0), (0, [None, 1.0], 5.0), (0, None, 5.0), (0, [1.0, float("nan")], 5.0), (0, [1.0, 0.0], None), (1, [0.0, 0.0], None)], "task int, x array<double>, y double")
    models = KR.fit(rows, [KR.KernelTask(0, 1.0, 1.0), KR.KernelTask(1, 1.0, 1.0)])
    assert [(r["task"], r["n_rows"], r["n_landmarks"]) for r in models.collect()] == [(0, 1, 1)]
    out = KR.predict(rows, models).collect()
    assert len(out) == 6 and sum(r["pred"] is None for r in out) == 4
    assert next(r["pred"] for r in out if r["y"] == 1.0) == pytest.approx(0.5)
    assert KR.fit(rows.limit(0), [KR.KernelTask(0, 1.0, 1.0)]).count() == 0


def test_hybrid_is_trunk_plus_gated_dense_correction(spark):
    """The state gives the base; the correction is the dense solve on its residuals, scaled and gated by hand."""
    from evenfold.checks.learner_checks import HYBRID_INPUTS
    from evenfold.checks.model_checks import trunk_rows
    from evenfold.plans import hybrid as H
    from evenfold.session import settle

    rows = settle(trunk_rows(spark, "/root/testdata/sf0.001"), "rows").where("row_id % 5 = 0")
    rows = settle(rows.withColumn("fold", F.when(F.col("fold") == 1, 1).otherwise(2)), "rows")
    state = H.fit(rows, [1], HYBRID_INPUTS, 0.85, strength=0.1, settings=((2.0, 1.0),), count=600)
    out = H.score(state, rows.withColumn("hold", F.lit(1)), HYBRID_INPUTS, etas=(0.5,)).toPandas().sort_values("row_id")
    train = out[out["is_event"] & (out["fold"] != 1)]
    mean, sd = train[HYBRID_INPUTS].mean(), train[HYBRID_INPUTS].std(ddof=0).replace(0.0, 1.0)
    x, at = ((t[HYBRID_INPUTS] - mean) / sd for t in (train, out))
    want = dense(x.to_numpy(), (train["y"] - train["base"]).to_numpy(), at.to_numpy(), 2.0, 1.0, False)
    np.testing.assert_allclose(out["correction"], want, atol=1e-4)
    gap = np.abs(out["temp_c"].to_numpy()[:, None] - train["temp_c"].to_numpy()[None, :]).min(1)
    np.testing.assert_allclose(out["pred"], out["base"] + 0.5 * np.exp(-(gap / 250) ** 2) * want, atol=1e-4)


def test_equal_points_are_added_up_and_give_the_same_model(spark, monkeypatch):
    rng = np.random.default_rng(4)
    x = np.repeat(rng.normal(size=(60, 3)), 5, axis=0)
    points = table(spark, {0: (x, x[:, 0] + rng.normal(size=300))})
    tasks = [KR.KernelTask(0, 2.0, alpha, True) for alpha in (0.1, 1.0)]
    packed, made = [], KR.block_sums
    monkeypatch.setattr(KR, "block_sums", lambda points, marks: (packed.append(points.count()), made(points, marks))[1])
    together = KR.fit(points, tasks, count=40, block=8).orderBy("alpha").collect()
    monkeypatch.setattr(KR, "WORTH_ADDING", 0.0)
    apart = KR.fit(points, tasks, count=40, block=8).orderBy("alpha").collect()
    assert packed == [60, 300]
    for a, b in zip(together, apart, strict=True):
        assert a["n_rows"] == b["n_rows"] == 300 and a["landmarks"] == b["landmarks"]
        for name in ("mean", "rmse", "gap_mean", "gap_max", "bound", "weights"):
            assert a[name] == pytest.approx(b[name], rel=1e-6, abs=1e-9), name


def test_points_that_do_not_count_are_left_early():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(3000, 4))
    marks = KR.Landmarks(x[:1], 2.0).extended(x[1:], 99, 1e-6)
    whole = np.maximum(1.0 - (marks.features(x) ** 2).sum(1), 0.0)
    least = np.sort(whole)[-50]
    left = marks.gaps(x, least - 1e-8)
    counts = whole >= least
    assert np.allclose(left[counts], whole[counts], atol=1e-10) and (left[~counts] < least + 1e-10).all()
    assert np.allclose(marks.gaps(x), whole, atol=1e-10) and not np.allclose(left, whole, atol=1e-3)


def test_scoring_measures_distances_before_it_corrects(spark, monkeypatch):
    from evenfold.plans import hybrid as H

    read = []

    class Seen(Exception):
        pass

    def distances(queries, *rest):
        read.extend(queries.columns)
        raise Seen

    monkeypatch.setattr(H, "nearest_distance", distances)
    with pytest.raises(Seen):
        H.score(H.Hybrid(None, None, None, None), spark.range(1).select(F.lit(1).alias("hold"), F.lit(25.0).alias("temp_c")), [])
    assert read == ["hold", "temp_c"]
