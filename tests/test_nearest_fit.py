import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from evenfold.operators import joins as J
from evenfold.operators.fit import likelihood as LK
from evenfold.operators.fit import mapped as MP
from evenfold.operators.fit import trunk as TR


def test_nearest_value(spark):
    rng = np.random.default_rng(2)
    q = [("a", float(x)) for x in rng.normal(size=200)] + [("b", 1.0), ("c", 2.0)]
    t = [("a", float(x)) for x in np.concatenate([rng.normal(size=40), [0.0]])] + [("b", 1.0 + 1e-9)]
    df = spark.createDataFrame(q, "s string, v double")
    train = spark.createDataFrame(t, "s string, v double")
    for r in J.nearest_distance(df, train, ["s"], "v").collect():
        own = [x for s, x in t if s == r["s"]]
        assert (r["distance"] is None) if not own else r["distance"] == pytest.approx(min(abs(r["v"] - x) for x in own), abs=1e-15)
    near = {(r["s"], r["v"]): r["supported"] for r in J.within_tolerance(df, train, ["s"], "v", 1e-8).collect()}
    assert near["b", 1.0] is True and near["c", 2.0] is False


def test_nearest_point_with_a_dense_corner(spark):
    """Most points lie in a tiny corner, so cells must be refined there."""
    rng = np.random.default_rng(3)
    t = np.concatenate([rng.normal(size=(150, 3)), 5 + 1e-6 * rng.normal(size=(300, 3))])
    q = np.concatenate([rng.normal(size=(60, 3)), 5 + 1e-6 * rng.normal(size=(60, 3)), [[50.0, -50.0, 0.0]]])
    cols = ["x", "y", "z"]
    as_df = lambda m: spark.createDataFrame([("s", *map(float, r)) for r in m], "k string, x double, y double, z double")
    got = {(r["x"], r["y"], r["z"]): r["distance"] for r in J.nearest_point_distance(as_df(q), as_df(t), ["k"], cols).collect()}
    for row in q:
        assert got[tuple(map(float, row))] == pytest.approx(np.sqrt(((t - row) ** 2).sum(1)).min(), rel=1e-9, abs=1e-12)


def planted(spark, family="normal", n=3000):
    rng = np.random.default_rng(5)
    s = rng.uniform(-0.5, 0.3, n)
    r = rng.uniform(-1, 0.5, n)
    x = s + 0.85 * np.log10((1 - r) / 2)
    noise = rng.normal(size=n) if family == "normal" else np.log(rng.exponential(size=n))
    y = 5.0 - 3.0 * x + 0.4 * noise
    limit = np.quantile(y, 0.7)
    event = y < limit
    rows = [(int(i), int(i % 3) + 1, float(s[i]), float(r[i]), float(min(y[i], limit)), bool(event[i]), not bool(event[i])) for i in range(n)]
    return spark.createDataFrame(rows, "row_id long, fold int, log_s double, r_ratio double, y double, is_event boolean, is_censored boolean")


@pytest.mark.parametrize("family", ["normal", "weibull"])
def test_walker_fit_recovers_truth_and_is_optimal(spark, family):
    df = planted(spark, family)
    f = TR.fit_walker(df, [{"hold": 0, "gamma": 0.85}], TR.leave_fold_out(), ["fold"], family=family)[0]
    assert f.converged
    assert f.theta[0] == pytest.approx(5.0, abs=0.06) and f.theta[1] == pytest.approx(3.0, abs=0.12) and f.scale == pytest.approx(0.4, abs=0.03)
    p = df.toPandas()
    x = p.log_s + 0.85 * np.log10((1 - p.r_ratio) / 2)
    e = p.is_event.to_numpy()

    def objective(t):
        sd = math.exp(t[2])
        z = ((p.y - (t[0] - t[1] * x)) / sd).to_numpy()
        if family == "normal":
            tail = np.array([-math.log(0.5 * math.erfc(v / math.sqrt(2))) for v in z])
            return np.where(e, 0.5 * math.log(2 * math.pi) + t[2] + 0.5 * z * z, tail).mean()
        return np.where(e, t[2] - z + np.exp(z), np.exp(z)).mean()

    best = objective(f.theta)
    assert best == pytest.approx(f.objective, rel=1e-9)
    for j in range(3):
        for h in (1e-3, -1e-3):
            assert objective(f.theta + h * np.eye(3)[j]) >= best - 1e-9


def test_slope_bound_is_kept(spark):
    df = planted(spark).withColumn("y", -F.col("y"))
    f = TR.fit_walker(df, [{"hold": 0, "gamma": 0.85}], TR.leave_fold_out(), ["fold"])[0]
    assert f.theta[1] == pytest.approx(0.05)


def test_competing_fit_improves_on_linear(spark):
    rng = np.random.default_rng(8)
    df = planted(spark).withColumns({
        "wet": F.col("row_id") % 4 == 0, "env_class": F.when(F.col("row_id") % 4 == 0, "steam").when(F.col("row_id") % 4 == 1, "vacuum").otherwise("air"),
        "exposure": F.when(F.col("row_id") % 4 == 1, 0.0).otherwise(1.0), "drive": (F.col("row_id") % 5).cast("double") / 10,
        "freq_drive": F.lit(0.0), "stress_on": F.lit(1.0)})
    ratio = F.when(F.col("exposure") > 0, -0.2 + F.when(F.col("wet"), 0.6).otherwise(0.0) + 4.0 * F.col("drive") / math.log(10))
    df = df.withColumn("y", F.col("y") - F.coalesce(F.log10(1 + F.pow(F.lit(10.0), ratio)), F.lit(0.0)))
    keys = [{"hold": 0, "gamma": 0.85}]
    member, carry = TR.leave_fold_out(), ["fold"]
    linear = TR.fit_walker(df, keys, member, carry)[0]
    policy = TR.class_policy(df, [0])
    assert policy[0]["status"] == "estimated"
    f = TR.fit_competing(df, keys, {(0, 0.85): linear}, policy, member, carry, strength=0.0)[0]
    assert f.loss < linear.loss - 0.05
    assert f.theta[5] == pytest.approx(0.6, abs=0.25) and f.theta[4] == pytest.approx(4.0, abs=1.5)
    assert rng is not None


def test_policy_without_wet_rows(spark):
    df = planted(spark).withColumns({"wet": F.lit(False), "exposure": F.lit(1.0), "env_class": F.lit("air")})
    assert TR.class_policy(df, [1])[1]["status"] == "no_wet_training_rows"


def test_scale_calibration(spark):
    df = planted(spark).withColumns({"pred": 5.0 - 3.0 * (F.col("log_s") + 0.85 * F.log10((1 - F.col("r_ratio")) / 2)), "model": F.lit("m")})
    r = TR.calibrate_scales(df, ["model"], "normal").first()
    assert r["scale"] == pytest.approx(0.4, abs=0.02) and not r["at_bound"]
    tiny = TR.calibrate_scales(df.withColumn("pred", F.col("y")), ["model"], "normal").first()
    assert tiny["scale"] == pytest.approx(LK.SCALE_RANGE[0]) and tiny["at_bound"]


def test_ridge_matches_numpy(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(90, 2))
    y = 1.0 + x @ [2.0, -1.0] + 0.1 * rng.normal(size=90)
    df = spark.createDataFrame([(int(i % 3), float(a), float(b), float(v)) for i, ((a, b), v) in enumerate(zip(x, y))], "fold int, a double, b double, y double")
    for f in MP.complement_ridge(df, "fold", ["a", "b"], "y", (2.0,)):
        keep = np.arange(90) % 3 != f["fold"]
        xc = x[keep] - x[keep].mean(0)
        beta = np.linalg.solve(xc.T @ xc + 2.0 * np.eye(2), xc.T @ (y[keep] - y[keep].mean()))
        assert [f["a"], f["b"]] == pytest.approx(list(beta))


def test_mapped_fit_merges_the_parts_of_a_task(spark):
    import pandas as pd

    df = spark.range(1000).select("id", F.lit(1).alias("k"))
    part = lambda p: pd.DataFrame({"k": [1], "n": [len(p)], "s": [int(p["id"].sum())]})
    total = lambda p: pd.DataFrame({"k": [1], "n": [p["n"].sum()], "s": [p["s"].sum()], "parts": [len(p)]})
    row = MP.map_tasks(df, ["k"], part, "k int, n long, s long", total, "k int, n long, s long, parts long", rows_per_part=125).first()
    assert (row.n, row.s) == (1000, 499500) and row.parts == 8


def test_equal_rows_and_null_tasks_are_spread(spark):
    """One task of equal rows takes as many workers as its size asks for, a small one takes one, and no row is lost."""
    import pandas as pd

    df = spark.range(9000).select(F.when(F.col("id") < 8000, F.lit("hot")).when(F.col("id") < 8900, F.lit("b")).alias("k"), F.lit(1.5).alias("v"))
    sizes = {(r.k, r._part): r["count"] for r in MP.dealt(df, ["k"], 1000).groupBy("k", "_part").count().collect()}
    assert sum(sizes.values()) == 9000 and len([1 for k, _ in sizes if k == "hot"]) == 8 and max(sizes.values()) <= 1100
    part = lambda p: pd.DataFrame({"k": [p["k"].iloc[0]], "s": [p["v"].sum()]})
    total = lambda p: pd.DataFrame({"k": [p["k"].iloc[0]], "s": [p["s"].sum()], "states": [len(p)]})
    fit = lambda rows: {r.k: (r.s, r.states) for r in MP.map_tasks(rows, ["k"], part, "k string, s double", total, "k string, s double, states long", 1000).collect()}
    assert fit(df) == {"hot": (12000.0, 8), "b": (1350.0, 1), None: (150.0, 1)}
    assert fit(df.where("false")) == {}


def test_best_start_is_a_finite_one():
    fits = [LK.Fit({"hold": 1}, np.zeros(1), v, v, 1, True, 5) for v in (1.0, float("nan"), 0.5, float("inf"))]
    assert LK.best_of(fits)[0].objective == 0.5 and LK.best_of(fits[1:2])[0].objective != 0


def test_task_without_rows_has_null_parameters(spark):
    rows = planted(spark).withColumn("fold", F.lit(1))
    fits = TR.fit_walker(rows, [{"hold": 1, "gamma": 0.85}, {"hold": 2, "gamma": 0.85}], TR.leave_fold_out(), ["fold"])
    table = {r.hold: r for r in LK.parameter_table(spark, fits, ("a", "b")).collect()}
    assert table[1].a is None and table[1].scale is None and not table[1].converged and table[1].n_train == 0
    assert table[2].a is not None and table[2].converged


def test_unknown_classes_are_not_dry(spark):
    df = planted(spark).withColumns({"wet": F.monotonically_increasing_id() % 2 == 0, "exposure": F.lit(1.0), "env_class": F.lit("unknown")})
    assert TR.class_policy(df, [99])[99]["status"] == "no_dry_training_rows"


def test_nearest_value_reads_no_frame_again(spark, monkeypatch):
    """Thousands of values in one bucket: right, and by running frames only."""
    rng = np.random.default_rng(4)
    q, t = 5 + 1e-4 * rng.random(3000), np.sort(5 + 1e-4 * rng.random(2000))
    plans = []
    settled = J.settle
    monkeypatch.setattr(J, "settle", lambda df, label="t": (plans.append(df._jdf.queryExecution().toString().lower()), settled(df, label))[1])
    as_df = lambda v: spark.createDataFrame([("s", float(x)) for x in v], "k string, v double")
    got = J.nearest_distance(as_df(q), as_df(t), ["k"], "v").collect()
    at = np.searchsorted(t, q).clip(1, len(t) - 1)
    assert sorted(r["distance"] for r in got) == pytest.approx(sorted(np.minimum(abs(q - t[at - 1]), abs(q - t[at]))), abs=1e-15)
    assert plans and not any("unboundedfollowing" in p for p in plans)
