import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from evenfold.operators import metrics as M
from evenfold.operators import resample as B
from evenfold.operators import scores as SC
from evenfold.operators import weights as W

SCHEMA = "model string, group_id string, source_id string, equiv_id string, row_id long, y double, pred double, is_event boolean, is_censored boolean, row_nll double"


def frame(spark, n=900, seed=0):
    """Random rows; one group and one of its equivalences hold a third of them."""
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        hot = i % 3 == 0
        g = "hot" if hot else f"g{rng.integers(0, 9)}"
        e = "h" if hot and i % 2 else f"e{rng.integers(0, 30)}"
        event = bool(rng.random() < 0.7)
        y = float(rng.normal(5, 1))
        rows.append(("m", g, f"s{rng.integers(0, 4)}", e, i, y, y + float(rng.normal(0, 0.6)), event, not event, float(rng.random())))
    return spark.createDataFrame(rows, SCHEMA)


def weights(p):
    m = p.groupby(["group_id", "equiv_id"])["row_id"].transform("size")
    e = p.groupby("group_id")["equiv_id"].transform("nunique")
    return 1.0 / (m * e)


def test_score_card_against_row_weights(spark):
    df = frame(spark)
    r = M.score_card(df, ["model"]).first()
    p = df.toPandas()
    ev = p[p.is_event]
    w = weights(ev)
    err = ev.pred - ev.y
    assert r["gb_rmse"] == pytest.approx(math.sqrt((w * err**2).sum() / w.sum()))
    assert r["gb_mae"] == pytest.approx((w * err.abs()).sum() / w.sum())
    mu = (w * ev.y).sum() / w.sum()
    assert r["gb_r2"] == pytest.approx(1 - (w * err**2).sum() / (w * (ev.y - mu) ** 2).sum())
    wa = weights(p)
    assert r["joint_nll"] == pytest.approx((wa * p.row_nll).sum() / wa.sum())
    assert r["joint_nll"] == pytest.approx(r["event_nll_part"] + r["censored_nll_part"])


def test_row_weights_add_up(spark):
    df = frame(spark)
    for norm, total in (("sum", 1.0), ("mean", 900.0)):
        assert W.balanced_weights(df, ["model"], norm=norm).agg(F.sum("weight")).first()[0] == pytest.approx(total)
    p = W.balanced_weights(df, [], norm="none").toPandas()
    assert np.allclose(p.groupby("group_id")["weight"].sum(), 1.0)
    assert np.allclose(p.sort_values("row_id")["weight"], weights(p.sort_values("row_id")))


def test_hand_values(spark):
    """Two groups; one row and one equivalence each would give the plain mean."""
    df = spark.createDataFrame([
        ("m", "a", "s", "e1", 1, 5.0, 6.0, True, False, 1.0), ("m", "a", "s", "e1", 2, 5.0, 5.0, True, False, 1.0),
        ("m", "a", "s", "e2", 3, 5.0, 7.0, True, False, 1.0), ("m", "b", "s", "e3", 4, 4.0, 4.0, True, False, 2.0)], SCHEMA)
    r = M.point_metrics(df, ["model"]).first()
    assert r["gb_mae"] == pytest.approx(((0.5 + 2.0) / 2 + 0.0) / 2)
    assert r["gb_rmse"] == pytest.approx(math.sqrt(((0.5 + 4.0) / 2 + 0.0) / 2))
    one = {x["group_id"]: x["composite"] for x in M.group_composites(df, ["model"]).collect()}
    assert one["b"] == pytest.approx(0.0)


def test_no_events_gives_null_not_nan(spark):
    df = frame(spark).where("is_censored").withColumn("is_event", F.lit(False))
    r = M.score_card(df, ["model"]).first()
    assert r["gb_rmse"] is None and r["gb_r2"] is None and r["joint_nll"] is not None and r["n_events"] == 0


def test_composite_against_numpy(spark):
    df = frame(spark)
    got = {r["group_id"]: r["composite"] for r in M.group_composites(df, ["model"]).collect()}
    for g, p in df.where("is_event").toPandas().groupby("group_id"):
        err, y = (p.pred - p.y).to_numpy(), p.y.to_numpy()
        s = max(np.subtract(*np.percentile(y, [95, 5])), math.log10(5))
        parts = [min(math.sqrt((err**2).mean()) / s, 1), min(abs(err).mean() / s, 1), (abs(err) > math.log10(3)).mean(),
                 (abs(err) > math.log10(5)).mean(), min(abs(err.mean()) / s, 1)]
        assert got[g] == pytest.approx(np.mean(parts))


def test_bootstrap_of_equal_groups_has_no_spread(spark):
    df = spark.createDataFrame([(f"g{i}", 3.0) for i in range(6)], "group_id string, v double").withColumn("k", F.lit("x"))
    r = B.mean_intervals(df, ["k"], "group_id", ["v"], 50, 1).first()
    assert (r["v"], r["v_lo"], r["v_hi"], r["n_groups"]) == (3.0, 3.0, 3.0, 6)


def test_single_group_has_no_interval(spark):
    df = spark.createDataFrame([("x", "g", 1.0)], "k string, group_id string, v double")
    r = B.mean_intervals(df, ["k"], "group_id", ["v"], 20, 1).first()
    assert r["v"] == 1.0 and r["v_lo"] is None


def test_paired_draws_are_shared(spark):
    """The same predictions under two names must never differ."""
    df = frame(spark)
    both = df.unionByName(df.withColumn("model", F.lit("copy")))
    for r in B.paired_effects(both, [], "m", 60, 4).collect():
        assert r["estimate"] == pytest.approx(0.0, abs=1e-12) and r["lo"] == pytest.approx(0.0, abs=1e-12) and r["hi"] == pytest.approx(0.0, abs=1e-12)


def test_halfwidths_against_numpy(spark):
    df = frame(spark)
    got = {r["q"]: r["value"] for r in SC.empirical_halfwidths(df, ["model"], (0.8, 0.9)).collect()}
    p = df.where("is_event").toPandas()
    p["v"] = (p.y - p.pred).abs()
    p["w"] = 1.0 / p.groupby("group_id")["row_id"].transform("size")
    p = p.sort_values(["v", "row_id"])
    for q in (0.8, 0.9):
        assert got[q] == pytest.approx(np.interp(q, np.cumsum(p.w) / p.w.sum(), p.v))


def test_subgroup_keeps_other_columns(spark):
    df = frame(spark).withColumn("scenario", F.lit("Primary"))
    out = SC.subgroup_scores(df, ["source_id"], ["scenario", "model"])
    assert out.count() == 4 and {r["scenario"] for r in out.collect()} == {"Primary"}


def test_two_weightings(spark):
    df = frame(spark)
    p = df.toPandas()
    got = {r["weighting"]: r for r in SC.two_weightings(df, ["model"], {}).collect()}
    assert got["row_equal"]["joint_nll"] == pytest.approx(p.row_nll.mean())
    assert got["group_equal"]["joint_nll"] == pytest.approx(p.groupby("group_id").row_nll.mean().mean())
    assert isinstance(p, pd.DataFrame)
