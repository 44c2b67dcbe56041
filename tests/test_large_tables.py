"""What keeps the work of a task and of a shuffle small on large tables."""

from pyspark.sql import functions as F

from evenfold.session import together


def plan_of(df):
    return df._jdf.queryExecution().toString()


def test_rows_of_a_key_lie_together(spark):
    df = spark.range(0, 4000, 1, 16).select((F.col("id") % 400).alias("k"), F.col("id").alias("v"))
    out = together(df, ["k"])
    assert out.select("k", F.input_file_name().alias("f")).distinct().groupBy("k").count().where("count > 1").count() == 0
    assert out.agg(F.sum("v")).first()[0] == 4000 * 3999 // 2


def test_factors_are_summed_one_after_the_other(spark):
    from evenfold.operators import scores as SC

    rows = [(f"r{i}", f"g{i % 3}", f"e{i % 7}", float(i), i + 0.5, i % 4 > 0, 0.1 * i, "ab"[i % 2], "xyz"[i % 3], "m") for i in range(40)]
    df = spark.createDataFrame(rows, "row_id string, group_id string, equiv_id string, y double, pred double, is_event boolean, row_nll double, f string, g string, model string")
    out = SC.subgroup_scores(df, ["f", "g"], ["model"])
    assert "Generate" not in plan_of(out)
    assert {(r["factor"], r["level"]): r["n_rows"] for r in out.collect()} == {("f", "a"): 20, ("f", "b"): 20, ("g", "x"): 14, ("g", "y"): 13, ("g", "z"): 13}


def test_scopes_are_summed_one_after_the_other(spark):
    from evenfold.plans.probability import scoped_summaries

    rows = [(f"r{i}", f"g{i % 3}", f"e{i % 7}", float(i), i + 0.5, i % 4 > 0, 0.1 * i, "s", [None, " ", "h"][i % 3], "m") for i in range(30)]
    df = spark.createDataFrame(rows, "row_id string, group_id string, equiv_id string, y double, pred double, is_event boolean, row_nll double, scenario string, holdout string, model string")
    out = scoped_summaries(df)
    assert "Generate" not in plan_of(out)
    assert {(r["level"], r["holdout"], r["n_rows"]) for r in out.collect()} == {("overall", "", 30), ("factor_level", "h", 10)}


def test_models_of_a_row_are_put_together_without_a_join(spark):
    from evenfold.operators import reshape as R

    df = spark.createDataFrame([(1, "g", 0.5, "a", 1.0), (1, "g", 0.5, "b", 3.0), (2, None, 1.5, "a", None)], "row_id int, group_id string, y double, model string, pred double")
    out = R.model_columns(df, "row_id", ["group_id", "y"], {"a": ("a", "pred"), "b": ("b", "pred")}, "model")
    assert sorted(map(tuple, out.select("row_id", "group_id", "y", "a", "b").collect())) == [(1, "g", 0.5, 1.0, 3.0), (2, None, 1.5, None, None)]


def test_environment_response_has_no_join(spark):
    from evenfold.checks.catalog import QUERIES

    plan = QUERIES["environment_response"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan


def test_candidate_scores_has_no_join(spark):
    from evenfold.checks.catalog import QUERIES

    plan = QUERIES["candidate_scores"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan


def test_roles_are_compared_without_sorting(spark):
    from evenfold.operators import contracts as C

    df = spark.createDataFrame([(1, "a", "test"), (1, "a", "train"), (1, "b", "train"), (2, "a", "test")], "task int, k string, role string")
    out = C.role_overlap(df, ["k"])
    assert "SortAggregate" not in plan_of(out)
    assert [r["key"] for r in out.collect()] == ["1|a"]


def test_nearest_distances_are_settled_before_rows_meet_them(spark):
    from evenfold.checks.catalog import QUERIES

    out = QUERIES["support_rows"](spark, "/root/testdata/sf0.001")
    assert any("/nearest-" in f for f in out.inputFiles())


def test_normal_scales_read_events_once(spark, monkeypatch):
    import math
    from dataclasses import replace

    from evenfold.operators.fit import trunk as TR

    df = spark.createDataFrame([("a", 0.1 * i, 0.05 * i * (-1) ** i, i % 3 > 0) for i in range(60)], "model string, y double, pred double, is_event boolean")
    want = TR.calibrate_scales(df, ["model"], "normal").first()["scale"]
    assert want > 0
    # Rounds that went through the events again would meet NaN.
    lost = replace(TR.FAMILIES["normal"], event=lambda z: F.lit(math.nan), event_d=lambda z: (F.lit(math.nan), F.lit(math.nan)))
    monkeypatch.setitem(TR.FAMILIES, "normal", lost)
    again = TR.calibrate_scales(df, ["model"], "normal").first()["scale"]
    assert again is not None and abs(again - want) < 1e-9


def test_split_inputs_are_settled_once(spark):
    from evenfold.checks.catalog import QUERIES

    files = QUERIES["repeated_splits"](spark, "/root/testdata/sf0.001").inputFiles()
    assert any("/splits-" in f for f in files) and not any("lineitem" in f for f in files)


def test_boosting_packs_its_training_rows(spark):
    from evenfold.operators.fit import boosting as B
    from test_trees import learner, rows_of

    df = learner(spark, rows_of(160))
    blocks = B.blocks_of(df, B.input_cuts(df))
    assert blocks.agg(F.sum("n")).first()[0] == df.where("w > 0").count()
    assert blocks.count() <= df.rdd.getNumPartitions()


def test_clusters_are_dealt_to_parts_that_grow_with_the_rows(spark):
    from evenfold.operators.audits import CLUSTER_PARTS, cluster_stats

    raw = spark.range(0, 1000, 1, 4).select((F.col("id") % 700).cast("string").alias("equiv_id"), (F.col("id") % 3).alias("source_id"), (F.col("id") % 2 == 0).alias("is_censored"))
    out = cluster_stats(raw)
    assert out.rdd.getNumPartitions() >= 4 * CLUSTER_PARTS
    assert out.agg(F.count(F.lit(1)), F.sum("cluster_size"), F.sum("cluster_sources")).first()[:] == (700, 1000, 1000)
    assert out.where("cross_source").count() == 300
