import pytest
from pyspark.sql import functions as F

from evenfold import session
from evenfold.operators import diff as D
from evenfold.operators import joins as J
from evenfold.operators import select as K
from evenfold.operators.contracts import ContractError
from evenfold.plans import claims as CL
from evenfold.plans import frozen as FZ
from evenfold.plans import variants as V
from evenfold.sources import tables as IO


def test_candidate_grids(spark):
    grid = V.structural_candidates(spark).toPandas()
    assert grid.groupby("pool").size().to_dict() == {"hybrid": 54, "control": 64}
    assert grid[grid.family == "boosting"].shape[0] == 18 and grid[grid.family == "fixed_ensemble"].gamma.isna().all()
    simple = V.simple_candidates(spark).toPandas()
    assert simple.groupby("trunk").size().to_dict() == {"walker": 18, "plain": 6}


def test_variants(spark):
    assert len(V.VARIANTS) == 34 and len({v.name for v in V.VARIANTS}) == 34
    assert V.variant_design(spark).where("role = 'reference'").count() == 1


def test_write_refuses_to_overwrite(spark, tmp_path):
    out = f"{tmp_path}/o"
    IO.require_empty_target(spark, out)
    IO.write_tables({"a": spark.range(3)}, out)
    with pytest.raises(FileExistsError):
        IO.require_empty_target(spark, out)
    with pytest.raises(Exception, match="(?i)exists"):
        IO.write_tables({"a": spark.range(3)}, out)


def test_templates_and_manifest(spark):
    t = IO.templates(spark)
    assert t["new_conditions"].count() == 0 and "specimen_id" in t["new_outcomes"].columns
    a, b = spark.range(10).withColumn("v", F.col("id") * 2), spark.range(10).repartition(3).withColumn("v", F.col("id") * 2)
    assert IO.run_hash(IO.manifest({"x": a}, {"k": 1})) == IO.run_hash(IO.manifest({"x": b}, {"k": 1}))
    assert IO.run_hash(IO.manifest({"x": a}, {"k": 1})) != IO.run_hash(IO.manifest({"x": a}, {"k": 2}))


def test_empty_store(spark, tmp_path):
    plan = spark.createDataFrame([("h", 1)], "run string, fold int")
    assert IO.todo(plan, IO.stored(spark, f"{tmp_path}/none", plan.schema), ["run", "fold"]).count() == 1


def test_settle_keeps_schema_and_size(spark):
    df = session.settle(spark.range(100).withColumn("s", F.lit("x")))
    assert df.schema.names == ["id", "s"] and df.count() == 100
    assert "FileScan" in df._jdf.queryExecution().executedPlan().toString()


def test_cardinality_checks(spark):
    a = spark.createDataFrame([(1,), (1,)], "k long")
    with pytest.raises(ContractError):
        J.one_to_one(a, a, ["k"])
    with pytest.raises(ContractError):
        J.many_to_one(a, a, ["k"])


def test_diff(spark):
    a = spark.createDataFrame([(1, 1.0, ("x", 2.0)), (2, float("nan"), ("y", 3.0))], "k long, v double, n struct<s:string,d:double>")
    b = spark.createDataFrame([(1, 1.0 + 1e-12, ("x", 2.0)), (2, float("nan"), ("z", 3.5))], "k long, v double, n struct<s:string,d:double>")
    out = {r["column"]: r for r in D.compare(a, b, ["k"]).collect()}
    assert out["v"]["passed"] and out["_rows"]["passed"]
    assert out["n_s"]["n_different"] == 1 and out["n_d"]["max_abs_difference"] == pytest.approx(0.5)
    assert D.schema_differences(a, b.withColumnRenamed("v", "w")) == ["only in first: v", "only in second: w"]


def test_budget_rule(spark):
    rows = [(1, 0, 1.000, 5.0), (1, 1, 1.015, 4.0), (1, 2, 1.021, 1.0), (1, 3, None, 0.1), (2, 0, 2.0, None), (2, 1, 2.0, 3.0)]
    out = K.budget_rule(spark.createDataFrame(rows, "fold int, candidate int, inner_rmse double, censored_nll double"), ["fold"]).where("selected").collect()
    assert {r["fold"]: r["candidate"] for r in out} == {1: 1, 2: 1}


def test_gate_needs_every_required_rule(spark):
    df = spark.range(3)
    n = F.count(F.lit(1))
    rules = [CL.rule("a", df, n == 3, n), CL.rule("b", df, n == 4, n), CL.rule("c", df.where("id > 9"), F.max("id") > 0, n)]
    verdict = {r["gate"]: r["passed"] for r in CL.gate(rules, ["a"]).collect()}
    assert verdict == {"a": True, "b": False, "c": False, "all_required": True}
    assert CL.gate(rules).where("gate = 'all_required'").first()["passed"] is False


def test_claims_read_each_table_once(spark):
    n = F.count(F.lit(1))
    tables = {"t": spark.range(3), "empty": spark.range(0)}
    claims = [CL.Claim("few", "t", n == 3, n), CL.Claim("big", "t", F.max("id") > 5, F.max("id")), CL.Claim("none", "empty", F.bool_and(F.col("id") > 0), F.max("id"))]
    verdicts = CL.judged(tables, claims)
    assert [tuple(r) for r in verdicts.orderBy("gate").collect()] == [("big", False, "2", "t"), ("few", True, "3", "t"), ("none", False, "none", "empty")]
    assert verdicts._jdf.queryExecution().optimizedPlan().toString().count("Range (0, 3") == 1
    assert CL.overall(verdicts, ["few"]).where("gate = 'overall_claim'").first()["passed"] is True
    # A required rule that nobody judged fails the whole.
    assert CL.overall(verdicts, ["few", "other"]).where("gate = 'overall_claim'").first()["evidence"] == "1/2"
    with pytest.raises(ValueError, match="not given"):
        CL.judged({}, claims)


def test_study_claims_fail_where_one_comparator_is_not_beaten(spark):
    effects = spark.createDataFrame([("a", "rmse", 0.2, 0.1), ("b", "rmse", 0.2, -0.1), ("a", "mae", 0.1, 0.05), ("b", "mae", 0.1, 0.05)], "model string, effect string, estimate double, lo double")
    tables = {
        "effects": effects, "holdouts": spark.createDataFrame([("S", "a", 0.1, 0.0), ("S", "b", 0.1, 0.2)], "scenario string, model string, estimate double, lo double"),
        "coverage": spark.createDataFrame([("p", 0.85, 0.95), ("a", 0.1, 0.2)], "model string, coverage_lo double, coverage_hi double"),
        "intervals": spark.createDataFrame([("p", 1.0), ("a", 0.5)], "model string, interval_completeness double"),
        "losses": spark.createDataFrame([("p", 0.4), ("a", 0.3)], "model string, censored_nll double"),
        "parameters": spark.createDataFrame([(1, 1.0, False), (2, float("nan"), False)], "fold int, slope double, any_boundary_hit boolean"),
        "selection": spark.createDataFrame([(1, 0, True, True), (1, 1, False, False), (2, 0, False, True), (2, 1, True, False)], "fold int, candidate int, within boolean, selected boolean"),
        "folds": spark.createDataFrame([(1, True), (1, False), (2, True)], "fold int, is_event boolean"),
    }
    got = {r["gate"]: r["passed"] for r in CL.judged(tables, CL.study_claims("p", "a", ["a", "b"], ["S"], 2, 2, 0.9)).collect()}
    passed = {"beats_a_point", "beats_a_interval", "beats_b_point", "holdout_scenarios_complete", "holdout_point_superiority", "interval_coverage_nominal", "parameters_in_all_folds",
              "slope_positive", "parameters_interior", "all_candidates_scored"}
    assert {g for g, p in got.items() if p} == passed and len(got) == 19


def test_leak_guard_stops_scoring(spark):
    rows = spark.createDataFrame([("s1", "g1", 1.0)], "specimen_id string, group_id string, y double")
    groups = spark.createDataFrame([("g1",)], "group_id string")
    frozen = FZ.Frozen(groups, groups, {}, groups, groups)
    with pytest.raises(ContractError, match="outcome_present"):
        FZ.score_conditions(frozen, rows, F.lit(1.0), "specimen_id", ["y"])
