import hashlib

import pytest
from pyspark.sql import functions as F

from evenfold.operators import contracts as C
from evenfold.operators import folds as FO


def greedy(sizes, k, seed):
    """The rule, one group after the other."""
    order = sorted(sizes, key=lambda g: (-sizes[g], hashlib.md5(f"{seed}|{g}".encode()).hexdigest(), g))
    load, out = [0] * min(k, len(sizes)), {}
    for g in order:
        f = load.index(min(load))
        load[f] += sizes[g]
        out[g] = f + 1
    return out


@pytest.mark.parametrize("k", [1, 3, 5, 50])
def test_greedy_folds(spark, k):
    sizes = {f"g{i}": 1 + (i * i) % 5 for i in range(40)} | {"hot": 60}
    rows = [(g, i) for g, n in sizes.items() for i in range(n)]
    df = spark.createDataFrame(rows, "group_id string, row_id long")
    got = {r["group_id"]: r["fold"] for r in FO.greedy_group_folds(df, k, 17).collect()}
    assert got == greedy(sizes, k, 17)


def test_strict_holdouts_with_infeasible_inner_folds(spark):
    """Events in only two training groups leave some of four inner folds without any."""
    rows = []
    for g in range(8):
        level = "x" if g >= 6 else "y"
        for i in range(3):
            rows.append((100 * g + i, f"g{g}", level, g in (0, 1, 6), True))
    df = spark.createDataFrame(rows, "row_id long, group_id string, f string, is_event boolean, u boolean")
    plan = {r["level"]: r for r in FO.strict_holdouts(df, {"S": "f"}, seed=3).collect()}
    assert plan["x"]["reason"] == "inner_folds_not_feasible" and plan["x"]["action"] == "not_estimable"
    assert plan["y"]["reason"] == "too_few_training_groups"


def test_strict_actions(spark):
    rows = []
    for g in range(10):
        for i in range(4):
            rows.append((100 * g + i, f"g{g}", "shared" if g == 0 and i == 0 else f"l{g % 2}" if g else "l0", True))
    df = spark.createDataFrame(rows, "row_id long, group_id string, f string, is_event boolean")
    plan = {r["level"]: r for r in FO.strict_holdouts(df, {"S": "f"}, seed=3).collect()}
    assert plan["shared"]["action"] == "refit" and plan["shared"]["n_removed"] == 3
    assert plan["l1"]["action"] == "reuse"


def test_record_folds_are_balanced(spark):
    n = [r["count"] for r in FO.record_folds(spark.range(1003).withColumnRenamed("id", "row_id"), 5, 2).groupBy("fold").count().collect()]
    assert sorted(n) == [200, 200, 201, 201, 201]


def test_missing_column_is_reported(spark):
    with pytest.raises(C.ContractError, match="missing columns"):
        C.require_columns(spark.range(1), ["id", "z"], "table")


def test_require_shows_examples(spark):
    df = spark.createDataFrame([(1,), (1,), (2,)], "k long")
    with pytest.raises(C.ContractError, match="not_unique"):
        C.require(C.duplicates(df, ["k"]), "table")
    C.require(C.duplicates(df.distinct(), ["k"]), "table")


def test_null_never_passes_a_rule(spark):
    df = spark.createDataFrame([(1, None), (2, 1.0), (3, float("nan")), (4, float("inf"))], "k long, v double")
    bad = C.Contract(("k", "v"), "k", {"v": (C.not_finite(F.col("v")), F.col("v")), "p": (F.col("v") <= 0, F.col("v"))}).violations(df).collect()
    assert {(r["rule"], r["key"]) for r in bad} == {("v", "1"), ("p", "1"), ("v", "3"), ("v", "4")}


def test_fold_problems(spark):
    df = spark.createDataFrame([(1, True), (1, True), (2, False)], "fold int, is_event boolean")
    assert {(r["fold"], r["reason"]) for r in FO.fold_problems(df).collect()} == {(1, "no_events_in_training"), (2, "no_events_in_test")}
