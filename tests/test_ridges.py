"""Ridges of all folds from one pass of sums against ridges solved on the rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from evenfold.operators.fit import learners as LN

SCHEMA = "row_id int, fold int, is_event boolean, a double, b double, y double"


def rows_of(n=300, seed=8):
    rng = np.random.default_rng(seed)
    out = []
    for i in range(n):
        a, b = map(float, rng.normal(size=2))
        out.append((i, i % 3 + 1, bool(rng.random() < 0.7), a, b, float(np.sin(2 * a) + b + 4 + rng.normal(scale=0.1))))
    return out


@pytest.mark.parametrize("centred", [True, False])
def test_ridges_are_those_of_the_rows(spark, centred):
    rows, features = rows_of(), LN.random_features(["a", "b"], 2.0, 16, 3)
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    got = {r["row_id"]: r["pred"] for r in LN.fold_predictions(df, ["a", "b"], LN.kernel_ridge(0.5), "y", [1, 2, 3], features=features, centred=centred).collect()}
    assert len(got) == len(rows)
    for h in (1, 2, 3):
        train, test = [r for r in rows if r[2] and r[1] != h], [r for r in rows if r[1] == h]
        x, y = features.of(np.array([r[3:5] for r in train])), np.array([r[5] for r in train])
        mean = y.mean() if centred else 0.0
        w = np.linalg.solve(x.T @ x + 0.5 / y.std() * np.eye(16), x.T @ (y - mean))
        want = features.of(np.array([r[3:5] for r in test])) @ w + mean
        assert [got[r[0]] for r in test] == pytest.approx(want)


def test_all_folds_take_two_passes_over_the_rows(spark):
    df = spark.createDataFrame(rows_of(), SCHEMA)
    seen = spark.sparkContext.accumulator(0)
    tap = df.mapInArrow(lambda batches: (seen.add(b.num_rows) or b for b in batches), SCHEMA)
    out = LN.fold_predictions(tap, ["a", "b"], LN.kernel_ridge(1.0), "y", [1, 2, 3], features=LN.random_features(["a", "b"], 2.0, 8, 3))
    assert out.agg(F.sum("pred")).first()[0] is not None and seen.value == 2 * 300


def test_a_fold_without_training_rows_has_nulls(spark):
    df = spark.createDataFrame([(1, 1, True, 1.0, 0.0, 2.0), (2, 2, False, 1.0, 0.0, 5.0), (3, 3, False, 1.0, 0.0, 5.0)], SCHEMA)
    got = {r["row_id"]: r["pred"] for r in LN.fold_predictions(df, ["a", "b"], LN.kernel_ridge(1.0), "y", [1, 2], centred=True).collect()}
    assert got == {1: None, 2: pytest.approx(2.0)}


def test_a_hybrid_reads_its_rows_twice(spark):
    df = spark.createDataFrame(rows_of(), SCHEMA).withColumn("base", F.lit(4.0))
    seen = spark.sparkContext.accumulator(0)
    tap = df.mapInArrow(lambda batches: (seen.add(b.num_rows) or b for b in batches), df.schema)
    out = LN.hybrid(tap, "base", ["a", "b"], LN.kernel_ridge(1.0), [1, 2, 3], 0.75, F.lit(1.0), features=LN.random_features(["a", "b"], 2.0, 8, 3))
    assert out.agg(F.sum("pred")).first()[0] is not None and seen.value == 2 * 300
