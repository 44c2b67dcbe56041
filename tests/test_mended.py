"""Cases that once gave wrong results."""

import pytest
from pyspark.sql import functions as F

from evenfold.functions.text import shortest_number
from evenfold.operators.diff import compare_unkeyed
from evenfold.operators.ranks import label_ranks
from evenfold.operators.resample import require_pairs
from evenfold.plans.variants import VARIANTS
from evenfold.streaming.jobs import with_pending


def test_numbers_keep_all_digits(spark):
    df = spark.createDataFrame([(1.2e-7,), (20.0,), (1e10,), (0.1234567891,), (-3.5,)], "v double")
    assert [r.t for r in df.select(shortest_number(F.col("v")).alias("t")).collect()] == ["1.2E-7", "20", "1E10", "0.1234567891", "-3.5"]


def test_unkeyed_tables_agree_within_tolerance(spark):
    a = spark.createDataFrame([("x", 0.5), ("x", 0.5), ("y", 1.0), ("z", 2.0)], "k string, v double")
    b = spark.createDataFrame([("x", 0.5 + 1e-12), ("x", 0.5 - 1e-12), ("y", 1.0 + 4e-10), ("z", 2.0)], "k string, v double")
    got = sorted((r.k, r.n_first, r.n_second) for r in compare_unkeyed(a, b, ["k", "v"]).collect())
    assert got == [("y", 0, 1), ("y", 1, 0)]


def test_labels_with_a_common_prefix(spark):
    names = [f"group-{i:04d}" for i in range(500)]
    got = {r.k: r.plot_label for r in label_ranks(spark.createDataFrame([(n,) for n in names], "k string"), "k", "S").collect()}
    assert got == {n: f"S{i + 1:02d}" for i, n in enumerate(names)}


def test_groups_without_a_partner_are_an_error(spark):
    base = spark.createDataFrame([("s", "g1"), ("s", "g2")], "scope string, g string")
    full = spark.createDataFrame([("s", "m", "g1"), ("s", "m", "g2")], "scope string, m string, g string")
    require_pairs(full, base, ["scope"], ["m"], "g")
    require_pairs(full.drop("scope"), base.drop("scope"), [], ["m"], "g")
    for bad in (full.where("g = 'g1'"), full.unionByName(spark.createDataFrame([("s", "m", "g3")], full.schema))):
        with pytest.raises(ValueError, match="partner"):
            require_pairs(bad, base, ["scope"], ["m"], "g")


def test_variants_are_distinct_and_spelt_out():
    assert len(VARIANTS) == 34 and len({v.name for v in VARIANTS}) == 34
    by = {v.name: v for v in VARIANTS}
    assert by["wet_factor=0.5,freq_power=1.5"].drivers == {"wet_factor": 0.5, "freq_power": 1.5}
    assert by["trunk_only=True,family=loglogistic"].trunk_only and by["unchanged"].changes == ()


def test_waiting_predictions_are_pending(spark):
    joined = spark.createDataFrame([(1, 10, True)], "id long, at long, observed boolean")
    sent = spark.createDataFrame([(1, 10), (2, 20)], "id long, at long")
    assert sorted((r.id, r.observed) for r in with_pending(joined, sent, "id", "at").collect()) == [(1, True), (2, False)]
