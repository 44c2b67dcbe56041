import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from evenfold.operators.quantiles import linear_quantiles, value_bucket, weighted_quantiles
from evenfold.operators.ranks import hash_row_number, label_ranks

SLOW = settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
VALUE = st.sampled_from([-3.5, -1.0, -1e-9, 0.0, 1e-9, 0.25, 0.2500001, 1.0, 2.0, 1e6, 1e6 + 1e-3])


@SLOW
@given(st.lists(st.tuples(st.sampled_from("ab"), VALUE, st.sampled_from([0.5, 1.0, 3.0])), min_size=1, max_size=40))
def test_quantiles_match_numpy(spark, data):
    df = spark.createDataFrame([(i, *d) for i, d in enumerate(data)], "i long, s string, v double, w double")
    qs = (0.05, 0.5, 0.8, 0.95)
    lin = {(r["s"], r["q"]): r["value"] for r in linear_quantiles(df, ["s"], F.col("v"), qs).collect()}
    wtd = {(r["s"], r["q"]): r["value"] for r in weighted_quantiles(df, ["s"], F.col("v"), F.col("w"), F.col("i"), qs).collect()}
    for s in {d[0] for d in data}:
        part = sorted([(v, i, w) for i, (k, v, w) in enumerate(data) if k == s])
        v = np.array([p[0] for p in part])
        w = np.array([p[2] for p in part])
        for q in qs:
            assert lin[s, q] == pytest.approx(np.quantile(v, q), rel=1e-9, abs=1e-12)
            assert wtd[s, q] == pytest.approx(np.interp(q, np.cumsum(w) / w.sum(), v), rel=1e-9, abs=1e-12)


def test_bucket_keeps_order(spark):
    rng = np.random.default_rng(1)
    v = sorted(float(x) for x in np.concatenate([rng.normal(size=300), rng.normal(size=300) * 1e-8, rng.normal(size=300) * 1e12, [0.0, 2.0, 4.0, -8.0]]))
    for bits in (10, 20):
        b = [r[0] for r in spark.createDataFrame([(x,) for x in v], "v double").coalesce(1).select(value_bucket(F.col("v"), bits)).collect()]
        assert b == sorted(b)


def test_one_scope_with_most_rows(spark):
    """A third of the rows in one scope and a constant value in it."""
    rows = spark.range(30000).select(F.col("id").alias("i"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("g"), F.col("id") % 500)).alias("s"),
                                     F.when(F.col("id") % 6 == 0, 7.0).otherwise(F.sqrt("id")).alias("v"))
    out = {r["s"]: r["value"] for r in linear_quantiles(rows, ["s"], F.col("v"), (0.5,)).collect()}
    pdf = rows.toPandas()
    for s, part in pdf.groupby("s"):
        assert out[s] == pytest.approx(np.quantile(part["v"], 0.5))


def test_row_numbers(spark):
    df = spark.range(5000).withColumn("g", F.when(F.col("id") < 2000, "hot").otherwise((F.col("id") % 7).cast("string")))
    got = {(r["g"], r["id"]): r["rn"] for r in hash_row_number(df, ["g"], 3, "id").collect()}
    import hashlib

    by = {}
    for g, i in got:
        by.setdefault(g, []).append(i)
    for g, ids in by.items():
        order = sorted(ids, key=lambda i: (hashlib.md5(f"3|{i}".encode()).hexdigest(), i))
        assert [got[g, i] for i in order] == list(range(1, len(ids) + 1))


def test_labels(spark):
    df = spark.createDataFrame([(f"src{i:03d}",) for i in range(120)], "s string")
    out = {r["s"]: r["plot_label"] for r in label_ranks(df, "s", "S").collect()}
    assert (out["src000"], out["src008"], out["src009"], out["src119"]) == ("S01", "S09", "S10", "S120")
