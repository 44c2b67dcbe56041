import math

import pytest
from pyspark.sql import functions as F

from evenfold.functions import damage as D
from evenfold.functions import families as L
from evenfold.functions import normal as N
from evenfold.functions import text as X


def upper_tail_log(z):
    if z < 25:
        p = 0.5 * math.erfc(z / math.sqrt(2))
        return math.log(p) if z > -1 else math.log1p(-0.5 * math.erfc(-z / math.sqrt(2)))
    # Continued fraction of the Mills ratio.
    f = z
    for k in range(200, 0, -1):
        f = z + k / f
    return -0.5 * z * z - N.HALF_LOG_2PI - math.log(f)


def test_log_survival(spark):
    zs = [x / 4 for x in range(-160, 161)] + [0.66, 0.663, 5.65, 5.66]
    df = spark.createDataFrame([(z,) for z in zs], "z double").select("z", N.log_sf(F.col("z")).alias("v"))
    for r in df.collect():
        want = upper_tail_log(r["z"])
        assert r["v"] == pytest.approx(want, rel=1e-12, abs=1e-300), r["z"]


def test_family_derivatives(spark):
    """Derivatives of every family against central differences of its losses."""
    h = 1e-5
    rows = spark.createDataFrame([(z / 3,) for z in range(-9, 10)], "z double")
    z = F.col("z")
    for name, fam in L.FAMILIES.items():
        for loss, deriv in ((fam.event, fam.event_d), (fam.censored, fam.censored_d)):
            d1, d2 = deriv(z)
            out = rows.select(
                "z", d1.alias("d1"), d2.cast("double").alias("d2"), loss(z).alias("f0"), loss(z + h).alias("fp"), loss(z - h).alias("fm")).collect()
            for r in out:
                assert r["d1"] == pytest.approx((r["fp"] - r["fm"]) / (2 * h), rel=1e-5, abs=1e-6), (name, r["z"])
                assert r["d2"] == pytest.approx((r["fp"] - 2 * r["f0"] + r["fm"]) / h**2, rel=2e-2, abs=2e-3), (name, r["z"])


def test_weibull_forms_differ_by_their_median(spark):
    """With the location moved so that medians agree, both forms give the same loss."""
    df = spark.createDataFrame([(1.3, 1.0, 0.4, True), (1.3, 1.0, 0.4, False)], "y double, m double, s double, e boolean")
    at_location = L.row_loss("weibull", F.col("y"), F.col("m") - F.col("s") * L.LN_LN2, F.col("s"), F.col("e"))
    at_median = L.row_loss("weibull_median", F.col("y"), F.col("m"), F.col("s"), F.col("e"))
    for r in df.select(at_location.alias("a"), at_median.alias("b")).collect():
        assert r["a"] == pytest.approx(r["b"], rel=1e-12)


def test_competing_location_is_sum_of_damages(spark):
    df = spark.createDataFrame([(5.0, 2.0, -0.4, 0.7), (5.0, 2.0, 0.3, None), (5.0, 2.0, 0.3, 500.0)], "a double, b double, x double, r double")
    out = df.select("*", D.competing_location(F.col("a"), F.col("b"), F.col("x"), F.col("r")).alias("p")).collect()
    d = 10 ** (2.0 * -0.4 - 5.0)
    assert out[0]["p"] == pytest.approx(-math.log10(d + d * 10**0.7), rel=1e-12)
    assert out[1]["p"] == pytest.approx(5.0 - 0.6)
    assert out[2]["p"] == pytest.approx(5.0 - 0.6 - 500.0)


def test_bool_tokens(spark):
    df = spark.createDataFrame([(" TRUE",), ("y",), ("0",), ("No ",), ("maybe",), (None,)], "t string")
    assert [r[0] for r in df.select(X.parse_bool(F.col("t"))).collect()] == [True, True, False, False, None, None]


def test_new_family_by_name(spark):
    base = L.FAMILIES["normal"]
    L.register("my_normal", base)
    with pytest.raises(ValueError):
        L.register("my_normal", base)
    df = spark.createDataFrame([(1.0, 0.5, 0.7, True)], "y double, m double, s double, e boolean")
    a, b = (L.row_loss(n, *[F.col(c) for c in "ymse"]) for n in ("normal", "my_normal"))
    r = df.select(a.alias("a"), b.alias("b")).first()
    assert r["a"] == r["b"]
