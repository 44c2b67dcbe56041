"""Derived columns of a record table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evenfold.functions import damage as D
from evenfold.functions import text as X


def with_features(df: DataFrame, s: str = "s_level", r: str = "r_ratio", freq: str = "freq", uts: str = "uts",
                  temp: str = "temp_c", env: str = "env_class", life: str = "life") -> DataFrame:
    """Outcome on the log scale, loading features, exposure, thermal drive and proxies."""
    c = F.col
    out = df.withColumns({"y": F.log10(F.greatest(c(life), F.lit(1.0)))} if life in df.columns else {})
    out = out.withColumns(D.loading_features(c(s), c(r), c(freq), c(uts), c(temp)))
    out = out.withColumns({"exposure": X.exposure(c(env)), "drive": D.thermal_drive(c(temp))})
    return out.withColumns(D.proxies(c(s), c(temp), c("log_f"), X.is_inert(c(env)), X.is_wet(c(env))))


def qa_flags(life: Column, event: Column, raw_text: Column, s: Column, limits: tuple[float, ...]) -> list[Column]:
    """Events exactly at a usual stopping limit, and stress above strength."""
    at_limit = F.lit(False)
    for limit in limits:
        at_limit = at_limit | X.near(life, limit)
    approximate = F.lower(F.coalesce(raw_text, F.lit(""))).rlike(X.APPROXIMATE_PATTERN)
    return [(event & at_limit & ~approximate).alias("round_event"), (s > 1.0).alias("above_strength")]


def trunk_features(df: DataFrame, intercept, slope, gamma, log_s: str = "log_s", r: str = "r_ratio") -> DataFrame:
    """Corrected stress and mechanical prediction, as further inputs of a residual learner."""
    x = D.walker(F.col(log_s), F.col(r), gamma)
    as_col = lambda v: v if isinstance(v, Column) else F.lit(float(v))
    return df.withColumn("walker_stress", x).withColumn(
        "mechanical_prediction", D.linear_location([as_col(intercept), as_col(slope)], [F.col("walker_stress")]))
