"""A competing-damage trunk with a kernel learner on its residuals, kept as tables and scored later.

Trunk, input scales, kernel and support are fitted for every training set (``hold``; 0
trains on all rows) in shared passes. The state is four small tables keyed by ``hold``,
so it can be stored, and scoring is a join with them, for held-out folds and for new
rows alike.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evenfold.functions import damage as D
from evenfold.operators.fit import kernel as KR
from evenfold.operators.fit import likelihood as LK
from evenfold.operators.fit import trunk as TR
from evenfold.operators.joins import nearest_distance
from evenfold.roles import DEFAULT, Roles
from evenfold.session import settle

TABLES = ("parameters", "scales", "models", "temperatures")


@dataclass
class Hybrid:
    """The fitted state: trunk parameters, input scales, kernel models and training temperatures by ``hold``."""

    parameters: DataFrame
    scales: DataFrame
    models: DataFrame
    temperatures: DataFrame

    def save(self, folder: str) -> None:
        for name in TABLES:
            getattr(self, name).write.parquet(f"{folder}/{name}")

    @staticmethod
    def load(spark: SparkSession, folder: str) -> "Hybrid":
        return Hybrid(*[spark.read.parquet(f"{folder}/{name}") for name in TABLES])


def standardised(inputs: list[str]) -> Column:
    return F.array(*[(F.col(c) - F.col(f"mean_{c}")) / F.col(f"sd_{c}") for c in inputs])


def with_base(rows: DataFrame, parameters: DataFrame, scales: DataFrame, inputs: list[str]) -> DataFrame:
    """``rows`` (hold and inputs) with the trunk's ``base`` and the standardised inputs ``x`` of their training set."""
    kept = parameters.select("hold", "gamma", *TR.COMPETING_NAMES)
    based = TR.predict_competing(rows, kept, ["hold"], out="base").drop("gamma", "decrement", *TR.COMPETING_NAMES)
    return based.join(scales, "hold").withColumn("x", standardised(inputs)).drop(*[f"{p}_{c}" for p in ("mean", "sd") for c in inputs])


def fit(rows: DataFrame, holds: list[int], inputs: list[str], gamma: float, strength: float = 0.0, settings: tuple[tuple[float, float], ...] = ((2.0, 1.0),),
        count: int = 256, roles: Roles = DEFAULT) -> Hybrid:
    """Fit every training set of ``holds`` on the rows whose fold is not held out; ``settings`` are (length, alpha) of the residual kernel.

    ``inputs`` are numeric; the environment is the trunk's business and is not among them.
    """
    spark = rows.sparkSession
    keys = [{"hold": h, "gamma": gamma} for h in holds]
    classic = {(f.key["hold"], f.key["gamma"]): f for f in TR.fit_walker(rows, keys, TR.leave_fold_out(), ["fold"], roles=roles)}
    fits = TR.fit_competing(rows, keys, classic, TR.class_policy(rows, holds, roles=roles), TR.leave_fold_out(), ["fold"], strength, roles=roles)
    parameters = settle(LK.parameter_table(spark, fits, TR.COMPETING_NAMES), "hybrid_parameters")
    training = F.explode(F.filter(F.array(*[F.lit(h) for h in holds]), lambda h: h != F.col("fold"))).alias("hold")
    events = rows.where(F.col(roles.event)).select("*", training)
    spreads = [F.when(F.stddev_pop(c) > 0, F.stddev_pop(c)).otherwise(1.0).alias(f"sd_{c}") for c in inputs]
    scales = settle(events.groupBy("hold").agg(*[F.avg(c).alias(f"mean_{c}") for c in inputs], *spreads), "hybrid_scales")
    points = with_base(events, parameters, scales, inputs).select(F.col("hold").alias("task"), "x", (F.col(roles.y) - F.col("base")).alias("y"))
    models = KR.fit(points, [KR.KernelTask(h, length, alpha) for h in holds for length, alpha in settings], count)
    return Hybrid(parameters, scales, models, settle(events.select("hold", roles.temperature).distinct(), "hybrid_temperatures"))


def score(state: Hybrid, rows: DataFrame, inputs: list[str], etas: tuple[float, ...] = (0.75,), roles: Roles = DEFAULT) -> DataFrame:
    """``rows`` (with ``hold``) once per kernel setting and gain, with base, correction, support and prediction.

    The correction fades with the distance to the nearest training temperature; where it
    is null, for want of an input, the base stands alone.
    """
    # Distances first: they read their rows twice, and corrections are dear.
    near = nearest_distance(rows, state.temperatures, ["hold"], roles.temperature, "_gap")
    based = with_base(near, state.parameters, state.scales, inputs).withColumn("task", F.col("hold"))
    learned = KR.predict(based, state.models, "correction").drop("task")
    gated = learned.withColumn("support", F.coalesce(D.support_weight(F.col("_gap")), F.lit(0.0))).drop("_gap").withColumn("eta", F.explode(F.array(*[F.lit(float(e)) for e in etas])))
    return gated.withColumn(roles.pred, D.gated_blend(F.col("base"), F.coalesce("correction", F.lit(0.0)), F.col("support"), F.col("eta")))
