"""Scoring a stream of conditions and joining predictions with outcomes that arrive later."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from evenfold.functions import families as L
from evenfold.plans.frozen import Frozen, with_prediction
from evenfold.roles import DEFAULT, Roles


def score_stream(conditions: DataFrame, frozen: Frozen, location: Column) -> DataFrame:
    """Stateless scoring with a frozen parameter table."""
    return with_prediction(frozen, conditions, location)


def join_outcomes(predictions: DataFrame, outcomes: DataFrame, key: str, predicted_at: str, observed_at: str, horizon: str,
                  delay: str) -> DataFrame:
    """Predictions with their outcome within ``horizon``; without one, once the watermark has
    passed, the prediction comes out with null outcome columns.

    State is bounded by horizon and watermark; outcomes later than the watermark are dropped.
    """
    p = predictions.withWatermark(predicted_at, delay).alias("p")
    o = outcomes.withColumnRenamed(key, "_key").withWatermark(observed_at, delay).alias("o")
    on = (
        (F.col(f"p.{key}") == F.col("o._key"))
        & (F.col(f"o.{observed_at}") >= F.col(f"p.{predicted_at}"))
        & (F.col(f"o.{observed_at}") <= F.col(f"p.{predicted_at}") + F.expr(f"INTERVAL {horizon}")))
    return p.join(o, on, "left_outer").drop("_key")


def with_outcome_scores(joined: DataFrame, family: str = "normal", roles: Roles = DEFAULT) -> DataFrame:
    y, event = F.col(roles.y), F.col(roles.event)
    return joined.withColumns({
        "observed": y.isNotNull(),
        "row_nll": L.row_loss(family, y, F.col(roles.pred), F.col(roles.scale), event),
        "covered90": F.when(event, L.covered(y, F.col("prob_lower90"), F.col("prob_upper90")))})


def with_pending(joined: DataFrame, sent: DataFrame, key: str, at: str) -> DataFrame:
    """The joined rows and, as not observed, every prediction that is still waiting in the state of the join.

    A prediction comes out of the join only once the watermark has passed its horizon; the
    sink of the predictions knows the others. Outcomes dropped for lateness leave theirs pending.
    """
    waiting = sent.select(key, at).join(joined.select(key), key, "left_anti").withColumn("observed", F.lit(False))
    return joined.unionByName(waiting, allowMissingColumns=True)


def window_summary(scored: DataFrame, at: str, width: str) -> DataFrame:
    """Per window of prediction time: observed and pending rows, loss and coverage."""
    return scored.groupBy(F.window(at, width).alias("_w")).agg(
        F.count(F.lit(1)).alias("n_predicted"), F.count(F.when(F.col("observed"), 1)).alias("n_observed"),
        F.avg("row_nll").alias("joint_nll"), F.avg(F.col("covered90").cast("double")).alias("coverage90"),
    ).select(F.col("_w.start").alias("window_start"), "n_predicted", "n_observed", "joint_nll", "coverage90")


def write_available(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append all data available now to a Parquet table; restarts go on where they stopped."""
    return (stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start(path))
