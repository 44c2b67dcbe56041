"""Stand-in views, sources and simple checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from evenfold.checks.registry import query
from evenfold.operators import metrics as M
from evenfold.plans import standins as S

REC_EXACT = "row_id group_id source_id equiv_id architecture env_class temp_bin is_event is_censored n_lines"
REC_NUM = "temp_c life y x_gross s_level r_ratio freq sigma_max uts"


@query("records", "SELECT * REPLACE (log10(sigma_max) AS sigma_max, log10(uts) AS uts) FROM rec", REC_EXACT, REC_NUM, "rec")
def _records(spark, sf):
    return S.records(spark, sf).withColumns({"sigma_max": F.log10("sigma_max"), "uts": F.log10("uts")})


@query("raw_rows", "SELECT * FROM dup", "row_id equiv_id source_id is_censored", "nf", "dup")
def _raw(spark, sf):
    return S.raw_rows(spark, sf)


@query("greedy_group_folds", "SELECT * FROM folds", "group_id n_rows fold", "", "folds")
def _folds(spark, sf):
    return S.fold_map(S.records(spark, sf))


@query("prediction_facts", "SELECT * FROM pred", "row_id group_id equiv_id model fold family scenario holdout is_event",
       "y pred scale", "pred")
def _pred(spark, sf):
    return S.predictions(spark, sf).select(
        "row_id", "group_id", "equiv_id", "model", "fold", "family", "scenario", "holdout", "is_event", "y", "pred", "scale")


@query("factor_predictions", "SELECT * FROM fpred", "row_id scenario holdout model is_event", "y pred scale", "fpred")
def _fpred(spark, sf):
    return S.factor_predictions(spark, sf).select(
        "row_id", "scenario", "holdout", "model", "is_event", "y", "pred", "scale")


@query("scored_predictions", "SELECT * FROM sco", "row_id model", "row_nll lower80 upper80 lower90 upper90", "sco")
def _scored(spark, sf):
    return S.scored(spark, sf).select("row_id", "model", "row_nll", "lower80", "upper80", "lower90", "upper90")
