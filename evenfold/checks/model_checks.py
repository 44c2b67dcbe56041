"""Sources and sinks, fits, nested evaluation, frozen scoring and streams."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as ST

from evenfold.checks.registry import query
from evenfold.functions import families as L
from evenfold.functions import normal as NM
from evenfold.functions import text as X
from evenfold.operators import features as FE
from evenfold.operators import folds as FO
from evenfold.operators import metrics as M
from evenfold.operators import reshape as R
from evenfold.operators import scores as SC
from evenfold.operators.fit import learners as LN
from evenfold.operators.fit import likelihood as LK
from evenfold.operators.fit import mapped as MP
from evenfold.operators.fit import trunk as TR
from evenfold.operators.fit.closed_form import complement_line
from evenfold.operators.fit.design import Design
from evenfold.plans import frozen as FZ
from evenfold.plans import nested as N
from evenfold.plans import standins as S
from evenfold.plans import studies as T
from evenfold.plans.variants import VARIANTS
from evenfold.session import settle, shared_folder
from evenfold.sources import tables as IO
from evenfold.streaming import jobs as J
from evenfold.streaming import pending as PD

c = F.col


def _new_folder(spark, what: str) -> str:
    import uuid

    return f"{shared_folder(spark)}/evenfold/{what}-{uuid.uuid4().hex}"


# ------------------------------------------------------------------ sources and sinks

@query("read_contracted", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders", "o_orderkey o_custkey", "o_totalprice")
def _read(spark, sf):
    return IO.read_records(spark, f"{sf}/orders.parquet", ["o_orderkey", "o_custkey", "o_totalprice"]).select("o_orderkey", "o_custkey", "o_totalprice")


@query("csv_with_mark", "SELECT c_custkey, c_name, c_acctbal FROM customer", "c_custkey c_name", "c_acctbal")
def _csv(spark, sf):
    path = _new_folder(spark, "csv")
    src = S.table(spark, sf, "customer").select(c("c_custkey").alias(IO.BOM + "c_custkey"), "c_name", "c_acctbal")
    src.write.mode("errorifexists").option("header", True).csv(path)
    schema = ST.StructType([ST.StructField("c_custkey", ST.LongType()), ST.StructField("c_acctbal", ST.DoubleType())])
    return IO.read_csv(spark, path, ["c_custkey", "c_name"], schema)


@query("write_tables", "SELECT 'rec' AS name, count(*) AS n FROM rec UNION ALL SELECT 'levels', count(DISTINCT env_class) FROM rec", "name n", "", "rec")
def _write(spark, sf):
    out = _new_folder(spark, "tables")
    IO.require_empty_target(spark, out)
    rec = S.records(spark, sf)
    names = IO.write_tables({"rec": rec, "levels": rec.select("env_class").distinct()}, out)
    parts = [spark.read.parquet(f"{out}/{n}").agg(F.count(F.lit(1)).alias("n")).select(F.lit(n).alias("name"), "n") for n in names]
    return parts[0].unionByName(parts[1])


@query("run_manifest")
def _manifest(spark, sf):
    return IO.manifest({"records": S.records(spark, sf), "raw": S.raw_rows(spark, sf)}, {"folds": S.K, "seed": S.SEED})


@query("incremental_todo", "SELECT DISTINCT env_class, temp_bin FROM rec WHERE env_class NOT IN ('air', 'steam')", "env_class temp_bin", "", "rec")
def _todo(spark, sf):
    rec = S.records(spark, sf)
    plan = rec.groupBy("env_class", "temp_bin").agg(F.count(F.lit(1)).alias("n"))
    run = IO.run_hash(IO.manifest({"records": rec}, {"folds": S.K}))
    store = _new_folder(spark, "store")
    keys = ["run_hash", "env_class", "temp_bin"]
    plan = settle(plan.withColumn("run_hash", F.lit(run)), "plan")
    IO.append_results(plan.where("env_class IN ('air', 'steam')"), store, keys)
    IO.append_results(plan.where("env_class = 'vacuum'").withColumn("run_hash", F.lit("other")), store, keys)
    return IO.todo(plan, IO.stored(spark, store, plan.schema), keys).select("env_class", "temp_bin")


# ------------------------------------------------------------------ closed forms and fits

@query("fold_lines", "SELECT fold, slope, intercept FROM ln", "fold", "slope intercept", "pred")
def _lines(spark, sf):
    return complement_line(S.folded(spark, sf).where("is_event"), "fold", "x_gross", "y").select("fold", "slope", "intercept")


@query("ridge_lines", "SELECT fold, a AS alpha, (sy - (sxy-sx*sy/n)/(sxx-sx*sx/n+a)*sx)/n AS intercept, (sxy-sx*sy/n)/(sxx-sx*sx/n+a) AS x_gross FROM cs, (VALUES (0.1::double), (10.0::double)) v(a)", "fold", "alpha intercept x_gross", "pred")
def _ridge(spark, sf):
    fits = MP.complement_ridge(S.folded(spark, sf).where("is_event"), "fold", ["x_gross"], "y", (0.1, 10.0))
    return spark.createDataFrame([(f["fold"], f["alpha"], f["intercept"], f["x_gross"]) for f in fits], "fold int, alpha double, intercept double, x_gross double")


def trunk_rows(spark, sf):
    f = FE.with_features(S.folded(spark, sf))
    return f.withColumns({"wet": X.is_wet(c("env_class")), "freq_drive": c("log_f"), "stress_on": F.lit(1.0)})


HOLDS = list(range(1, S.K + 1))


@query("walker_fit")
def _walker(spark, sf):
    keys = [{"hold": h, "gamma": g} for h in HOLDS for g in (0.75, 0.85, 0.95)]
    fits = TR.fit_walker(trunk_rows(spark, sf), keys, TR.leave_fold_out(), ["fold"])
    return LK.parameter_table(spark, fits, ("a", "b"))


@query("walker_fit_with_extras")
def _walker2(spark, sf):
    fits = TR.fit_walker(trunk_rows(spark, sf), [{"hold": h, "gamma": 0.85} for h in HOLDS], TR.leave_fold_out(), ["fold"], ("m_mean",))
    return LK.parameter_table(spark, fits, ("a", "b", "c_m_mean"))


DESIGN = Design(numeric=("s_level", "r_ratio", "x_gross"), categorical={"env_class": ("air", "vacuum", "steam")})


@query("censored_regression")
def _aft(spark, sf):
    rows = S.folded(spark, sf)
    out = None
    for family in ("normal", "weibull"):
        fits = TR.fit_linear(rows, DESIGN, HOLDS, (0.01, 1.0), family)
        t = LK.parameter_table(spark, fits, ("intercept", *DESIGN.names())).withColumn("family", F.lit(family))
        out = t if out is None else out.unionByName(t)
    return out


@query("competing_fit")
def _competing(spark, sf):
    rows = settle(trunk_rows(spark, sf), "trunk")
    keys = [{"hold": h, "gamma": 0.85} for h in HOLDS]
    classic = {(f.key["hold"], f.key["gamma"]): f for f in TR.fit_walker(rows, keys, TR.leave_fold_out(), ["fold"])}
    fits = TR.fit_competing(rows, keys, classic, TR.class_policy(rows, HOLDS), TR.leave_fold_out(), ["fold"], strength=0.1)
    return LK.parameter_table(spark, fits, TR.COMPETING_NAMES)


@query("multiplier_profile")
def _bprofile(spark, sf):
    return N.beta_profile(settle(trunk_rows(spark, sf), "trunk"), (0.0, 1.0), 0.85, S.K, 0.1)


@query("custom_location")
def _custom(spark, sf):
    """A location of the user's own, with a log-logistic family."""
    model = LK.LocationModel(("a", "b"), ("x_gross",), lambda t, s: (t[0] + t[1] * c("x_gross"), [F.lit(1.0), c("x_gross")]))
    import numpy as np

    inf = np.inf
    tasks = [LK.Task({"hold": h}, np.array([5.0, 0.0, 0.0]), np.array([-inf, -inf, TR.LN_SCALE[0]]), np.array([inf, inf, TR.LN_SCALE[1]])) for h in HOLDS]
    return LK.parameter_table(spark, LK.fit(S.folded(spark, sf), tasks, model, "loglogistic", TR.leave_fold_out(), ["fold"]), ("a", "b"))


def _zoom_sql(levels: int = 7, cells: int = 32) -> str:
    """SQL that closes in on the zero of the slope of the mean normal loss in ln(scale), a grid at a time."""
    z = "((y-pred)/exp(ls))"
    slope = f"avg(CASE WHEN is_event THEN 1 - {z}*{z} ELSE -{z}*exp(-0.5::double*{z}*{z} - {NM.HALF_LOG_2PI!r}::double - ({NM.log_sf_sql(z)})) END)"
    parts = [f"z0 AS (SELECT model, count(*) AS n_train, {TR.LN_SCALE[0]!r}::double AS lo, {TR.LN_SCALE[1] - TR.LN_SCALE[0]!r}::double / {cells} AS st FROM pred GROUP BY model)"]
    for i in range(levels):
        parts.append(f"g{i} AS (SELECT model, n_train, st, ls, {slope} AS g FROM (SELECT pred.*, n_train, st, lo + i * st AS ls FROM pred JOIN z{i} ON pred.model = z{i}.model, range({cells}) t(i)) GROUP BY model, n_train, st, ls)")
        parts.append(f"z{i + 1} AS (SELECT model, n_train, max(ls) FILTER (WHERE g < 0) AS lo, st / {cells} AS st FROM g{i} GROUP BY model, n_train, st)")
    return f"WITH {', '.join(parts)} SELECT model, n_train, exp(lo) AS scale, false AS at_bound, true AS converged FROM z{levels}"


@query("calibrated_scales", _zoom_sql(), "model n_train at_bound converged", "scale", "pred")
def _cal(spark, sf):
    return TR.calibrate_scales(S.predictions(spark, sf), ["model"], "normal").select("model", "n_train", "scale", "at_bound", "converged")


@query("mapped_fits", "SELECT env_class, sum(n*m)/sum(n) AS weighted_mean, stddev_samp(m) AS group_sd FROM (SELECT env_class, group_id, count(*)::double AS n, avg(y) AS m FROM rec GROUP BY ALL) GROUP BY env_class", "env_class", "weighted_mean group_sd", "rec")
def _mapped(spark, sf):
    stats = S.records(spark, sf).groupBy("env_class", "group_id").agg(F.count(F.lit(1)).cast("double").alias("n"), F.avg("y").alias("m"))

    def part(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"env_class": [pdf["env_class"].iloc[0]], "w": [pdf["n"].sum()], "wm": [(pdf["n"] * pdf["m"]).sum()], "k": [float(len(pdf))], "s": [pdf["m"].sum()], "ss": [(pdf["m"] ** 2).sum()]})

    def finish(pdf: pd.DataFrame) -> pd.DataFrame:
        t = pdf.drop(columns="env_class").sum()
        sd = math.sqrt(max(t["ss"] - t["s"] ** 2 / t["k"], 0.0) / (t["k"] - 1)) if t["k"] > 1 else None
        return pd.DataFrame({"env_class": [pdf["env_class"].iloc[0]], "weighted_mean": [t["wm"] / t["w"]], "group_sd": [sd]})

    return MP.map_tasks(stats, ["env_class"], part, "env_class string, w double, wm double, k double, s double, ss double", finish, "env_class string, weighted_mean double, group_sd double")


# ------------------------------------------------------------------ learners

def _designed(spark, sf):
    rows = S.folded(spark, sf)
    return DESIGN.apply(rows, DESIGN.scales(rows.where("is_event"), "fold"), "fold")


@query("forest_predictions")
def _forest(spark, sf):
    out = LN.fold_predictions(_designed(spark, sf), DESIGN.names(), LN.forest(10, seed=S.SEED % 1000), "y", HOLDS)
    return out.select("row_id", "fold", "y", "pred")


@query("boosting_predictions")
def _boost(spark, sf):
    out = LN.fold_predictions(_designed(spark, sf), DESIGN.names(), LN.boosting(5, seed=7), "y", HOLDS)
    return out.select("row_id", "fold", "y", "pred")


@query("kernel_predictions")
def _kernel(spark, sf):
    names = DESIGN.names()
    out = LN.fold_predictions(_designed(spark, sf), names, LN.kernel_ridge(1.0), "y", HOLDS, features=LN.random_features(names, 2.0, 64, 11), centred=True)
    return out.select("row_id", "fold", "y", "pred")


@query("hybrid_predictions")
def _hybrid(spark, sf):
    rows = _designed(spark, sf)
    line = complement_line(S.folded(spark, sf).where("is_event"), "fold", "x_gross", "y")
    rows = rows.join(settle(line, "line"), "fold").withColumn("base", c("intercept") + c("slope") * c("x_gross")).drop("mean", "slope", "intercept")
    from evenfold.functions.damage import support_weight
    from evenfold.operators.joins import nearest_distance

    outside = F.explode(F.filter(F.sequence(F.lit(1), F.lit(S.K)), lambda k: k != c("_own")))
    train = rows.where("is_event").select(c("fold").alias("_own"), "temp_c").distinct().select(outside.alias("fold"), "temp_c")
    rows = nearest_distance(rows, train, ["fold"], "temp_c", "gap")
    inputs = [n for n in DESIGN.names() if not n.startswith("env_class")]
    out = LN.hybrid(rows, "base", inputs, LN.kernel_ridge(1.0), HOLDS, 0.75, support_weight(c("gap")), features=LN.random_features(inputs, 2.0, 32, 5))
    return out.select("row_id", "fold", "y", "base", "pred")


@query("ensemble_mean", "SELECT row_id, avg(pred) AS ensemble FROM pred GROUP BY row_id", "row_id", "ensemble", "pred")
def _ens(spark, sf):
    wide = R.wide(S.predictions(spark, sf), ["row_id"], "model", "pred", list(S.MODELS))
    return LN.ensemble(wide, list(S.MODELS)).select("row_id", "ensemble")


@query("nested_selection")
def _nested(spark, sf):
    out = N.nested_trunk(FE.with_features(S.folded(spark, sf)), (0.75, 0.95), S.K, 4, S.SEED + 500)
    scores = M.point_metrics(out["predictions"], ["model"])
    chosen = out["selection"].where("selected").agg(F.count(F.lit(1)).alias("n_choices"))
    from evenfold.session import with_scalars

    return with_scalars(scores, chosen)


@query("variant_sensitivity")
def _sens(spark, sf):
    chosen = [v for v in VARIANTS if v.name in ("unchanged", "environment_on=False", "trunk_only=True,family=normal")]
    pred, _ = N.variant_sensitivity(FE.with_features(S.folded(spark, sf)), chosen, 0.85, S.K)
    return T.variant_comparison(pred, "variant", "unchanged", 200, 3)


@query("family_audit")
def _famaudit(spark, sf):
    p = S.predictions(spark, sf)
    oof = T.development_rows(p.select("model", "row_id", "fold", "y", "pred", "is_event"), S.K).drop("fold").withColumnRenamed("outer", "fold")
    return T.family_audit(oof, p.drop("scale", "family"), ("normal", "weibull_median", "loglogistic"), ["model"], "fold")


@query("probability_records")
def _precords(spark, sf):
    p = S.predictions(spark, sf)
    oof = T.development_rows(p.select("model", "row_id", "fold", "y", "pred", "is_event"), S.K).drop("fold").withColumnRenamed("outer", "fold")
    return N.probability_records(p, oof, "normal", ["model"], "fold").select("row_id", "model", "fold", "pred", "scale", "family", "at_bound")


# ------------------------------------------------------------------ frozen scoring

TRAIN, NEW = "temp_bin < '1997'", "temp_bin >= '1997'"
FROZEN_SQL = f"""fz AS (SELECT regr_slope(y, x_gross) AS slope, regr_intercept(y, x_gross) AS intercept FROM rec WHERE is_event AND {TRAIN}),
 rz AS (SELECT stddev_pop(y - intercept - slope*x_gross) AS scale, max(abs(y - intercept - slope*x_gross)) AS h FROM rec, fz WHERE is_event AND {TRAIN}),
 nw AS (SELECT rec.*, 'S' || row_id AS specimen_id, intercept + slope*x_gross AS pred, scale, 0.8::double*h AS half80, 0.9::double*h AS half90 FROM rec, fz, rz WHERE {NEW})"""


def _frozen(spark, sf):
    rec = S.records(spark, sf).withColumn("s_ratio", c("s_level"))
    train = rec.where(TRAIN)
    line = settle(train.where("is_event").agg(F.regr_slope("y", "x_gross").alias("slope"), F.regr_intercept("y", "x_gross").alias("intercept")), "line")
    from evenfold.session import with_scalars

    res = with_scalars(train.where("is_event"), line).withColumn("r", c("y") - c("intercept") - c("slope") * c("x_gross"))
    spread = res.agg(F.stddev_pop("r").alias("scale"), F.max(F.abs("r")).alias("h"))
    params = with_scalars(line, spread).select("slope", "intercept", "scale", (0.8 * c("h")).alias("half80"), (0.9 * c("h")).alias("half90"))
    new = rec.where(NEW).withColumn("specimen_id", F.concat(F.lit("S"), c("row_id")))
    # Group names of the new rows are new, as the leak guard asks.
    conditions = new.drop("y", "life", "is_event", "is_censored").withColumn("group_id", F.concat(F.lit("N-"), c("group_id")))
    return FZ.freeze(train, params), conditions, new


LOC = lambda: c("intercept") + c("slope") * c("x_gross")
FLAG_NUM = ("temp_c", "r_ratio", "freq", "s_level", "uts")


@query("frozen_scores", f"""WITH {FROZEN_SQL} SELECT specimen_id, pred, pred-half80 AS empirical_lower80, pred+half90 AS empirical_upper90, pred - 1.2815515655446008::double*scale AS prob_lower80,
  pred + 1.6448536269514715::double*scale AS prob_upper90, log10(pow(10.0::double, pred)) AS log_median, false AS conversion_clipped FROM nw""", "specimen_id conversion_clipped", "pred empirical_lower80 empirical_upper90 prob_lower80 prob_upper90 log_median", "rec")
def _fscores(spark, sf):
    frozen, conditions, _ = _frozen(spark, sf)
    out = FZ.score_conditions(frozen, conditions, LOC(), "specimen_id", ["y", "life"])
    return out.select("specimen_id", "pred", "empirical_lower80", "empirical_upper90", "prob_lower80", "prob_upper90", F.log10("median_life").alias("log_median"), "conversion_clipped")


CELL = f"""tr AS (SELECT *, s_level AS s_ratio FROM rec WHERE {TRAIN}), cl AS (SELECT architecture, env_class, temp_c, r_ratio, freq, min(s_ratio) AS s_lo, max(s_ratio) AS s_hi FROM tr GROUP BY ALL),
 mt AS (SELECT q.row_id, min(s_lo) AS lo, max(s_hi) AS hi FROM rec q JOIN cl ON cl.architecture = q.architecture AND cl.env_class = q.env_class AND abs(q.temp_c-cl.temp_c) <= 1e-8+1e-5*abs(cl.temp_c) AND abs(q.r_ratio-cl.r_ratio) <= 1e-8+1e-5*abs(cl.r_ratio) AND abs(q.freq-cl.freq) <= 1e-8+1e-5*abs(cl.freq) GROUP BY q.row_id)"""


@query("domain_flags", f"""WITH {CELL}, rg AS (SELECT {', '.join(f'min({n}) AS lo_{n}, max({n}) AS hi_{n}' for n in FLAG_NUM)} FROM tr) SELECT row_id, CASE WHEN f = '' THEN 'within_recorded_support' ELSE f END AS support_status FROM (
  SELECT q.row_id, concat_ws('|', CASE WHEN q.architecture NOT IN (SELECT architecture FROM tr) THEN 'unseen_architecture' END, CASE WHEN q.env_class NOT IN (SELECT env_class FROM tr) THEN 'unseen_env_class' END,
  {', '.join(f"CASE WHEN q.{n} < lo_{n} OR q.{n} > hi_{n} THEN 'outside_{'s_ratio' if n == 's_level' else n}' END" for n in FLAG_NUM)}, CASE WHEN lo IS NULL THEN 'unseen_joint_conditions' END, CASE WHEN s_level < lo OR s_level > hi THEN 'outside_matched_stress_range' END) AS f
  FROM rec q LEFT JOIN mt USING (row_id), rg WHERE q.temp_bin >= '1996')""", "row_id support_status", "", "rec")
def _flags(spark, sf):
    frozen, _, _ = _frozen(spark, sf)
    rows = S.records(spark, sf).where("temp_bin >= '1996'").withColumn("s_ratio", c("s_level"))
    return FZ.domain_flags(frozen, rows, "row_id").select("row_id", "support_status")


def _evaluated(spark, sf):
    frozen, conditions, new = _frozen(spark, sf)
    pred = settle(FZ.with_prediction(frozen, conditions, LOC()), "scored")
    outcomes = new.where("n_lines <> 3").select("specimen_id", "life", F.when(c("is_censored"), "yes").otherwise("no").alias("is_censored"))
    return FZ.evaluate_outcomes(pred, outcomes, "specimen_id")


@query("outcome_evaluation", f"""WITH {FROZEN_SQL}, ob AS (SELECT * FROM nw WHERE n_lines <> 3) SELECT weighting, n_rows, n_events, n_groups, rmse, mae, prob_coverage90, empirical_coverage80, (SELECT count(*) FROM nw) - n_rows AS n_pending FROM (
  SELECT 'row_equal' AS weighting, count(*) AS n_rows, sum(is_event::int)::BIGINT AS n_events, count(DISTINCT group_id) AS n_groups, sqrt(avg(CASE WHEN is_event THEN (pred-y)*(pred-y) END)) AS rmse, avg(CASE WHEN is_event THEN abs(pred-y) END) AS mae,
   avg(CASE WHEN is_event THEN (abs(y-pred) <= 1.6448536269514715::double*scale)::int END) AS prob_coverage90, avg(CASE WHEN is_event THEN (abs(y-pred) <= half80)::int END) AS empirical_coverage80 FROM ob
  UNION ALL SELECT 'group_equal', sum(n)::BIGINT, sum(e)::BIGINT, count(*), sqrt(avg(e2)), avg(e1), avg(p9), avg(m8) FROM (SELECT group_id, count(*) AS n, sum(is_event::int) AS e, avg(CASE WHEN is_event THEN (pred-y)*(pred-y) END) AS e2, avg(CASE WHEN is_event THEN abs(pred-y) END) AS e1,
   avg(CASE WHEN is_event THEN (abs(y-pred) <= 1.6448536269514715::double*scale)::int END) AS p9, avg(CASE WHEN is_event THEN (abs(y-pred) <= half80)::int END) AS m8 FROM ob GROUP BY group_id))""",
       "weighting n_rows n_events n_groups n_pending", "rmse mae prob_coverage90 empirical_coverage80", "rec")
def _oeval(spark, sf):
    return _evaluated(spark, sf)[1].select("weighting", "n_rows", "n_events", "n_groups", "rmse", "mae", "prob_coverage90", "empirical_coverage80", "n_pending")


# ------------------------------------------------------------------ streams

HORIZON = 12


def _event_stream(spark, sf):
    schema = S.table(spark, sf, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf).withColumn("ts", c("ts").cast("timestamp"))


def _event_model(spark, sf):
    events = S.table(spark, sf, "events").where("value > 0")
    y = F.log10("value")
    p = events.agg(F.avg(y).alias("mean"), F.stddev_pop(y).alias("scale")).select(
        "mean", "scale", (1.3 * c("scale")).alias("half80"), (1.7 * c("scale")).alias("half90"))
    p = settle(p, "eparams")
    return FZ.Frozen(p, p, {}, p, p)


def _run(spark, stream, what):
    out, mark = _new_folder(spark, what), _new_folder(spark, what + "-log")
    J.write_available(stream, out, mark).awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


@query("stream_scoring", """SELECT event_id, m AS pred, m - 1.2815515655446008::double*s AS prob_lower80, m + 1.7::double*s AS empirical_upper90 FROM events, (SELECT avg(log10(value)) AS m, stddev_pop(log10(value)) AS s FROM events WHERE value > 0)""", "event_id", "pred prob_lower80 empirical_upper90")
def _stream1(spark, sf):
    frozen = _event_model(spark, sf)
    scored = J.score_stream(_event_stream(spark, sf).select("event_id", "ts", "event_type"), frozen, c("mean"))
    return _run(spark, scored.select("event_id", "pred", "prob_lower80", "empirical_upper90"), "stream")


def _joined(spark, sf):
    frozen = _event_model(spark, sf)
    base = _event_stream(spark, sf)
    pred = J.score_stream(base.select("event_id", "ts", "user_id"), frozen, c("mean")).select("event_id", "ts", "user_id", "pred", "scale", "prob_lower90", "prob_upper90")
    outcomes = base.where("value > 0").select(
        "event_id", (c("ts") + F.make_dt_interval(F.lit(0), F.lit(0), c("value").cast("int"))).alias("seen_at"), F.log10("value").alias("y"), (c("event_type") != "error").alias("is_event"))
    joined = J.join_outcomes(pred, outcomes, "event_id", "ts", "seen_at", f"{HORIZON} MINUTES", "1 HOUR")
    return _run(spark, J.with_outcome_scores(joined), "late")


@query("stream_outcomes", f"""SELECT event_id, log10(value) AS y, event_type <> 'error' AS is_event FROM events WHERE value > 0 AND value::INTEGER * 1 <= {HORIZON} AND trunc(value) <= {HORIZON}""".replace("value::INTEGER * 1 <= 12 AND ", ""), "event_id is_event", "y")
def _stream2(spark, sf):
    return _joined(spark, sf).where("observed").select("event_id", "y", "is_event")


NLL = f"ln(scale) + {NM.HALF_LOG_2PI!r}::double + 0.5::double*((y-pred)/scale)*((y-pred)/scale)"


@query("stream_windows", f"""SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, count(*) AS n_predicted, sum(observed::int)::BIGINT AS n_observed,
  avg(CASE WHEN observed THEN CASE WHEN is_event THEN {NLL} ELSE -({NM.log_sf_sql('((y-pred)/scale)')}) END END) AS joint_nll,
  avg(CASE WHEN observed AND is_event THEN (abs(y-pred) <= 1.6448536269514715::double*scale)::int END) AS coverage90
  FROM (SELECT ts, value > 0 AND trunc(value) <= {HORIZON} AS observed, log10(CASE WHEN value > 0 THEN value END) AS y, event_type <> 'error' AS is_event, m AS pred, s AS scale
   FROM events, (SELECT avg(log10(value)) AS m, stddev_pop(log10(value)) AS s FROM events WHERE value > 0)) GROUP BY 1""", "day n_predicted n_observed", "joint_nll coverage90")
def _stream3(spark, sf):
    joined = _joined(spark, sf)
    sent = _run(spark, _event_stream(spark, sf).select("event_id", "ts"), "sent")
    windows = J.window_summary(J.with_pending(joined, sent, "event_id", "ts"), "ts", "1 day")
    return windows.select(F.date_format("window_start", "yyyy-MM-dd").alias("day"), "n_predicted", "n_observed", "joint_nll", "coverage90")


@query("stream_pending", f"""WITH e AS (SELECT ts, value > 0 AS seen, trunc(value)::BIGINT AS late_by, epoch_ms(ts) AS ms FROM events), m AS (SELECT max(greatest(ms, CASE WHEN seen THEN ms + 60000 * late_by ELSE ms END)) - 3600000 AS mark FROM e),
  s AS (SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, CASE WHEN seen AND late_by <= {HORIZON} THEN 'observed' WHEN seen THEN 'late' WHEN ms + {HORIZON * 60000} < mark THEN 'expired' ELSE 'pending' END AS st FROM e, m)
  SELECT day, {', '.join(f"count(*) FILTER (WHERE st = '{x}') AS n_{x}" for x in PD.STATUSES)} FROM s GROUP BY day""", "day " + " ".join(f"n_{x}" for x in PD.STATUSES))
def _stream4(spark, sf):
    """What became of every prediction by day, counted inside the stream."""
    base = _event_stream(spark, sf)
    outcomes = base.where("value > 0").select("event_id", (c("ts") + F.make_dt_interval(F.lit(0), F.lit(0), c("value").cast("int"))).alias("seen_at"))
    changes = _run(spark, PD.follow(base.select("event_id", "ts"), outcomes, "event_id", "ts", "seen_at", HORIZON * 60000, "1 HOUR"), "pending")
    counts = PD.window_counts(changes, "1 day")
    return counts.select(F.date_format("window_start", "yyyy-MM-dd").alias("day"), *[f"n_{x}" for x in PD.STATUSES])
