"""Selection rules, folds, holdout plans, resampling and reshaping."""

from __future__ import annotations

from pyspark.sql import functions as F

from evenfold.checks.registry import query
from evenfold.checks.score_checks import L5, COMPOSITE_SQL, weights
from evenfold.functions import families as L
from evenfold.operators import folds as FO
from evenfold.operators import metrics as M
from evenfold.operators import reshape as R
from evenfold.operators import resample as B
from evenfold.operators import select as K
from evenfold.plans import probability as PR
from evenfold.plans import standins as S
from evenfold.session import settle

c = F.col
ETAS = (0.0, 0.25, 0.5, 0.75, 1.0, 1.25, 1.5)

# Candidates: the line prediction shrunk towards the constant one, scored per fold.
CAND = """cand AS (SELECT fold, i::INTEGER AS candidate, i::INTEGER % 3 AS leaf, CASE WHEN i % 2 = 0 THEN 'even' ELSE 'odd' END AS family, eta, sqrt(avg(CASE WHEN is_event THEN (p-y)*(p-y) END)) AS inner_rmse,
   avg(CASE WHEN NOT is_event THEN exp((y-p)/scale) END) AS censored_nll FROM (SELECT a.fold, a.is_event, a.y, a.scale, i, eta, b.pred + eta*(a.pred-b.pred) AS p FROM pred a JOIN pred b USING (row_id),
   (VALUES """ + ", ".join(f"({i}, {e}::double)" for i, e in enumerate(ETAS)) + """) v(i, eta) WHERE a.model = 'line' AND b.model = 'const') GROUP BY ALL)"""
CAND_EXACT = "fold candidate"


def candidates(spark, sf):
    p = S.predictions(spark, sf)
    wide = R.model_columns(p.where("model IN ('line', 'const')"), "row_id", ["fold", "is_event", "y"], {"pred": ("line", "pred"), "scale": ("line", "scale"), "b": ("const", "pred")}, "model")
    grid = F.array(*[F.struct(F.lit(i).alias("candidate"), F.lit(e).alias("eta")) for i, e in enumerate(ETAS)])
    rows = wide.select("fold", "is_event", "y", "scale", "pred", "b", F.explode(grid).alias("_g"))
    q = c("b") + c("_g.eta") * (c("pred") - c("b"))
    err = q - c("y")
    per = rows.groupBy("fold", c("_g.candidate").alias("candidate"), c("_g.eta").alias("eta")).agg(
        F.sqrt(F.avg(F.when(c("is_event"), err * err))).alias("inner_rmse"),
        F.avg(F.when(~c("is_event"), F.exp((c("y") - q) / c("scale")))).alias("censored_nll"))
    return per.withColumns({"leaf": c("candidate") % 3, "family": F.when(c("candidate") % 2 == 0, "even").otherwise("odd")})


ORDER = "censored_nll, inner_rmse, candidate"


@query("candidate_scores", f"WITH {CAND} SELECT * FROM cand", "fold candidate leaf family", "eta inner_rmse censored_nll", "pred")
def _cand(spark, sf):
    return candidates(spark, sf)


def budget_sql(tol: str) -> str:
    return (f"(SELECT *, inner_rmse <= best + {tol} AS within, row_number() OVER (PARTITION BY fold ORDER BY (inner_rmse <= best + {tol})::int DESC, {ORDER}) AS rank "
            f"FROM (SELECT *, min(inner_rmse) OVER (PARTITION BY fold) AS best FROM cand))")


@query("budget_rule", f"WITH {CAND} SELECT fold, candidate, within, rank::INTEGER AS rank, rank = 1 AS selected, best FROM {budget_sql('0.00002::double')}", "fold candidate within rank selected", "best", "pred")
def _budget(spark, sf):
    return K.budget_rule(candidates(spark, sf), ["fold"], 0.00002).select("fold", "candidate", "within", "rank", "selected", "best")


@query("near_tie_rule", f"WITH {CAND} SELECT fold, candidate, leaf FROM (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY leaf, censored_nll, candidate) AS rn FROM (SELECT *, min(inner_rmse) OVER (PARTITION BY fold) AS best FROM cand) WHERE inner_rmse <= best + 0.001) WHERE rn = 1", "fold candidate leaf", "", "pred")
def _neartie(spark, sf):
    return K.near_tie_rule(candidates(spark, sf), ["fold"], ["leaf", "censored_nll", "candidate"]).select("fold", "candidate", "leaf")


@query("best_by_keys", f"WITH {CAND} SELECT fold, candidate, inner_rmse FROM (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY inner_rmse, leaf, candidate) AS rn FROM cand) WHERE rn = 1", "fold candidate", "inner_rmse", "pred")
def _best(spark, sf):
    return K.first_per(candidates(spark, sf), ["fold"], [c("inner_rmse"), c("leaf"), c("candidate")]).select("fold", "candidate", "inner_rmse")


@query("within_minimum", f"WITH {CAND} SELECT fold, candidate, inner_rmse <= min(inner_rmse) OVER (PARTITION BY fold) + 0.0001 AS within FROM cand", "fold candidate within", "", "pred")
def _within(spark, sf):
    return K.within_minimum(candidates(spark, sf), ["fold"], "inner_rmse", 0.0001).select("fold", "candidate", "within")


@query("selection_replay", f"""WITH {CAND}, ref AS (SELECT fold, censored_nll AS reference_nll FROM cand WHERE candidate = 4), formal AS (SELECT fold, candidate AS f FROM {budget_sql('0.00002::double')} WHERE rank = 1),
  t AS (SELECT *, row_number() OVER (PARTITION BY fold, tolerance ORDER BY (inner_rmse <= best + tolerance)::int DESC, {ORDER}) AS rank FROM (SELECT *, min(inner_rmse) OVER (PARTITION BY fold) AS best FROM cand), (VALUES (0.0::double), (0.00002::double), (0.001::double), (0.02::double)) v(tolerance))
  SELECT fold, tolerance*1000 AS tolerance, margin, candidate, inner_rmse, censored_nll, censored_nll <= reference_nll + margin*0.01::double + 1e-12 AS censor_feasible, candidate = f AS same_choice FROM t JOIN ref USING (fold) JOIN formal USING (fold), (VALUES (0.0::double), (1.0::double)) w(margin) WHERE rank = 1""",
       "fold candidate censor_feasible same_choice", "tolerance margin inner_rmse censored_nll", "pred")
def _replay(spark, sf):
    cand = settle(candidates(spark, sf), "cand")
    ref = cand.where("candidate = 4").select("fold", c("censored_nll").alias("reference_nll"))
    with_ref = cand.join(ref, "fold").withColumn("margin_se", F.lit(0.01))
    formal = K.budget_rule(cand, ["fold"], 0.00002).where("selected")
    out = K.replay(with_ref, ["fold"], [0.0, 0.00002, 0.001, 0.02], [0.0, 1.0], formal)
    return out.withColumn("tolerance", c("tolerance") * 1000)


@query("total_order", f"WITH {CAND} SELECT fold, candidate, row_number() OVER (PARTITION BY fold ORDER BY family DESC, x ASC NULLS LAST, candidate)::INTEGER AS place FROM (SELECT *, CASE WHEN leaf > 0 THEN inner_rmse END AS x FROM cand)", "fold candidate place", "", "pred")
def _order(spark, sf):
    from pyspark.sql.window import Window

    x = F.when(c("leaf") > 0, c("inner_rmse"))
    w = Window.partitionBy("fold").orderBy(c("family").desc(), x.asc_nulls_last(), c("candidate"))
    return candidates(spark, sf).select("fold", "candidate", F.row_number().over(w).alias("place"))


@query("listed_last_order", "SELECT model, row_number() OVER (ORDER BY CASE model WHEN 'const' THEN 1 WHEN 'line' THEN 2 ELSE 0 END, model)::INTEGER AS place FROM (SELECT DISTINCT model FROM pred)", "model place", "", "pred")
def _listed(spark, sf):
    from pyspark.sql.window import Window

    models = S.predictions(spark, sf).select("model").distinct()
    w = Window.partitionBy(F.lit(0)).orderBy(*K.listed_last(c("model"), ("const", "line")))
    return models.select("model", F.row_number().over(w).alias("place"))


@query("best_model", "SELECT fold, arg_min(model, rmse) AS best, min(rmse) AS rmse FROM (SELECT fold, model, sqrt(avg((pred-y)*(pred-y))) AS rmse FROM pred WHERE is_event GROUP BY ALL) GROUP BY fold", "fold best", "rmse", "pred")
def _bestmodel(spark, sf):
    from evenfold.operators.scores import unweighted_metrics

    return K.best_by(unweighted_metrics(S.predictions(spark, sf), ["fold", "model"]), ["fold"], "model", "rmse")


# ------------------------------------------------------------------ folds and plans

@query("record_folds", "SELECT row_id, ((row_number() OVER (ORDER BY md5('11|' || row_id), row_id) - 1) % 5 + 1)::INTEGER AS fold FROM rec", "row_id fold", "", "rec")
def _recfolds(spark, sf):
    return FO.record_folds(S.records(spark, sf).select("row_id"), 5, 11)


@query("fixed_fold_map", "SELECT group_id, fold, count(*) AS n FROM recf WHERE is_censored GROUP BY ALL", "group_id fold n", "", "recf")
def _fixed(spark, sf):
    rec = S.records(spark, sf)
    fold_map = settle(S.fold_map(rec), "fixed")
    other = rec.where("is_censored")
    from evenfold.operators.contracts import require, violation

    require(violation(FO.unknown_groups(other, fold_map), "unknown_group", c("group_id"), F.lit("fold map")), "fixed folds")
    return FO.with_folds(other, fold_map).groupBy("group_id", "fold").agg(F.count(F.lit(1)).alias("n"))


FACTORS = {"LOSO": "source_id", "LOAO": "architecture", "LOTO": "temp_bin", "LOEO": "env_class"}
LONG = "(" + " UNION ALL ".join(f"SELECT *, '{s}' AS scenario, '{f}' AS factor, {f} AS level FROM rec" for s, f in FACTORS.items()) + ")"


@query("level_holdouts", f"""SELECT scenario, factor, level, n_test, test_events, n - n_test AS n_train, e - test_events AS train_events FROM (SELECT scenario, factor, level, count(*) AS n_test, sum(is_event::int)::BIGINT AS test_events FROM {LONG} GROUP BY ALL),
  (SELECT count(*) AS n, sum(is_event::int)::BIGINT AS e FROM rec) WHERE test_events > 0 AND e > test_events""", "scenario factor level n_test test_events n_train train_events", "", "rec")
def _holdouts(spark, sf):
    return FO.level_holdouts(S.records(spark, sf), FACTORS)


@query("strict_holdouts", f"""WITH cells AS (SELECT DISTINCT scenario, factor, level, group_id FROM {LONG}), g AS (SELECT group_id, count(*) AS gn, sum(is_event::int) AS ge FROM rec GROUP BY group_id), tot AS (SELECT count(*) AS n, count(DISTINCT group_id) AS ng FROM rec)
  SELECT scenario, factor, level, n_test, n_test_groups, n - n_test AS n_train_original, (n - gn)::BIGINT AS n_train, ng - n_test_groups AS n_train_groups, (gn - n_test)::BIGINT AS n_removed,
   CASE WHEN ng - n_test_groups < 4 THEN 'too_few_training_groups' ELSE '' END AS reason, CASE WHEN ng - n_test_groups < 4 THEN 'not_estimable' WHEN gn > n_test THEN 'refit' ELSE 'reuse' END AS action
  FROM (SELECT scenario, factor, level, count(*) AS n_test FROM {LONG} GROUP BY ALL) JOIN (SELECT scenario, factor, level, count(*) AS n_test_groups, sum(gn) AS gn FROM cells JOIN g USING (group_id) GROUP BY ALL) USING (scenario, factor, level), tot""",
       "scenario factor level n_test n_test_groups n_train_original n_train n_train_groups n_removed reason action", "", "rec")
def _strict(spark, sf):
    return FO.strict_holdouts(S.records(spark, sf), FACTORS, seed=S.SEED)


@query("fold_membership", "SELECT k::INTEGER AS task, row_id, group_id, CASE WHEN fold = k THEN 'test' ELSE 'train' END AS role FROM recf, range(1, 6) t(k)", "task row_id group_id role", "", "recf")
def _membership(spark, sf):
    return FO.membership(S.folded(spark, sf), S.K, ["row_id", "group_id"])


REP_SEEDS = (S.SEED, S.SEED + 101)


@query("repeated_splits", f"""WITH RECURSIVE {S.REC_SQL}, {', '.join(S.greedy_sql(f'g{i}', 'rec', 'group_id', 5, s) for i, s in enumerate(REP_SEEDS))}
  SELECT 'record' AS strategy, r::INTEGER AS repeat, row_id, ((row_number() OVER (PARTITION BY r ORDER BY md5(s || '|' || row_id), row_id) - 1) % 5 + 1)::INTEGER AS fold FROM rec, (VALUES (1, {REP_SEEDS[0]}), (2, {REP_SEEDS[1]})) v(r, s)
  UNION ALL SELECT 'group', 1, row_id, fold FROM rec JOIN g0 USING (group_id) UNION ALL SELECT 'group', 2, row_id, fold FROM rec JOIN g1 USING (group_id)""")
def _repeated(spark, sf):
    return FO.repeated_splits(S.records(spark, sf), {"record": None, "group": "group_id"}, 5, list(REP_SEEDS))


# ------------------------------------------------------------------ resampling

REPS = 200


def draws_sql(pool: str, keys: str, values: list[str], seed: int) -> str:
    """SQL: means over drawn groups per replicate, with the same md5 draws."""
    k = keys.split(", ")
    on = " AND ".join(f"s.{x} = d.{x}" for x in k)
    return f"""(SELECT d.{', d.'.join(k)}, rep, {', '.join(f'avg(s.{v}) AS {v}' for v in values)} FROM
   (SELECT {keys}, rep, ('0x' || substr(md5('{seed}|' || rep || '|' || seat), 1, 8))::BIGINT % g AS slot FROM (SELECT {keys}, count(*) AS g FROM {pool} GROUP BY {keys}), range(1, {REPS + 1}) r(rep), range(0, 1000) q(seat) WHERE seat < g) d
   JOIN (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY md5('{seed}|' || group_id), group_id) - 1 AS slot FROM {pool}) s ON {on} AND s.slot = d.slot GROUP BY ALL)"""


GROUPS = f"""grp AS (SELECT model, group_id, n_events, e2, e1, y1, y2, f5, composite FROM (SELECT model, group_id, count(*) AS n_events, sum(w*(pred-y)*(pred-y)) AS e2, sum(w*abs(pred-y)) AS e1, sum(w*y) AS y1, sum(w*y*y) AS y2, sum(w*(abs(pred-y) <= {L5})::int) AS f5
   FROM {weights('model', 'is_event', 'pred')} GROUP BY ALL) JOIN ({COMPOSITE_SQL}) USING (model, group_id))"""
METRICS = {"gb_rmse": "sqrt(e2)", "gb_mae": "e1", "gb_r2": "CASE WHEN y2-y1*y1 > 0 THEN 1-e2/(y2-y1*y1) END", "gb_f5": "f5", "gb_composite": "composite"}
VALUES = ["e2", "e1", "y1", "y2", "f5", "composite"]


@query("metric_bootstrap", f"""WITH {GROUPS}, p AS (SELECT model, sum(n_events)::BIGINT AS n_events, count(*) AS n_groups, {', '.join(f'avg({v}) AS {v}' for v in VALUES)} FROM grp GROUP BY model),
  r AS (SELECT model, {', '.join(f'{s} AS {n}' for n, s in METRICS.items())} FROM {draws_sql('grp', 'model', VALUES, 5)})
  SELECT model, n_events, n_groups, {', '.join(f'{s} AS {n}' for n, s in METRICS.items())}, {', '.join(f'{n}_lo, {n}_hi' for n in METRICS)} FROM p JOIN (SELECT model, {', '.join(f'quantile_cont({n}, 0.025) AS {n}_lo, quantile_cont({n}, 0.975) AS {n}_hi' for n in METRICS)} FROM r GROUP BY model) USING (model)""",
       "model n_events n_groups", " ".join(f"{n} {n}_lo {n}_hi" for n in METRICS), "pred")
def _boot(spark, sf):
    return B.metric_intervals(S.predictions(spark, sf), ["model"], REPS, 5)


PV = VALUES + [f"p_{v}" for v in VALUES]


def gain_sql(n: str) -> str:
    mine = METRICS[n]
    for v in sorted(VALUES, key=len, reverse=True):
        mine = mine.replace(v, f"p_{v}")
    return f"({mine}) - ({METRICS[n]})" if n in ("gb_r2", "gb_f5") else f"({METRICS[n]}) - ({mine})"


@query("paired_bootstrap", f"""WITH {GROUPS}, pool AS (SELECT o.model, o.group_id, {', '.join('o.' + v for v in VALUES)}, {', '.join(f'm.{v} AS p_{v}' for v in VALUES)} FROM grp o JOIN grp m ON o.group_id = m.group_id AND m.model = 'line' WHERE o.model <> 'line'),
  pt AS (SELECT model, count(*) AS n_groups, {', '.join(f'avg({v}) AS {v}' for v in PV)} FROM pool GROUP BY model), rp AS (SELECT * FROM {draws_sql('pool', 'model', PV, 6)})
  {' UNION ALL '.join(f"SELECT model, n_groups, '{n[3:]}' AS effect, {gain_sql(n)} AS estimate, lo, hi FROM pt JOIN (SELECT model, quantile_cont(g, 0.025) AS lo, quantile_cont(g, 0.975) AS hi FROM (SELECT model, {gain_sql(n)} AS g FROM rp) GROUP BY model) USING (model)" for n in METRICS)}""",
       "model n_groups effect", "estimate lo hi", "pred")
def _paired(spark, sf):
    return B.paired_effects(S.predictions(spark, sf), [], "line", REPS, 6)


@query("ablation_bootstrap", f"""WITH {GROUPS}, pool AS (SELECT o.model, o.group_id, o.e2, m.e2 AS p_e2 FROM grp o JOIN grp m ON o.group_id = m.group_id AND m.model = 'line' WHERE o.model <> 'line'),
  rp AS (SELECT * FROM {draws_sql('pool', 'model', ['e2', 'p_e2'], 9)})
  SELECT model, sqrt(a)-sqrt(b) AS estimate, lo, hi FROM (SELECT model, avg(e2) AS a, avg(p_e2) AS b FROM pool GROUP BY model) JOIN (SELECT model, quantile_cont(sqrt(e2)-sqrt(p_e2), 0.025) AS lo, quantile_cont(sqrt(e2)-sqrt(p_e2), 0.975) AS hi FROM rp GROUP BY model) USING (model)""",
       "model", "estimate lo hi", "pred")
def _ablation(spark, sf):
    out = B.paired_effects(S.predictions(spark, sf), [], "line", REPS, 9, composite=False, metrics=("rmse",))
    return out.select("model", "estimate", "lo", "hi")


@query("factor_paired_gains", f"""WITH g AS (SELECT scenario, model, group_id, sum(w*(pred-y)*(pred-y)) AS e2 FROM {weights('scenario, model', 'is_event', 'fpred')} GROUP BY ALL), pool AS (SELECT o.scenario, o.model, o.group_id, o.e2, m.e2 AS p_e2 FROM g o JOIN g m ON o.scenario = m.scenario AND o.group_id = m.group_id AND m.model = 'line' WHERE o.model <> 'line')
  SELECT scenario, model, n_groups, sqrt(a)-sqrt(b) AS estimate, lo, hi FROM (SELECT scenario, model, count(*) AS n_groups, avg(e2) AS a, avg(p_e2) AS b FROM pool GROUP BY ALL) JOIN (SELECT scenario, model, quantile_cont(sqrt(e2)-sqrt(p_e2), 0.025) AS lo, quantile_cont(sqrt(e2)-sqrt(p_e2), 0.975) AS hi FROM {draws_sql('pool', 'scenario, model', ['e2', 'p_e2'], 12)} GROUP BY ALL) USING (scenario, model)""",
       "scenario model n_groups", "estimate lo hi", "fpred")
def _fpaired(spark, sf):
    from evenfold.plans.studies import factor_study

    paired = factor_study(S.factor_predictions(spark, sf), "line", REPS, 12)["paired"]
    return paired.where("effect = 'rmse'").select("scenario", "model", "n_groups", "estimate", "lo", "hi")


IV = ("coverage", "width", "interval_score")


@query("interval_bootstrap", f"""WITH pool AS (SELECT model, group_id, avg((y >= lower90 AND y <= upper90)::int) AS coverage, avg(upper90-lower90) AS width, avg(upper90-lower90 + 20*greatest(lower90-y, 0) + 20*greatest(y-upper90, 0)) AS interval_score FROM sco WHERE is_event GROUP BY ALL)
  SELECT * FROM (SELECT model, count(*) AS n_groups, {', '.join(f'avg({v}) AS {v}' for v in IV)} FROM pool GROUP BY model) JOIN (SELECT model, {', '.join(f'quantile_cont({v}, 0.025) AS {v}_lo, quantile_cont({v}, 0.975) AS {v}_hi' for v in IV)} FROM {draws_sql('pool', 'model', list(IV), 7)} GROUP BY model) USING (model)""",
       "model n_groups", " ".join(f"{v} {v}_lo {v}_hi" for v in IV), "sco")
def _ivboot(spark, sf):
    groups = M.empirical_interval_groups(S.scored(spark, sf), ["model"], "lower90", "upper90", 0.9)
    return B.mean_intervals(groups, ["model"], "group_id", list(IV), REPS, 7)


@query("loss_gain_bootstrap", f"""WITH g AS (SELECT model, group_id, sum(w*row_nll) AS nll FROM {weights('model', 'true', 'sco')} GROUP BY ALL), pool AS (SELECT o.model, o.group_id, o.nll - m.nll AS gain FROM g o JOIN g m ON o.group_id = m.group_id AND m.model = 'line' WHERE o.model <> 'line')
  SELECT 'Primary' AS scenario, model, n_groups, gain, gain_lo, gain_hi FROM (SELECT model, count(*) AS n_groups, avg(gain) AS gain FROM pool GROUP BY model) JOIN (SELECT model, quantile_cont(gain, 0.025) AS gain_lo, quantile_cont(gain, 0.975) AS gain_hi FROM {draws_sql('pool', 'model', ['gain'], 8)} GROUP BY model) USING (model)""",
       "scenario model n_groups", "gain gain_lo gain_hi", "sco")
def _lossboot(spark, sf):
    return PR.paired_loss_gains(S.scored(spark, sf), "line", REPS, 8)


DIFF = {"gb_rmse": "sqrt(e2)-sqrt(r_e2)", "gb_mae": "e1-r_e1", "gb_r2": "(CASE WHEN y2-y1*y1 > 1e-15 THEN 1-e2/(y2-y1*y1) END) - (CASE WHEN r_y2-r_y1*r_y1 > 1e-15 THEN 1-r_e2/(r_y2-r_y1*r_y1) END)", "joint_nll": "nll-r_nll"}
DVAL = ["e2", "e1", "y1", "y2", "nll"]


@query("difference_bootstrap", f"""WITH g AS (SELECT model, group_id, avg(CASE WHEN is_event THEN (pred-y)*(pred-y) END) AS e2, avg(CASE WHEN is_event THEN abs(pred-y) END) AS e1, avg(CASE WHEN is_event THEN y END) AS y1, avg(CASE WHEN is_event THEN y*y END) AS y2, avg(row_nll) AS nll FROM sco GROUP BY ALL),
  pool AS (SELECT o.model, o.group_id, {', '.join('o.' + v for v in DVAL)}, {', '.join(f'm.{v} AS r_{v}' for v in DVAL)} FROM g o JOIN g m ON o.group_id = m.group_id AND m.model = 'const' WHERE o.model <> 'const')
  SELECT model, {', '.join(f'quantile_cont({n}, 0.025) AS {n}_lo, quantile_cont({n}, 0.975) AS {n}_hi, count({n}) AS {n}_draws' for n in DIFF)} FROM (SELECT model, {', '.join(f'{s} AS {n}' for n, s in DIFF.items())} FROM {draws_sql('pool', 'model', DVAL + ['r_' + v for v in DVAL], 10)}) GROUP BY model""",
       "model " + " ".join(f"{n}_draws" for n in DIFF), " ".join(f"{n}_lo {n}_hi" for n in DIFF), "sco")
def _diffboot(spark, sf):
    return B.difference_intervals(S.scored(spark, sf), [], "model", "const", REPS, 10)


# ------------------------------------------------------------------ reshape

@query("pivot_models", "SELECT row_id, max(CASE WHEN model = 'const' THEN pred END) AS const, max(CASE WHEN model = 'line' THEN pred END) AS line, max(CASE WHEN model = 'segment' THEN pred END) AS segment FROM pred GROUP BY row_id", "row_id", "const line segment", "pred")
def _pivot(spark, sf):
    return R.wide(S.predictions(spark, sf), ["row_id"], "model", "pred", list(S.MODELS))


@query("unpivot_metrics", "WITH m AS (SELECT model, sqrt(avg((pred-y)*(pred-y))) AS rmse, avg(abs(pred-y)) AS mae FROM pred WHERE is_event GROUP BY model) SELECT model, 'rmse' AS metric, rmse AS value FROM m UNION ALL SELECT model, 'mae', mae FROM m", "model metric", "value", "pred")
def _unpivot(spark, sf):
    from evenfold.operators.scores import unweighted_metrics

    return R.long(unweighted_metrics(S.predictions(spark, sf), ["model"]), ["model"], ["rmse", "mae"])


@query("candidate_json", f"WITH {CAND} SELECT fold, candidate, eta, rank = 1 AS selected FROM {budget_sql('0.00002::double')}", "fold candidate selected", "eta", "pred")
def _json(spark, sf):
    chosen = K.budget_rule(candidates(spark, sf), ["fold"], 0.00002)
    packed = R.pack_candidates(chosen, ["fold"], ["candidate", "eta", "selected"], "candidate")
    return R.unpack_candidates(packed, "candidates", "candidate int, eta double, selected boolean", ["fold"])


@query("candidate_json_problems", f"WITH {CAND} SELECT fold, count(*) AS n_candidates, 1::BIGINT AS n_selected FROM cand GROUP BY fold", "fold n_candidates n_selected", "", "pred")
def _jsonproblems(spark, sf):
    return R.unpack_problems(_json(spark, sf), ["fold"], len(ETAS) + 1)


@query("settings_json", """WITH s AS (SELECT DISTINCT env_class, architecture, n_lines FROM rec) SELECT env_class, architecture, n_lines, '{"architecture":"' || architecture || '","env_class":"' || env_class || '","n_lines":' || n_lines || '}' AS settings FROM s""", "env_class architecture n_lines settings", "", "rec")
def _settings(spark, sf):
    s = S.records(spark, sf).select("env_class", "architecture", "n_lines").distinct()
    return s.withColumn("settings", R.settings_json(["n_lines", "env_class", "architecture"]))


@query("label_lists", "SELECT group_id, string_agg(source_id, '|' ORDER BY source_id) AS sources FROM (SELECT DISTINCT group_id, source_id FROM rec) GROUP BY group_id", "group_id sources", "", "rec")
def _lists(spark, sf):
    return R.label_lists(S.records(spark, sf), ["group_id"], "source_id", "sources")


@query("issue_lists", """SELECT row_id, CASE WHEN l = '' THEN 'ok' ELSE l END AS issues FROM (SELECT row_id, concat_ws('|', CASE WHEN n_lines > 6 THEN 'many_lines' END, CASE WHEN r_ratio > 0.08 THEN 'high_ratio' END, CASE WHEN env_class = 'vacuum' THEN 'vacuum' END) AS l FROM rec)""", "row_id issues", "", "rec")
def _issues(spark, sf):
    return S.records(spark, sf).select("row_id", R.issue_list({
        "many_lines": c("n_lines") > 6, "high_ratio": c("r_ratio") > 0.08, "vacuum": c("env_class") == "vacuum"}, "ok").alias("issues"))


@query("split_id_arrays", "SELECT fold, row_id FROM recf", "fold row_id", "", "recf")
def _ids(spark, sf):
    return R.unpack_ids(R.pack_ids(S.folded(spark, sf), ["fold"], "row_id"), ["fold"], "ids", "row_id")
