"""Support tables, audits, comparisons and study tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from evenfold.checks import score_checks as Q
from evenfold.checks import selection_checks as X
from evenfold.checks.registry import QUERIES, SQL, query
from evenfold.operators import audits as A
from evenfold.operators import diff as D
from evenfold.operators import folds as FO
from evenfold.operators import metrics as M
from evenfold.operators import resample as B
from evenfold.operators import select as K
from evenfold.operators import support as SU
from evenfold.plans import claims as CL
from evenfold.plans import standins as S
from evenfold.plans import studies as T
from evenfold.session import settle

c = F.col
CNT = """count(*) AS n_rows, sum(is_event::int)::BIGINT AS n_events, sum((NOT is_event)::int)::BIGINT AS n_censored, count(DISTINCT group_id) AS n_groups, count(DISTINCT source_id) AS n_sources,
  count(DISTINCT CASE WHEN is_event THEN group_id END) AS n_event_groups, count(DISTINCT CASE WHEN NOT is_event THEN group_id END) AS n_censored_groups"""
CNT_EXACT = "n_rows n_events n_censored n_groups n_sources n_event_groups n_censored_groups"
MORE = "sum((NOT is_event)::int)/count(*)::double AS censored_fraction, count(DISTINCT group_id) = 1 AS single_group, count(*) < 10 AS few_rows"
FACTORS = ["architecture", "env_class", "temp_bin"]


@query("support_counts", f"SELECT architecture, env_class, {CNT}, {MORE} FROM rec GROUP BY ALL", f"architecture env_class {CNT_EXACT} single_group few_rows", "censored_fraction", "rec")
def _support(spark, sf):
    return SU.support_counts(S.records(spark, sf), ["architecture", "env_class"])


PAIRS = [("architecture", "env_class"), ("architecture", "temp_bin"), ("env_class", "temp_bin")]


def _factor_sql(sets) -> str:
    return " UNION ALL ".join(f"SELECT '{','.join(s)}' AS factors, concat_ws('|', {', '.join(s)}) AS levels, {CNT}, {MORE} FROM rec GROUP BY {', '.join(s)}" for s in sets)


@query("factor_tables_one_way", _factor_sql([(f,) for f in FACTORS]), f"factors levels {CNT_EXACT} single_group few_rows", "censored_fraction", "rec")
def _one(spark, sf):
    return SU.factor_tables(S.records(spark, sf), FACTORS, 1)


@query("factor_tables_two_way", _factor_sql(PAIRS), f"factors levels {CNT_EXACT} single_group few_rows", "censored_fraction", "rec")
def _two(spark, sf):
    return SU.factor_tables(S.records(spark, sf), FACTORS, 2)


@query("factor_tables_three_way", _factor_sql([tuple(FACTORS)]), f"factors levels {CNT_EXACT} single_group few_rows", "censored_fraction", "rec")
def _three(spark, sf):
    return SU.factor_tables(S.records(spark, sf), FACTORS, 3)


@query("full_grid", f"""SELECT a.architecture, e.env_class, s.source_id, {', '.join(f'coalesce({n}, 0)::BIGINT AS {n}' for n in CNT_EXACT.split())}, n_rows IS NOT NULL AS observed FROM (SELECT DISTINCT architecture FROM rec) a, (SELECT DISTINCT env_class FROM rec) e, (SELECT DISTINCT source_id FROM rec) s
  LEFT JOIN (SELECT architecture, env_class, source_id, {CNT} FROM rec GROUP BY architecture, env_class, source_id) c ON c.architecture = a.architecture AND c.env_class = e.env_class AND c.source_id = s.source_id""",
       f"architecture env_class source_id {CNT_EXACT} observed", "", "rec")
def _gridq(spark, sf):
    rec = S.records(spark, sf)
    f = ["architecture", "env_class", "source_id"]
    return SU.full_grid(rec, f, SU.support_counts(rec, f))


@query("cell_ranges", "SELECT architecture, env_class, min(s_level) AS s_level_min, max(s_level) AS s_level_max, min(freq) AS freq_min, max(freq) AS freq_max, min(r_ratio) AS r_ratio_min, max(r_ratio) AS r_ratio_max FROM rec GROUP BY ALL",
       "architecture env_class", "s_level_min s_level_max freq_min freq_max r_ratio_min r_ratio_max", "rec")
def _ranges(spark, sf):
    return SU.ranges(S.records(spark, sf), ["architecture", "env_class"], ["s_level", "freq", "r_ratio"])


@query("split_overlap", """WITH m AS (SELECT k::INTEGER AS task, group_id, temp_bin = cast(1994 + k AS varchar) AS te FROM rec, range(1, 6) t(k)), g AS (SELECT task, group_id, sum(te::int) AS a, sum((NOT te)::int) AS b FROM m GROUP BY ALL)
  SELECT task, sum(b)::BIGINT AS n_train, sum(a)::BIGINT AS n_test, count(CASE WHEN b > 0 THEN 1 END) AS n_train_groups, count(CASE WHEN a > 0 THEN 1 END) AS n_test_groups, count(CASE WHEN a > 0 AND b > 0 THEN 1 END) AS n_overlapping,
   coalesce(string_agg(CASE WHEN a > 0 AND b > 0 THEN group_id END, ' | ' ORDER BY group_id), '') AS groups_to_purge, sum(CASE WHEN a > 0 AND b > 0 THEN 0 ELSE b END)::BIGINT AS n_train_after_purge FROM g GROUP BY task""",
       "task n_train n_test n_train_groups n_test_groups n_overlapping groups_to_purge n_train_after_purge", "", "rec")
def _overlap(spark, sf):
    rec = S.records(spark, sf)
    members = rec.select("row_id", "group_id", "temp_bin", F.explode(F.sequence(F.lit(1), F.lit(5))).alias("task")).withColumn(
        "role", F.when(c("temp_bin") == (c("task") + 1994).cast("string"), "test").otherwise("train"))
    return SU.split_overlap(members)


NUM = ["temp_c", "r_ratio", "freq", "s_level"]
UNSEEN = ["architecture", "env_class", "source_id"]


def support_sql() -> str:
    st = ", ".join(f"min({n}) AS lo_{n}, max({n}) AS hi_{n}, CASE WHEN stddev_pop({n}) > 0 THEN stddev_pop({n}) ELSE 1 END AS sd_{n}" for n in NUM)
    out = ", ".join(f"CASE WHEN q.{n} < lo_{n} OR q.{n} > hi_{n} THEN '{n}' END" for n in NUM)
    uns = ", ".join(f"CASE WHEN NOT EXISTS (SELECT 1 FROM lv_{u} l WHERE l.v = q.{u} AND l.fold <> q.fold) THEN '{u}' END" for u in UNSEEN)
    dist = " + ".join(f"pow((q.{n}-t.{n})/sd_{n}, 2)" for n in NUM)
    lv = ", ".join(f"lv_{u} AS (SELECT DISTINCT {u} AS v, fold FROM recf)" for u in UNSEEN)
    return f"""WITH fd AS (SELECT DISTINCT fold FROM recf), tr AS (SELECT k.fold, {st} FROM fd k JOIN recf r ON r.fold <> k.fold GROUP BY k.fold), {lv},
   cell AS (SELECT architecture, env_class, temp_bin, fold, count(*) AS n, sum(is_event::int) AS e, count(DISTINCT group_id) AS g FROM recf GROUP BY ALL),
   pts AS (SELECT DISTINCT fold, temp_c, r_ratio, freq, s_level FROM recf),
   nn AS (SELECT q.fold, q.temp_c, q.r_ratio, q.freq, q.s_level, sqrt(min({dist})) AS nearest_distance FROM pts q JOIN tr USING (fold) JOIN pts t ON t.fold <> q.fold GROUP BY ALL)
   SELECT row_id, fold, cell_rows, cell_events, cell_groups, unseen_categories, outside_ranges, nearest_distance,
    CASE WHEN unseen_categories <> '' THEN 'unseen_category' WHEN outside_ranges <> '' THEN 'outside_numeric_range' WHEN cell_rows = 0 THEN 'unseen_joint_cell' ELSE 'within_support' END AS support_class FROM (
    SELECT q.row_id, q.fold, coalesce(cc.n, 0)::BIGINT AS cell_rows, coalesce(cc.e, 0)::BIGINT AS cell_events, coalesce(cc.g, 0)::BIGINT AS cell_groups, concat_ws('|', {uns}) AS unseen_categories, concat_ws('|', {out}) AS outside_ranges, nn.nearest_distance
    FROM recf q JOIN tr USING (fold) JOIN nn USING (fold, temp_c, r_ratio, freq, s_level) LEFT JOIN (SELECT a.architecture, a.env_class, a.temp_bin, k.fold, sum(CASE WHEN a.fold <> k.fold THEN a.n END) AS n, sum(CASE WHEN a.fold <> k.fold THEN a.e END) AS e, sum(CASE WHEN a.fold <> k.fold THEN a.g END) AS g FROM cell a, fd k GROUP BY ALL) cc
     ON cc.architecture = q.architecture AND cc.env_class = q.env_class AND cc.temp_bin = q.temp_bin AND cc.fold = q.fold)"""


@query("support_rows", support_sql(), "row_id fold cell_rows cell_events cell_groups unseen_categories outside_ranges support_class", "nearest_distance", "recf")
def _srows(spark, sf):
    return SU.support_rows(S.folded(spark, sf), NUM, UNSEEN, FACTORS)


STRAT = "(SELECT *, CASE WHEN n_lines > 6 THEN 'sparse' ELSE 'dense' END AS stratum FROM sco)"


@query("stratum_scores", Q.card_sql("stratum, model", STRAT), "stratum model " + Q.CARD_EXACT, Q.CARD_NUM, "sco")
def _strata(spark, sf):
    p = S.scored(spark, sf).withColumn("stratum", F.when(c("n_lines") > 6, "sparse").otherwise("dense"))
    return M.score_card(p, ["stratum", "model"], intervals=Q.P90)


# ------------------------------------------------------------------ selection audits

SEL = f"{X.CAND}, sel AS (SELECT 'blend' AS model, fold, candidate, family, leaf, eta FROM {X.budget_sql('0.00002::double')} WHERE rank = 1), cd AS (SELECT 'blend' AS model, * FROM cand)"


def _selected(spark, sf):
    cand = settle(X.candidates(spark, sf).withColumn("model", F.lit("blend")), "cand")
    return cand, K.budget_rule(cand, ["fold"], 0.00002).where("selected")


@query("selection_frequency", f"""WITH {SEL} SELECT model, candidate, coalesce(n, 0)::BIGINT AS selected_count, (SELECT count(DISTINCT fold) FROM sel) AS n_folds, (SELECT count(DISTINCT candidate) FROM cd) AS n_candidates, coalesce(n, 0)/(SELECT count(DISTINCT fold) FROM sel)::double AS selected_fraction
  FROM (SELECT DISTINCT model, candidate FROM cd) LEFT JOIN (SELECT model, candidate, count(*) AS n FROM sel GROUP BY ALL) USING (model, candidate)""", "model candidate selected_count n_folds n_candidates", "selected_fraction", "pred")
def _freq(spark, sf):
    cand, sel = _selected(spark, sf)
    return SU.selection_frequency(cand, sel, ["candidate"])


@query("parameter_frequency", f"""WITH {SEL}, p AS (SELECT model, fold, 'family' AS parameter, family AS value FROM sel UNION ALL SELECT model, fold, 'leaf', cast(leaf AS varchar) FROM sel)
  SELECT model, parameter, value, count(*) AS n, (SELECT count(DISTINCT fold) FROM sel) AS applicable_folds, 'searched' AS role FROM p GROUP BY ALL""", "model parameter value n applicable_folds role", "", "pred")
def _pfreq(spark, sf):
    cand, sel = _selected(spark, sf)
    return SU.parameter_frequency(cand, sel, ["family", "leaf"])


@query("development_support", """SELECT k.fold, count(*) AS n_train, sum(is_event::int)::BIGINT AS n_train_events, sum((NOT is_event)::int)::BIGINT AS n_train_censored, count(DISTINCT group_id) AS n_train_groups, count(DISTINCT CASE WHEN is_event THEN group_id END) AS n_train_event_groups
  FROM (SELECT DISTINCT fold FROM recf) k JOIN recf r ON r.fold <> k.fold GROUP BY k.fold""", "fold n_train n_train_events n_train_censored n_train_groups n_train_event_groups", "", "recf")
def _dev(spark, sf):
    return SU.development_support(S.folded(spark, sf))


# ------------------------------------------------------------------ duplicates and other tables

@query("duplicate_clusters", "SELECT equiv_id, count(*) AS cluster_size, count(DISTINCT source_id) AS cluster_sources, count(DISTINCT source_id) > 1 AS cross_source, count(DISTINCT is_censored) > 1 AS label_conflict FROM dup GROUP BY equiv_id",
       "equiv_id cluster_size cluster_sources cross_source label_conflict", "", "dup")
def _clusters(spark, sf):
    return A.cluster_stats(S.raw_rows(spark, sf))


@query("duplicate_members", "SELECT row_id, equiv_id, source_id, cluster_size FROM dup JOIN (SELECT equiv_id, count(*) AS cluster_size FROM dup GROUP BY equiv_id HAVING count(*) > 1) USING (equiv_id)", "row_id equiv_id source_id cluster_size", "", "dup")
def _members(spark, sf):
    raw = S.raw_rows(spark, sf)
    return A.cluster_members(raw, A.cluster_stats(raw)).select("row_id", "equiv_id", "source_id", "cluster_size")


@query("group_source_map", """SELECT g.group_id, source_id, n_rows, n_events, first_row, n_sources, representative_source, source_id = representative_source AS is_representative FROM (SELECT group_id, source_id, count(*) AS n_rows, sum(is_event::int)::BIGINT AS n_events, min(row_id) AS first_row FROM rec GROUP BY ALL) g
  JOIN (SELECT group_id, count(DISTINCT source_id) AS n_sources, arg_min(source_id, row_id) AS representative_source FROM rec GROUP BY group_id) USING (group_id)""", "group_id source_id n_rows n_events first_row n_sources representative_source is_representative", "", "rec")
def _gsm(spark, sf):
    return A.group_source_map(S.records(spark, sf))


@query("temperature_support", """SELECT fold, temp_bin, avg(CASE WHEN is_event THEN (n_lines <= 5)::int END) AS event_support_rate, count(CASE WHEN is_event AND n_lines > 5 THEN 1 END) AS n_events_unsupported, avg((n_lines <= 5)::int) AS support_rate, count(CASE WHEN n_lines > 5 THEN 1 END) AS n_unsupported FROM recf GROUP BY ALL""",
       "fold temp_bin n_events_unsupported n_unsupported", "event_support_rate support_rate", "recf")
def _tsup(spark, sf):
    return SU.temperature_support(S.folded(spark, sf).withColumn("ok", c("n_lines") <= 5), "ok", ["fold", "temp_bin"])


@query("boundary_hits", "SELECT fold, slope, slope < -1e9 AS slope_at_lower, false AS slope_at_upper, abs(intercept - 5) <= 0.05 AS intercept_at_upper, abs(intercept - 5) <= 0.05 AS any_boundary_hit FROM ln",
       "fold slope_at_lower slope_at_upper intercept_at_upper any_boundary_hit", "slope", "pred")
def _bounds(spark, sf):
    from evenfold.operators.fit.closed_form import complement_line

    line = complement_line(S.folded(spark, sf).where("is_event"), "fold", "x_gross", "y").drop("mean")
    out = SU.boundary_hits(line, {"slope": (-1e10, 1e10), "intercept": (None, 5.0)}, 0.05)
    return out.drop("intercept")


@query("audit_items", """SELECT 'rows' AS item, cast(count(*) AS varchar) AS value FROM rec UNION ALL SELECT 'events', cast(sum(is_event::int) AS varchar) FROM rec UNION ALL SELECT 'groups', cast(count(DISTINCT group_id) AS varchar) FROM rec
  UNION ALL SELECT 'sources', cast(count(DISTINCT source_id) AS varchar) FROM rec UNION ALL SELECT 'equivalences', cast(count(DISTINCT equiv_id) AS varchar) FROM rec UNION ALL SELECT 'above_strength', cast(sum((s_level > 1)::int) AS varchar) FROM rec
  UNION ALL SELECT 'max_temp_c', cast(max(temp_c)::BIGINT AS varchar) FROM rec""", "item value", "", "rec")
def _items(spark, sf):
    return SU.audit_items(S.records(spark, sf), {
        "rows": F.count(F.lit(1)), "events": F.sum(c("is_event").cast("long")), "groups": F.countDistinct("group_id"),
        "sources": F.countDistinct("source_id"), "equivalences": F.countDistinct("equiv_id"),
        "above_strength": F.sum((c("s_level") > 1).cast("long")), "max_temp_c": F.max("temp_c").cast("long")})


@query("review_extract", """SELECT row_id, group_id, 'above_strength' AS finding, 'check normalisation' AS action FROM rec WHERE s_level > 5 UNION ALL SELECT row_id, group_id, 'many_lines', 'check duplicates' FROM rec WHERE n_lines > 7""", "row_id group_id finding action", "", "rec")
def _review(spark, sf):
    return SU.review_extract(S.records(spark, sf), {
        "above_strength": (c("s_level") > 5, "check normalisation"), "many_lines": (c("n_lines") > 7, "check duplicates")}, ["row_id", "group_id"])


# ------------------------------------------------------------------ studies

@query("ablation_deltas", f"WITH m AS ({Q.point_sql('model')}), r AS (SELECT * FROM m WHERE model = 'line') SELECT m.model, m.gb_rmse-r.gb_rmse AS delta_gb_rmse, m.gb_mae-r.gb_mae AS delta_gb_mae, m.gb_r2-r.gb_r2 AS delta_gb_r2 FROM m, r", "model", "delta_gb_rmse delta_gb_mae delta_gb_r2", "sco")
def _abl(spark, sf):
    out = T.ablation_deltas(M.point_metrics(S.predictions(spark, sf), ["model"]), "model", "line")
    return out.select("model", "delta_gb_rmse", "delta_gb_mae", "delta_gb_r2")


# Held-out levels and the customers they touch; training rows are those of all other customers.
REFIT_SQL = """touch AS (SELECT DISTINCT scenario, holdout, equiv_id FROM fl), lev AS (SELECT DISTINCT scenario, holdout FROM fl),
 tr AS (SELECT lev.scenario, lev.holdout, x_gross, y FROM lev JOIN rec ON is_event WHERE NOT EXISTS (SELECT 1 FROM touch t WHERE t.scenario = lev.scenario AND t.holdout = lev.holdout AND t.equiv_id = rec.equiv_id)),
 ln0 AS (SELECT scenario, holdout, count(*) AS n_train, regr_slope(y, x_gross) AS slope, regr_intercept(y, x_gross) AS intercept FROM tr GROUP BY ALL),
 refit AS (SELECT ln0.*, (SELECT sqrt(avg((tr.y - ln0.intercept - ln0.slope*tr.x_gross)*(tr.y - ln0.intercept - ln0.slope*tr.x_gross))) FROM tr WHERE tr.scenario = ln0.scenario AND tr.holdout = ln0.holdout) AS scale FROM ln0 WHERE n_train >= 3)"""


@query("strict_refits", f"WITH {REFIT_SQL} SELECT scenario, holdout, n_train, slope, intercept, scale FROM refit", "scenario holdout n_train", "slope intercept scale", "fpred")
def _refits(spark, sf):
    return T.strict_lines(S.folded(spark, sf), {"LOEO": "env_class", "LOTO": "temp_bin"}, "x_gross", "y", "equiv_id").where("slope IS NOT NULL")


@query("strict_comparison", f"""WITH {Q.factor_scored_sql()}, {REFIT_SQL}, org AS (SELECT * FROM fsco WHERE model = 'line' AND (scenario, holdout) IN (SELECT (scenario, holdout) FROM refit)), a AS ({Q.card_sql('scenario, model', 'org')}),
  st0 AS (SELECT o.* EXCLUDE (pred, scale, row_nll), r.intercept + r.slope*o.x_gross AS pred, r.scale FROM org o JOIN refit r ON o.scenario = r.scenario AND o.holdout = r.holdout), st AS (SELECT *, {Q.NORMAL_LOSS} AS row_nll FROM st0), b AS ({Q.card_sql('scenario, model', 'st')})
  {' UNION ALL '.join(f"SELECT a.scenario, a.model, '{m}' AS metric, b.{m} - a.{m} AS strict_minus_original FROM a JOIN b ON a.scenario = b.scenario AND a.model = b.model" for m in T.CARD_METRICS)}""", "scenario model metric", "strict_minus_original", "fpred")
def _strict(spark, sf):
    records = S.folded(spark, sf)
    refits = settle(T.strict_lines(records, {"LOEO": "env_class", "LOTO": "temp_bin"}, "x_gross", "y", "equiv_id").where("slope IS NOT NULL"), "refits")
    original = M.with_row_loss(S.factor_predictions(spark, sf).where("model = 'line'")).join(refits.select("scenario", "holdout"), ["scenario", "holdout"], "left_semi")
    moved = original.drop("pred", "scale", "row_nll").join(records.select("row_id", "x_gross"), "row_id").join(refits.drop("n_train"), ["scenario", "holdout"])
    strict = M.with_row_loss(moved.withColumn("pred", c("intercept") + c("slope") * c("x_gross")).drop("x_gross", "slope", "intercept"))
    return T.matched_comparison(strict, original, ["scenario", "model"])[1]


RVR = """rv AS (SELECT 'reference' AS variant, cast(row_id AS varchar) AS variant_row, equiv, group_id, is_censored, y FROM rr UNION ALL SELECT 'no_secondary', cast(row_id AS varchar), equiv, group_id, is_censored, y FROM rr WHERE n_lines <= 4
  UNION ALL SELECT 'high_evidence_only', cast(row_id AS varchar), equiv, group_id, is_censored, y FROM rr WHERE n_lines = 2 UNION ALL SELECT 'expanded', d.row_id, equiv, group_id, d.is_censored, y FROM rr JOIN dup d ON d.equiv_id = equiv)"""


@query("duplicate_variants", f"WITH rr AS (SELECT *, row_id || '-1' AS equiv FROM rec), {RVR} SELECT variant, variant_row, equiv AS equiv_id, group_id, is_censored, y FROM rv", "variant variant_row equiv_id group_id is_censored", "y", "rec dup")
def _dupvar(spark, sf):
    rep = S.records(spark, sf).withColumns({
        "equiv_id": F.concat(c("row_id").cast("string"), F.lit("-1")), "secondary": c("n_lines") > 4, "high_evidence": c("n_lines") == 2})
    return T.raw_variants(S.raw_rows(spark, sf), rep, ["is_censored", "y"], ["secondary", "high_evidence"]).select(
        "variant", "variant_row", "equiv_id", "group_id", "is_censored", "y")


EXC = "(SELECT *, 'all_rows' AS variant FROM pred UNION ALL SELECT *, 'without_high_stress' FROM pred WHERE NOT s_level > 4)"


@query("exclusion_sensitivity", Q.point_sql("variant, model", EXC), "variant model n_events n_groups", "gb_rmse gb_mae gb_r2 gb_f5", "pred")
def _excl(spark, sf):
    rows = T.exclusion_variant(S.predictions(spark, sf), c("s_level") > 4, "without_high_stress")
    return M.point_metrics(rows, ["variant", "model"])


@query("result_diff", """WITH a AS (SELECT * FROM pred), b AS (SELECT * FROM pred WHERE n_lines < 7), j AS (SELECT a.row_id, b.row_id IS NULL AS miss, a.y, a.n_lines FROM a LEFT JOIN b USING (row_id, model))
  SELECT '_rows' AS "column", false AS "numeric", count(*) AS n_compared, sum(miss::int)::BIGINT AS n_different, NULL::double AS max_abs_difference, sum(miss::int) = 0 AS passed FROM j
  UNION ALL SELECT 'y', true, count(*), sum((n_lines = 2)::int)::BIGINT, 0.001::double, sum((n_lines = 2)::int) = 0 FROM j WHERE NOT miss
  UNION ALL SELECT 'fold', true, count(*), 0, 0.0::double, true FROM j WHERE NOT miss UNION ALL SELECT 'group_id', false, count(*), 0, NULL, true FROM j WHERE NOT miss""",
       '"column" "numeric" n_compared n_different passed', "max_abs_difference", "pred")
def _diff(spark, sf):
    p = S.predictions(spark, sf)
    a = p.select("row_id", "model", "y", "fold", "group_id")
    b = p.where("n_lines < 7").select("row_id", "model", F.when(c("n_lines") == 2, c("y") + 0.001).otherwise(c("y") + 1e-12).alias("y"), "fold", "group_id")
    return D.compare(a, b, ["row_id", "model"])


@query("unkeyed_diff", """WITH a AS (SELECT group_id, env_class, n_lines FROM rec), b AS (SELECT group_id, env_class, CASE WHEN n_lines = 7 THEN 6 ELSE n_lines END AS n_lines FROM rec)
  SELECT group_id, env_class, n_lines, coalesce(x, 0)::BIGINT AS n_first, coalesce(z, 0)::BIGINT AS n_second FROM (SELECT *, count(*) AS x FROM a GROUP BY ALL) FULL JOIN (SELECT *, count(*) AS z FROM b GROUP BY ALL) USING (group_id, env_class, n_lines) WHERE coalesce(x, 0) <> coalesce(z, 0)""", "group_id env_class n_lines n_first n_second", "", "rec")
def _udiff(spark, sf):
    a = S.records(spark, sf).select("group_id", "env_class", "n_lines")
    b = a.withColumn("n_lines", F.when(c("n_lines") == 7, F.lit(6).cast("long")).otherwise(c("n_lines")))
    return D.compare_unkeyed(a, b, ["group_id", "env_class", "n_lines"])


def _chained(columns: tuple[str, ...], exact: str, tolerance: str) -> str:
    """Every column in turn numbers the runs of its values within the columns before it."""
    parts, held = [], [exact]
    for i, x in enumerate(columns):
        by = f"PARTITION BY {', '.join(held)} ORDER BY {x}"
        parts.append(f"g{i} AS (SELECT *, sum(o) OVER ({by}) AS k{i} FROM (SELECT * EXCLUDE (o), coalesce({x} - lag({x}) OVER ({by}) > {tolerance} + {tolerance} * abs({x}), false)::int AS o FROM {f'g{i - 1}' if i else 'u'}))")
        held.append(f"k{i}")
    shown = ", ".join(f"min({x}) AS {x}" for x in columns)
    return f"{', '.join(parts)} SELECT {exact}, {shown}, sum(p)::bigint AS n_first, sum(q)::bigint AS n_second FROM g{len(columns) - 1} GROUP BY {', '.join(held)} HAVING sum(p) <> sum(q)"


@query("unkeyed_diff_within_tolerance", f"""WITH a AS (SELECT env_class, y, x_gross FROM rec), b AS (SELECT env_class, CASE WHEN n_lines = 7 THEN y + 0.001 ELSE y + 1e-12 END AS y, x_gross FROM rec),
  u AS (SELECT *, 1 AS p, 0 AS q, 0 AS o FROM a UNION ALL SELECT *, 0, 1, 0 FROM b), {_chained(('y', 'x_gross'), 'env_class', '1e-9')}""", "env_class n_first n_second", "y x_gross", "rec")
def _udiff_loose(spark, sf):
    a = S.records(spark, sf).select("env_class", "y", "x_gross", "n_lines")
    b = a.withColumn("y", F.when(c("n_lines") == 7, c("y") + 0.001).otherwise(c("y") + 1e-12))
    return D.compare_unkeyed(a, b, ["env_class", "y", "x_gross"], 1e-9, 1e-9)


# The stored result set is damaged in one model, by more than the tolerance, and in another by less.
@query("recompute_audit", "SELECT DISTINCT model, model <> 'segment' AS passed FROM pred", "model passed", "", "pred")
def _recompute(spark, sf):
    damage = F.when(c("model") == "segment", 1e-4).when(c("model") == "const", 1e-14).otherwise(0.0)
    saved = settle(M.point_metrics(S.predictions(spark, sf), ["model"]).withColumn("gb_mae", c("gb_mae") + damage), "saved").select("model", "gb_rmse", "gb_mae", "gb_r2", "gb_f5")
    return T.recompute_audit(S.predictions(spark, sf), saved, ["model"]).select("model", "passed")


@query("model_comparison", f"SELECT * FROM ({Q.point_sql('model')}) JOIN (SELECT model, 1.0::double AS interval_completeness, avg(coverage) AS coverage, avg(width) AS width, avg(interval_score) AS interval_score FROM ({Q.EIS}) GROUP BY model) USING (model) WHERE model IN ('const', 'line')",
       "model n_events n_groups", "gb_rmse gb_mae gb_r2 gb_f5 interval_completeness coverage width interval_score", "sco")
def _modelcmp(spark, sf):
    return T.model_comparison(S.scored(spark, sf), ("const", "line"), [], "lower90", "upper90", 0.9)


@query("scope_table", f"""WITH a AS ({Q.point_sql('model', 'pred')}), b AS ({Q.point_sql('model', "(SELECT * FROM fpred WHERE scenario = 'LOEO')")}), d AS ({Q.point_sql('model', "(SELECT * FROM fpred WHERE scenario = 'LOTO')")})
  {' UNION ALL '.join(f"SELECT '{n}' AS scope, max(CASE WHEN model = 'const' THEN gb_rmse END) AS const, max(CASE WHEN model = 'line' THEN gb_rmse END) AS line, max(CASE WHEN model = 'segment' THEN gb_rmse END) AS segment FROM {t}" for n, t in (('Primary', 'a'), ('LOEO', 'b'), ('LOTO', 'd')))}""",
       "scope", "const line segment", "pred fpred")
def _scope(spark, sf):
    f = S.factor_predictions(spark, sf)
    return T.scope_table({"Primary": S.predictions(spark, sf), "LOEO": f.where("scenario = 'LOEO'"), "LOTO": f.where("scenario = 'LOTO'")}, "gb_rmse", list(S.MODELS))


@query("scale_profile", f"SELECT model, s AS grid_scale, avg(CASE WHEN is_event THEN ln(s)-(y-pred)/s+exp((y-pred)/s) ELSE exp((y-pred)/s) END) AS mean_nll FROM pred, (VALUES (0.2::double), (0.3::double), (0.45::double), (0.7::double), (1.0::double), (2.0::double)) v(s) GROUP BY ALL", "model", "grid_scale mean_nll", "pred")
def _profile(spark, sf):
    from evenfold.operators.fit.trunk import scale_profile

    return scale_profile(S.predictions(spark, sf), ["model"], (0.2, 0.3, 0.45, 0.7, 1.0, 2.0), "weibull")


@query("data_audit", f"""SELECT 'cells' AS part, count(*) AS n FROM (SELECT DISTINCT architecture, env_class, temp_bin FROM rec) UNION ALL SELECT 'single_group_cells', count(*) FROM (SELECT architecture, env_class, temp_bin FROM rec GROUP BY ALL HAVING count(DISTINCT group_id) = 1)
  UNION ALL SELECT 'few_row_cells', count(*) FROM (SELECT architecture, env_class, temp_bin FROM rec GROUP BY ALL HAVING count(*) < 10)""", "part n", "", "rec")
def _daudit(spark, sf):
    cells = SU.support_counts(S.records(spark, sf), FACTORS)
    one = cells.agg(F.count(F.lit(1)).alias("cells"), F.count(F.when(c("single_group"), 1)).alias("single_group_cells"), F.count(F.when(c("few_rows"), 1)).alias("few_row_cells"))
    return one.unpivot([], ["cells", "single_group_cells", "few_row_cells"], "part", "n")


GATES = ("unique_row_ids", "labels_complementary", "one_fold_per_group", "each_row_predicted_once", "prediction_table_valid", "temperature_has_one_bin")


@query("claim_gate")
def _claims(spark, sf):
    rec, pred = S.folded(spark, sf), S.predictions(spark, sf)
    metrics = settle(M.point_metrics(pred, ["model"]), "metrics")
    paired = settle(B.paired_effects(pred, [], S.PROPOSED, X.REPS, 6, composite=False), "paired")
    chosen = settle(K.budget_rule(X.candidates(spark, sf), ["fold"], 0.00002), "chosen")
    rules = CL.evaluation_rules(rec, pred, metrics, paired, rec.select("group_id", "fold"), settle(A.cluster_stats(S.raw_rows(spark, sf)), "cl"), chosen, S.PROPOSED, S.K)
    return CL.gate(rules, list(GATES))


@query("claim_gate_data_rules", """SELECT 'events_present' AS gate, true AS passed, cast(sum(is_event::int) AS varchar) AS evidence FROM rec UNION ALL SELECT 'enough_groups', count(DISTINCT group_id) >= 5, cast(count(DISTINCT group_id) AS varchar) FROM rec
  UNION ALL SELECT 'no_duplicate_keys', false, 'violations=' || (SELECT count(*) FROM (SELECT equiv_id FROM dup GROUP BY equiv_id HAVING count(*) > 1)) UNION ALL SELECT 'all_required', true, '2/2'""", "gate passed evidence", "", "rec dup")
def _claims2(spark, sf):
    from evenfold.operators import contracts as C

    rec = S.records(spark, sf)
    ev = F.sum(c("is_event").cast("long"))
    return CL.gate([CL.rule("events_present", rec, ev > 0, ev), CL.rule("enough_groups", rec, F.countDistinct("group_id") >= 5, F.countDistinct("group_id")),
                    CL.empty("no_duplicate_keys", C.duplicates(S.raw_rows(spark, sf), ["equiv_id"]))], ["events_present", "enough_groups"])


#: Result tables that the claims read: name in the claims and registered query.
STUDY = {"effects": "paired_bootstrap", "holdouts": "factor_paired_gains", "coverage": "interval_bootstrap", "intervals": "empirical_interval_summary",
         "losses": "joint_losses", "parameters": "boundary_hits", "selection": "budget_rule"}
OTHERS = [m for m in S.MODELS if m != S.PROPOSED]
REQUIRED = ["multimetric_superiority", "holdout_point_superiority", "interval_coverage_nominal", "survival_noninferiority", "parameters_interior", "budget_never_relaxed"]


def _study_sql() -> str:
    """Every rule stated again over the SQL of the tables it reads."""
    def d4(x: str) -> str:
        return f"cast(cast({x} AS decimal(18,4)) AS varchar)"

    def ratio(x: str) -> str:
        return f"count(*) FILTER (WHERE {x}) || '/' || count(*)"

    known = f"model IN ({', '.join(repr(m) for m in OTHERS)})"
    rules = []
    for m in OTHERS:
        for name, value in (("point", "estimate"), ("interval", "lo")):
            v = f"max({value}) FILTER (WHERE model = '{m}' AND effect = 'rmse')"
            rules.append((f"beats_{m}_{name}", "effects", f"{v} > 0", d4(v)))
    def counted(name: str, origin: str, condition: str, wanted: str) -> None:
        n = f"count(*) FILTER (WHERE {condition})"
        rules.append((name, origin, f"{n} = {wanted}", n))
    counted("rmse_superiority", "effects", f"{known} AND effect = 'rmse' AND lo > 0", str(len(OTHERS)))
    counted("multimetric_superiority", "effects", f"{known} AND lo > 0", f"{len(OTHERS)} * count(DISTINCT effect)")
    held = f"{known} AND scenario IN ('LOEO', 'LOTO')"
    for name, more in (("scenarios_complete", ""), ("point_superiority", " AND estimate > 0"), ("interval_superiority", " AND lo > 0")):
        counted(f"holdout_{name}", "holdouts", held + more, str(2 * len(OTHERS)))
    lo, hi = (f"max(coverage_{e}) FILTER (WHERE model = '{S.PROPOSED}')" for e in ("lo", "hi"))
    rules.append(("interval_coverage_nominal", "coverage", f"{lo} <= 0.9 AND {hi} >= 0.9", f"{d4(lo)} || ',' || {d4(hi)}"))
    rules.append(("intervals_complete", "intervals", "bool_and(interval_completeness = 1)", ratio("interval_completeness = 1")))
    a, b = (f"max(censored_nll) FILTER (WHERE model = '{m}')" for m in (S.PROPOSED, "const"))
    rules.append(("survival_noninferiority", "losses", f"{a} <= {b}", f"{d4(a)} || ',' || {d4(b)}"))
    rules.append(("parameters_in_all_folds", "parameters", f"count(DISTINCT fold) = {S.K}", "count(DISTINCT fold)"))
    rules.append(("parameters_finite", "parameters", "bool_and(isfinite(slope))", ratio("isfinite(slope)")))
    rules.append(("slope_positive", "parameters", "min(slope) > 0", d4("min(slope)")))
    rules.append(("parameters_interior", "parameters", "NOT bool_or(any_boundary_hit)", ratio("any_boundary_hit")))
    rules.append(("all_candidates_scored", "selection", f"count(DISTINCT (fold, candidate)) = {S.K * len(X.ETAS)}", "count(DISTINCT (fold, candidate))"))
    counted("budget_never_relaxed", "selection", "selected AND within", str(S.K))
    rules.append(("every_training_set_has_censored_rows", "folds", "count(DISTINCT fold) FILTER (WHERE NOT is_event) > 1", "count(DISTINCT fold) FILTER (WHERE NOT is_event)"))
    tables = ", ".join([f"t_{n} AS ({SQL[q]})" for n, q in STUDY.items()] + ["t_folds AS (SELECT fold, is_event FROM recf)"])
    union = " UNION ALL ".join(f"SELECT '{g}' AS gate, coalesce({p}, false) AS passed, cast({e} AS varchar) AS evidence, '{o}' AS origin FROM t_{o}" for g, o, p, e in rules)
    wanted = f"count(*) FILTER (WHERE passed AND gate IN ({', '.join(repr(g) for g in REQUIRED)}))"
    return f"WITH {tables}, v AS ({union}) SELECT * FROM v UNION ALL SELECT 'overall_claim', {wanted} = {len(REQUIRED)}, {wanted} || '/{len(REQUIRED)}', 'all' FROM v"


@query("claim_gate_study", _study_sql(), "gate passed evidence origin", "", "recf")
def _study_claims(spark, sf):
    tables = {n: QUERIES[q](spark, sf) for n, q in STUDY.items()} | {"folds": S.folded(spark, sf).select("fold", "is_event")}
    claims = CL.study_claims(S.PROPOSED, "const", OTHERS, ["LOEO", "LOTO"], S.K, len(X.ETAS), 0.9)
    return CL.overall(CL.judged(tables, claims), REQUIRED)
