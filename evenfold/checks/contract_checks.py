"""Contracts, leakage checks and audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from evenfold.checks.projections import COEF, EXPO, LOGF, WALK, WET, _location_frame
from evenfold.checks.registry import query
from evenfold.functions import damage as D
from evenfold.functions import text as X
from evenfold.operators import audits as A
from evenfold.operators import contracts as C
from evenfold.operators import folds as FO
from evenfold.plans import standins as S

c = F.col
V = "rule key detail"


@query("uniqueness_violations", """SELECT 'not_unique:equiv_id' AS rule, equiv_id AS key, cast(count(*) AS varchar) AS detail FROM dup GROUP BY equiv_id HAVING count(*) > 1
  UNION ALL SELECT 'blank:source_id', row_id, 'blank' FROM dup WHERE source_id IS NULL""", V, "", "dup")
def _unique(spark, sf):
    raw = S.raw_rows(spark, sf)
    return C.all_of(C.duplicates(raw, ["equiv_id"]), C.blank(raw, "source_id", "row_id"))


@query("label_violations", """SELECT rule, cast(row_id AS varchar) AS key, d AS detail FROM (
  SELECT row_id, 'labels_not_complementary' AS rule, cast(is_event AS varchar) || '/' || cast(z AS varchar) AS d FROM x WHERE is_event = z
  UNION ALL SELECT row_id, 'training_role', role FROM x WHERE role <> CASE WHEN is_event THEN 'exact' ELSE 'censored' END
  UNION ALL SELECT row_id, 'weight', cast(w AS varchar) FROM x WHERE abs(w - 1) > 1e-8 + 1e-5)""", V, "", "rec xlab")
def _labels(spark, sf):
    rec = S.records(spark, sf)
    bad = F.pmod(c("row_id"), F.lit(97)) == 0
    x = rec.withColumns({
        "is_censored": F.when(bad, c("is_event")).otherwise(c("is_censored")),
        "role": F.when(c("n_lines") > 6, "exact").when(c("is_event"), "exact").otherwise("censored"),
        "w": F.when(c("n_lines") > 7, 2.0).otherwise(1.0)})
    rules = C.label_rules() | {
        "training_role": C.implied_label(c("is_event"), c("role"), "exact", "censored"), "weight": C.unit_weight(c("w"))}
    return C.Contract(("row_id", "is_event", "is_censored"), "row_id", rules).violations(x)


@query("range_violations", """SELECT 'not_positive:r_ratio' AS rule, cast(row_id AS varchar) AS key, cast(r_ratio AS varchar) AS detail FROM rec WHERE r_ratio <= 0
  UNION ALL SELECT 'not_below_7:freq', cast(row_id AS varchar), cast(freq AS varchar) FROM rec WHERE freq >= 7""", V, "", "rec")
def _ranges(spark, sf):
    rules = C.range_rules(("y", "s_level", "temp_c"), ("s_level", "freq", "r_ratio"), {"freq": 7.0})
    return C.Contract(("row_id", "y", "s_level"), "row_id", rules).violations(S.records(spark, sf))


@query("dependency_violations", """SELECT 'temp_c_has_many:temp_bin' AS rule, cast(temp_c AS varchar) AS key, min(temp_bin) || '..' || max(temp_bin) AS detail FROM rec GROUP BY temp_c HAVING min(temp_bin) <> max(temp_bin)
  UNION ALL SELECT 'equiv_id_has_many:env_class', equiv_id, min(env_class) || '..' || max(env_class) FROM rec GROUP BY equiv_id HAVING min(env_class) <> max(env_class)
  UNION ALL SELECT 'equiv_id_has_many:architecture', equiv_id, min(architecture) || '..' || max(architecture) FROM rec GROUP BY equiv_id HAVING min(architecture) <> max(architecture)""", V, "", "rec")
def _fd(spark, sf):
    rec = S.records(spark, sf)
    return C.all_of(C.functional_dependency(rec, "temp_c", "temp_bin"), C.functional_dependency(rec, "equiv_id", "env_class"),
                    C.functional_dependency(rec, "equiv_id", "architecture"))


@query("coverage_violations", """SELECT CASE WHEN e = 0 THEN 'unexpected' WHEN a = 0 THEN 'missing' ELSE 'repeated' END AS rule, model || '|' || cast(row_id AS varchar) AS key, cast(a AS varchar) AS detail FROM (
  SELECT model, row_id, sum(e) AS e, sum(a) AS a FROM (
   SELECT m AS model, row_id, 1 AS e, 0 AS a FROM rec, (VALUES ('const'), ('line'), ('segment')) v(m)
   UNION ALL SELECT model, row_id, 0, 1 FROM pred WHERE NOT (model = 'const' AND n_lines = 1)
   UNION ALL SELECT model, row_id, 0, 1 FROM pred WHERE model = 'line' AND n_lines = 7) GROUP BY ALL) WHERE a <> 1 OR e = 0""", V, "", "pred")
def _coverage(spark, sf):
    models = F.explode(F.array(*[F.lit(m) for m in S.MODELS])).alias("model")
    expected = S.records(spark, sf).select(models, "row_id")
    p = S.predictions(spark, sf)
    actual = p.where("NOT (model = 'const' AND n_lines = 1)").select("model", "row_id").unionByName(
        p.where("model = 'line' AND n_lines = 7").select("model", "row_id"))
    return C.coverage(expected, actual, ["model", "row_id"])


@query("overlap_violations", """SELECT 'overlap:group_id' AS rule, group_id AS key, 'train and test' AS detail FROM rec GROUP BY group_id HAVING count(DISTINCT temp_bin = '1995') > 1
  UNION ALL SELECT 'overlap:equiv_id', equiv_id, 'train and test' FROM rec GROUP BY equiv_id HAVING count(DISTINCT temp_bin = '1995') > 1""", V, "", "rec")
def _overlap(spark, sf):
    rec = S.records(spark, sf)
    test = c("temp_bin") == "1995"
    return C.overlap(rec.where(~test), rec.where(test), ["row_id", "group_id", "equiv_id"])


@query("membership_overlap", "SELECT 'none' AS status, count(*) AS n FROM (SELECT group_id FROM folds GROUP BY group_id HAVING count(DISTINCT fold) > 1)", "status n", "", "folds")
def _member_overlap(spark, sf):
    m = FO.membership(S.folded(spark, sf), S.K, ["row_id", "group_id", "equiv_id"])
    return C.role_overlap(m, ["row_id", "group_id", "equiv_id"]).agg(F.lit("none").alias("status"), F.count(F.lit(1)).alias("n"))


@query("partition_violations", """SELECT 'not_a_partition' AS rule, cast(row_id AS varchar) AS key, '1,' || CASE WHEN fold = 1 THEN '1,' ELSE '0,' END || CASE WHEN fold >= 3 OR (fold = 1 AND n_lines = 2) THEN '1' ELSE '0' END AS detail
  FROM recf WHERE fold = 2 OR (fold = 1 AND n_lines = 2)""", V, "", "recf")
def _partition(spark, sf):
    f = S.folded(spark, sf)
    return C.partition_complement(f, f.where("fold = 1"), f.where("fold >= 3 OR (fold = 1 AND n_lines = 2)"), "row_id")


@query("pairing_violations", """SELECT CASE WHEN n_lines = 1 THEN 'only_left' ELSE 'values_differ' END AS rule, cast(row_id AS varchar) AS key, 'y,is_event,group_id' AS detail
  FROM rec WHERE n_lines = 1 OR n_lines = 5""", V, "", "rec")
def _pairing(spark, sf):
    p = S.predictions(spark, sf)
    a = p.where("model = 'line'")
    b = p.where("model = 'const' AND n_lines <> 1").withColumn("y", F.when(c("n_lines") == 5, c("y") + 1e-9).otherwise(c("y") + 1e-14))
    return C.identical_rows(a, b, "row_id", ["y", "is_event", "group_id"])


@query("prediction_contract", """SELECT 'not_positive:scale' AS rule, cast(row_id AS varchar) AS key, '0.0' AS detail FROM pred WHERE n_lines = 7
  UNION ALL SELECT 'unknown_family', cast(row_id AS varchar), 'gamma' FROM pred WHERE model = 'segment'""", V, "", "pred")
def _pred_contract(spark, sf):
    p = S.predictions(spark, sf).withColumn("scale", F.when(c("n_lines") == 7, 0.0).otherwise(c("scale"))).withColumn(
        "family", F.when(c("model") == "segment", "gamma").otherwise(c("family")))
    return C.prediction_contract().violations(p)


@query("outcome_leak", """SELECT 'outcome_present:life' AS rule, cast(row_id AS varchar) AS key, cast(n_lines AS varchar) AS detail FROM rec WHERE temp_bin = '1998' AND n_lines > 5
  UNION ALL SELECT DISTINCT 'group_seen_in_training', group_id, 'training' FROM rec WHERE temp_bin = '1998' AND group_id IN (SELECT group_id FROM rec WHERE temp_bin < '1998')""", V, "", "rec")
def _leak(spark, sf):
    rec = S.records(spark, sf)
    new = rec.where("temp_bin = '1998'").withColumn("life", F.when(c("n_lines") > 5, c("n_lines")))
    return C.outcome_leak(new, ["life"], rec.where("temp_bin < '1998'"), "row_id")


@query("outcome_table_violations", """SELECT 'not_positive:life' AS rule, cast(row_id AS varchar) AS key, '-1.0' AS detail FROM rec WHERE n_lines = 6 AND temp_bin >= '1998'
  UNION ALL SELECT 'not_unique:row_id', cast(row_id AS varchar), '2' FROM rec WHERE n_lines = 7 AND temp_bin >= '1998'
  UNION ALL SELECT 'not_predicted', cast(row_id AS varchar), 'outcome' FROM rec WHERE temp_bin = '1998'""", V, "", "rec")
def _outcomes(spark, sf):
    rec = S.records(spark, sf)
    obs = rec.where("temp_bin >= '1998'").select("row_id", "n_lines", F.when(c("n_lines") == 6, -1.0).otherwise(c("life")).alias("life"))
    obs = obs.unionByName(obs.where("n_lines = 7"))
    return C.outcome_table(obs, rec.where("temp_bin > '1998'"), "row_id", "life")


@query("fold_id_hashes", """SELECT fold, sum(n)::BIGINT AS n_rows, sha256(string_agg(sha, ',' ORDER BY part)) AS ids_sha FROM (
  SELECT fold, part, count(*) AS n, sha256(string_agg(s, ',' ORDER BY s)) AS sha FROM (SELECT fold, cast(row_id AS varchar) AS s, substr(md5(cast(row_id AS varchar)), 1, 3) AS part FROM recf) GROUP BY fold, part) GROUP BY fold""",
       "fold n_rows ids_sha", "", "recf")
def _hashes(spark, sf):
    return A.fold_id_hashes(S.folded(spark, sf), ["fold"])


@query("fold_fingerprints", """SELECT fold, count(*) AS n_rows, sum(h::hugeint)::varchar AS hash_sum, bit_xor(h) AS hash_xor
  FROM (SELECT fold, ('0x' || substr(md5(cast(row_id AS varchar)), 1, 15))::BIGINT AS h FROM recf) GROUP BY fold""", "fold n_rows hash_sum hash_xor", "", "recf")
def _fingerprints(spark, sf):
    return A.fold_fingerprints(S.folded(spark, sf), ["fold"])


@query("calibration_trace", """SELECT model, fold, count(*) AS n_validation, sum(is_event::int)::BIGINT AS n_events, sum((n_lines = 3)::int)::BIGINT AS n_mismatch, 0::BIGINT AS n_unknown FROM pred GROUP BY ALL""",
       "model fold n_validation n_events n_mismatch n_unknown", "", "pred")
def _trace(spark, sf):
    rec = S.records(spark, sf).withColumn("y", F.when(c("n_lines") == 3, c("y") + 0.5).otherwise(c("y")))
    return A.calibration_trace(S.predictions(spark, sf), rec, ["model"], "fold")


ORD = f"(5.0::double - 0.8::double*{WALK.format(g='0.85::double')})"
LR = f"(-1.0::double + 2.0::double*(1000.0::double * (1.0::double/1073.15 - 1.0::double/(temp_c + 273.15)))/ln(10.0::double) + 1.5::double*{WALK.format(g='0.85::double')} - {LOGF})"
ORD_SQL = f"""SELECT fold, -(log10(1+pow(10.0::double, {LR}+0.4::double))) + log10(1+pow(10.0::double, {LR})) AS d FROM recf"""


def _order(spark, sf):
    f = _location_frame(spark, sf)
    f = f.join(S.fold_map(S.records(spark, sf)).select("group_id", "fold"), "group_id")
    drive = D.thermal_drive(c("temp_c"))

    def base(wet):
        ratio = D.damage_ratio(COEF["k"], COEF["m"], COEF["q"], c("x"), F.lit(1.0), drive, c("log_f"), COEF["beta"] if wet else 0.0)
        return D.competing_location(COEF["a"], COEF["b"], c("x"), ratio)

    shared = 0.75 * D.support_weight(F.abs(c("temp_c") - 600.0))
    return A.order_audit(f, base(True) + shared, base(False) + shared, base(True), base(False), ["row_id", "fold"])


@query("order_audit", f"SELECT fold, count(*) AS n_conditions, 0::BIGINT AS total_reversals, max(d) AS max_trunk_change, max(d) AS max_total_change FROM ({ORD_SQL}) GROUP BY fold",
       "fold n_conditions total_reversals", "max_trunk_change max_total_change", "recf")
def _order_summary(spark, sf):
    return A.order_summary(_order(spark, sf), ["fold"])


@query("order_audit_rows", f"""SELECT row_id, fold, d AS trunk_change, d AS total_change, 0.0::double AS residual_change, false AS total_reversal, false AS trunk_reversal
  FROM (SELECT row_id, fold, -(log10(1+pow(10.0::double, {LR}+0.4::double))) + log10(1+pow(10.0::double, {LR})) AS d FROM recf)""",
       "row_id fold total_reversal trunk_reversal", "trunk_change total_change residual_change", "recf")
def _order_rows(spark, sf):
    return _order(spark, sf)


@query("scale_invariance", "SELECT env_class, count(*) AS n_rows, env_class <> 'steam' AS within_tolerance FROM rec GROUP BY env_class", "env_class n_rows within_tolerance", "", "rec")
def _invariance(spark, sf):
    f = _location_frame(spark, sf)
    drive = D.thermal_drive(c("temp_c"))
    first = D.competing_location(5.0, 0.8, c("x"), c("ratio"))
    # Ten times the exposure with the coefficient lowered by one decade is the same model; in one class it is lowered by less.
    lowered = F.when(c("env_class") == "steam", COEF["k"] - 0.9).otherwise(COEF["k"] - 1.0)
    other = D.damage_ratio(lowered, COEF["m"], COEF["q"], c("x"), c("exposure") * 10.0, drive, c("log_f"), c("wet_shift"))
    audit = A.invariance_audit(f, first, D.competing_location(5.0, 0.8, c("x"), other), ["env_class"])
    return audit.select("env_class", "n_rows", (c("max_abs_difference") < 1e-9).alias("within_tolerance"))


REQ = ("page", "quote", "document", "scope")


def _evidence(spark, sf):
    return S.records(spark, sf).where("is_censored AND n_lines > 2").select(
        "row_id", "source_id",
        F.when(c("n_lines") == 3, "unknown").when(c("n_lines") == 4, "damage_threshold").when(c("n_lines") == 7, "other").otherwise("administrative_cycle_limit").alias("stop_type"),
        F.when(c("n_lines") != 4, "p1").alias("page"), F.lit("q").alias("quote"), F.lit(" d ").alias("document"), F.lit("s").alias("scope"))


EVID = """ (SELECT row_id, source_id, group_id, CASE WHEN n_lines <= 2 THEN 'unreviewed' WHEN n_lines = 3 THEN 'unknown' WHEN n_lines = 4 THEN 'damage_threshold' WHEN n_lines = 7 THEN 'other' ELSE 'administrative_cycle_limit' END AS stop_type,
  n_lines > 2 AND n_lines <> 4 AS evidence_complete,
  CASE WHEN n_lines <= 2 THEN 'unreviewed' WHEN n_lines = 3 THEN 'unknown' WHEN n_lines = 4 THEN 'incomplete_evidence' ELSE 'documented_pending_review' END AS audit_status FROM rec WHERE is_censored) """


@query("censoring_evidence", f"SELECT * FROM {EVID}", "row_id source_id group_id stop_type evidence_complete audit_status", "", "rec")
def _cens(spark, sf):
    return A.censoring_evidence(S.records(spark, sf), _evidence(spark, sf), REQ)


@query("evidence_gaps", f"SELECT source_id, stop_type, audit_status, count(*) AS n_rows FROM {EVID} GROUP BY ALL", "source_id stop_type audit_status n_rows", "", "rec")
def _gaps(spark, sf):
    return A.evidence_gaps(A.censoring_evidence(S.records(spark, sf), _evidence(spark, sf), REQ))


@query("evidence_problems", "SELECT 'unknown_stop_type' AS rule, cast(row_id AS varchar) AS key FROM rec WHERE is_censored AND n_lines = 7", "rule key", "", "rec")
def _evproblems(spark, sf):
    return A.evidence_problems(S.records(spark, sf), _evidence(spark, sf))
