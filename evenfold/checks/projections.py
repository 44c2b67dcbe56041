"""Row-wise expressions: cleaning, features, location model, losses and intervals."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from evenfold.checks.registry import query
from evenfold.functions import damage as D
from evenfold.functions import families as L
from evenfold.functions import normal as N
from evenfold.functions import text as X
from evenfold.operators import features as FE
from evenfold.plans import standins as S
from evenfold.plans.variants import DRIVER_DEFAULTS, VARIANTS, with_variants

c = F.col

SIG = "(1/(1+exp(-greatest(least({0}, 40.0::double), -40.0::double))))"
INERT = "regexp_matches(lower(env_class), 'vacuum|inert|argon')"
WET = "regexp_matches(lower(env_class), 'water|steam')"
LOGS = "log10(greatest(s_level, 1e-8))"
LOGF = "log10(greatest(freq, 1e-8))"
WALK = f"({LOGS} + {{g}} * log10(greatest((1.0::double - r_ratio) / 2, 1e-6)))"
DRIVE = "(1000.0::double * (1.0::double/1073.15 - 1.0::double/(temp_c + 273.15)))"
EXPO = f"(CASE WHEN {INERT} THEN 0.0::double ELSE 1.0::double END)"


@query("parse_bool", """SELECT row_id, CASE WHEN t IN ('true','1','yes','y') THEN true WHEN t IN ('false','0','no','n') THEN false END AS flag
  FROM (SELECT l_orderkey * 8 + l_linenumber AS row_id, lower(trim(CASE l_returnflag WHEN 'N' THEN ' Yes' WHEN 'R' THEN 'FALSE ' ELSE l_returnflag END)) AS t FROM lineitem)""",
       "row_id flag")
def _parse_bool(spark, sf):
    li = S.table(spark, sf, "lineitem")
    raw = F.when(c("l_returnflag") == "N", " Yes").when(c("l_returnflag") == "R", "FALSE ").otherwise(c("l_returnflag"))
    return li.select((c("l_orderkey") * 8 + c("l_linenumber")).alias("row_id"), X.parse_bool(raw).alias("flag"))


@query("text_normalise", """SELECT event_id, lower(trim(coalesce(CASE WHEN event_type = 'error' THEN NULL ELSE '  ' || upper(event_type) || ' ' END, 'unknown'))) AS label
  FROM events""", "event_id label")
def _text(spark, sf):
    raw = F.when(c("event_type") != "error", F.concat(F.lit("  "), F.upper("event_type"), F.lit(" ")))
    return S.table(spark, sf, "events").select("event_id", X.label(raw).alias("label"))


@query("numeric_coerce", """SELECT event_id, TRY_CAST(CASE WHEN event_type = 'view' THEN 'n/a' ELSE cast(value AS varchar) END AS double) AS number FROM events""",
       "event_id", "number")
def _number(spark, sf):
    raw = F.when(c("event_type") == "view", "n/a").otherwise(c("value").cast("string"))
    return S.table(spark, sf, "events").select("event_id", X.number(raw).alias("number"))


@query("loading_features", f"""SELECT row_id, log10(greatest(life, 1.0)) AS y, {LOGS} AS log_s, {LOGF} AS log_f, log10(greatest(uts, 1e-8)) AS log_uts,
  (temp_c - 25.0::double)/1000 AS temp_n, sqrt(0.5::double*s_level*greatest(least(1.0::double - r_ratio, 2.0::double), 0.0::double)) AS s_amp,
  sqrt(0.5::double*s_level*(1.0::double + r_ratio)) AS s_mean FROM rec""", "row_id", "y log_s log_f log_uts temp_n s_amp s_mean", "rec")
def _features(spark, sf):
    f = FE.with_features(S.records(spark, sf))
    return f.select("row_id", "y", "log_s", "log_f", "log_uts", "temp_n", F.sqrt("s_amp").alias("s_amp"), F.sqrt("s_mean").alias("s_mean"))


@query("environment_class", f"""SELECT row_id, CASE WHEN {INERT} THEN 'inert' WHEN {WET} THEN 'wet' ELSE 'other' END AS kind,
  CASE WHEN {INERT} THEN 0.0::double WHEN {WET} THEN 1.5::double ELSE 1.0::double END AS exposure FROM rec""", "row_id kind", "exposure", "rec")
def _env(spark, sf):
    env = c("env_class")
    return S.records(spark, sf).select("row_id", X.env_kind(env).alias("kind"), X.exposure(env, 1.5).alias("exposure"))


@query("thermal_drive", f"SELECT row_id, CASE WHEN temp_c + 273.15::double > 0 THEN {DRIVE} END AS drive FROM rec", "row_id", "drive", "rec")
def _drive(spark, sf):
    return S.records(spark, sf).select("row_id", D.thermal_drive(c("temp_c")).alias("drive"))


def _variant_values() -> str:
    def lit(v):
        return "NULL" if v is None else str(v).lower() if isinstance(v, bool) else f"{float(v)!r}::double"
    rows = []
    for v in VARIANTS:
        d = DRIVER_DEFAULTS | v.drivers
        rows.append("(" + ", ".join([f"'{v.name}'", *[lit(d[k]) for k in DRIVER_DEFAULTS]]) + ")")
    return f"(VALUES {', '.join(rows)}) v(variant, {', '.join(DRIVER_DEFAULTS)})"


@query("driver_variants", f"""SELECT row_id, variant,
  CASE WHEN NOT environment_on THEN 0.0::double WHEN {INERT} THEN inert_factor WHEN {WET} THEN coalesce(wet_factor, 1.0::double) ELSE air_factor END AS exposure,
  CASE WHEN temperature_on THEN {DRIVE} ELSE 0.0::double END AS drive, freq_power * {LOGF} AS freq_drive,
  CASE WHEN stress_on THEN 1.0::double ELSE 0.0::double END AS stress_on, wet_factor IS NULL AND environment_on AS fit_wet, wet_log_cap
  FROM rec, {_variant_values()}""", "row_id variant fit_wet", "exposure drive freq_drive stress_on wet_log_cap", "rec")
def _variants(spark, sf):
    v = with_variants(FE.with_features(S.records(spark, sf)))
    return v.select("row_id", "variant", "fit_wet", "exposure", "drive", "freq_drive",
                    c("stress_on"), "wet_log_cap")


@query("clipped_sigmoid", f"SELECT row_id, {SIG.format('((temp_c-800.0::double)/200*30)')} AS s FROM rec", "row_id", "s", "rec")
def _sigmoid(spark, sf):
    return S.records(spark, sf).select("row_id", D.sigmoid((c("temp_c") - 800.0) / 200.0 * 30).alias("s"))


@query("damage_proxies", f"""SELECT row_id, ox AS oxidation, st AS d_m, greatest(least(st*(0.6::double+0.4::double*ox), 1.0), 0.0) AS d_i, greatest(least(st*st, 1.0), 0.0) AS d_f,
  (st + greatest(least(st*(0.6::double+0.4::double*ox), 1.0), 0.0) + greatest(least(st*st, 1.0), 0.0))/3 AS m_mean,
  (st + greatest(least(st*(0.6::double+0.4::double*ox), 1.0), 0.0) + greatest(least(st*st, 1.0), 0.0) + ox)/4 AS q_mean FROM (
  SELECT row_id, greatest(least(s_level, 1.0::double), 0.0::double) AS st, greatest(least(greatest(CASE WHEN {INERT} THEN 0.0::double ELSE th*(0.5::double+0.5::double*sl) END,
    CASE WHEN {WET} THEN th ELSE 0.0::double END), 1.0::double), 0.0::double) AS ox FROM (
    SELECT *, {SIG.format('((temp_c-800.0::double)/200)')} AS th, {SIG.format('(-' + LOGF + ')')} AS sl FROM rec))""",
       "row_id", "oxidation d_m d_i d_f m_mean q_mean", "rec")
def _proxies(spark, sf):
    f = FE.with_features(S.records(spark, sf))
    return f.select("row_id", "oxidation", "d_m", "d_i", "d_f", "m_mean", "q_mean")


@query("series_key", """SELECT row_id, concat_ws('|', source_id, architecture, env_class, cast(cast(temp_c AS bigint) AS varchar), cast(n_lines AS varchar)) AS series_key
  FROM rec""", "row_id series_key", "", "rec")
def _series(spark, sf):
    return S.records(spark, sf).select("row_id", X.series_key(
        c("source_id"), c("architecture"), c("env_class"), X.shortest_number(c("temp_c")),
        X.shortest_number(c("n_lines"))).alias("series_key"))


@query("qa_flags", """SELECT row_id, is_event AND abs(n_lines - 4) <= 1e-8 + 1e-5*4 AND NOT regexp_matches(lower(architecture), '~|未断|runout|>') AS round_event,
  s_level > 1 AS above_strength FROM rec""", "row_id round_event above_strength", "", "rec")
def _qa(spark, sf):
    return S.records(spark, sf).select(
        "row_id", *FE.qa_flags(c("n_lines"), c("is_event"), c("architecture"), c("s_level"), (4.0,)))


@query("boundary_rebin", """SELECT row_id, CASE WHEN temp_c = 825 AND b IN ('500-800','800-1000') THEN '800-1000' ELSE b END AS temp_bin FROM (
  SELECT row_id, temp_c, CASE WHEN temp_c < 500 THEN '0-500' WHEN temp_c <= 825 THEN '500-800' ELSE '800-1000' END AS b FROM rec)""",
       "row_id temp_bin", "", "rec")
def _rebin(spark, sf):
    b = F.when(c("temp_c") < 500, "0-500").when(c("temp_c") <= 825, "500-800").otherwise("800-1000")
    return S.records(spark, sf).select(
        "row_id", X.upper_bin_at(c("temp_c"), b, 825.0, ("500-800", "800-1000")).alias("temp_bin"))


@query("walker_stress", f"SELECT row_id, g AS gamma, {WALK.format(g='g')} AS x FROM rec, (VALUES (0.75::double), (0.85::double), (0.95::double)) v(g)",
       "row_id", "gamma x", "rec")
def _walker(spark, sf):
    gammas = F.explode(F.array(*[F.lit(g) for g in (0.75, 0.85, 0.95)])).alias("gamma")
    f = FE.with_features(S.records(spark, sf)).select("row_id", "log_s", "r_ratio", gammas)
    return f.select("row_id", "gamma", D.walker(c("log_s"), c("r_ratio"), c("gamma")).alias("x"))


COEF = {"a": 5.0, "b": 0.8, "k": -1.0, "m": 1.5, "q": 2.0, "beta": 0.4}
RATIO = (f"(-1.0::double + log10({EXPO}) + (CASE WHEN {WET} THEN 0.4::double ELSE 0.0::double END) + 2.0::double*{DRIVE}/ln(10.0::double)"
         f" + 1.5::double*{WALK.format(g='0.85::double')} - {LOGF})")
DECR = f"(CASE WHEN {EXPO} > 0 THEN (CASE WHEN {RATIO} > 0 THEN {RATIO} + log10(1+pow(10.0::double, -{RATIO})) ELSE log10(1+pow(10.0::double, {RATIO})) END) ELSE 0.0::double END)"


def _location_frame(spark, sf):
    f = FE.with_features(S.records(spark, sf))
    f = f.withColumn("x", D.walker(c("log_s"), c("r_ratio"), 0.85)).withColumn("exposure", X.exposure(c("env_class")))
    shift = D.class_shift(X.is_wet(c("env_class")), F.lit(True), COEF["beta"])
    ratio = D.damage_ratio(COEF["k"], COEF["m"], COEF["q"], c("x"), c("exposure"), D.thermal_drive(c("temp_c")), c("log_f"), shift)
    return f.withColumn("wet_shift", shift).withColumn("ratio", ratio)


@query("linear_predictor", f"SELECT row_id, 5.0::double - 0.8::double*{WALK.format(g='0.85::double')} - 0.1::double*q_in AS pred FROM (SELECT *, r_ratio AS q_in FROM rec)",
       "row_id", "pred", "rec")
def _linear(spark, sf):
    f = _location_frame(spark, sf)
    return f.select("row_id", D.linear_location([F.lit(5.0), F.lit(0.8), F.lit(0.1)], [c("x"), c("r_ratio")]).alias("pred"))


@query("environment_decrement", f"SELECT row_id, {DECR} AS decrement FROM rec", "row_id", "decrement", "rec")
def _decrement(spark, sf):
    return _location_frame(spark, sf).select("row_id", D.decrement(c("ratio")).alias("decrement"))


@query("competing_predictor", f"SELECT row_id, 5.0::double - 0.8::double*{WALK.format(g='0.85::double')} - {DECR} AS pred FROM rec", "row_id", "pred", "rec")
def _competing(spark, sf):
    f = _location_frame(spark, sf)
    return f.select("row_id", D.competing_location(COEF["a"], COEF["b"], c("x"), c("ratio")).alias("pred"))


@query("class_shift", f"SELECT row_id, CASE WHEN {WET} AND is_event THEN 0.4::double ELSE 0.0::double END AS shift FROM rec", "row_id", "shift", "rec")
def _shift(spark, sf):
    return S.records(spark, sf).select(
        "row_id", D.class_shift(X.is_wet(c("env_class")), c("is_event"), 0.4).alias("shift"))


@query("parameter_columns", """SELECT fold, intercept, slope AS walker_slope, -intercept AS mechanical_scale,
  CASE WHEN slope <= 300 THEN pow(10.0::double, slope) END AS multiplier FROM ln""", "fold", "intercept walker_slope mechanical_scale multiplier", "pred")
def _parameters(spark, sf):
    from evenfold.operators.fit.closed_form import complement_line

    line = complement_line(S.folded(spark, sf).where("is_event"), "fold", "x_gross", "y")
    return line.select("fold", "intercept", c("slope").alias("walker_slope"), (-c("intercept")).alias("mechanical_scale"),
                       D.multiplier(c("slope")).alias("multiplier"))


@query("log_survival", f"SELECT row_id, {N.log_sf_sql('((y-5.0::double)*12)')} AS log_sf FROM rec", "row_id", "log_sf", "rec")
def _log_sf(spark, sf):
    return S.records(spark, sf).select("row_id", N.log_sf((c("y") - 5.0) * 12).alias("log_sf"))


_Q = {f: {p: L.FAMILIES[f].quantile(p) for p in (0.05, 0.5, 0.95)} for f in ("normal", "weibull", "weibull_median", "loglogistic")}


@query("standard_quantiles", "SELECT row_id, model, v.family, p, pred + scale * z AS q FROM pred, (VALUES "
       + ", ".join(f"('{f}', {p}::double, {z!r}::double)" for f, ps in _Q.items() for p, z in ps.items()) + ") v(family, p, z)",
       "row_id model family", "p q", "pred")
def _quantiles(spark, sf):
    rows = S.predictions(spark, sf).select("row_id", "model", "pred", "scale")
    q = F.array(*[F.struct(F.lit(f).alias("family"), F.lit(p).alias("p"), L.quantile(f, c("pred"), c("scale"), p).alias("q"))
                  for f, ps in _Q.items() for p in ps])
    return rows.select("row_id", "model", F.explode(q).alias("_q")).select("row_id", "model", "_q.*")


Z = "((y-pred)/scale)"
SP = "(greatest({0},0)+ln(1+exp(-abs({0}))))"
LOSS_SQL = {
    "normal": f"CASE WHEN is_event THEN {N.HALF_LOG_2PI!r}::double+ln(scale)+0.5::double*{Z}*{Z} ELSE -{N.log_sf_sql(Z)} END",
    "weibull": f"CASE WHEN is_event THEN ln(scale)-{Z}+exp({Z}) ELSE exp({Z}) END",
    "weibull_median": f"CASE WHEN is_event THEN ln(scale)-ln(ln(2.0::double))-{Z}+ln(2.0::double)*exp({Z}) ELSE ln(2.0::double)*exp({Z}) END",
    "loglogistic": f"CASE WHEN is_event THEN ln(scale)+{SP.format(Z)}+{SP.format('(-' + Z + ')')} ELSE {SP.format(Z)} END",
}


@query("row_losses", "SELECT row_id, model, " + ", ".join(f"{s} AS {f}" for f, s in LOSS_SQL.items()) + " FROM pred",
       "row_id model", "normal weibull weibull_median loglogistic", "pred")
def _losses(spark, sf):
    p = S.predictions(spark, sf)
    return p.select("row_id", "model", *[
        L.row_loss(f, c("y"), c("pred"), c("scale"), c("is_event")).alias(f) for f in LOSS_SQL])


@query("back_transform", """SELECT row_id, model, log10(pow(10.0::double, greatest(least(pred*40, 300.0::double), -300.0::double))) AS log_life, abs(pred*40) > 300 AS clipped FROM pred""",
       "row_id model clipped", "log_life", "pred")
def _back(spark, sf):
    p = S.predictions(spark, sf)
    return p.select("row_id", "model", F.log10(D.power_of_ten(c("pred") * 40)).alias("log_life"), (F.abs(c("pred") * 40) > 300).alias("clipped"))


@query("support_weight", """SELECT row_id, exp(-pow(abs(temp_c-600.0::double)/250, 2)) AS w FROM rec""", "row_id", "w", "rec")
def _support(spark, sf):
    return S.records(spark, sf).select("row_id", D.support_weight(F.abs(c("temp_c") - 600.0)).alias("w"))


@query("gated_blend", """SELECT row_id, model, pred + 0.75::double*exp(-pow(abs(temp_c-600.0::double)/250, 2))*(x_gross-pred) AS blend FROM pred""",
       "row_id model", "blend", "pred")
def _blend(spark, sf):
    p = S.predictions(spark, sf)
    return p.select("row_id", "model", D.gated_blend(
        c("pred"), c("x_gross") - c("pred"), D.support_weight(F.abs(c("temp_c") - 600.0)), 0.75).alias("blend"))


@query("interval_columns", """SELECT row_id, model, pred-h AS lower, pred+h AS upper, y >= pred-h AND y <= pred+h AS covered,
  2*h + 20*greatest(pred-h-y, 0) + 20*greatest(y-pred-h, 0) AS score FROM (SELECT *, 1.5::double*scale AS h FROM pred)""",
       "row_id model covered", "lower upper score", "pred")
def _interval(spark, sf):
    p = S.predictions(spark, sf)
    low, high = L.interval(c("pred"), 1.5 * c("scale"))
    return p.select("row_id", "model", low.alias("lower"), high.alias("upper"), L.covered(c("y"), low, high).alias("covered"),
                    L.interval_score(c("y"), low, high, 0.9).alias("score"))


@query("open_ended_bins", "SELECT row_id, CASE WHEN n_lines-2 <= 0 THEN '0' WHEN n_lines-2 <= 1 THEN '1' WHEN n_lines-2 <= 3 THEN '2-3' ELSE '4+' END AS bin FROM rec",
       "row_id bin", "", "rec")
def _bins(spark, sf):
    return S.records(spark, sf).select("row_id", X.open_ended_bins(c("n_lines") - 2).alias("bin"))


@query("design_scaling", f"""SELECT r.row_id, r.fold, (r.s_level-m1)/s1 AS z_s_level, (r.x_gross-m2)/s2 AS z_x_gross,
  CASE WHEN env_class = 'air' THEN 1.0::double ELSE 0.0::double END AS env_air, CASE WHEN env_class = 'vacuum' THEN 1.0::double ELSE 0.0::double END AS env_vacuum
  FROM recf r JOIN (SELECT k.fold, avg(s_level) AS m1, stddev_pop(s_level) AS s1, avg(x_gross) AS m2, stddev_pop(x_gross) AS s2
    FROM recf JOIN (SELECT DISTINCT fold FROM recf) k ON recf.fold <> k.fold WHERE is_event GROUP BY k.fold) t USING (fold)""",
       "row_id fold", "z_s_level z_x_gross env_air env_vacuum", "recf")
def _scaling(spark, sf):
    from evenfold.operators.fit.design import Design

    d = Design(numeric=("s_level", "x_gross"), categorical={"env_class": ("air", "vacuum")})
    out = d.apply(S.folded(spark, sf), d.scales(S.folded(spark, sf).where("is_event"), "fold"), "fold")
    return out.select("row_id", "fold", "z_s_level", "z_x_gross", c("env_class_air").alias("env_air"),
                      c("env_class_vacuum").alias("env_vacuum"))


@query("trunk_features", f"""SELECT row_id, {WALK.format(g='0.85::double')} AS walker_stress, 5.0::double - 0.8::double*{WALK.format(g='0.85::double')} AS mechanical_prediction FROM rec""",
       "row_id", "walker_stress mechanical_prediction", "rec")
def _trunk_features(spark, sf):
    f = FE.with_features(S.records(spark, sf))
    return FE.trunk_features(f, 5.0, 0.8, 0.85).select("row_id", "walker_stress", "mechanical_prediction")


@query("prospective_frame", f"""SELECT specimen_id, s_ratio, {LOGF} AS log_f, {EXPO} AS exposure, {DRIVE} AS drive, env_class IN ('air_or_oxygen','water_oxygen','vacuum') AS env_allowed
  FROM (SELECT *, 'S' || row_id AS specimen_id, sigma_max/uts AS s_ratio FROM rec)""", "specimen_id env_allowed", "s_ratio log_f exposure drive", "rec")
def _prospective(spark, sf):
    from evenfold.plans.frozen import condition_frame

    raw = S.records(spark, sf).withColumn("specimen_id", F.concat(F.lit("S"), c("row_id")))
    return condition_frame(raw).select("specimen_id", "s_ratio", "log_f", "exposure", "drive", "env_allowed")


@query("audit_enrichment", """SELECT r.row_id, coalesce(n, 1) AS cluster_size, coalesce(s, 1) AS cluster_sources, coalesce(s, 1) > 1 AS cross_source, coalesce(f, false) AS label_conflict,
  CASE WHEN r.status <> '' THEN 'audited_' || r.status ELSE 'not_audited' END AS mapping_status,
  contains(lower(r.role), 'secondary') AS secondary, r.role <> '' AND r.status <> '' AS audit_complete
  FROM (SELECT row_id, cast(row_id AS varchar) || '-1' AS equiv_id, CASE WHEN n_lines > 4 THEN 'Secondary' WHEN n_lines > 2 THEN 'primary' ELSE '' END AS role,
     CASE WHEN is_event THEN 'ok' ELSE '' END AS status FROM rec) r
  LEFT JOIN (SELECT equiv_id, count(*) AS n, count(DISTINCT source_id) AS s, count(DISTINCT is_censored) > 1 AS f FROM dup GROUP BY equiv_id) d USING (equiv_id)""",
       "row_id cluster_size cluster_sources cross_source label_conflict mapping_status secondary audit_complete", "", "rec dup")
def _enrich(spark, sf):
    from evenfold.operators.audits import cluster_stats, enrich

    rec = S.records(spark, sf).select(
        "row_id", F.concat(c("row_id").cast("string"), F.lit("-1")).alias("equiv_id"),
        F.when(c("n_lines") > 4, "Secondary").when(c("n_lines") > 2, "primary").otherwise("").alias("record_role"),
        F.when(c("is_event"), "ok").alias("audit_status"))
    return enrich(rec, cluster_stats(S.raw_rows(spark, sf)), audit_fields=("record_role", "audit_status")).select(
        "row_id", "cluster_size", "cluster_sources", "cross_source", "label_conflict", "mapping_status", "secondary", "audit_complete")
