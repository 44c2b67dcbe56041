"""Joins and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from evenfold.checks.registry import query
from evenfold.operators import joins as J
from evenfold.operators import support as SU
from evenfold.plans import standins as S

c = F.col


@query("one_to_one_join", "SELECT a.row_id, a.pred - b.pred AS difference FROM pred a JOIN pred b USING (row_id) WHERE a.model = 'line' AND b.model = 'const'", "row_id", "difference", "pred")
def _one(spark, sf):
    p = S.predictions(spark, sf)
    a = p.where("model = 'line'").select("row_id", c("pred").alias("a"))
    b = p.where("model = 'const'").select("row_id", c("pred").alias("b"))
    return J.one_to_one(a, b, ["row_id"]).select("row_id", (c("a") - c("b")).alias("difference"))


@query("many_to_one_join", "SELECT model, n_name, count(*) AS n FROM pred JOIN nation ON group_id = 'G' || n_nationkey GROUP BY ALL", "model n_name n", "", "pred")
def _many(spark, sf):
    nation = S.table(spark, sf, "nation").select(F.concat(F.lit("G"), c("n_nationkey")).alias("group_id"), "n_name")
    return J.many_to_one(S.predictions(spark, sf), nation, ["group_id"]).groupBy("model", "n_name").agg(F.count(F.lit(1)).alias("n"))


@query("key_lookup", "SELECT row_id, CASE WHEN n_nationkey < 20 THEN n_name END AS name FROM rec JOIN nation ON group_id = 'G' || n_nationkey", "row_id name", "", "rec")
def _lookup(spark, sf):
    m = S.table(spark, sf, "nation").where("n_nationkey < 20").select(F.concat(F.lit("G"), c("n_nationkey")).alias("group_id"), "n_name")
    return J.lookup(S.records(spark, sf), m, "group_id", "n_name", "name").select("row_id", "name")


@query("left_join_zero_fill", "SELECT group_id, coalesce(n, 0) AS n FROM (SELECT DISTINCT group_id FROM rec) LEFT JOIN (SELECT group_id, count(*) AS n FROM rec WHERE n_lines >= 9 OR (n_lines = 8 AND temp_bin > '1998') GROUP BY ALL) USING (group_id)", "group_id n", "", "rec")
def _zero(spark, sf):
    rec = S.records(spark, sf)
    counts = rec.where("n_lines >= 9 OR (n_lines = 8 AND temp_bin > '1998')").groupBy("group_id").agg(F.count(F.lit(1)).alias("n"))
    return J.left_zero(rec.select("group_id").distinct(), counts, ["group_id"], ["n"])


@query("outer_join_gaps", """SELECT equiv_id, CASE WHEN max((temp_bin = '1996')::int) = 1 THEN 'left' ELSE 'right' END AS only_in FROM rec WHERE temp_bin IN ('1996', '1997') GROUP BY equiv_id HAVING count(DISTINCT temp_bin) = 1""", "equiv_id only_in", "", "rec")
def _gaps(spark, sf):
    rec = S.records(spark, sf)
    return J.unmatched(rec.where("temp_bin = '1996'"), rec.where("temp_bin = '1997'"), ["equiv_id"])


@query("semi_anti_filters", """SELECT 'semi' AS kind, row_id FROM rec WHERE equiv_id IN (SELECT equiv_id FROM rec WHERE n_lines > 7) UNION ALL
  SELECT 'anti', row_id FROM rec WHERE equiv_id NOT IN (SELECT equiv_id FROM rec WHERE n_lines > 5)""", "kind row_id", "", "rec")
def _semi(spark, sf):
    rec = S.records(spark, sf)
    semi = rec.join(rec.where("n_lines > 7").select("equiv_id"), "equiv_id", "left_semi").select(F.lit("semi").alias("kind"), "row_id")
    anti = rec.join(rec.where("n_lines > 5").select("equiv_id"), "equiv_id", "left_anti").select(F.lit("anti").alias("kind"), "row_id")
    return semi.unionByName(anti)


@query("parameter_combinations", """SELECT a.architecture, e.env_class, g AS gamma FROM (SELECT DISTINCT architecture FROM rec) a, (SELECT DISTINCT env_class FROM rec) e,
  (VALUES (0.75::double), (0.85::double), (0.95::double)) v(g)""", "architecture env_class", "gamma", "rec")
def _combos(spark, sf):
    levels = S.records(spark, sf).agg(F.collect_set("architecture").alias("a"), F.collect_set("env_class").alias("e"))
    grid = levels.select(F.explode("a").alias("architecture"), "e").select("architecture", F.explode("e").alias("env_class"))
    return grid.select("*", F.explode(F.array(*[F.lit(g) for g in (0.75, 0.85, 0.95)])).alias("gamma"))


NEAR_SQL = """SELECT row_id, fold, (SELECT min(abs(t.v - q.x_gross)) FROM (SELECT DISTINCT x_gross AS v, fold AS f FROM recf WHERE is_event) t WHERE t.f <> q.fold) AS distance FROM recf q"""


@query("nearest_value", NEAR_SQL, "row_id fold", "distance", "recf")
def _nearest(spark, sf):
    return _nearest_of(spark, sf, "x_gross")


def _nearest_of(spark, sf, value):
    f = S.folded(spark, sf).select("row_id", "fold", value, "is_event")
    folds = F.explode(F.filter(F.sequence(F.lit(1), F.lit(S.K)), lambda k: k != F.col("_own")))
    train = f.where("is_event").select(c("fold").alias("_own"), value).distinct().select(folds.alias("fold"), value)
    return J.nearest_distance(f, train, ["fold"], value).select("row_id", "fold", "distance")


@query("temperature_gate", """SELECT q.row_id, q.fold, count(t.v) > 0 AS supported FROM recf q LEFT JOIN (SELECT DISTINCT s_level AS v, fold AS f FROM recf WHERE is_event AND n_lines <> 4) t
  ON t.f <> q.fold AND abs(t.v - q.s_level) <= 1e-9 GROUP BY q.row_id, q.fold""", "row_id fold supported", "", "recf")
def _gate(spark, sf):
    f = S.folded(spark, sf)
    folds = F.explode(F.filter(F.sequence(F.lit(1), F.lit(S.K)), lambda k: k != F.col("_own")))
    train = f.where("is_event AND n_lines <> 4").select(c("fold").alias("_own"), "s_level").distinct().select(folds.alias("fold"), "s_level")
    return J.within_tolerance(f.select("row_id", "fold", "s_level"), train, ["fold"], "s_level", 1e-9).select("row_id", "fold", "supported")


@query("matched_conditions", """WITH ks AS (SELECT 'conditions' AS scope, concat_ws('|', architecture, temp_bin, n_lines) AS k, env_class AS l, 1 AS w FROM rec
   UNION ALL SELECT 'conditions_and_stress', concat_ws('|', architecture, temp_bin, n_lines, cast(s_level AS varchar)), env_class, 1 FROM rec
   UNION ALL SELECT 'group_conditions_and_stress', concat_ws('|', group_id, architecture, temp_bin, n_lines, cast(s_level AS varchar)), env_class, 1 FROM rec),
  cc AS (SELECT scope, k, l, count(*) AS n FROM ks GROUP BY ALL), lv AS (SELECT DISTINCT env_class AS l FROM rec), sp AS (SELECT DISTINCT scope FROM ks)
  SELECT sp.scope, a.l AS level_a, b.l AS level_b, coalesce(m, 0) AS matched_cells, coalesce(na, 0)::BIGINT AS rows_a, coalesce(nb, 0)::BIGINT AS rows_b
  FROM sp, lv a JOIN lv b ON a.l < b.l LEFT JOIN (SELECT x.scope, x.l AS la, y.l AS lb, count(*) AS m, sum(x.n) AS na, sum(y.n) AS nb FROM cc x JOIN cc y ON x.scope = y.scope AND x.k = y.k AND x.l < y.l GROUP BY ALL) j
   ON j.scope = sp.scope AND la = a.l AND lb = b.l""", "scope level_a level_b matched_cells rows_a rows_b", "", "rec")
def _matched(spark, sf):
    base = ["architecture", "temp_bin", "n_lines"]
    return J.matched_conditions(S.records(spark, sf), "env_class", {
        "conditions": base, "conditions_and_stress": [*base, "s_level"], "group_conditions_and_stress": ["group_id", *base, "s_level"]})


@query("scenario_join", """SELECT row_id, a.pred AS pred_new, b.pred AS pred_old FROM pred a JOIN pred b USING (row_id) WHERE a.model = 'segment' AND b.model = 'line'""", "row_id", "pred_new pred_old", "pred")
def _scenario(spark, sf):
    p = S.predictions(spark, sf)
    return J.side_by_side(p.where("model = 'segment'").select("row_id", "pred"), p.where("model = 'line'").select("row_id", "pred"),
                          ["row_id"], ["pred"], ("_new", "_old"))


# ------------------------------------------------------------------ set operations

@query("union_by_name", "SELECT row_id, y, NULL::varchar AS raw_source FROM rec WHERE is_event UNION ALL SELECT NULL, NULL, source_id::varchar FROM dup WHERE is_censored", "row_id raw_source", "y", "rec dup")
def _union(spark, sf):
    a = S.records(spark, sf).where("is_event").select("row_id", "y")
    b = S.raw_rows(spark, sf).where("is_censored").select(c("source_id").cast("string").alias("raw_source"))
    return a.unionByName(b, allowMissingColumns=True)


@query("distinct_projection", "SELECT DISTINCT group_id, architecture, env_class FROM rec", "group_id architecture env_class", "", "rec")
def _distinct(spark, sf):
    return S.records(spark, sf).select("group_id", "architecture", "env_class").distinct()


@query("key_intersection", "SELECT equiv_id FROM rec WHERE temp_bin = '1995' INTERSECT SELECT equiv_id FROM rec WHERE temp_bin = '1996'", "equiv_id", "", "rec")
def _intersect(spark, sf):
    rec = S.records(spark, sf)
    return rec.where("temp_bin = '1995'").select("equiv_id").intersect(rec.where("temp_bin = '1996'").select("equiv_id"))


@query("key_differences", """SELECT 'left' AS side, equiv_id FROM (SELECT equiv_id FROM rec WHERE temp_bin = '1995' EXCEPT ALL SELECT equiv_id FROM rec WHERE temp_bin = '1996')
  UNION ALL SELECT 'right', equiv_id FROM (SELECT equiv_id FROM rec WHERE temp_bin = '1996' EXCEPT ALL SELECT equiv_id FROM rec WHERE temp_bin = '1995')""", "side equiv_id", "", "rec")
def _differences(spark, sf):
    rec = S.records(spark, sf)
    a, b = (rec.where(f"temp_bin = '{t}'").select("equiv_id") for t in ("1995", "1996"))
    left = a.exceptAll(b).select(F.lit("left").alias("side"), "equiv_id")
    return left.unionByName(b.exceptAll(a).select(F.lit("right").alias("side"), "equiv_id"))


def _nearest_sql() -> str:
    from evenfold.checks.audit_checks import support_sql

    return support_sql()


SUP_NUM = ["temp_c", "r_ratio", "freq", "s_level"]


@query("nearest_point", f"SELECT row_id, fold, nearest_distance FROM ({_nearest_sql()})", "row_id fold", "nearest_distance", "recf")
def _nearest_point(spark, sf):
    return _support(spark, sf).select("row_id", "fold", "nearest_distance")


def _support(spark, sf):
    return SU.support_rows(S.folded(spark, sf), SUP_NUM, ["architecture", "env_class", "source_id"], ["architecture", "env_class", "temp_bin"])
