"""The driver's tables seen as records, raw duplicates and predictions.

One record per order: the order total is the outcome, orders still in process are censored,
the customer's nation is the group and the customer the equivalence.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evenfold.functions import families
from evenfold.operators import folds as fold_ops
from evenfold.operators.fit.closed_form import complement_line, complement_means, complement_spread
from evenfold.session import settle, spread, still_there, together

# Base seed, used as a hash salt, and the number of outer folds.
SEED = 20260824
K = 5
MODELS = ("const", "line", "segment")
PROPOSED = "line"

ENV_OF_SEGMENT = {
    "AUTOMOBILE": "air", "BUILDING": "air_or_oxygen", "FURNITURE": "vacuum",
    "HOUSEHOLD": "steam", "MACHINERY": "water_oxygen",
}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def records(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(
        F.count(F.lit(1)).alias("n_lines"), F.sum("l_quantity").alias("qty"),
        F.sum("l_extendedprice").alias("gross"), F.avg("l_discount").alias("disc"))
    env: Column = F.lit("unknown")
    for segment, name in ENV_OF_SEGMENT.items():
        env = F.when(F.col("c_mktsegment") == segment, name).otherwise(env)
    orders = table(spark, sf, "orders").join(
        table(spark, sf, "customer").select("c_custkey", "c_nationkey", "c_mktsegment"),
        F.col("o_custkey") == F.col("c_custkey"))
    r = orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
    year = F.year("o_orderdate")
    return r.select(
        F.col("o_orderkey").alias("row_id"),
        F.concat(F.lit("G"), F.col("c_nationkey")).alias("group_id"),
        F.concat(F.lit("G"), F.col("c_nationkey"), F.lit("-"), F.col("c_mktsegment")).alias("source_id"),
        F.concat(F.lit("C"), F.col("o_custkey")).alias("equiv_id"),
        F.lower(F.trim("o_orderpriority")).alias("architecture"),
        env.alias("env_class"),
        year.cast("string").alias("temp_bin"),
        ((year - 1992) * 200 + 25).cast("double").alias("temp_c"),
        F.col("o_totalprice").alias("life"),
        F.log10("o_totalprice").alias("y"),
        (F.col("o_orderstatus") == "P").alias("is_censored"),
        (F.col("o_orderstatus") != "P").alias("is_event"),
        F.log10("gross").alias("x_gross"),
        (F.col("qty") / 50.0).alias("s_level"),
        F.col("disc").alias("r_ratio"),
        F.col("n_lines").cast("double").alias("freq"),
        (F.col("gross") / F.col("qty")).alias("sigma_max"),
        (F.col("gross") / F.col("qty") / (F.col("qty") / 50.0)).alias("uts"),
        "n_lines",
    )


def raw_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Raw rows with physical duplicates: several lines share one (order, line number)."""
    c = F.col
    return table(spark, sf, "lineitem").select(
        F.md5(F.concat_ws(
            "|", c("l_orderkey").cast("string"), c("l_linenumber").cast("string"), c("l_partkey").cast("string"),
            c("l_suppkey").cast("string"), c("l_quantity").cast("long").cast("string"),
            F.date_format("l_shipdate", "yyyy-MM-dd HH:mm:ss"))).alias("row_id"),
        F.concat_ws("-", c("l_orderkey").cast("string"), c("l_linenumber").cast("string")).alias("equiv_id"),
        c("l_suppkey").alias("source_id"),
        (c("l_returnflag") == "N").alias("is_censored"),
        c("l_extendedprice").alias("nf"),
    )


def fold_map(rec: DataFrame) -> DataFrame:
    return fold_ops.greedy_group_folds(rec, K, SEED)


_SETTLED: dict[tuple[str, str, str], DataFrame] = {}


def _once(spark: SparkSession, sf: str, what: str, build) -> DataFrame:
    """Fact tables are written once per application and data folder, then read by every query."""
    key = (spark.sparkContext.applicationId, sf, what)
    if key not in _SETTLED or not still_there(_SETTLED[key]):
        _SETTLED[key] = spread(build(), what)
    return _SETTLED[key]


def folded(spark: SparkSession, sf: str) -> DataFrame:
    """Records with their outer fold, those of one equivalence next to each other; the records are joined and written once."""
    key = (spark.sparkContext.applicationId, sf, "folded")
    if key not in _SETTLED or not still_there(_SETTLED[key]):
        rec = together(records(spark, sf), ["equiv_id"], "records")
        _SETTLED[key] = fold_ops.with_folds(rec, settle(fold_map(rec), "folds"))
    return _SETTLED[key]


def predictions(spark: SparkSession, sf: str) -> DataFrame:
    """Out-of-fold predictions of three closed-form models, in long form."""
    def build() -> DataFrame:
        rec = folded(spark, sf)
        events = rec.where("is_event")
        line = settle(complement_line(events, "fold", "x_gross", "y"), "line")
        segment = settle(complement_means(events, "fold", ["env_class"], "y", "s_mean"), "segment")
        wide = rec.join(line.withColumnRenamed("mean", "c_mean"), "fold").join(segment, ["fold", "env_class"], "left")
        members = F.array(
            F.struct(F.lit("const").alias("model"), F.col("c_mean").alias("pred"), F.lit("normal").alias("family")),
            F.struct(F.lit("line").alias("model"), (F.col("intercept") + F.col("slope") * F.col("x_gross")).alias("pred"),
                     F.lit("normal").alias("family")),
            F.struct(F.lit("segment").alias("model"), F.coalesce("s_mean", "c_mean").alias("pred"),
                     F.lit("weibull").alias("family")))
        long = wide.select(*rec.columns, F.explode(members).alias("_m")).select(*rec.columns, "_m.*")
        residual = long.where("is_event").withColumn("_r", F.col("y") - F.col("pred"))
        scale = settle(complement_spread(residual, ["model"], "fold", "_r", "scale"), "scale")
        return long.join(scale, ["model", "fold"]).withColumn("scenario", F.lit("Primary")).withColumn("holdout", F.lit(""))
    return _once(spark, sf, "predictions", build)


def scored(spark: SparkSession, sf: str) -> DataFrame:
    """Predictions with row loss and central 80 % and 90 % intervals."""
    p = predictions(spark, sf)
    args = (F.col("family"), F.col("pred"), F.col("scale"))
    cols = {"row_nll": families.row_loss_by_name(F.col("family"), F.col("y"), F.col("pred"), F.col("scale"), F.col("is_event"))}
    for tag, tail in (("80", 0.1), ("90", 0.05)):
        cols[f"lower{tag}"] = families.quantile_by_name(*args, tail)
        cols[f"upper{tag}"] = families.quantile_by_name(*args, 1.0 - tail)
    return p.withColumns(cols)


def factor_predictions(spark: SparkSession, sf: str) -> DataFrame:
    """Leave-one-level-out predictions of the constant and the line model for two factors."""
    def build() -> DataFrame:
        rec = folded(spark, sf).drop("fold")
        factors = {"LOEO": "env_class", "LOTO": "temp_bin"}
        keep = ["row_id", "group_id", "source_id", "equiv_id", "y", "is_event", "is_censored", "x_gross"]
        long = fold_ops.long_factors(rec, factors, keep).withColumnRenamed("level", "holdout").drop("factor")
        events = long.where("is_event")
        line = settle(complement_line(events, "holdout", "x_gross", "y", ["scenario"]), "fline")
        wide = long.join(line.withColumnRenamed("mean", "c_mean"), ["scenario", "holdout"])
        members = F.array(
            F.struct(F.lit("const").alias("model"), F.col("c_mean").alias("pred")),
            F.struct(F.lit("line").alias("model"), (F.col("intercept") + F.col("slope") * F.col("x_gross")).alias("pred")))
        out = wide.select(*[c for c in keep if c != "x_gross"], "scenario", "holdout", F.explode(members).alias("_m"))
        out = out.select(*[c for c in out.columns if c != "_m"], "_m.*")
        residual = out.where("is_event").withColumn("_r", F.col("y") - F.col("pred"))
        scale = settle(complement_spread(residual, ["scenario", "model"], "holdout", "_r", "scale"), "fscale")
        return out.join(scale, ["scenario", "model", "holdout"]).withColumn("family", F.lit("normal")).withColumn(
            "fold", F.lit(0))
    return _once(spark, sf, "factor_predictions", build)


# ------------------------------------------------------------------ the same views as SQL

REC_SQL = """
l AS (SELECT l_orderkey, count(*) AS n_lines, sum(l_quantity) AS qty, sum(l_extendedprice) AS gross, avg(l_discount) AS disc
      FROM lineitem GROUP BY l_orderkey),
rec AS (SELECT o_orderkey AS row_id, 'G' || c_nationkey AS group_id, 'G' || c_nationkey || '-' || c_mktsegment AS source_id,
  'C' || o_custkey AS equiv_id, lower(trim(o_orderpriority)) AS architecture,
  CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'air' WHEN 'BUILDING' THEN 'air_or_oxygen' WHEN 'FURNITURE' THEN 'vacuum'
    WHEN 'HOUSEHOLD' THEN 'steam' WHEN 'MACHINERY' THEN 'water_oxygen' ELSE 'unknown' END AS env_class,
  cast(year(o_orderdate) AS varchar) AS temp_bin, cast((year(o_orderdate) - 1992) * 200 + 25 AS double) AS temp_c,
  o_totalprice AS life, log10(o_totalprice) AS y, o_orderstatus = 'P' AS is_censored, o_orderstatus <> 'P' AS is_event,
  log10(gross) AS x_gross, qty / 50.0::double AS s_level, disc AS r_ratio, cast(n_lines AS double) AS freq,
  gross / qty AS sigma_max, gross / qty / (qty / 50.0::double) AS uts, n_lines
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN l ON l_orderkey = o_orderkey)"""

DUP_SQL = """
dup AS (SELECT md5(concat_ws('|', cast(l_orderkey AS varchar), cast(l_linenumber AS varchar), cast(l_partkey AS varchar),
  cast(l_suppkey AS varchar), cast(cast(l_quantity AS bigint) AS varchar), strftime(l_shipdate, '%Y-%m-%d %H:%M:%S'))) AS row_id,
  concat_ws('-', cast(l_orderkey AS varchar), cast(l_linenumber AS varchar)) AS equiv_id, l_suppkey AS source_id,
  l_returnflag = 'N' AS is_censored, l_extendedprice AS nf FROM lineitem)"""


def greedy_sql(name: str, source: str, group: str, k: int, seed: int) -> str:
    """The greedy rule as a recursive query: one step per group."""
    zeros = "[" + ", ".join(["0"] * k) + "]::BIGINT[]"
    return f"""
{name}_ord AS (SELECT {group}, n, row_number() OVER (ORDER BY n DESC, h, {group}) AS i
  FROM (SELECT {group}, count(*) AS n, md5('{seed}|' || {group}) AS h FROM {source} GROUP BY {group})),
{name}_run(i, loads, fold) AS (
  SELECT 0::BIGINT, {zeros}, 0::BIGINT
  UNION ALL
  SELECT o.i, list_transform(r.loads, lambda x, j: CASE WHEN j = list_position(r.loads, list_min(r.loads)) THEN x + o.n ELSE x END),
    list_position(r.loads, list_min(r.loads))::BIGINT
  FROM {name}_run r JOIN {name}_ord o ON o.i = r.i + 1),
{name} AS (SELECT o.{group}, o.n AS n_rows, cast(r.fold AS integer) AS fold FROM {name}_ord o JOIN {name}_run r ON o.i = r.i)"""


FOLD_SQL = greedy_sql("folds", "rec", "group_id", K, SEED)
FOLDED_SQL = "recf AS (SELECT rec.*, fold FROM rec JOIN folds USING (group_id))"
PRED_SQL = """
ev AS (SELECT * FROM recf WHERE is_event),
fs AS (SELECT fold, count(*)::double AS n, sum(x_gross) AS sx, sum(y) AS sy, sum(x_gross*x_gross) AS sxx, sum(x_gross*y) AS sxy FROM ev GROUP BY fold),
ts AS (SELECT sum(n) AS n, sum(sx) AS sx, sum(sy) AS sy, sum(sxx) AS sxx, sum(sxy) AS sxy FROM fs),
cs AS (SELECT f.fold, t.n-f.n AS n, t.sx-f.sx AS sx, t.sy-f.sy AS sy, t.sxx-f.sxx AS sxx, t.sxy-f.sxy AS sxy FROM fs f, ts t),
ln AS (SELECT fold, sy/n AS c_mean, (n*sxy-sx*sy)/(n*sxx-sx*sx) AS slope, (sy-(n*sxy-sx*sy)/(n*sxx-sx*sx)*sx)/n AS intercept FROM cs),
es AS (SELECT fold, env_class, count(*)::double AS n, sum(y) AS sy FROM ev GROUP BY ALL),
et AS (SELECT env_class, sum(n) AS n, sum(sy) AS sy FROM es GROUP BY ALL),
sg AS (SELECT f.fold, e.env_class, CASE WHEN e.n - coalesce(x.n, 0) > 0 THEN (e.sy - coalesce(x.sy, 0)) / (e.n - coalesce(x.n, 0)) END AS s_mean
  FROM et e CROSS JOIN (SELECT DISTINCT fold FROM ev) f LEFT JOIN es x ON x.fold = f.fold AND x.env_class = e.env_class),
p0 AS (SELECT recf.*, 'const' AS model, c_mean AS pred, 'normal' AS family FROM recf JOIN ln USING (fold)
  UNION ALL SELECT recf.*, 'line', intercept + slope * x_gross, 'normal' FROM recf JOIN ln USING (fold)
  UNION ALL SELECT recf.*, 'segment', coalesce(s_mean, c_mean), 'weibull' FROM recf JOIN ln USING (fold) LEFT JOIN sg USING (fold, env_class)),
rs AS (SELECT model, fold, count(*)::double AS n, sum(y-pred) AS s1, sum((y-pred)*(y-pred)) AS s2 FROM p0 WHERE is_event GROUP BY ALL),
rt AS (SELECT model, sum(n) AS n, sum(s1) AS s1, sum(s2) AS s2 FROM rs GROUP BY ALL),
sc AS (SELECT model, rs.fold, sqrt((rt.s2-rs.s2)/(rt.n-rs.n) - ((rt.s1-rs.s1)/(rt.n-rs.n))*((rt.s1-rs.s1)/(rt.n-rs.n))) AS scale FROM rs JOIN rt USING (model)),
pred AS (SELECT p0.*, scale, 'Primary' AS scenario, '' AS holdout FROM p0 JOIN sc USING (model, fold))"""


def scored_sql() -> str:
    from evenfold.functions.families import FAMILIES
    from evenfold.functions.normal import HALF_LOG_2PI, log_sf_sql

    z = "((y-pred)/scale)"
    q = lambda p: (f"pred + scale * (CASE WHEN family = 'weibull' THEN {FAMILIES['weibull'].quantile(p)!r}::double "
                   f"ELSE {FAMILIES['normal'].quantile(p)!r}::double END)")
    return f"""
sco AS (SELECT *, CASE WHEN family = 'weibull' THEN (CASE WHEN is_event THEN ln(scale) - {z} + exp({z}) ELSE exp({z}) END)
  ELSE (CASE WHEN is_event THEN {HALF_LOG_2PI!r}::double + ln(scale) + 0.5::double*{z}*{z} ELSE -{log_sf_sql(z)} END) END AS row_nll,
  {q(0.1)} AS lower80, {q(0.9)} AS upper80, {q(0.05)} AS lower90, {q(0.95)} AS upper90 FROM pred)"""


FACTOR_SQL = """
fl AS (SELECT r.*, 'LOEO' AS scenario, env_class AS holdout FROM rec r UNION ALL SELECT r.*, 'LOTO', temp_bin FROM rec r),
ff AS (SELECT scenario, holdout, count(*)::double AS n, sum(x_gross) AS sx, sum(y) AS sy, sum(x_gross*x_gross) AS sxx, sum(x_gross*y) AS sxy
  FROM fl WHERE is_event GROUP BY ALL),
ft AS (SELECT scenario, sum(n) AS n, sum(sx) AS sx, sum(sy) AS sy, sum(sxx) AS sxx, sum(sxy) AS sxy FROM ff GROUP BY ALL),
fc AS (SELECT f.scenario, f.holdout, t.n-f.n AS n, t.sx-f.sx AS sx, t.sy-f.sy AS sy, t.sxx-f.sxx AS sxx, t.sxy-f.sxy AS sxy FROM ff f JOIN ft t USING (scenario)),
fn AS (SELECT scenario, holdout, sy/n AS c_mean, (n*sxy-sx*sy)/(n*sxx-sx*sx) AS slope, (sy-(n*sxy-sx*sy)/(n*sxx-sx*sx)*sx)/n AS intercept FROM fc),
fp0 AS (SELECT fl.*, 'const' AS model, c_mean AS pred FROM fl JOIN fn USING (scenario, holdout)
  UNION ALL SELECT fl.*, 'line', intercept + slope * x_gross FROM fl JOIN fn USING (scenario, holdout)),
frs AS (SELECT scenario, model, holdout, count(*)::double AS n, sum(y-pred) AS s1, sum((y-pred)*(y-pred)) AS s2 FROM fp0 WHERE is_event GROUP BY ALL),
frt AS (SELECT scenario, model, sum(n) AS n, sum(s1) AS s1, sum(s2) AS s2 FROM frs GROUP BY ALL),
fsc AS (SELECT scenario, model, f.holdout, sqrt((t.s2-f.s2)/(t.n-f.n) - ((t.s1-f.s1)/(t.n-f.n))*((t.s1-f.s1)/(t.n-f.n))) AS scale FROM frs f JOIN frt t USING (scenario, model)),
fpred AS (SELECT fp0.*, scale, 'normal' AS family, 0 AS fold FROM fp0 JOIN fsc USING (scenario, model, holdout))"""
