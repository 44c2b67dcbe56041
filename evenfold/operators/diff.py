"""Numeric comparison of two result sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from evenfold.session import settle


def flat_columns(df: DataFrame) -> DataFrame:
    """Struct fields become columns named parent.child; arrays become text."""
    cols: list[Column] = []

    def walk(field: T.StructField, path: str) -> None:
        if isinstance(field.dataType, T.StructType):
            for f in field.dataType.fields:
                walk(f, f"{path}.{f.name}")
        elif isinstance(field.dataType, (T.ArrayType, T.MapType)):
            cols.append(F.to_json(F.col(path)).alias(path.replace(".", "_")))
        else:
            cols.append(F.col(path).alias(path.replace(".", "_")))

    for f in df.schema.fields:
        walk(f, f.name)
    return df.select(*cols)


def compare(a: DataFrame, b: DataFrame, keys: list[str], rtol: float = 1e-10, atol: float = 1e-10) -> DataFrame:
    """Per column: values compared, values out of tolerance, largest absolute difference.

    Null and NaN equal themselves. Rows that only one side has are reported under ``_rows``.
    """
    a, b = flat_columns(a), flat_columns(b)
    shared = [c for c in a.columns if c in b.columns and c not in keys]
    types = dict(a.dtypes)
    numeric = [c for c in shared if types[c] in ("double", "float", "bigint", "int", "smallint", "tinyint")]
    left = a.select(*keys, F.struct(*shared).alias("_a"))
    right = b.select(*keys, F.struct(*shared).alias("_b"))
    joined = left.join(right, keys, "full_outer")
    entries = []
    for c in shared:
        x, z = F.col(f"_a.{c}"), F.col(f"_b.{c}")
        if c in numeric:
            xd, zd = x.cast("double"), z.cast("double")
            gap = F.abs(xd - zd)
            same = xd.eqNullSafe(zd) | F.coalesce(gap <= atol + rtol * F.abs(zd), F.lit(False))
            entries.append(F.struct(F.lit(c).alias("column"), (~same).alias("bad"), gap.alias("gap"), F.lit(True).alias("numeric")))
        else:
            entries.append(F.struct(F.lit(c).alias("column"), (~x.eqNullSafe(z)).alias("bad"), F.lit(None).cast("double").alias("gap"), F.lit(False).alias("numeric")))
    one_sided = F.col("_a").isNull() | F.col("_b").isNull()
    rows = F.array(F.struct(F.lit("_rows").alias("column"), one_sided.alias("bad"), F.lit(None).cast("double").alias("gap"), F.lit(False).alias("numeric")))
    every = F.when(one_sided, rows).otherwise(F.concat(rows, F.array(*entries)))
    out = joined.select(F.explode(every).alias("_e")).select("_e.*").groupBy("column", "numeric").agg(
        F.count(F.lit(1)).alias("n_compared"), F.sum(F.col("bad").cast("long")).alias("n_different"),
        F.max(F.when(~F.isnan("gap"), F.col("gap"))).alias("max_abs_difference"))
    return out.withColumn("passed", F.col("n_different") == 0)


def schema_differences(a: DataFrame, b: DataFrame) -> list[str]:
    left, right = dict(flat_columns(a).dtypes), dict(flat_columns(b).dtypes)
    out = [f"only in first: {c}" for c in left if c not in right] + [f"only in second: {c}" for c in right if c not in left]
    return out + [f"type of {c}: {left[c]} / {right[c]}" for c in left if c in right and left[c] != right[c]]


def chains(values: DataFrame, held: list[str], column: str, rtol: float, atol: float, parts: int | None = None) -> DataFrame:
    """Distinct (``held``, ``column``) with ``_start``: the smallest value of the chain that the value belongs to.

    Values of one ``held`` key follow one another in a chain while the step is no more than
    ``atol + rtol |value|``. They are dealt into ranges of (key, value), so a key of any size is
    spread over all ranges; from one range to the next only its last key and value and the start
    of its last chain are carried, one row per range. Null, NaN and infinities chain only with themselves.
    """
    spark = values.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    v, key = F.col(column), F.struct(F.lit(0), *held)
    dealt = settle(values.select(*held, column).distinct().repartitionByRange(parts, *held, column).withColumn("_part", F.spark_partition_id()), "ranges")
    # One row per range from here to the carried values, whatever the number of values.
    in_order = Window.orderBy("_part")
    ends = dealt.groupBy("_part").agg(F.max(F.struct(key.alias("key"), v.alias("value"))).alias("_end"))
    before = ends.withColumn("_before", F.lag("_end").over(in_order)).drop("_end")
    local = Window.partitionBy("_part", *held).orderBy(column)
    rows = dealt.join(F.broadcast(before), "_part").withColumn("_first", F.row_number().over(local) == 1).withColumn("_lag", F.lag(column).over(local))
    follows = ~F.col("_first") | F.coalesce(F.col("_before.key").eqNullSafe(key) & F.col("_before").isNotNull(), F.lit(False))
    last = F.when(F.col("_first"), F.col("_before.value")).otherwise(F.col("_lag"))
    step = v - last
    near = v.eqNullSafe(last) | F.coalesce((step <= atol + rtol * F.abs(v)) & (step < float("inf")), F.lit(False))
    opened = F.when(~(follows & near), F.struct(v.alias("value")))
    rows = rows.withColumn("_opened", opened).withColumn("_chain", F.last("_opened", ignorenulls=True).over(local.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    rows = settle(rows.select(*held, column, "_part", "_chain"), "chains")
    tails = rows.groupBy("_part").agg(F.max_by("_chain", F.struct(key, v)).alias("_tail"))
    carried = tails.withColumn("_carried", F.last("_tail", ignorenulls=True).over(in_order.rowsBetween(Window.unboundedPreceding, -1))).drop("_tail")
    return rows.join(F.broadcast(carried), "_part").select(*held, column, F.coalesce("_chain", "_carried")["value"].alias("_start"))


def compare_unkeyed(a: DataFrame, b: DataFrame, columns: list[str], rtol: float = 1e-10, atol: float = 1e-10, parts: int | None = None) -> DataFrame:
    """Tables without a key: rows that do not occur equally often on both sides, up to the tolerance.

    In each numeric column, values that follow one another by no more than
    ``atol + rtol |value|`` are one value; its smallest stands for it. Other columns compare exactly.
    Columns are taken in turn, each within what the ones before left equal. Only distinct values are
    put in order, in ranges, so neither a frequent value nor a frequent exact key is one task's work.
    """
    types = dict(a.dtypes)
    loose = [c for c in columns if types[c] in ("double", "float")]
    exact = [c for c in columns if c not in loose]

    def tagged(df: DataFrame, first: int) -> DataFrame:
        return df.select(*columns, F.lit(first).alias("_a"), F.lit(1 - first).alias("_b"))

    # Equal rows first become one, so that only distinct rows are compared.
    both = tagged(a, 1).unionByName(tagged(b, 0)).groupBy(*columns).agg(F.sum("_a").alias("_a"), F.sum("_b").alias("_b"))
    if not loose:
        return both.withColumnsRenamed({"_a": "n_first", "_b": "n_second"}).where("n_first <> n_second").select(*columns, "n_first", "n_second")
    both, held = settle(both, "unkeyed"), list(exact)
    for i, c in enumerate(loose):
        known = chains(both, held, c, rtol, atol, parts)
        names = {x: f"_k{n}" for n, x in enumerate([*held, c])}
        known = known.withColumnsRenamed(names | {"_start": f"_g{i}"})
        same = F.lit(True)
        for x, k in names.items():
            same = same & F.col(x).eqNullSafe(F.col(k))
        both = both.join(known, same).drop(*names.values())
        held.append(f"_g{i}")
    counted = both.groupBy(*held).agg(*[F.min(c).alias(c) for c in loose], F.sum("_a").alias("n_first"), F.sum("_b").alias("n_second"))
    return counted.where("n_first <> n_second").select(*columns, "n_first", "n_second")
