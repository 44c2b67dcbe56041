"""Row numbers over whole tables without one task that sees all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from evenfold.session import settle


def bucketed_row_number(df: DataFrame, scope: list[str], bucket: Column, order: list[Column],
                        out: str = "rn") -> DataFrame:
    """Row number within ``scope`` when ``bucket`` never decreases along ``order``.

    Rows are numbered inside their bucket and shifted by the number of rows in earlier
    buckets. Only the bucket counts are ordered in one task per scope, and the join and the
    window use the same partitioning, so the rows are shuffled once.
    """
    keyed = df.withColumn("_bucket", bucket)
    counts = keyed.groupBy(*scope, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = (
        Window.partitionBy(*scope).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = counts.select(*scope, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(*scope, "_bucket").orderBy(*order)
    return (
        keyed.join(offsets, [*scope, "_bucket"])
        .withColumn(out, F.col("_before") + F.row_number().over(inside))
        .drop("_bucket", "_before")
    )


def hash_row_number(df: DataFrame, scope: list[str], seed: int, key: str, out: str = "rn") -> DataFrame:
    """Row number in the order of md5(seed|key), key: a reproducible shuffle."""
    h = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string")))
    tagged = df.withColumn("_h", h)
    return bucketed_row_number(
        tagged, scope, F.substring("_h", 1, 3), [F.col("_h"), F.col(key)], out
    ).drop("_h")


def label_ranks(df: DataFrame, key: str, prefix: str, out: str = "plot_label") -> DataFrame:
    """S01, S02, … for the distinct values of ``key`` in their order."""
    # Buckets are ranges of the key cut by a sample of it, so that common prefixes do not matter.
    names = settle(df.select(key).distinct().repartitionByRange(key).withColumn("_range", F.spark_partition_id()), "labels")
    ranked = bucketed_row_number(names, [], F.col("_range"), [F.col(key)], "_rank").drop("_range")
    number = F.col("_rank").cast("string")
    return ranked.select(
        key, F.concat(F.lit(prefix), F.when(F.length(number) < 2, F.lpad(number, 2, "0")).otherwise(number)).alias(out)
    )
