"""Reading contracted tables, writing named result sets, manifests and incremental stores."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evenfold.functions.hashing import set_fingerprint
from evenfold.operators.contracts import require_columns

# Columns of the tables a user fills in for new conditions and their outcomes.
CONDITION_SCHEMA = T.StructType([
    T.StructField(n, T.StringType()) for n in ("specimen_id", "group_id", "architecture", "env_class")] + [
    T.StructField(n, T.DoubleType()) for n in ("temp_c", "r_ratio", "freq", "sigma_max", "uts")])
OUTCOME_SCHEMA = T.StructType([
    T.StructField("specimen_id", T.StringType()), T.StructField("life", T.DoubleType()), T.StructField("is_censored", T.StringType()),
    T.StructField("stop_reason", T.StringType()), T.StructField("result_date", T.StringType())])

BOM = "﻿"


def read_records(spark: SparkSession, path: str, required: list[str]) -> DataFrame:
    """A Parquet record table; fails before any job if a required column is missing."""
    df = spark.read.parquet(path)
    require_columns(df, required, path)
    return df


def read_csv(spark: SparkSession, path: str, required: list[str] | None = None, schema: T.StructType | None = None) -> DataFrame:
    """CSV with a header; a byte-order mark before the first name is removed."""
    reader = spark.read.option("header", True).option("multiLine", False)
    df = reader.csv(path)
    if df.columns and df.columns[0].startswith(BOM):
        df = df.withColumnRenamed(df.columns[0], df.columns[0].lstrip(BOM).strip('"'))
    require_columns(df, required or [], path)
    if schema is not None:
        known = {f.name: f.dataType for f in schema.fields}
        df = df.select(*[F.col(c).try_cast(known[c]).alias(c) if c in known else F.col(c) for c in df.columns])
    return df


def write_tables(tables: dict[str, DataFrame], out: str) -> list[str]:
    """Every table under its name; an existing table is never overwritten."""
    for name, df in tables.items():
        df.write.mode("errorifexists").parquet(f"{out}/{name}")
    return sorted(tables)


def require_empty_target(spark: SparkSession, out: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(out)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(path) and len(fs.listStatus(path)) > 0:
        raise FileExistsError(f"{out} is not empty")


def manifest(inputs: dict[str, DataFrame], settings: dict) -> DataFrame:
    """One row per input: counts and an order-free content fingerprint, and the settings as JSON."""
    out = None
    text = json.dumps(settings, sort_keys=True)
    for name, df in sorted(inputs.items()):
        row = df.agg(*set_fingerprint(*[F.col(c) for c in sorted(df.columns)]))
        row = row.select(F.lit(name).alias("input"), "*", F.lit(text).alias("settings"))
        out = row if out is None else out.unionByName(row)
    return out


def run_hash(manifest_table: DataFrame) -> str:
    """Hash of all inputs and settings; the manifest has one row per input."""
    parts = F.array_sort(F.collect_list(F.concat_ws("|", "input", "n_rows", "hash_sum", F.col("hash_xor").cast("string"), "settings")))
    return manifest_table.agg(F.sha2(F.array_join(parts, "\n"), 256).alias("h")).first()["h"]


def todo(plan: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Plan entries that the store does not hold under the same run hash."""
    return plan.join(done.select(*keys).distinct(), keys, "left_anti")


def append_results(df: DataFrame, store: str, keys: list[str]) -> None:
    """Add finished results, partitioned by their keys."""
    df.write.mode("append").partitionBy(*keys).parquet(store)


def stored(spark: SparkSession, store: str, schema: T.StructType) -> DataFrame:
    """The store, or an empty table of its schema if nothing was written yet."""
    path = spark._jvm.org.apache.hadoop.fs.Path(store)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(store)


def templates(spark: SparkSession) -> dict[str, DataFrame]:
    """Empty tables for new conditions and for their outcomes."""
    return {"new_conditions": spark.createDataFrame([], CONDITION_SCHEMA), "new_outcomes": spark.createDataFrame([], OUTCOME_SCHEMA)}
