"""Durable intermediate tables and other settings taken from the running session."""

from __future__ import annotations

import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Only a local master may fall back to a temporary folder: on a cluster a
    machine-local path would be lost together with its executor.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="spark-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def settle(df: DataFrame, label: str = "t") -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    This cuts the lineage, survives lost executors, and gives Catalyst the real
    size of the table: a join with it is broadcast only when the files are below
    ``spark.sql.autoBroadcastJoinThreshold`` and shuffled otherwise.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/evenfold/{label}-{uuid.uuid4().hex}"
    df.write.mode("errorifexists").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def still_there(df: DataFrame) -> bool:
    """Whether the files of a settled table still exist."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df.inputFiles()[0])
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def spread(df: DataFrame, label: str = "rows") -> DataFrame:
    """Settle a table that will be read many times, in enough files to use all cores.

    Only a table that was written in few files is written again, and such a table is small.
    """
    cores = parallelism(df.sparkSession)
    out = settle(df, label)
    return out if out.rdd.getNumPartitions() >= cores else settle(out.repartition(cores), label)


def together(df: DataFrame, keys: list[str], label: str = "rows") -> DataFrame:
    """Settle a table whose rows are mostly aggregated by ``keys``, with rows of equal keys next to each other.

    Tasks that read it then add most rows of a key up before they send anything, and hold few keys each.
    Partitions are rebalanced: adaptive execution splits that of a hot key. Nothing relies on the layout.
    """
    cores = parallelism(df.sparkSession)
    out = settle(df.hint("rebalance", *keys), label)
    return out if out.rdd.getNumPartitions() >= cores else settle(out.repartition(cores, *keys), label)


def with_scalars(df: DataFrame, totals: DataFrame) -> DataFrame:
    """Put the columns of a one-row table on every row, as scalar subqueries."""
    return df.select("*", *[totals.select(c).scalar().alias(c) for c in totals.columns])


def local_table(spark: SparkSession, rows: list[tuple], schema: T.StructType) -> DataFrame:
    """A small driver-side table as a local relation, whose size Catalyst knows."""
    columns = list(zip(*rows)) if rows else [[] for _ in schema.fields]
    arrays = [pa.array(list(c), type=to_arrow_type(f.dataType)) for c, f in zip(columns, schema.fields)]
    return spark.createDataFrame(pa.table(arrays, names=schema.names), schema=schema)


def parallelism(spark: SparkSession) -> int:
    """Partition count for generated rows, which have no input splits of their own."""
    return max(spark.sparkContext.defaultParallelism, 1)
