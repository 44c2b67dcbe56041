"""Helpers shared by the operators of this package."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evenfold.session import parallelism, settle, shared_folder

#: ASCII white space as a character class of Java and of Python's ``re``.
SPACE_CLASS = "[\\x20\\x09-\\x0D]"
SPACES = " \t\n\x0b\f\r"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once per row, however often ``body`` names it.

    A lambda variable holds a finished value. A plain column expression inside a
    lambda would be computed again for every element.
    """
    return F.transform(F.array(value), body)[0]


def space_words(text: Column) -> Column:
    """Maximal runs of characters other than ASCII white space; null text has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), f"{SPACE_CLASS}+"), lambda w: w != "")


def remainder_of_id(key: Column, divisor: int) -> Column:
    """crc32 of the id as text, modulo ``divisor``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % divisor


def lower_space_words(text: str | None) -> list[bytes]:
    """UTF-8 words between ASCII white space, with A-Z in lower case."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective mix of 64-bit values (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def bounded_batches(frames, text: str, limit: int = 6_000_000):
    """Cut pandas batches so that their texts stay near ``limit`` characters; a longer text stands alone."""
    for frame in frames:
        sizes = frame[text].str.len().fillna(0).to_numpy(dtype=np.int64)
        block = np.cumsum(sizes) // limit
        for b in np.unique(block):
            yield frame[block == b]


def fresh(docs: DataFrame, name: str) -> str:
    """``name``, with underscores added until no column of ``docs`` has it."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


#: Tables of so many numbers may be broadcast: some megabytes. Larger ones are shuffled.
BROADCAST_NUMBERS = 500_000


def small_side(df: DataFrame, n: int) -> DataFrame:
    """``df``, marked for broadcast if ``n``, the numbers it holds, is small."""
    return F.broadcast(df) if n <= BROADCAST_NUMBERS else df


def matching(docs: DataFrame, ids: DataFrame, key: str, how: str) -> DataFrame:
    """Semi or anti join of documents with a one-column settled table of ids."""
    name = fresh(docs, "_id")
    return docs.join(small_side(ids.toDF(name), ids.count()), F.col(key) == F.col(name), how)


def runs(texts: pa.Array, limit: int = 6_000_000):
    """Texts in runs of about ``limit`` characters."""
    run, size = [], 0
    for t in texts:
        run.append(t.as_py())
        size += len(run[-1] or "")
        if size >= limit:
            yield run
            run, size = [], 0
    if run:
        yield run


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def settled_clean(df: DataFrame, label: str) -> DataFrame:
    """``settle``, after which the shuffle files of the write are removed: the table replaces them."""
    conf = df.sparkSession.conf
    before = conf.get(CLEANUP, None)
    conf.set(CLEANUP, "true")
    try:
        return settle(df, label)
    finally:
        conf.unset(CLEANUP) if before is None else conf.set(CLEANUP, before)


def bucketed(df: DataFrame, key: str) -> DataFrame:
    """Settle ``df`` in buckets of ``key``, so that grouping it with another table moves only the other."""
    spark = df.sparkSession
    name = f"evenfold_{uuid.uuid4().hex}"
    cores = max(parallelism(spark), int(spark.conf.get("spark.sql.shuffle.partitions")))
    df.write.bucketBy(cores, key).sortBy(key).option("path", f"{shared_folder(spark)}/evenfold/{name}").saveAsTable(name)
    return spark.table(name)


ARROW_SIZE = "spark.sql.execution.arrow.maxBytesPerBatch"
ARROW_BYTES, ARROW_DEFAULT = "8m", "67108864b"
#: For sessions that run one operator after the other: neither JVM nor worker gives all of a batch back between them.
CHAINED_BYTES = "2m"


def default_batches(spark: SparkSession, size: str) -> None:
    """Arrow batches of ``size``, unless the session sets its own size."""
    if spark.conf.get(ARROW_SIZE) in (ARROW_DEFAULT, ARROW_BYTES):
        spark.conf.set(ARROW_SIZE, size)


def text_batches(df: DataFrame) -> DataFrame:
    """``df``, whose rows go to Python in Arrow batches of a few megabytes, unless the session sets its own size.

    Texts differ in length, so the number of rows bounds no memory; Spark's default of 64 MB is held several times
    over by the JVM and the worker of every running task.
    """
    default_batches(df.sparkSession, ARROW_BYTES)
    return df
