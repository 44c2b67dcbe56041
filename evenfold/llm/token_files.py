"""Token ids in Parquet list columns, in ascending key order, with controlled row groups and page indexes.

Files are written by Spark's Parquet writer: version 2 pages, so that id columns
take a dictionary and, where it grows too large, delta encoding; a row group and a
page of bounded size; column and offset indexes, which the writer adds to every
file. A reader that wants the lengths, or a few documents, reads only those
columns and pages.

Defined results: a null or empty text holds the end id alone; a null key comes
first; rows of one key are ordered by a hash of their text, and repeated rows are
all kept; an empty table gives empty files; only the named columns are written.
"""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from evenfold.llm.common import text_batches
from evenfold.llm.tokens import encoder
from evenfold.session import shared_folder

ROW_GROUP_BYTES = 32 << 20
PAGE_BYTES = 1 << 20
PAGE_ROWS = 5_000
#: Words whose ids a worker keeps: files are written by a job of its own, which has the memory to itself.
CACHE_WORDS = 700_000


def new_folder(docs: DataFrame, label: str) -> str:
    return f"{shared_folder(docs.sparkSession)}/evenfold/{label}-{uuid.uuid4().hex}"


def write(docs: DataFrame, path: str, tokenizer: str, key: str = "doc_id", text: str = "text", keep: tuple[str, ...] = (), end_id: int = 0,
          leading_space: bool = True, row_group_bytes: int = ROW_GROUP_BYTES, page_bytes: int = PAGE_BYTES, page_rows: int = PAGE_ROWS) -> None:
    """Encode every text, append ``end_id``, and write (key, ``keep`` columns, n_tokens, ids) in the order of the key."""
    rows = docs.select(F.col(key).alias("_key"), *[F.col(c).alias(f"_keep_{c}") for c in keep], F.col(text).alias("_text"))
    order = [F.col("_key"), F.xxhash64("_text")]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    kept = T.StructType([f for f in rows.schema if f.name != "_text"])
    schema = T.StructType([*kept, T.StructField("_n", T.LongType()), T.StructField("_ids", T.ArrayType(T.IntegerType()))])
    end = end_id.to_bytes(4, "little")

    def encode(batches):
        words = encoder(tokenizer, leading_space, CACHE_WORDS)
        for batch in batches:
            texts = batch.column("_text")
            for at, part in parts(texts):
                ids = [words.encode(t) + end for t in part]
                n = np.array([len(i) // 4 for i in ids], dtype=np.int64)
                flat = pa.array(np.frombuffer(b"".join(ids), dtype="<u4").view("<i4"))
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), flat)
                yield pa.RecordBatch.from_arrays([*[batch.column(c).slice(at, len(part)) for c in kept.names], pa.array(n), lists], names=schema.names)

    named = text_batches(rows).mapInArrow(encode, schema).select(F.col("_key").alias(key), *[F.col(f"_keep_{c}").alias(c) for c in keep], F.col("_n").alias("n_tokens"), F.col("_ids").alias("ids"))
    named.write.options(**{
        "parquet.writer.version": "v2", "parquet.enable.dictionary": "true", "parquet.block.size": str(row_group_bytes),
        "parquet.page.size": str(page_bytes), "parquet.page.row.count.limit": str(page_rows),
    }).parquet(path)


def parts(texts: pa.Array, limit: int = 4_000_000):
    """(offset, texts) of runs of about ``limit`` characters, so that their ids fit in memory and in one list array."""
    at, run, size = 0, [], 0
    for i, text in enumerate(texts):
        run.append(text.as_py())
        size += len(run[-1] or "")
        if size >= limit:
            yield at, run
            at, run, size = i + 1, [], 0
    if run:
        yield at, run


def digests(frame: DataFrame) -> DataFrame:
    """Replace the list column ``ids`` by the crc32 of its little-endian bytes."""
    rest = [f for f in frame.schema if f.name != "ids"]
    schema = T.StructType([*rest, T.StructField("ids_crc32", T.LongType())])

    def crc(batches):
        for batch in batches:
            lists = batch.column("ids")
            bounds = lists.offsets.to_numpy()
            flat = memoryview(np.ascontiguousarray(lists.values.to_numpy(zero_copy_only=False).astype("<i4")))
            sums = [zlib.crc32(flat[a:b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
            yield pa.RecordBatch.from_arrays([*[batch.column(f.name) for f in rest], pa.array(sums, pa.int64())], names=schema.names)

    return text_batches(frame).mapInArrow(crc, schema)


def read(spark, path: str, *columns: str) -> DataFrame:
    """The files' rows with their place: ``file_number`` follows the order of the keys, ``file_row`` the order in a file."""
    return spark.read.parquet(path).select(
        *columns, F.regexp_extract("_metadata.file_name", r"part-(\d+)", 1).cast("long").alias("file_number"), F.col("_metadata.row_index").alias("file_row"))


def with_starts(rows: DataFrame, sizes: DataFrame, n: str = "n_tokens") -> DataFrame:
    """Add ``start``, the ids of all earlier rows: a sum over whole files, then over the rows of the own file."""
    totals = sizes.groupBy("file_number").agg(F.sum(n).alias("_sum"))
    before = totals.select("file_number", F.coalesce(F.sum("_sum").over(Window.orderBy("file_number").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    inside = F.coalesce(F.sum(n).over(Window.partitionBy("file_number").orderBy("file_row").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.join(before, "file_number").withColumn("start", F.col("_before") + inside).drop("_before")
