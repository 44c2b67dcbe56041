"""Best-fit decreasing packing of token documents into sequences of a fixed width.

Documents are encoded once into a settled table of pieces: full windows first,
then the rest. The plan is made from the counts of piece lengths (at most
``width`` numbers) and says, for ranges of ranks within a length, which window
they go to and where. Ranks come from counts per writing task, so no length is
ranked in one place, and pieces look up their range of the plan in parallel.

A sequence is padded to the width unless its length is a power of two
(``padded_length``).

Defined results: a null or empty text is the end id alone; rows of one key are
documents of their own; an empty table gives no pieces; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from evenfold.llm.bestfit import best_fit_decreasing
from evenfold.llm.common import text_batches
from evenfold.llm.token_files import parts
from evenfold.llm.tokens import encoder
from evenfold.session import settle

PIECE = "k {key}, doc_tokens bigint, start bigint, length bigint, task bigint, rank_in_task bigint, ids binary"


def pieces(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", width: int = 2048, end_id: int = 1, leading_space: bool = False) -> DataFrame:
    """One settled row per piece: its document, place and ids, and its number among the pieces of its length in the writing task."""
    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("t"))
    end = end_id.to_bytes(4, "little")

    def cut(batches):
        words = encoder(tokenizer, leading_space)
        context = TaskContext.get()
        task = context.partitionId() if context else 0
        seen = [0] * (width + 1)
        for batch in batches:
            for at, run in parts(batch.column("t")):
                out, owner = [], []
                for i, body in enumerate(run):
                    ids = words.encode(body) + end
                    n = len(ids) // 4
                    for start in range(0, n, width):
                        length = min(width, n - start)
                        out.append((n, start, length, task, seen[length], ids[4 * start:4 * (start + length)]))
                        seen[length] += 1
                        owner.append(at + i)
                columns = list(zip(*out))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("k").take(pa.array(owner, pa.int64())), *[pa.array(c, pa.int64()) for c in columns[:5]], pa.array(columns[5], pa.binary())],
                    names=["k", "doc_tokens", "start", "length", "task", "rank_in_task", "ids"])

    return settle(text_batches(rows).mapInArrow(cut, PIECE.format(key=rows.schema["k"].dataType.simpleString())), "pieces")


def assigned(cut: DataFrame, width: int = 2048) -> DataFrame:
    """Every piece with ``sequence_id`` and ``offset``; ``cut`` has length, task and rank_in_task."""
    per_task = settle(cut.groupBy("length", "task").agg(F.count(F.lit(1)).alias("n")), "lengths")
    earlier = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bases = per_task.select(F.col("length").alias("_l"), F.col("task").alias("_t"), earlier.alias("_base"))
    counts = {r["length"]: r["n"] for r in per_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    steps, _ = best_fit_decreasing(counts, width)
    steps = steps[np.lexsort((steps[:, 1], steps[:, 0]))]
    ranked = cut.join(bases, (F.col("length") == F.col("_l")) & (F.col("task") == F.col("_t"))).withColumn("_rank", F.col("_base") + F.col("rank_in_task")).drop("_l", "_t", "_base")
    span = int(max(counts.values(), default=0)) + 1
    starts = steps[:, 0] * span + steps[:, 1]

    def place(frames):
        for frame in frames:
            length, rank = frame["length"].to_numpy(), frame["_rank"].to_numpy()
            _, first, _, window, each, offset = steps[np.searchsorted(starts, length * span + rank, "right") - 1].T
            frame["sequence_id"] = window + (rank - first) // each
            frame["offset"] = offset + (rank - first) % each * length
            yield frame

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranked.schema) + ", sequence_id bigint, offset bigint"
    return ranked.mapInPandas(place, schema).drop("_rank")


def padded_length(used: Column, width: int = 2048) -> Column:
    """Length of a sequence as stored: its own if that is a power of two, else the width."""
    return F.when(used.bitwiseAND(used - 1) == 0, used).otherwise(F.lit(width))


def packed(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", width: int = 2048, end_id: int = 1) -> DataFrame:
    """Pieces of all documents in their sequences, with the crc32 of their ids, which stay in the settled table of pieces."""
    cut = pieces(docs, tokenizer, key, text, width, end_id)
    narrow = cut.select("k", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "task", "rank_in_task")
    return assigned(narrow, width).select(F.col("k").alias(key), "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
