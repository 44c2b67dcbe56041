"""Ranked lexical search by dense matrix products: all documents for each of a set of items.

A document's score for an item sums weight(term) * impact(term, document) over the item's
distinct terms; both are whole numbers (below). Items come in blocks of a bounded number of
terms. Per block one pass over the texts keeps, for each document, its length and the counts
of the block's terms. A task then takes documents in tiles: the impacts of a tile are a
dense float64 matrix over the terms that occur in it, a slice of the terms at a time, and its
product with the weights of these terms gives partial scores of all items at once. A slice
is so narrow that no partial sum reaches 2^53, so every product is exact; slices are added
up in 64-bit integers. Of each tile only scores that reach an item's k-th best so far are
kept, equal ones included, so ties are decided by the key and never by the tiling.

    N documents with a term, L their terms with repeats, n those of one document,
    df documents with the term, tf its count in the document
    weight = floor(1000 ln((2 N + 2) / (2 df + 1)))         m = 50 + (50 n N) div L
    impact = (10^9 tf) div (1000 tf + 20 m)

What a task emits is k rows per item; they are cut again in groups of tasks and then per
item, so that no group grows with the number of tasks.

Defined results: a null or empty text has no terms and is not counted in N; a text of any
length is read whole, a megabyte of words at a time; rows are documents, so repeated rows
rank one after the other; equal scores are ordered by key, null keys last; rows of one item
id are one item with the terms of all; an item without terms, or whose terms are in no
document, has no rows; empty tables give an empty result; other columns are not read,
whatever their names.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from evenfold.llm.common import text_batches
from evenfold.session import local_table, settle

TOP = 50
#: (item, term) pairs of a block, on average: what the driver and each task hold at once.
BLOCK_PAIRS = 100_000
TILE_ROWS = 512
TILE_TERMS = 1_024
EXACT = 1 << 53
#: An impact is below this, whatever the counts.
MOST_IMPACT = 1_000_000
#: Kept scores of a task before they are cut to the k best of each item.
MOST_KEPT = 200_000
#: Tasks whose results are cut together.
TASKS_PER_CUT = 64
PIECE = 1 << 20

#: ASCII letters and digits in lower case, every other ASCII byte a blank; other bytes stay.
TERM_BYTES = bytes(ord(chr(b).lower()) if b < 128 and chr(b).isalnum() else 32 if b < 128 else b for b in range(256))


def words_of(text: str | None) -> Iterator[list[bytes]]:
    """The terms of a text with repeats, in lists of about a megabyte."""
    data = (text or "").encode("utf-8", "surrogatepass").translate(TERM_BYTES)
    start = 0
    while start < len(data):
        end = data.find(b" ", start + PIECE)
        end = len(data) if end < 0 else end
        yield data[start:end].split()
        start = end


def item_terms(items: DataFrame, item: str, text: str) -> DataFrame:
    """(item, term): the distinct terms of each item."""
    kind = items.schema[item].dataType.simpleString()

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            terms = [list(set().union(*words_of(t.as_py()))) for t in batch.column(1)]
            yield pa.record_batch({"item": batch.column(0), "terms": pa.array(terms, pa.list_(pa.binary()))})

    rows = text_batches(items.select(item, text)).mapInArrow(split, f"item {kind}, terms array<binary>")
    return rows.select("item", F.explode("terms").alias("term")).distinct()


def term_counts(docs: DataFrame, key: str, text: str, vocabulary: dict[bytes, int]) -> DataFrame:
    """(key, n, terms, counts) of the documents that have a term: their length, and the counts of the vocabulary's terms."""
    kind = docs.schema[key].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    ints = pa.list_(pa.int32())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value.get
        for batch in batches:
            keep, ns, terms, counts = [], [], [], []
            for i, t in enumerate(batch.column(1)):
                found, n = Counter(), 0
                for words in words_of(t.as_py()):
                    n += len(words)
                    found.update(map(known, words))
                if n:
                    found.pop(None, None)
                    keep.append(i)
                    ns.append(n)
                    terms.append(list(found))
                    counts.append(list(found.values()))
            yield pa.record_batch({"key": batch.column(0).take(pa.array(keep, pa.int32())), "n": pa.array(ns, pa.int64()), "terms": pa.array(terms, ints), "counts": pa.array(counts, ints)})

    return text_batches(docs.select(key, text)).mapInArrow(count, f"key {kind}, n bigint, terms array<int>, counts array<int>")


@dataclass(frozen=True)
class Block:
    """The weights of a block of items and the totals of all documents."""

    weights: np.ndarray
    holds: np.ndarray
    documents: int
    terms: int

    @property
    def slice_terms(self) -> int:
        """Terms whose products add up to less than 2^53."""
        return max(1, min(TILE_TERMS, (EXACT - 1) // (MOST_IMPACT * max(int(self.weights.max(initial=1)), 1))))


def impacts(counts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    return (1_000_000_000 * counts) // (1_000 * counts + 20 * lengths)


def tile_scores(block: Block, n: list[int], sizes: np.ndarray, terms: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Scores (documents × items) of a tile; ``terms`` and ``counts`` lie one document after the other."""
    length = np.array([50 + 50 * x * block.documents // block.terms for x in n], dtype=np.int64)
    rows = np.repeat(np.arange(len(n)), sizes)
    values = impacts(counts, length[rows])
    used, columns = np.unique(terms, return_inverse=True)
    out = np.zeros((len(n), block.holds.shape[1]), dtype=np.int64)
    for start in range(0, len(used), block.slice_terms):
        part = used[start:start + block.slice_terms]
        inside = (columns >= start) & (columns < start + len(part))
        dense = np.zeros((len(n), len(part)))
        dense[rows[inside], columns[inside] - start] = values[inside]
        out += (dense @ (block.holds[part] * block.weights[part, None]).astype(np.float64)).astype(np.int64)
    return out


def best_rows(rows: pa.Table, k: int) -> pa.Table:
    """The ``k`` best rows of each item, by falling score and rising key."""
    rows = rows.take(pc.sort_indices(rows, [("item", "ascending"), ("score", "descending"), ("key", "ascending")]))
    item = rows["item"].to_numpy()
    first = np.searchsorted(item, item)
    return rows.filter(pa.array(np.arange(len(item)) - first < k))


def tile_tops(counted: DataFrame, block: Block, k: int) -> DataFrame:
    """(item, key, score, task): each task's ``k`` best documents of every item, by the item's place in the block."""
    kind = counted.schema["key"].dataType.simpleString()
    shared = counted.sparkSession.sparkContext.broadcast(block)

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        block, kept, size = shared.value, [], 0
        least = np.ones(block.holds.shape[1], dtype=np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, TILE_ROWS):
                tile = batch.slice(at, TILE_ROWS)
                lists = tile.column(2)
                terms, counts = (tile.column(c).flatten().to_numpy().astype(np.int64) for c in (2, 3))
                scores = tile_scores(block, tile.column(1).to_pylist(), pc.list_value_length(lists).to_numpy(), terms, counts)
                doc, item = np.nonzero(scores >= least)
                kept.append(pa.table({"item": pa.array(item.astype(np.int32)), "key": tile.column(0).take(pa.array(doc)), "score": pa.array(scores[doc, item])}))
                size += len(doc)
                if size > MOST_KEPT:
                    kept = [best_rows(pa.concat_tables(kept), k)]
                    size = kept[0].num_rows
                    item, score = kept[0]["item"].to_numpy(), kept[0]["score"].to_numpy()
                    full = np.flatnonzero(np.bincount(item, minlength=len(least)) == k)
                    least[full] = score[np.searchsorted(item, full, "right") - 1]
        if kept:
            out = best_rows(pa.concat_tables(kept), k)
            task = pa.array(np.full(out.num_rows, TaskContext.get().partitionId(), dtype=np.int32))
            yield from out.append_column("task", task).combine_chunks().to_batches()

    return counted.mapInArrow(rank, f"item int, key {kind}, score bigint, task int")


def cut(rows: DataFrame, by: list, k: int) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.desc("score"), F.asc_nulls_last("key"))
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def block_of(docs: DataFrame, pairs: list[tuple[int, bytes]], n_items: int, key: str, text: str) -> tuple[DataFrame, Block]:
    """Counted documents of a block of (item, term) pairs, and its weights."""
    vocabulary = {t: i for i, t in enumerate(dict.fromkeys(t for _, t in pairs))}
    counted = settle(term_counts(docs, key, text, vocabulary), "counts")
    totals = counted.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    holders = {r["term"]: r["df"] for r in counted.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df")).collect()}
    weights = np.zeros(len(vocabulary), dtype=np.int64)
    for term, df in holders.items():
        weights[term] = math.floor(1000 * math.log((2 * totals[0] + 2) / (2 * df + 1)))
    holds = np.zeros((len(vocabulary), n_items), dtype=bool)
    holds[[vocabulary[t] for _, t in pairs], [i for i, _ in pairs]] = True
    return counted, Block(weights, holds, totals[0], totals[1])


def ranked(docs: DataFrame, items: DataFrame, k: int = TOP, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text",
           block_pairs: int = BLOCK_PAIRS) -> DataFrame:
    """(item, rank, key, score): the ``k`` best documents of each item with a score above 0."""
    terms = settle(item_terms(items, item, item_text), "terms")
    n_blocks = max(1, math.ceil(terms.count() / block_pairs))
    out = []
    for b in range(n_blocks):
        rows = terms.where(F.pmod(F.xxhash64("item"), F.lit(n_blocks)) == b).collect()
        ids = list(dict.fromkeys(r["item"] for r in rows))
        place = {x: i for i, x in enumerate(ids)}
        counted, block = block_of(docs, [(place[r["item"]], bytes(r["term"])) for r in rows], len(ids), key, text)
        tops = settle(tile_tops(counted, block, k), "tops")
        merged = cut(tops, ["item", F.floor(F.col("task") / TASKS_PER_CUT)], k).drop("rank") if counted.rdd.getNumPartitions() > TASKS_PER_CUT else tops
        names = local_table(docs.sparkSession, list(enumerate(ids)), T.StructType([T.StructField("place", T.IntegerType()), T.StructField("name", items.schema[item].dataType)]))
        best = cut(merged, ["item"], k).join(F.broadcast(names), F.col("item") == F.col("place"))
        out.append(best.select(F.col("name").alias("item"), "rank", "key", "score"))
    return reduce(DataFrame.unionAll, out)
