"""Verbatim benchmark matches found with suffix arrays over shards of the training documents.

A shard is a bounded run of documents, laid end to end as word numbers with a gap
between them. Its suffix array lists the positions in the order of the words that
follow. Only positions that begin with as many benchmark words as the shortest
window are listed: no other suffix can match. Every test suffix (one per window of
a benchmark item) is looked up by two binary searches that bound all its
occurrences, and hits that continue one another are joined to longest matches.

Words are `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` after A-Z is lowered. A window
is ``width`` consecutive words of an item; a shorter item is one window.

Defined results: null and empty texts have no words and match nothing; an item
without words is ignored; an item without id taints documents but is not listed;
equal items are all listed; repeated documents are judged each for itself; an
empty table on either side gives no matches; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evenfold.llm.common import bounded_batches, runs, text_batches
from evenfold.session import settle

#: Everything but ASCII digits, letters and bytes of longer characters becomes a space; A-Z is lowered.
WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)

BLOCK_CHARS = 4_000_000
MATCH = "struct<doc_start: bigint, length: bigint, item_id: bigint, item_start: bigint>"


def plain_words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(WORD_BYTES).split() if isinstance(text, str) else []


class TestSuffixes:
    """The windows of a block of benchmark items, as sorted keys to be looked up in suffix arrays."""

    __test__ = False

    def __init__(self, items: list[tuple[int | None, str | None]], width: int):
        self.width = width
        self.number: dict[bytes, int] = {}
        windows: dict[tuple[int, ...], list[tuple[int | None, int]]] = {}
        for item_id, text in items:
            ids = [self.number.setdefault(w, len(self.number) + 1) for w in plain_words(text)]
            for start in range(max(1, len(ids) - width + 1)):
                if ids:
                    windows.setdefault(tuple(ids[start:start + width]), []).append((item_id, start))
        keys = list(windows)
        self.length = np.array([len(k) for k in keys], dtype=np.int64)
        self.places = list(windows.values())
        table = np.zeros((len(keys), width), dtype=">u4")
        for row, key in enumerate(keys):
            table[row, :len(key)] = key
        above = table.copy()
        above[np.arange(width)[None, :] >= self.length[:, None]] = 0xFFFFFFFF
        self.low, self.high = as_keys(table), as_keys(above)
        self.shortest = int(self.length.min()) if keys else 0

    def search(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, position) of every occurrence in the numbered words of a shard; 0 is a word of no item."""
        if not self.shortest or not len(ids):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        stops = np.flatnonzero(ids == 0)
        ahead = np.append(stops, len(ids))[np.searchsorted(stops, np.arange(len(ids)))] - np.arange(len(ids))
        starts = np.flatnonzero(ahead >= self.shortest)
        padded = np.concatenate([ids, np.zeros(self.width, ids.dtype)])
        table = padded[starts[:, None] + np.arange(self.width)[None, :]].astype(">u4")
        table[np.arange(self.width)[None, :] >= ahead[starts][:, None]] = 0
        keys = as_keys(table)
        order = np.argsort(keys, kind="stable")
        ranked = keys[order]
        first, last = np.searchsorted(ranked, self.low, "left"), np.searchsorted(ranked, self.high, "right")
        counts = last - first
        window = np.repeat(np.arange(len(counts)), counts)
        rank = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(first, counts)
        return window, starts[order[rank]]


def as_keys(table: np.ndarray) -> np.ndarray:
    """Rows of big-endian numbers as byte strings, which compare as the rows do."""
    return np.ascontiguousarray(table).view(f"S{4 * table.shape[1]}").ravel() if len(table) else np.empty(0, f"S{4 * table.shape[1]}")


def longest(found: list[tuple[int, int, int | None, int]]) -> list[tuple[int, int, int | None, int]]:
    """Join hits (start, length, item, item start) of one document that continue one another in text and item."""
    out: list[list] = []
    for start, length, item, at in sorted(found, key=lambda m: (m[2] is None, m[2] or 0, m[0] - m[3], m[0])):
        if out and out[-1][2] == item and out[-1][0] - out[-1][3] == start - at and start <= out[-1][0] + out[-1][1]:
            out[-1][1] = max(out[-1][1], start + length - out[-1][0])
        else:
            out.append([start, length, item, at])
    return sorted(((s, n, i, a) for s, n, i, a in out), key=lambda m: (m[0], m[2] is None, m[2] or 0, m[3]))


def shard_matches(texts: list, test: TestSuffixes) -> tuple[list[int], list[list[tuple]]]:
    """Words and longest matches of each text, through one suffix array over all of them."""
    number = test.number.get
    parts, sizes = [], []
    for text in texts:
        words = plain_words(text)
        sizes.append(len(words))
        parts.append(np.fromiter((number(w, 0) for w in words), np.int64, len(words)))
        parts.append(np.zeros(1, np.int64))
    offsets = np.cumsum([0] + [n + 1 for n in sizes])
    window, position = test.search(np.concatenate(parts) if parts else np.empty(0, np.int64))
    found: list[list[tuple]] = [[] for _ in texts]
    owner = np.searchsorted(offsets, position, "right") - 1
    for w, p, d in zip(window.tolist(), position.tolist(), owner.tolist()):
        for item, at in test.places[w]:
            found[d].append((p - int(offsets[d]), int(test.length[w]), item, at))
    return sizes, [longest(f) if f else [] for f in found]


def item_blocks(bench: DataFrame, item: str, item_text: str, block_chars: int):
    """The benchmark's (id, text) rows in blocks of about ``block_chars`` characters, one block at a time."""
    items = bench.select(F.col(item).cast("long").alias("item"), F.col(item_text).alias("body"))
    total = items.agg(F.sum(F.length("body"))).first()[0] or 0
    blocks = 1 + total // block_chars
    for b in range(blocks):
        yield [tuple(r) for r in items.where(F.pmod(F.xxhash64("body"), F.lit(blocks)) == b).collect()], b == blocks - 1


def matches(docs: DataFrame, bench: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text",
            width: int = 10, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(key, n_words, matches) for every document: all longest verbatim matches with their places.

    The benchmark is taken in blocks, one after the other, so what a task holds of
    it is bounded; each block searches all documents. Nothing is shuffled: a shard
    is searched where its documents lie.
    """
    out = docs.select(F.col(key).alias("k"), F.col(text).alias("t"), F.lit(0).cast("long").alias("n"), F.expr(f"cast(array() as array<{MATCH}>)").alias("m"))
    for block, last in item_blocks(bench, item, item_text, block_chars):
        out = text_batches(out).mapInPandas(searching(block, width, last), out.schema)
        if not last:
            out = settle(out, "matches")
    return out.select(F.col("k").alias(key), F.col("n").alias("n_words"), F.col("m").alias("matches"))


def searching(block: list, width: int, last: bool):
    """A pass over documents that adds their matches with one block of the benchmark; the last pass drops the texts."""
    names = ("doc_start", "length", "item_id", "item_start")

    def search(frames):
        test = TestSuffixes(block, width)
        for frame in bounded_batches(frames, "t"):
            sizes, found = shard_matches(frame["t"].tolist(), test)
            rows = [[*before, *[dict(zip(names, x)) for x in new]] for before, new in zip(frame["m"], found)]
            yield pd.DataFrame({"k": frame["k"], "t": None if last else frame["t"], "n": sizes, "m": rows})

    return search


def contamination(found: DataFrame) -> DataFrame:
    """n_hit, items (distinct ids, in the order of their texts) and contaminated, from the matches of each document."""
    def reach(acc, m):
        # acc: words covered so far and the end of the last covered word; matches come by start.
        end = m["doc_start"] + m["length"]
        start = F.greatest(m["doc_start"], acc["upto"])
        return F.struct((acc["total"] + F.greatest(end - start, F.lit(0).cast("long"))).alias("total"), F.greatest(end, acc["upto"]).alias("upto"))

    zero = F.struct(F.lit(0).cast("long").alias("total"), F.lit(0).cast("long").alias("upto"))
    ids = F.filter(F.transform("matches", lambda m: m["item_id"].cast("string")), lambda x: x.isNotNull())
    return (
        found.withColumn("n_hit", F.aggregate(F.array_sort("matches"), zero, reach, lambda a: a["total"]))
        .withColumn("items", F.array_sort(F.array_distinct(ids)))
        .withColumn("contaminated", F.col("n_hit") > 0)
    )


def clean(docs: DataFrame, bench: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", width: int = 10, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The documents without a match, with all their columns; documents are filtered where they lie."""
    schema, body = docs.schema, docs.columns.index(text)

    def keeping(block):
        def keep(batches):
            test = TestSuffixes(block, width)
            for batch in batches:
                free = []
                for run in runs(batch.column(body)):
                    free += [not m for m in shard_matches(run, test)[1]]
                yield batch.filter(pa.array(free, pa.bool_()))

        return keep

    for block, last in item_blocks(bench, item, item_text, block_chars):
        docs = text_batches(docs).mapInArrow(keeping(block), schema)
        if not last:
            docs = settle(docs, "clean")
    return docs
