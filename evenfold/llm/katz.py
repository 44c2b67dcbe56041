"""Katz backoff language model over a corpus, stored in partitioned tables, and scores of whole texts.

    P1(w)    = (c(w) + 0.5) / (N + 0.5 (V + 1))                       one slot of V + 1 is for unknown words
    Pn(w|h)  = d(c(hw)) c(hw) / c(h)         if hw was seen           d: Good-Turing discount of counts up to K
             = a(h) P(n-1)(w|h')             else                     a(h): what discounting left over, divided by
                                                                      the lower-order mass of the words not seen after h

so that the probabilities after every context add up to 1. A context whose seen
words are all above K leaves nothing over; it counts one event more, and that event
is its left-over mass. An unseen context has a = 1.

How it is computed. Texts are cut into blocks, and whatever a block asks or adds is
first reduced to its distinct words and n-grams. Per order there is one shuffle of
(context, word, training count, lower-order probability) to the partition of the
context, and one back with counts and the sums that give a(h). A context with more
than ``HOT_SHARE`` of all events is spread over several partitions by its next word
and its sums are added up by the block. Tables of counts are kept per partition.

Words and n-grams are named by 64-bit hashes. The end of a text is a word; contexts
at the start of a text hold a start mark that is never predicted.

Defined results: a null or empty text is the end alone; a null key is learnt from
or held out by the crc32 of the empty text; repeated rows count each time; without
training rows every probability is the unknown word's; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evenfold.llm.common import bucketed, lower_space_words, mixed, runs, settled_clean, text_batches

K = 5
ORDER = 2
BLOCK_CHARS = 10_000_000
#: In how many turns the n-grams of one order are exchanged.
TURNS = 2
PART_ENTRIES = 2_000_000
HOT_EVENTS = 1_000_000
HOT_SHARE = 1e-3
WORD = np.array([0x9E3779B97F4A7C15], np.uint64)
CONTEXT = np.array([0xD1342543DE82EF95], np.uint64)
#: The words "end" and "start", which no text can hold.
END, START = np.uint64(xxhash.xxh3_64_intdigest(b"\nend")), np.uint64(xxhash.xxh3_64_intdigest(b"\nstart"))


def packed(values: np.ndarray) -> bytes:
    """Numbers by byte planes, compressed: small values cost little."""
    return zstandard.compress(values.view(np.uint8).reshape(-1, values.itemsize).T.tobytes(), 1)


def unpacked(data: bytes, dtype) -> np.ndarray:
    raw = np.frombuffer(zstandard.decompress(data), np.uint8)
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(raw.reshape(size, -1).T).view(dtype).ravel()


def packed_words(hashes: np.ndarray) -> bytes:
    """The low 48 bits of word hashes, which tell the words after one context apart."""
    return zstandard.compress(hashes.view(np.uint8).reshape(-1, 8).T[:6].tobytes(), 1)


def unpacked_words(data: bytes) -> np.ndarray:
    low = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(6, -1)
    return np.ascontiguousarray(np.concatenate([low, np.zeros((2, low.shape[1]), np.uint8)]).T).view(np.uint64).ravel()


def packed_floats(values: np.ndarray) -> bytes:
    """Floats of which many are equal: their distinct values, then which one each is."""
    distinct, at = np.unique(values, return_inverse=True)
    head = packed(distinct)
    return len(head).to_bytes(8, "little") + head + packed(at.astype(np.uint32))


def unpacked_floats(data: bytes) -> np.ndarray:
    size = 8 + int.from_bytes(data[:8], "little")
    return unpacked(data[8:size], np.float64)[unpacked(data[size:], np.uint32)]


def part_of(hashes: np.ndarray, parts: int) -> np.ndarray:
    return (((hashes >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)).astype(np.int64)


def by_count(counts: np.ndarray) -> np.ndarray:
    return np.argsort(-counts.astype(np.int64), kind="stable")


def ranks(counts: np.ndarray) -> np.ndarray:
    out = np.empty(len(counts), np.uint32)
    out[by_count(counts)] = np.arange(len(counts), dtype=np.uint32)
    return out


def blocks(docs: DataFrame, key: str, text: str, learn: Column, block_chars: int) -> DataFrame:
    """Token blocks: keys, training flags and lengths of the texts; sorted word hashes, their training counts, and the words of all texts in a row.

    Words in a row are numbered by falling training count, so that common words have small numbers.
    """
    rows = docs.select(F.col(key).alias("k"), learn.alias("learn"), F.col(text).alias("t"))
    kind = rows.schema["k"].dataType.simpleString()

    def cut(batches):
        context = TaskContext.get()
        block = (context.partitionId() if context else 0) << 20
        held: list = [[], [], []]
        hashes: list[np.ndarray] = []
        size = 0

        def flush():
            words, at = np.unique(np.concatenate(hashes), return_inverse=True)
            taught = np.repeat(np.array(held[1], dtype=bool), held[2])
            counts = np.bincount(at[taught], minlength=len(words)).astype(np.uint32)
            return pa.RecordBatch.from_arrays(
                [pa.array([block], pa.int64()), pa.array([held[0]], pa.list_(kinds)), pa.array([held[1]], pa.list_(pa.bool_())), pa.array([held[2]], pa.list_(pa.int64())),
                 *[pa.array([packed(x)], pa.binary()) for x in (words, counts, ranks(counts)[at])]],
                names=["block", "keys", "learn", "sizes", "words", "counts", "tokens"])

        for batch in batches:
            kinds = batch.column("k").type
            keys, learns, i = batch.column("k").to_pylist(), batch.column("learn").to_pylist(), 0
            for run in runs(batch.column("t"), 1_000_000):
                for body in run:
                    words = lower_space_words(body)
                    h = np.empty(len(words) + 1, np.uint64)
                    h[:-1] = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
                    h[-1] = END
                    hashes.append(h)
                    for part, x in zip(held, (keys[i], bool(learns[i]), len(h))):
                        part.append(x)
                    i += 1
                    size += len(body or "")
                if size >= block_chars:
                    yield flush()
                    block, held, hashes, size = block + 1, [[], [], []], [], 0
        if hashes:
            yield flush()

    return bucketed(text_batches(rows).mapInArrow(cut, f"block bigint, keys array<{kind}>, learn array<boolean>, sizes array<bigint>, words binary, counts binary, tokens binary"), "block")


#: Answers to a block; rows of block -1 are the model's tables.
ANSWER = "block bigint, n int, part int, a binary, b binary, c binary, d binary, seen bigint, total bigint, repeats array<bigint>"


def answer(n: int, part: int, block: int, *data: bytes | None) -> dict:
    return {"block": block, "n": n, "part": part, **dict(zip("abcd", [*data, None, None, None, None][:4])), "seen": 0, "total": 0, "repeats": None}


def word_counts(table: DataFrame, parts: int) -> DataFrame:
    """Training counts of every word, as answers to the blocks that hold it and as the model's table of order 1."""
    def ask(frames):
        for frame in frames:
            for block, words, counts in zip(frame["block"], frame["words"], frame["counts"]):
                words, counts = unpacked(words, np.uint64), unpacked(counts, np.uint32)
                bounds = np.searchsorted(part_of(words, parts), np.arange(parts + 1))
                yield pd.DataFrame([{"part": p, "block": block, "a": packed(words[x:y]), "b": packed(counts[x:y])} for p, (x, y) in enumerate(zip(bounds[:-1], bounds[1:])) if y > x],
                                   columns=["part", "block", "a", "b"])

    def add(frame: pd.DataFrame) -> pd.DataFrame:
        asked = [unpacked(x, np.uint64) for x in frame["a"]]
        words, at = np.unique(np.concatenate(asked), return_inverse=True)
        counts = np.bincount(at, np.concatenate([unpacked(x, np.uint32) for x in frame["b"]])).astype(np.uint64)
        part = int(frame["part"].iloc[0])
        seen = counts > 0
        out = [answer(1, part, -1, packed(words[seen]), packed(counts[seen])) | {"seen": int(seen.sum()), "total": int(counts.sum())}]
        for block, mine in zip(frame["block"], np.split(at, np.cumsum([len(x) for x in asked])[:-1])):
            out.append(answer(1, part, block, packed(counts[mine])))
        return pd.DataFrame(out)

    asked = table.select("block", "words", "counts").mapInPandas(ask, "part int, block bigint, a binary, b binary")
    return settled_clean(asked.groupBy("part").applyInPandas(add, ANSWER), "words")


class Level:
    """What a block knows of one order: per distinct n-gram its hash, context, word, training count and probability; ``at``: the n-gram of each token."""

    def __init__(self, hashes, at, counts, probability):
        self.hashes, self.at, self.counts, self.probability = hashes, at, counts, probability


class Block:
    """One block and, order by order, what it has been told."""

    def __init__(self, row, facts: dict):
        self.sizes = np.array(row["sizes"], dtype=np.int64)
        self.learn = np.repeat(np.array(row["learn"], dtype=bool), self.sizes)
        self.words = unpacked(row["words"], np.uint64)
        self.tokens = by_count(unpacked(row["counts"], np.uint32))[unpacked(row["tokens"], np.uint32)]
        self.first = np.cumsum(self.sizes) - self.sizes
        self.scale = facts["total"] + 0.5 * (facts["seen"] + 1)
        self.hot = np.uint64(facts["hot"])

    def unigrams(self, answers: pd.DataFrame) -> Level:
        counts = np.concatenate([unpacked(x, np.uint64) for x in answers.sort_values("part")["a"]])
        self.documents = counts[np.searchsorted(self.words, END)]
        return Level(self.words, self.tokens, counts, (counts + 0.5) / self.scale)

    def grams(self, low: Level) -> tuple[np.ndarray, ...]:
        """Distinct (context, word) pairs above ``low`` in the order of contexts; contexts are the n-grams of ``low``, the last one the start of a text."""
        before = np.empty(len(self.tokens), np.int64)
        before[1:] = low.at[:-1]
        before[self.first] = len(low.hashes)
        pairs, one, at = np.unique(before * len(self.words) + self.tokens, return_index=True, return_inverse=True)
        return pairs // len(self.words), pairs % len(self.words), one, at

    def contexts(self, low: Level) -> tuple[np.ndarray, np.ndarray]:
        """Hashes and training counts of contexts."""
        return np.append(low.hashes, START), np.append(low.counts, self.documents).astype(np.uint64)

    def request(self, low: Level, parts: int):
        """The n-grams above ``low`` by partition: (order, bounds, contexts by partition)."""
        context, word, one, at = self.grams(low)
        hashes, counts = self.contexts(low)
        spread = 1 + (counts // self.hot).astype(np.int64)
        salt = (self.words[word] % spread[context].astype(np.uint64))
        part = part_of(mixed(hashes[context] * CONTEXT + salt), parts)
        order = np.argsort(part, kind="stable")
        bounds = np.searchsorted(part[order], np.arange(parts + 1))
        # Contexts in several partitions are asked for in each of them.
        wide = np.unique(context[spread[context] > 1])
        extra = [(int(c), int(p)) for c in wide for p in np.unique(part_of(mixed(hashes[c] * CONTEXT + np.arange(spread[c], dtype=np.uint64)), parts))]
        return context, word, one, at, hashes, counts, order, bounds, extra


def split_by_part(block: Block, low: Level, parts: int):
    """For each partition: the rows of the block's n-grams there, and the contexts it wants sums of."""
    context, word, one, at, hashes, counts, order, bounds, extra = block.request(low, parts)
    more: dict[int, list[int]] = {}
    for c, p in extra:
        more.setdefault(p, []).append(c)
    slices = []
    for p in range(parts):
        rows = order[bounds[p]:bounds[p + 1]]
        wanted = np.unique(np.concatenate([context[rows], np.array(more.get(p, []), dtype=np.int64)]))
        if len(wanted):
            slices.append((p, rows, wanted))
    return context, word, one, at, hashes, counts, slices


def upto(row, told: pd.DataFrame, order: int, parts: int, facts: dict) -> tuple[Block, Level]:
    """The block with all levels up to ``order``, from the answers it was given."""
    block = Block(row, facts)
    level = block.unigrams(told[told["n"] == 1])
    for n in range(2, order + 1):
        answers = {int(r["part"]): r for r in told[told["n"] == n].to_dict("records")}
        context, word, one, at, hashes, below, slices = split_by_part(block, level, parts)
        counts = np.zeros(len(context), np.uint64)
        mass, repeats = np.zeros(len(hashes)), np.zeros((K, len(hashes)))
        for p, rows, wanted in slices:
            got = answers[p]
            counts[rows] = unpacked(got["a"], np.uint32)
            mass[wanted] += unpacked_floats(got["b"])
            repeats[:, wanted] += unpacked(got["c"], np.uint32).reshape(K, -1)
        lower = level.probability[level.at[one]]
        level = Level(mixed(hashes[context] * CONTEXT + block.words[word] * WORD), at, counts, backed_off(counts, below[context], lower, mass, repeats, context, facts["discounts"][n]))
    return block, level


def backed_off(counts, below, lower, mass, repeats, context, discounts) -> np.ndarray:
    """Pn of each n-gram from its count, its context's count and sums, and the lower-order probability."""
    r = np.arange(1, K + 1)
    freed = ((1 - discounts) * r) @ repeats
    freed = freed[context]
    none_left = freed <= 0
    events = np.where(none_left, below + 1.0, below.astype(np.float64))
    left = np.where(none_left, 1.0, freed) / np.maximum(events, 1)
    weight = np.where(below > 0, left / np.maximum(1 - mass[context], 1e-300), 1.0)
    factor = np.append(np.append(1.0, discounts), 1.0)[np.minimum(counts, K + 1).astype(np.int64)]
    return np.where(counts > 0, factor * counts / np.maximum(events, 1), weight * lower)


def good_turing(repeats: np.ndarray) -> np.ndarray:
    """Discounts of the counts 1 … K from how many n-grams have the counts 1 … K + 1.

    Where these numbers give no discount between 0 and 1, counts lose the constant
    n1 / (n1 + 2 n2), or one half if that is unknown.
    """
    n = repeats.astype(np.float64)
    r = np.arange(1, K + 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        top = (K + 1) * n[K] / n[0]
        d = ((r + 1) * n[1:] / n[:-1] / r - top) / (1 - top)
    if np.all(np.isfinite(d)) and np.all((d > 0) & (d <= 1)):
        return d
    lost = n[0] / (n[0] + 2 * n[1]) if n[0] > 0 and n[1] > 0 else 0.5
    return 1 - lost / r


def gram_counts(table: DataFrame, told: DataFrame, n: int, parts: int, facts: dict, turn: int, turns: int) -> DataFrame:
    """Counts of n-grams and sums of their contexts, as answers to the blocks and as the model's table of order ``n``.

    Covers every ``turns``-th partition, so that less is on its way at once.
    """
    def ask(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        for row in left.to_dict("records"):
            block, low = upto(row, right, n - 1, parts, facts)
            context, word, one, at, hashes, _, slices = split_by_part(block, low, parts)
            taught = np.bincount(at[block.learn], minlength=len(context)).astype(np.uint32)
            lower = low.probability[low.at[one]]
            for p, rows, wanted in slices:
                if p % turns == turn:
                    sizes = np.bincount(np.searchsorted(wanted, context[rows]), minlength=len(wanted)).astype(np.uint32)
                    out.append({"part": p, "block": row["block"], "a": packed(hashes[wanted]), "b": packed(sizes), "c": packed_words(block.words[word[rows]]),
                                "d": packed(taught[rows]), "e": packed_floats(lower[rows]) if n > 2 else packed(low.counts[word[rows]])})
        return pd.DataFrame(out, columns=["part", "block", "a", "b", "c", "d", "e"])

    def add(frame: pd.DataFrame) -> pd.DataFrame:
        wanted, sizes = [unpacked(x, np.uint64) for x in frame["a"]], [unpacked(x, np.uint32) for x in frame["b"]]
        asked = [np.repeat(w, s) for w, s in zip(wanted, sizes)]
        context, word = np.concatenate(asked), np.concatenate([unpacked_words(x) for x in frame["c"]])
        _, one, at = np.unique(mixed(context * CONTEXT + word * WORD), return_index=True, return_inverse=True)
        counts = np.bincount(at, np.concatenate([unpacked(x, np.uint32) for x in frame["d"]]), minlength=len(one)).astype(np.uint32)
        lower = np.concatenate([unpacked_floats(x) if n > 2 else unpacked(x, np.uint64) for x in frame["e"]])[one]
        if n == 2:
            lower = (lower + 0.5) / (facts["total"] + 0.5 * (facts["seen"] + 1))
        names = np.unique(np.concatenate(wanted))
        place = np.searchsorted(names, context[one])
        seen = counts > 0
        mass = np.bincount(place[seen], lower[seen], minlength=len(names))
        repeats = np.array([np.bincount(place[counts == r], minlength=len(names)) for r in range(1, K + 1)], dtype=np.uint32)
        part = int(frame["part"].iloc[0])
        kept = np.flatnonzero(seen)[np.argsort(context[one][seen], kind="stable")]
        own, sizes = np.unique(context[one][kept], return_counts=True)
        out = [answer(n, part, -1, packed(own), packed(sizes.astype(np.uint32)), packed_words(word[one][kept]), packed(counts[kept]))
               | {"seen": int(seen.sum()), "total": int(counts.sum()), "repeats": [int((counts == r).sum()) for r in range(1, K + 2)]}]
        for block, mine, want in zip(frame["block"], np.split(at, np.cumsum([len(x) for x in asked])[:-1]), wanted):
            spot = np.searchsorted(names, want)
            out.append(answer(n, part, block, packed(counts[mine]), packed_floats(mass[spot]), packed(np.ascontiguousarray(repeats[:, spot]).ravel())))
        return pd.DataFrame(out)

    asked = table.groupBy("block").cogroup(told.groupBy("block")).applyInPandas(ask, "part int, block bigint, a binary, b binary, c binary, d binary, e binary")
    return settled_clean(asked.groupBy("part").applyInPandas(add, ANSWER), f"grams{n}")


def scored(docs: DataFrame, learn: Column, key: str = "doc_id", text: str = "text", order: int = ORDER,
           block_chars: int = BLOCK_CHARS, part_entries: int = PART_ENTRIES, hot_events: int = HOT_EVENTS, turns: int = TURNS) -> DataFrame:
    """(key, learn, n_tokens, n_known, train_tokens, base_score, score) of every row; learns from the rows where ``learn`` holds."""
    kind = docs.select(key).schema[0].dataType.simpleString()
    table = blocks(docs, key, text, learn, block_chars)
    size = table.agg(F.coalesce(F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, b: a + b)), F.lit(0))).first()[0]
    parts = 1 + size // part_entries
    tables = [word_counts(table, parts)]
    model = tables[0].where("block = -1").agg(F.coalesce(F.sum("seen"), F.lit(0)), F.coalesce(F.sum("total"), F.lit(0))).first()
    facts = {"seen": model[0], "total": model[1], "hot": max(hot_events, int(HOT_SHARE * model[1])), "discounts": {}}
    told = tables[0].where("block >= 0")
    for n in range(2, order + 1):
        found = [gram_counts(table, told, n, parts, facts, i, turns) for i in range(turns)]
        tables.append(reduce(DataFrame.unionByName, found))
        sums = tables[-1].where("block = -1").agg(*[F.coalesce(F.sum(F.get("repeats", F.lit(r))), F.lit(0)) for r in range(K + 1)]).first()
        facts["discounts"][n] = good_turing(np.array(sums))
        told = told.unionByName(tables[-1].where("block >= 0"))

    def score(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        for row in left.to_dict("records"):
            block, top = upto(row, right, order, parts, facts)
            low = block.unigrams(right[right["n"] == 1])
            out.append(pd.DataFrame({
                "k": row["keys"], "learn": row["learn"], "n_tokens": block.sizes,
                "n_known": np.add.reduceat((low.counts > 0)[low.at].astype(np.int64), block.first), "train_tokens": facts["total"],
                "base_score": np.add.reduceat(np.log10(low.probability)[low.at], block.first),
                "score": np.add.reduceat(np.log10(top.probability)[top.at], block.first)}))
        return pd.concat(out)

    out = table.groupBy("block").cogroup(told.groupBy("block")).applyInPandas(
        score, f"k {kind}, learn boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")
    return out.withColumnRenamed("k", key)
