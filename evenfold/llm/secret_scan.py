"""Secrets in documents: an inverted index of byte trigrams narrows each rule to the documents that can match it.

The index is a table of postings (segment, gram, docs). A segment is a run of documents of
a few megabytes; ``docs`` are the places in it of the documents that hold the trigram, and
the row with gram -1 lists their keys. A file is sorted by trigram, so that a search reads
the pages of its own trigrams only, whatever else is indexed. No posting list spans
segments: a trigram of every document is as many short lists as there are segments.

A rule's expression gives a Boolean query of trigrams (``trigrams.query_of``). The query is
a tree of intersections and unions of posting lists, taken segment by segment; documents
that come out are verified with the expression itself. Rules whose query says nothing, such
as a run of hexadecimal digits, are tried on every document. Verification alone decides, so
spans are the same as without the index.

Kinds: assign, access and hex are the base ones; further rules know forms of well-known
tokens. Offsets are code points, ends exclusive; matches of one kind do not overlap. A match
that is too short is dropped and its text not tried again.

Defined results: a null or empty text has no spans; a text of any length is read whole;
rows that share a key are candidates together, so each is verified on its own text, and
repeated rows get the same spans; a null key is a key; spans that begin at the same place
are listed by kind; an empty table gives an empty index and an empty result; other columns
are not read, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from operator import or_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evenfold.llm import trigrams as G
from evenfold.llm.common import runs, small_side, text_batches
from evenfold.llm.token_files import new_folder
from evenfold.session import settle


@dataclass(frozen=True)
class Rule:
    """Matches of ``pattern`` (ASCII rules) whose ``group`` has ``least`` characters or more."""

    kind: str
    pattern: str
    least: int = 1
    group: int = 0


# The base patterns and their least lengths.
BASE = (
    Rule("assign", r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 8, 1),
    Rule("access", r"AKIA[A-Z0-9]+", 16),
    Rule("hex", r"[0-9a-f]{32,}", 32),
)

#: Forms of keys that their issuers publish.
FURTHER = (
    Rule("pem", r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----"),
    Rule("github", r"\bgh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"\bxox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"\bAIza[A-Za-z0-9_-]{35,}"),
    Rule("stripe", r"\b[sr]k_(?:live|test)_[A-Za-z0-9]{16,}"),
    Rule("jwt", r"\beyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+"),
    Rule("login", r"\b[a-z][a-z0-9+.-]*://[^\x09-\x0D\x20:/@]+:[^\x09-\x0D\x20:/@]+@"),
)
RULES = BASE + FURTHER

#: Bytes of text in a segment, apart from a longer text, which is a segment of its own.
SEGMENT = 3_000_000
PLACE_BITS = 20
LOWER = np.frombuffer(bytes(range(256)).lower(), dtype=np.uint8)
KEYS_ROW = -1
#: Rows of a page, the unit a search skips; and so many values at most reach the pages' statistics as a set.
PAGE_ROWS = 500
PUSHED_VALUES = 10


def posting_lists(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(grams, offsets, places): for each trigram of the texts, in order, the places of the texts that hold it."""
    parts = []
    for place, text in enumerate(texts):
        data = LOWER[np.frombuffer((text or "").encode("utf-8", "surrogatepass"), dtype=np.uint8)]
        for start in range(0, max(len(data) - 2, 0), SEGMENT):
            cut = data[start:start + SEGMENT + 2].astype(np.uint32)
            grams = np.unique(cut[:-2] << np.uint32(16) | cut[1:-1] << np.uint32(8) | cut[2:])
            parts.append(grams.astype(np.int64) << PLACE_BITS | place)
    pairs = np.unique(np.concatenate(parts)) if parts else np.empty(0, dtype=np.int64)
    grams = pairs >> PLACE_BITS
    first = np.flatnonzero(np.diff(grams, prepend=-1))
    return grams[first].astype(np.int32), np.append(first, len(pairs)).astype(np.int32), (pairs & ((1 << PLACE_BITS) - 1)).astype(np.int32)


def indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Index rows (segment, gram, docs, keys) of the segments of a task's documents."""
    from pyspark import TaskContext

    segment = TaskContext.get().partitionId() << 32
    for batch in batches:
        keys, start = batch.column(0), 0
        for texts in runs(batch.column(1), SEGMENT):
            own = keys.slice(start, len(texts))
            start += len(texts)
            grams, offsets, places = posting_lists(texts)
            n = len(grams)
            yield pa.record_batch({
                "segment": pa.array(np.full(n + 1, segment), pa.int64()), "gram": pa.array(np.append(KEYS_ROW, grams), pa.int32()),
                "docs": pa.ListArray.from_arrays(pa.array(np.append(0, offsets), pa.int32()), pa.array(places)),
                "keys": pa.ListArray.from_arrays(pa.array([0, len(own), *[len(own)] * n], pa.int32()), own)})
            segment += 1


def write_index(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> None:
    """Write the trigram index of ``docs``, sorted by trigram in each file."""
    kind = docs.schema[key].dataType.simpleString()
    rows = text_batches(docs.select(key, text)).mapInArrow(indexed, f"segment bigint, gram int, docs array<int>, keys array<{kind}>")
    rows.sortWithinPartitions("gram").write.option("compression", "zstd").option("parquet.page.row.count.limit", PAGE_ROWS).parquet(path)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def places(query: G.Query, lists: Column) -> Column:
    """The places of a segment that fulfil ``query``; ``lists`` maps its trigrams to posting lists."""
    if isinstance(query, int):
        return F.coalesce(F.try_element_at(lists, F.lit(query)), F.expr("cast(array() as array<int>)"))
    return reduce(F.array_intersect if query[0] == "and" else F.array_union, [places(p, lists) for p in query[1]])


def hits_of(docs: Column, rule: int) -> Column:
    """Places as structs (place, rule), the rule as its bit."""
    return F.transform(docs, lambda p: F.struct(p.alias("place"), F.lit(1 << rule).cast("long").alias("rule")))


def candidates(index: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """(key, rules): the keys of documents that a rule must be tried on, with one bit for each of ``rules``.

    Rules without a trigram query are not listed; they are tried on all documents.
    """
    queries = {i: q for i, q in enumerate(G.query_of(r.pattern) for r in rules) if q != G.ANY}
    wanted = set().union(*[G.grams_of(q) for q in queries.values()])
    listed_grams = [KEYS_ROW, *sorted(wanted)]
    pushed = [F.col("gram").isin(listed_grams[i:i + PUSHED_VALUES]) for i in range(0, len(listed_grams), PUSHED_VALUES)]
    read = index.where(reduce(or_, pushed))
    one = read.groupBy("segment").agg(
        F.map_from_entries(F.collect_list(F.when(F.col("gram") != KEYS_ROW, F.struct("gram", "docs")))).alias("lists"),
        F.max_by("keys", F.when(F.col("gram") == KEYS_ROW, 1)).alias("keys"))
    found = [hits_of(places(q, F.col("lists")), i) for i, q in queries.items()]
    hits = one.select("keys", F.explode(F.concat(*found)).alias("hit")) if found else one.select("keys", F.expr("named_struct('place', 0, 'rule', 0L)").alias("hit")).limit(0)
    return hits.select(F.get("keys", F.col("hit.place")).alias("key"), "hit.rule").groupBy("key").agg(F.bit_or("rule").alias("rules"))


def verified(rules: tuple[Rule, ...], text: str, mask: int) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the matches of the rules in ``mask``, in order; kind is the rule's place."""
    out = []
    for i, rule in enumerate(rules):
        if mask >> i & 1:
            for m in re.compile(rule.pattern, re.ASCII).finditer(text):
                if m.end(rule.group) - m.start(rule.group) >= rule.least:
                    out.append((m.start(), i, m.end()))
    return sorted(out)


def found_secrets(docs: DataFrame, index: DataFrame, rules: tuple[Rule, ...] = RULES, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, spans): the spans (start, kind, end) of every row of ``docs``, whose index is ``index``."""
    always = sum(1 << i for i, r in enumerate(rules) if G.query_of(r.pattern) == G.ANY)
    few = settle(candidates(index, rules), "candidates")
    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("t"))
    rows = rows.join(small_side(few, 2 * few.count()), F.col("k").eqNullSafe(F.col("key")), "left")
    rows = rows.select("k", "t", (F.coalesce("rules", F.lit(0)).bitwiseOR(F.lit(always))).alias("rules"))
    kind = docs.schema[key].dataType.simpleString()
    spans = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())]))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[dict(zip(("start", "kind", "end"), s, strict=True)) for s in verified(rules, t.as_py() or "", m.as_py())]
                     for t, m in zip(batch.column(1), batch.column(2), strict=True)]
            yield pa.record_batch({"key": batch.column(0), "spans": pa.array(found, spans)})

    return text_batches(rows).mapInArrow(verify, f"key {kind}, spans array<struct<start: int, kind: int, end: int>>")


def of_kinds(spans: Column, first: int, last: int) -> Column:
    """The spans of the rules from place ``first`` to ``last``."""
    return F.filter(spans, lambda s: s["kind"].between(first, last))


def listed(spans: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """kind:start:end of spans, comma-joined."""
    names = F.array(*[F.lit(r.kind) for r in rules])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, spans) of all rows, through an index made for it."""
    path = new_folder(docs, "trigrams")
    write_index(docs, path, key, text)
    return found_secrets(docs, read_index(docs.sparkSession, path), rules, key, text)
