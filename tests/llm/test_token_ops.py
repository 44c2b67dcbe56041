"""Token files, packing and trie counts against the tokenizers themselves."""

import math
import zlib

import numpy as np
import pyarrow.parquet as pq
import public_tokenizers
from conftest import SMALL
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from evenfold.llm import packing, queries, token_files, trie_counts
from evenfold.llm.bestfit import CapacityTree, best_fit_decreasing
from evenfold.llm.tokens import WordEncoder

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
BYTE_WORDS, CLIP_WORDS = WordEncoder(BYTE, True), WordEncoder(WORD, False)
ODD = "ab É.,!?0 \n\t\x0b\x1c\x85\xa0　'stredm<|endoftext|>ß‍é̈Σς😀_-#"


def plain(path):
    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    return t


PLAIN = {BYTE: plain(BYTE), WORD: plain(WORD)}


def ids_of(path, text):
    return PLAIN[path].encode(text or "", add_special_tokens=False).ids


def digest(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@settings(max_examples=600, deadline=None)
@given(st.text(st.sampled_from(ODD), max_size=40) | st.text(max_size=30) | st.lists(st.sampled_from(["The", "don't", "a,", "x\ny", "", "élan!!", "1st", "\n\n", "B\n"]), max_size=12).map(" ".join))
def test_word_by_word_ids_are_those_of_the_text(text):
    text = text.encode("utf-8", "ignore").decode()
    for words, path in ((BYTE_WORDS, BYTE), (CLIP_WORDS, WORD)):
        assert np.frombuffer(words.encode(text), "<u4").tolist() == ids_of(path, text), text


def test_token_files_round_trip(spark, small):
    rows = queries.QUERIES["op5_token_files"](spark, SMALL).orderBy("doc_id").collect()
    start = 0
    texts = {r.doc_id: r.text for r in small.collect()}
    assert [r.doc_id for r in rows] == sorted(texts)
    for r in rows:
        ids = [*ids_of(BYTE, texts[r.doc_id]), 0]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), digest(ids))
        start += len(ids)


def test_token_files_have_bounded_row_groups_page_indexes_and_compact_codes(spark, small):
    path = token_files.new_folder(small, "tokens")
    token_files.write(small, path, BYTE, keep=("lang", "source"), row_group_bytes=200_000, page_bytes=20_000, page_rows=50)
    files = [f.removeprefix("file:") for f in spark.read.parquet(path).inputFiles()]
    metas = [pq.ParquetFile(f).metadata for f in files]
    columns = [m.row_group(g).column(c) for m in metas for g in range(m.num_row_groups) for c in range(m.num_columns)]
    assert sum(m.num_row_groups for m in metas) >= len(files)
    assert all(c.has_offset_index and c.has_column_index for c in columns)
    assert any("DICTIONARY" in e or "DELTA_BINARY_PACKED" in e for c in columns for e in c.encodings if "ids" in c.path_in_schema)
    numbers = token_files.read(spark, path, "doc_id").orderBy("file_number", "file_row").collect()
    assert [r.doc_id for r in numbers] == sorted(r.doc_id for r in numbers)
    assert "ids" not in spark.read.parquet(path).select("n_tokens")._jdf.queryExecution().executedPlan().toString()


def test_token_file_edges(spark, edges, nothing):
    for docs, n in ((edges, edges.count()), (nothing, 0)):
        path = token_files.new_folder(docs, "tokens")
        token_files.write(docs, path, BYTE)
        rows = token_files.with_starts(token_files.digests(token_files.read(spark, path, "doc_id", "n_tokens", "ids")), token_files.read(spark, path, "n_tokens")).collect()
        assert len(rows) == n
        ordered = sorted(rows, key=lambda r: r.start)
        assert all(a.start + a.n_tokens == b.start for a, b in zip(ordered, ordered[1:]))
        assert all(r.n_tokens == 1 for r in rows if r.doc_id in (1, 2))


def check_pieces(rows, texts):
    by_doc, windows = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        windows.setdefault(r.sequence_id, []).append(r)
    for k, own in by_doc.items():
        ids = [*ids_of(WORD, texts[k]), 1]
        at = 0
        for r in sorted(own, key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == digest(ids[at:at + r.length])
            at += r.length
        assert at == len(ids)
    for own in windows.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
    return windows


def test_packing_places_every_id_once(spark, small):
    rows = queries.QUERIES["op9_best_fit_packing"](spark, SMALL).collect()
    texts = {r.doc_id: r.text for r in small.collect()}
    windows = check_pieces(rows, texts)
    assert {r.doc_id for r in rows} == set(texts)
    pieces = sorted((r.length for r in rows), reverse=True)
    assert len(windows) == len(plain_best_fit(pieces, 2048))


def plain_best_fit(lengths, width):
    rooms = []
    for n in sorted(lengths, reverse=True):
        fits = [r for r in rooms if r >= n]
        if fits:
            rooms.remove(min(fits))
            rooms.append(min(fits) - n)
        else:
            rooms.append(width - n)
    return rooms


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 24), max_size=80))
def test_plan_is_best_fit_decreasing(lengths):
    counts = {n: lengths.count(n) for n in set(lengths)}
    steps, windows = best_fit_decreasing(counts, 24)
    rooms = [24] * windows
    ranks = {n: set() for n in counts}
    filled = {}
    for length, first, n, window, each, offset in steps.tolist():
        for i in range(n):
            ranks[length].add(first + i)
            filled.setdefault(window + i // each, []).append((offset + i % each * length, length))
            rooms[window + i // each] -= length
    assert all(ranks[n] == set(range(c)) for n, c in counts.items())
    assert sorted(rooms) == sorted(plain_best_fit(lengths, 24))
    for own in filled.values():
        assert [o for o, _ in sorted(own)] == [sum(x for _, x in sorted(own)[:i]) for i in range(len(own))]


@given(st.lists(st.integers(0, 40), max_size=20), st.integers(0, 40))
def test_tree_finds_the_tightest(capacities, wanted):
    tree = CapacityTree(40)
    for c in capacities:
        tree.set(c, True)
    assert tree.at_least(wanted) == min((c for c in capacities if c >= wanted), default=None)


def test_packing_edges(spark, edges, nothing):
    rows = packing.packed(edges, WORD).collect()
    assert sum(r.start == 0 for r in rows) == edges.count()
    assert sorted(r.doc_tokens for r in rows if r.doc_id in (1, 2)) == [1, 1]
    assert packing.packed(nothing, WORD).collect() == []


def test_padding_leaves_powers_of_two(spark):
    got = spark.createDataFrame([(1,), (3,), (1024,), (2048,), (1025,)], "n long").select(packing.padded_length(F.col("n")).alias("p")).collect()
    assert [r.p for r in got] == [1, 2048, 1024, 2048, 2048]


def plain_split(word, scores):
    marked = trie_counts.WORD_MARK + word
    best = [(0.0, 0)] + [(-math.inf, 0)] * len(marked)
    for end in range(1, len(marked) + 1):
        for start in range(end):
            piece = marked[start:end]
            cost, size = scores.get(piece), 1
            if cost is None and end - start == 1:
                size = len(piece.encode())
                cost = trie_counts.BYTE_SCORE * size
            if cost is not None:
                total, n = best[start][0] + cost, best[start][1] + size
                if total > best[end][0] or (total == best[end][0] and n < best[end][1]):
                    best[end] = (total, n)
    return best[-1][1], best[-1][0]


def test_trie_counts_are_those_of_each_word_alone(spark, small):
    scores = trie_counts.rank_scores(public_tokenizers.path("piece_bpe_32k.model"))
    words = sorted({w for r in small.where("doc_id < 60").collect() for w in (r.text or "").split(" ")})[:1500] + ["", "\U0001f600x", "aaaa"]
    got = trie_counts.PieceScores(scores).counts(words)
    for w in words[::3]:
        n, score = plain_split(w, scores)
        assert got[w][0] == n and abs(got[w][1] - score) < 1e-9


def test_trie_counts_of_texts(spark, small, edges, nothing):
    model = public_tokenizers.path("piece_bpe_32k.model")
    scores = trie_counts.rank_scores(model)
    memo = {}
    for r in trie_counts.token_counts(small.where("doc_id < 40"), model).join(small.select("doc_id", "text"), "doc_id").collect():
        words = trie_counts.space_split(r.text)
        for w in words:
            memo[w] = memo.get(w) or plain_split(w, scores)
        assert r.n_words == len(words) and r.n_tokens == sum(memo[w][0] for w in words)
    got = trie_counts.token_counts(edges, model).collect()
    assert len(got) == edges.count() and {r.n_tokens for r in got if r.doc_id in (1, 2, 3)} == {0}
    assert trie_counts.token_counts(nothing, model).collect() == []
