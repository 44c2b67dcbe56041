"""Near-dedup, decontamination, the classifier and the pipeline against plain versions."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from conftest import SMALL
from pyspark.sql import functions as F

import corpus_pipeline
from evenfold.llm import decontaminate, pairwise_quality, queries, sketch_dedup
from evenfold.llm.common import lower_space_words


def shingles(text, size):
    words = lower_space_words(text)
    return {tuple(words[i:i + size]) for i in range(len(words) - size + 1)} if len(words) >= size else {tuple(words)} - {()}


def plain_components(texts, size, percent=80):
    sets = {k: shingles(t, size) for k, t in texts.items()}
    root = {k: k for k in texts}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    keys = sorted(texts)
    for i, a in enumerate(keys):
        for b in keys[i + 1:]:
            common = len(sets[a] & sets[b])
            if common and 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {k: find(k) for k in texts}


def near_copies(n, edits, seed=3):
    rng = random.Random(seed)
    base = [f"w{rng.randrange(10**6)}" for _ in range(150)]
    out = []
    for _ in range(n):
        words = list(base)
        for _ in range(rng.randrange(edits + 1)):
            words[rng.randrange(len(words))] = f"n{rng.randrange(10**6)}"
        out.append(" ".join(words))
    return out


@pytest.mark.parametrize("size", [4, 5])
def test_components_of_dense_groups(spark, size):
    texts = dict(enumerate(near_copies(120, 9) + near_copies(60, 3, seed=5) + ["a b", "A B", "", "a b c", "  "] * 2))
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.component_id for r in sketch_dedup.near_duplicates(docs, shingle=size).collect()}
    assert got == plain_components(texts, size)
    kept = {r.doc_id for r in sketch_dedup.representatives(docs, shingle=size).collect()}
    assert kept == set(plain_components(texts, size).values())


def test_sketches_fill_and_estimate_similarity():
    rng = np.random.default_rng(1)
    pool = rng.integers(0, 2**63, 1400).astype(np.uint64)
    sets = [np.unique(pool[:1000]), np.unique(pool[200:1200]), np.unique(pool[:3]), pool[:1], pool[:0]]
    table = sketch_dedup.similarity_sketches(sets)
    assert (table[:4] != sketch_dedup.EMPTY).all() and (table[4] == sketch_dedup.EMPTY).all()
    assert abs((table[0] == table[1]).mean() - 800 / 1200) < 0.15
    assert (sketch_dedup.similarity_sketches([sets[1]])[0] == table[1]).all()


def test_near_duplicate_edges(edges, nothing):
    got = sketch_dedup.near_duplicates(edges).collect()
    assert len(got) == edges.count()
    by = {r.doc_id: r for r in got}
    assert by[7].component_id == 6 and by[10].component_id == by[11].component_id == 9 and by[2].component_id == 2 and by[None].component_id is None
    kept = sketch_dedup.representatives(edges)
    assert kept.columns == edges.columns and kept.where("doc_id = 8").count() == 1 and kept.where("doc_id IS NULL").count() == 2
    assert sketch_dedup.near_duplicates(nothing).collect() == [] and sketch_dedup.representatives(nothing).collect() == []


def plain_hits(text, items, width=10):
    words, hit, found = decontaminate.plain_words(text), set(), set()
    for item, body in items:
        own = decontaminate.plain_words(body)
        for s in range(max(1, len(own) - width + 1)) if own else ():
            window = own[s:s + width]
            for p in range(len(words) - len(window) + 1):
                if words[p:p + len(window)] == window:
                    hit |= set(range(p, p + len(window)))
                    found.add(item)
    return len(words), len(hit), found


ITEMS = [(1, "Alpha beta GAMMA delta, epsilon zeta eta theta iota kappa lambda mu nu"), (2, "short item"), (3, "alpha beta gamma delta epsilon zeta eta theta iota kappa"), (4, ""), (5, None), (None, "secret words"), (7, "short item"), (8, "ß é ñ")]
TEXTS = ["x alpha beta gamma delta epsilon zeta eta theta iota kappa lambda y", "short item short item", "short-item. SHORT ITEM", "alpha beta gamma", "", None, "secret words here", "ß é ñ ß é ñ",
         "nu " + ITEMS[0][1] + " " + ITEMS[0][1], "short", "item short"]


@pytest.mark.parametrize("block", [10**6, 40])
def test_matches_are_those_of_plain_search(spark, block):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = {r.doc_id: r for r in decontaminate.contamination(decontaminate.matches(docs, bench, block_chars=block)).collect()}
    for k, text in enumerate(TEXTS):
        n, hit, found = plain_hits(text, ITEMS)
        assert (got[k].n_words, got[k].n_hit, set(got[k]["items"])) == (n, hit, {str(i) for i in found if i is not None})
        assert got[k].contaminated == (hit > 0)
    long = [m for m in got[0].matches if m.item_id == 1]
    assert [(m.doc_start, m.length, m.item_start) for m in long] == [(1, 11, 0)]
    clean = {r.doc_id for r in decontaminate.clean(docs, bench, block_chars=block).collect()}
    assert clean == {k for k, t in enumerate(TEXTS) if not plain_hits(t, ITEMS)[1]}


def test_match_edges(spark, edges, nothing):
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert decontaminate.clean(edges, bench).columns == edges.columns and decontaminate.clean(edges, bench).count() == edges.count()
    assert decontaminate.matches(edges, bench).count() == edges.count()
    assert decontaminate.matches(nothing, bench).collect() == [] and decontaminate.clean(edges, bench.limit(0)).count() == edges.count()


def test_held_out_quality(spark):
    sf = SMALL.replace("0.001", "0.01")
    got = queries.QUERIES["op4_pairwise_quality"](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").collect()
    assert np.mean([r.predicted == r.quality for r in got]) >= 0.95
    good, bad = [r.score for r in got if r.quality == 1], [r.score for r in got if r.quality == 0]
    assert np.mean([g > b for g in good for b in bad]) >= 0.97


def test_quality_edges(spark, edges, nothing):
    labels = spark.createDataFrame([(6, 1), (8, 0), (9, 1), (9, 0), (None, 1), (12, None), (13, 7)], "doc_id long, quality int")
    everything = F.lit(True)
    model = pairwise_quality.fit(edges, labels, everything)
    got = pairwise_quality.scored(edges.select("doc_id", "text"), model).collect()
    assert len(got) == edges.count() and all(0 <= r._score <= 1 for r in got)
    flat = pairwise_quality.fit(edges, labels.limit(0), everything)
    assert {r._score for r in pairwise_quality.scored(edges.select("doc_id", "text"), flat).collect()} == {0.5}
    assert pairwise_quality.accepted(edges, flat).columns == edges.columns and pairwise_quality.accepted(nothing, model).collect() == []


def test_pairs_teach_the_order():
    rng = np.random.default_rng(0)
    good, bad = rng.normal(0, 1, (300, pairwise_quality.N_FEATURES)), rng.normal(0, 1, (200, pairwise_quality.N_FEATURES))
    good[:, 5] += 3
    model = pairwise_quality.fit_pairs(good, bad, 0.4)
    assert np.mean(model.scores(good)[:200] > model.scores(bad)) > 0.9
    assert abs(np.mean(np.concatenate([model.scores(good)] * 1 + [model.scores(bad)]) < 0) - 0.4) < 0.05


def test_every_labelled_document_teaches(spark, monkeypatch):
    """Blocks hold all documents, the rarer class in each of them; the cut is the quantile of all scores."""
    monkeypatch.setattr(pairwise_quality, "BLOCK", 20)
    monkeypatch.setattr(pairwise_quality, "RARER", 3)
    rng = np.random.default_rng(6)
    rows = [(i, int(i % 12 != 0), ("Some words of text. " if i % 12 else "%% 123 || ") * int(rng.integers(1, 9)) + "ab" * int(rng.integers(0, 5))) for i in range(300)]
    docs = spark.createDataFrame([(i, t) for i, _, t in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, q) for i, q, _ in rows], "doc_id long, quality int")
    blocks, made = [], pairwise_quality.paired_blocks
    monkeypatch.setattr(pairwise_quality, "paired_blocks", lambda *a: (blocks.append(made(*a)), blocks[-1])[1])
    model = pairwise_quality.fit(docs, labels, F.lit(True))
    held = [(len(r.good), len(r.bad)) for r in blocks[0].collect()]
    assert sum(g for g, _ in held) == 275 and sum(b for _, b in held) >= 25 and np.mean([b > 0 for _, b in held]) > 0.8
    x = np.array([pairwise_quality.text_features(t) for _, _, t in rows], dtype=float)
    scores, good = model.scores(x), np.array([q for _, q, _ in rows]) == 1
    assert scores[good].min() > 0 > scores[~good].max()
    plain = pairwise_quality.weighted_quantile(scores, np.full(300, 1 / 300), 25 / 300)
    assert abs(plain) < 1e-9


def test_pipeline_stages(spark, small):
    docs, kept = small, {}
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.settle(stage(spark, docs, SMALL), name)
        kept[name] = docs
        if name != "packing":
            assert docs.columns == small.columns
    accepted = {r.doc_id for r in queries.QUERIES["op4_pairwise_quality"](spark, SMALL).where("predicted = 1").collect()}
    texts = {r.doc_id: r.text for r in small.collect() if r.doc_id in accepted}
    assert {r.doc_id for r in kept["quality"].collect()} == accepted
    unique = {k: t for k, t in texts.items() if k in set(plain_components(texts, 5).values())}
    assert {r.doc_id for r in kept["near_dedup"].collect()} == set(unique)
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    clean = {k for k, t in unique.items() if not plain_hits(t, bench)[1]}
    assert {r.doc_id for r in kept["decontamination"].collect()} == clean == {r.doc_id for r in kept["pii"].collect()}
    assert {r.doc_id for r in kept["packing"].collect()} == clean
    assert kept["packing"].groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 2048").isEmpty()


def test_pipeline_edges(spark, edges, nothing):
    for docs in (edges, nothing):
        out = docs
        for name, stage in corpus_pipeline.STAGES:
            out = corpus_pipeline.settle(stage(spark, out, SMALL), name)
        assert docs is edges or out.collect() == []


def test_remainder_is_that_of_crc32(spark):
    got = spark.range(50).select("id", queries.remainder_of_id(F.col("id"), 3).alias("r")).collect()
    assert all(r.r == zlib.crc32(str(r.id).encode()) % 3 for r in got)


def test_pipeline_stages_send_small_batches(spark):
    own = spark.newSession()
    docs = own.range(0, 40, 1, 1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("word "), 60_000).alias("text"))

    def sizes(batches):
        yield pa.RecordBatch.from_arrays([pa.array([b.nbytes for b in batches])], names=["n"])

    decontaminate.text_batches(docs)  # an operator alone, in the same session before
    corpus_pipeline.decontamination(own, docs, SMALL)
    assert max(r["n"] for r in docs.mapInArrow(sizes, "n bigint").collect()) < 3_000_000
