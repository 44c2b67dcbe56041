"""Document quality by Bradley-Terry pairwise ranking.

A pair prefers a document of label 1 to one of label 0. The logistic loss of score
differences is minimised over feature differences by Newton steps; scores are
linear in features of the whole text. The cut between predicted classes is the
quantile of scores at the share of label 0 among the labels learnt from.

The fit reads all labelled documents. They are dealt by hash to blocks of bounded size,
and every pair of both classes within a block counts, so pairs grow with the documents and
not with their square; a rarer class is dealt to several blocks. Passes over the blocks
add up slope and curvature, and the cut is an exact quantile of all learnt scores.
``fit_pairs`` is the same fit on arrays and random pairs.

Defined results: a null text is an empty one and gets a score too; ids with
conflicting labels, or labels other than 0 and 1, teach nothing; without documents
of both classes every score is one half; repeated documents are scored each;
label, language, source and id columns are never read for a score.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evenfold.llm.common import text_batches
from evenfold.session import settle

#: Rows of the larger class in a block, and the least of the rarer one; bins of a pass that looks for the cut.
BLOCK = 256
RARER = 64
BINS = 4_096
N_PAIRS = 40_000
RIDGE = 1e-3
STEPS = 12

SHAPES = ("log_words", "mean_word", "distinct_words", "distinct_lines", "upper_words", "compression", "longest_run", "line_length")
N_FEATURES = 129 + len(SHAPES)


def text_features(text: str | None) -> np.ndarray:
    """Square roots of ASCII byte shares and of the share of all other bytes, then the shape of the text."""
    out = np.zeros(N_FEATURES, dtype=np.float32)
    raw = (text or "").encode("utf-8", "surrogatepass")
    if not raw:
        return out
    codes = np.frombuffer(raw, dtype=np.uint8)
    counts = np.bincount(codes, minlength=256)
    out[:128] = counts[:128]
    out[128] = counts[128:].sum()
    out[:129] = np.sqrt(out[:129] / len(raw))
    words, lines = raw.split(), [x for x in raw.split(b"\n") if x]
    n = max(len(words), 1)
    change = np.flatnonzero(np.diff(codes)) + 1
    runs = np.diff(np.concatenate([[0], change, [len(codes)]]))
    out[129:] = (
        np.log1p(len(words)), np.log1p(len(raw) / n), len(set(words)) / n, len(set(lines)) / max(len(lines), 1),
        sum(map(bytes.isupper, words)) / n, len(zlib.compress(raw, 1)) / len(raw), np.log1p(runs.max()), np.log1p(len(raw) / max(len(lines), 1)),
    )
    return out


@dataclass(frozen=True)
class Ranking:
    """Scores are (features - centre) / scale times weights; ``cut`` is the score at which the classes part."""

    centre: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    cut: float

    def scores(self, features: np.ndarray) -> np.ndarray:
        return np.clip((features - self.centre) / self.scale, -8, 8) @ self.weights - self.cut


def fit_pairs(good: np.ndarray, bad: np.ndarray, share_bad: float, n_pairs: int = N_PAIRS, seed: int = 7) -> Ranking:
    """Newton's method on the mean of log(1 + exp(-w (good - bad))) over random pairs, with a small ridge."""
    d = N_FEATURES
    if not len(good) or not len(bad):
        return Ranking(np.zeros(d), np.ones(d), np.zeros(d), 0.0)
    both = np.concatenate([good, bad]).astype(np.float64)
    centre, scale = both.mean(axis=0), both.std(axis=0)
    scale = np.where(scale > 1e-6, scale, 1.0)
    flat = Ranking(centre, scale, np.eye(d), 0.0)
    rng = np.random.default_rng(seed)
    x = flat.scores(good)[rng.integers(len(good), size=n_pairs)] - flat.scores(bad)[rng.integers(len(bad), size=n_pairs)]
    w = np.zeros(d)
    for _ in range(STEPS):
        p = 1 / (1 + np.exp(np.clip(x @ w, -50, 50)))
        slope = -(x.T @ p) / n_pairs + RIDGE * w
        bend = (x.T * (p * (1 - p))) @ x / n_pairs + RIDGE * np.eye(d)
        move = np.linalg.solve(bend, slope)
        w = w - move * min(1.0, 5.0 / max(np.abs(move).max(), 1e-12))
        if np.abs(move).max() < 1e-6:
            break
    ranked = Ranking(centre, scale, w, 0.0)
    scores = np.concatenate([ranked.scores(good), ranked.scores(bad)])
    mass = np.concatenate([np.full(len(good), (1 - share_bad) / len(good)), np.full(len(bad), share_bad / len(bad))])
    return Ranking(centre, scale, w, weighted_quantile(scores, mass, share_bad))


def weighted_quantile(values: np.ndarray, mass: np.ndarray, share: float) -> float:
    """Halfway between the values on both sides of the point that has ``share`` of the mass below it."""
    order = np.argsort(values, kind="stable")
    values, below = values[order], np.cumsum(mass[order])
    at = min(int(np.searchsorted(below, share - 1e-9)), len(values) - 1)
    return float((values[at] + values[min(at + 1, len(values) - 1)]) / 2)


def training_labels(labels: DataFrame, learn_from: Column, key: str = "doc_id", quality: str = "quality") -> DataFrame:
    """(_id, _label): ids without a conflict among the rows to learn from."""
    return (
        labels.where(learn_from & F.col(key).isNotNull() & F.col(quality).isin(0, 1)).groupBy(F.col(key).alias("_id"))
        .agg(F.min(quality).alias("_label"), F.max(quality).alias("_max")).where("_label = _max").select("_id", "_label")
    )


def features_of(batch: pa.RecordBatch, column: str | int) -> np.ndarray:
    return np.array([text_features(t.as_py()) for t in batch.column(column)], dtype=np.float32).reshape(-1, N_FEATURES)


def stacked(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.float32).reshape(-1, N_FEATURES).astype(np.float64)


def total(rows: DataFrame, sums) -> np.ndarray:
    """``sums(batch)`` added over all batches of a table: in each partition first, then by Spark."""
    def part(batches):
        own = sum(sums(b) for b in batches if b.num_rows)
        if not np.isscalar(own):
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(own))), pa.array(own)], names=["cell", "v"])

    found = rows.mapInArrow(part, "cell bigint, v double").groupBy("cell").agg(F.sum("v").alias("v")).toArrow()
    out = np.zeros(found.num_rows)
    out[found.column("cell").to_numpy()] = found.column("v").to_numpy()
    return out


def fit(docs: DataFrame, labels: DataFrame, learn_from: Column, key: str = "doc_id", text: str = "text", quality: str = "quality") -> Ranking:
    """Learn from all labelled documents; only sums over them come to the driver."""
    known = settle(training_labels(labels, learn_from, key, quality).select("_id", "_label"), "quality_labels")

    def features(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("_id"), pa.array([r.tobytes() for r in features_of(batch, "_text")], pa.binary())], names=["_id", "_x"])

    # Features are a fraction of their texts, so they meet the labels and no text is moved.
    bodies = text_batches(docs.select(F.col(key).alias("_id"), F.col(text).alias("_text")))
    kind = bodies.schema["_id"].dataType.simpleString()
    rows = settle(bodies.mapInArrow(features, f"_id {kind}, _x binary").join(known, "_id").select("_id", F.col("_label").cast("int").alias("_label"), "_x"), "quality_features")
    sizes = {r["_label"]: r["n"] for r in rows.groupBy("_label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(sizes) < 2:
        return fit_pairs(np.empty((0, N_FEATURES)), np.empty((0, N_FEATURES)), 0.5)
    shares = {r["_label"]: r["n"] for r in known.groupBy("_label").agg(F.count(F.lit(1)).alias("n")).collect()}
    share_bad = shares[0] / (shares[0] + shares[1])

    n = sizes[0] + sizes[1]
    plain = rows.select("_x")
    centre = total(plain, lambda b: stacked(b.column(0)).sum(axis=0)) / n
    scale = np.sqrt(total(plain, lambda b: ((stacked(b.column(0)) - centre) ** 2).sum(axis=0)) / n)
    scale = np.where(scale > 1e-6, scale, 1.0)
    flat = Ranking(centre, scale, np.eye(N_FEATURES), 0.0)
    pairs = paired_blocks(rows, sizes)
    w, upper = np.zeros(N_FEATURES), np.triu_indices(N_FEATURES)
    for _ in range(STEPS):
        got = total(pairs, lambda b, w=w: block_sums(b, flat, w, upper))
        slope = got[1:N_FEATURES + 1] / got[0] + RIDGE * w
        bend = np.zeros((N_FEATURES, N_FEATURES))
        bend[upper] = got[N_FEATURES + 1:] / got[0]
        bend = bend + np.triu(bend, 1).T + RIDGE * np.eye(N_FEATURES)
        move = np.linalg.solve(bend, slope)
        w = w - move * min(1.0, 5.0 / max(np.abs(move).max(), 1e-12))
        if np.abs(move).max() < 1e-6:
            break
    ranked = Ranking(centre, scale, w, 0.0)
    return Ranking(centre, scale, w, cut_of(rows, ranked, sizes, share_bad))


def paired_blocks(rows: DataFrame, sizes: dict[int, int]) -> DataFrame:
    """Blocks of about ``BLOCK`` rows of the larger class and at least ``RARER`` of the other, settled.

    Every document of the larger class is in one block; one of the rarer class is in as many as it takes.
    """
    major = 1 if sizes[1] >= sizes[0] else 0
    n_blocks = -(-sizes[major] // BLOCK)
    times = min(n_blocks, -(-RARER * n_blocks // sizes[1 - major]))
    first = F.pmod(F.xxhash64("_id"), F.lit(n_blocks))
    copies = F.when(F.col("_label") == major, F.array(F.lit(0).cast("long"))).otherwise(F.sequence(F.lit(0).cast("long"), F.lit(times - 1).cast("long")))
    # Neighbouring copies of a document are spread evenly over the blocks.
    dealt = rows.select("_label", "_x", first.alias("_first"), F.explode(copies).alias("_copy")).select(
        F.pmod(F.col("_first") + F.floor(F.col("_copy") * F.lit(n_blocks) / F.lit(times)).cast("long"), F.lit(n_blocks)).alias("_block"), "_label", "_x")
    lists = [F.collect_list(F.when(F.col("_label") == c, F.col("_x"))).alias(name) for c, name in ((1, "good"), (0, "bad"))]
    return settle(dealt.groupBy("_block").agg(*lists).select("good", "bad"), "quality_pairs")


def block_sums(batch: pa.RecordBatch, flat: Ranking, w: np.ndarray, upper) -> np.ndarray:
    """Number of pairs, slope and curvature of the loss over all pairs of each block."""
    out = np.zeros(1 + N_FEATURES + len(upper[0]))
    for good, bad in zip(batch.column(0), batch.column(1), strict=True):
        g, b = (flat.scores(stacked(side.values)) for side in (good, bad))
        p = 1 / (1 + np.exp(np.clip((g @ w)[:, None] - (b @ w)[None, :], -50, 50)))
        q = p * (1 - p)
        both = g.T @ q @ b
        bend = (g.T * q.sum(axis=1)) @ g + (b.T * q.sum(axis=0)) @ b - both - both.T
        out += np.concatenate([[p.size], b.T @ p.sum(axis=0) - g.T @ p.sum(axis=1), bend[upper]])
    return out


def cut_of(rows: DataFrame, ranked: Ranking, sizes: dict[int, int], share: float) -> float:
    """``weighted_quantile`` of the scores of all rows, each class with its share of the mass; a bin that holds it is opened until it is small."""
    def score(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ranked.scores(stacked(batch.column(1))))], names=["_label", "_s"])

    scores = settle(rows.select("_label", "_x").mapInArrow(score, "_label int, _s double"), "quality_scores")
    mass = {1: (1 - share) / sizes[1], 0: share / sizes[0]}
    scores = scores.withColumn("_m", F.when(F.col("_label") == 1, mass[1]).otherwise(mass[0]))
    ends = scores.agg(F.min("_s").alias("lo"), F.max("_s").alias("hi")).first()
    lo, hi, below = ends["lo"], ends["hi"], 0.0
    while True:
        inside = scores.where(F.col("_s").between(lo, hi))
        bins = inside.groupBy(F.least(F.floor((F.col("_s") - lo) / max(hi - lo, 1e-300) * BINS), F.lit(BINS - 1)).alias("b")).agg(
            F.sum("_m").alias("m"), F.count(F.lit(1)).alias("n"), F.min("_s").alias("lo"), F.max("_s").alias("hi")).orderBy("b").collect()
        for k, r in enumerate(bins):
            if below + r["m"] >= share - 1e-9 or k == len(bins) - 1:
                break
            below += r["m"]
        lo, hi = r["lo"], r["hi"]
        if r["n"] <= BINS or lo == hi or len(bins) == 1:
            break
    if lo == hi and r["n"] > BINS:
        return float(lo)
    own = scores.where(F.col("_s").between(lo, hi)).orderBy("_s").select("_s", "_m").toArrow()
    values, upto = own.column("_s").to_numpy(), below + np.cumsum(own.column("_m").to_numpy())
    at = min(int(np.searchsorted(upto, share - 1e-9)), len(values) - 1)
    following = values[at + 1] if at + 1 < len(values) else scores.where(F.col("_s") > hi).agg(F.min("_s")).first()[0]
    return float((values[at] + (values[at] if following is None else following)) / 2)


def scored(docs: DataFrame, model: Ranking, text: str = "text") -> DataFrame:
    """Every row without its text, with ``_score`` between 0 and 1."""
    rest = [f for f in docs.schema if f.name != text]
    schema = T.StructType([*rest, T.StructField("_score", T.DoubleType())])
    body = docs.columns.index(text)

    def apply(batches):
        for batch in batches:
            x = np.array([text_features(t.as_py()) for t in batch.column(body)], dtype=np.float64).reshape(-1, N_FEATURES)
            score = 1 / (1 + np.exp(-np.clip(model.scores(x), -500, 500)))
            yield pa.RecordBatch.from_arrays([*[c for i, c in enumerate(batch.columns) if i != body], pa.array(score)], names=schema.names)

    return text_batches(docs).mapInArrow(apply, schema)


def accepted(docs: DataFrame, model: Ranking, text: str = "text") -> DataFrame:
    """The documents whose score reaches one half, with all their columns."""
    schema = docs.schema
    body = docs.columns.index(text)

    def keep(batches):
        for batch in batches:
            x = np.array([text_features(t.as_py()) for t in batch.column(body)], dtype=np.float64).reshape(-1, N_FEATURES)
            yield batch.filter(pa.array(model.scores(x) >= 0))

    return text_batches(docs).mapInArrow(keep, schema)
