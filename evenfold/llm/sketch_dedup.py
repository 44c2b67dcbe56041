"""Near-duplicate documents by fast similarity sketching, banding and exact verification.

A sketch has ``BINS`` coordinates. In each round every shingle is hashed to a bin
and a value, and bins that are still empty take the smallest value they are given;
in the last ``BINS`` rounds all shingles go to one bin each, so every coordinate is
filled. Coordinates of two sets agree with probability equal to their similarity,
with the concentration of independent hashes. Bands of equal coordinates give
candidates; a link is confirmed on the full shingle sets. At similarity 0.8 a pair
is missed by all bands with probability (1 - 0.8^4)^32 < 5e-8.

Texts with equal shingle sets are one class, named by its smallest key. Within a
band, classes are compared with one pivot per round instead of all with all; what
a round links is one component and is not compared again. Bands that still hold
several components then pass a prefix filter join (two sets of similarity s share
one of their rarest (1 - s) n + 1 shingles), which finds every remaining link.

Defined results: null and empty texts have no shingles and link with nothing; a
text of fewer words than a shingle is one shingle; rows without key are not linked
and have no component; rows of one key are judged by their own texts; equal rows
are copies of one another; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evenfold.llm.common import lower_space_words, matching, mixed, runs, settled_clean, text_batches

BINS = 128
BAND_ROWS = 4
PIVOT_ROUNDS = 1
EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)
#: Odd multipliers that tell the places of a shingle apart.
PLACES = mixed(np.arange(1, 65, dtype=np.uint64)) | np.uint64(1)
SEEDS = mixed(np.arange(1, 2 * BINS + 1, dtype=np.uint64))


def shingle_set(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of a text."""
    words = lower_space_words(text)
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    if len(h) < size:
        return mixed((h * PLACES[:len(h)]).sum(dtype=np.uint64, keepdims=True) + PLACES[63:64] * np.array([len(h)], np.uint64))
    n = len(h) - size + 1
    total = np.zeros(n, np.uint64)
    for i in range(size):
        total += h[i:i + n] * PLACES[i]
    return np.unique(mixed(total))


def similarity_sketches(sets: list[np.ndarray], bins: int = BINS) -> np.ndarray:
    """One row of ``bins`` coordinates per nonempty set; empty sets keep empty rows."""
    table = np.full(len(sets) * bins, EMPTY)
    flat = np.concatenate(sets) if sets else np.empty(0, np.uint64)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    for turn in range(2 * bins):
        if not len(flat):
            break
        value = mixed(flat + SEEDS[turn])
        place = (value & np.uint64(bins - 1)).astype(np.int64) if turn < bins else turn - bins
        slot = owner * bins + place
        free = table[slot] == EMPTY
        np.minimum.at(table, slot[free], value[free] >> np.uint64(1))
        unfilled = (table.reshape(-1, bins) == EMPTY).any(axis=1)[owner]
        flat, owner = flat[unfilled], owner[unfilled]
    return table.reshape(-1, bins)


def band_hashes(sketch: np.ndarray, rows: int = BAND_ROWS) -> np.ndarray:
    parts = sketch.reshape(len(sketch), -1, rows)
    total = np.arange(parts.shape[1], dtype=np.uint64)[None, :] + np.zeros((len(sketch), 1), np.uint64)
    for i in range(rows):
        total = mixed(total * PLACES[i] + parts[:, :, i])
    return total.view(np.int64)


def sketched(docs: DataFrame, key: str, text: str, shingle: int) -> DataFrame:
    """(k, n, f1, f2, bands): shingle count, 128-bit fingerprint of the set, and band hashes (none for an empty set)."""
    rows = docs.select(F.col(key).cast("long").alias("k"), F.col(text).alias("t"))

    def apply(batches):
        for batch in batches:
            n, f1, f2, bands = [], [], [], []
            for run in runs(batch.column("t"), 1_000_000):
                sets = [shingle_set(t, shingle) for t in run]
                hashes = band_hashes(similarity_sketches(sets))
                for s, h in zip(sets, hashes):
                    n.append(len(s))
                    f1.append(s.sum(dtype=np.uint64).view(np.int64))
                    f2.append(mixed(s + PLACES[0]).sum(dtype=np.uint64).view(np.int64))
                    bands.append(h if len(s) else h[:0])
            yield pa.RecordBatch.from_arrays(
                [batch.column("k"), pa.array(n, pa.int64()), pa.array(f1, pa.int64()), pa.array(f2, pa.int64()), pa.array(bands, pa.list_(pa.int64()))],
                names=["k", "n", "f1", "f2", "bands"])

    return text_batches(rows).mapInArrow(apply, "k bigint, n bigint, f1 bigint, f2 bigint, bands array<bigint>")


def full_sets(docs: DataFrame, ids: DataFrame, key: str, text: str, shingle: int) -> DataFrame:
    """(k, n, s): shingle sets of the rows whose key is in ``ids``."""
    rows = matching(docs.select(F.col(key).cast("long").alias("k"), F.col(text).alias("t")), ids, "k", "left_semi")

    def apply(batches):
        for batch in batches:
            sets = [shingle_set(t.as_py(), shingle).view(np.int64) for t in batch.column("t")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("k"), pa.array([len(s) for s in sets], pa.int64()), pa.array(sets, pa.list_(pa.int64()))], names=["k", "n", "s"])

    return text_batches(rows).mapInArrow(apply, "k bigint, n bigint, s array<bigint>").where("n > 0")


def alike(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets have at least ``percent`` hundredths of their union in common."""
    left = sets.select(F.col("k").alias("a"), F.col("n").alias("na"), F.col("s").alias("sa"))
    right = sets.select(F.col("k").alias("b"), F.col("n").alias("nb"), F.col("s").alias("sb"))
    sized = pairs.join(left.drop("sa"), "a").join(right.drop("sb"), "b").where(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")).select("a", "b").distinct()
    common = F.size(F.array_intersect("sa", "sb"))
    return sized.join(left, "a").join(right, "b").where(100 * common >= percent * (F.col("na") + F.col("nb") - common)).select("a", "b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(k, label): the smallest key that each key of ``edges`` (a, b) reaches, by alternating star contraction."""
    now = settled_clean(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    state = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = settled_clean(large.where("u <> v").distinct(), "edges")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        now = settled_clean(small.where("u <> v").distinct(), "edges")
        seen = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == state:
            break
        state = seen
    labels = now.select(F.col("u").alias("k"), F.col("v").alias("label"))
    return labels.unionByName(labels.select(F.col("label").alias("k"), "label").distinct())


def prefix_pairs(rest: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Candidate pairs among ``rest`` (k, label) of different labels, by a prefix join with positions.

    Shingles are put in one order, rarest first. Of a pair that is similar enough,
    the larger set has a common shingle among its first n - p n / 100 + 1 and the
    smaller among its first n - 2 p n / (100 + p) + 1. The first common shingle, at
    places i and j, leaves at most 1 + min(n - i, n' - j) in common, which must
    reach p (n + n') / (100 + p); at later common shingles less is left, so the test
    holds for each row of the join.
    """
    words = rest.join(sets, "k").select("k", "label", "n", F.explode("s").alias("w"))
    often = words.groupBy("w").agg(F.count(F.lit(1)).alias("c"))
    ranked = words.join(often.where("c > 1"), "w", "left")
    order = F.sort_array(F.collect_list(F.struct(F.coalesce("c", F.lit(1)).alias("c"), F.col("w").alias("w"))))
    listed = ranked.groupBy("k", "label", "n").agg(order.alias("o"))
    probe = (F.col("n") - F.ceil(F.col("n") * percent / 100) + 1).cast("int")
    placed = listed.select("k", "label", "n", F.posexplode(F.slice("o", F.lit(1), probe)).alias("i", "p")).where("p.c > 1")
    placed = settled_clean(placed.select("k", "label", "n", (F.col("i") + 1).alias("i"), F.col("p.w").alias("w")), "prefixes")
    x, y = placed.alias("x"), placed.where(F.col("i") <= F.col("n") - F.ceil(2 * percent * F.col("n") / (100 + percent)) + 1).alias("y")
    larger = (F.col("x.n") > F.col("y.n")) | ((F.col("x.n") == F.col("y.n")) & (F.col("x.k") > F.col("y.k")))
    left = 1 + F.least(F.col("x.n") - F.col("x.i"), F.col("y.n") - F.col("y.i"))
    enough = (100 + percent) * left >= percent * (F.col("x.n") + F.col("y.n"))
    return x.join(y, (F.col("x.w") == F.col("y.w")) & (F.col("x.label") != F.col("y.label")) & larger & enough).select(F.col("x.k").alias("a"), F.col("y.k").alias("b")).distinct()


def labelled(members: DataFrame, labels: DataFrame | None) -> DataFrame:
    """Members of bands that hold more than one component, with their labels."""
    if labels is None:
        return members.withColumn("label", F.col("k"))
    known = members.join(labels, "k", "left").withColumn("label", F.coalesce("label", "k"))
    mixed_bands = known.groupBy("band").agg(F.min("label").alias("_lo"), F.max("label").alias("_hi")).where("_lo < _hi").select("band")
    return known.join(mixed_bands, "band", "left_semi")


def links(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame | None:
    """Component labels (k, label) of the classes in ``members`` (band, k)."""
    found, labels = None, None
    for turn in range(PIVOT_ROUNDS):
        open_now = settled_clean(labelled(members, labels), "bands")
        # The first pivot is the smallest key; later ones are drawn, so that other members have their turn.
        draw = F.col("k") if turn == 0 else F.xxhash64("k", F.lit(turn))
        pivots = open_now.groupBy("band").agg(F.min(F.struct(draw.alias("d"), F.col("k").alias("a"), F.col("label").alias("l"))).alias("p")).select("band", "p.a", "p.l")
        pairs = open_now.join(pivots, "band").where("label <> l").select("a", F.col("k").alias("b")).distinct()
        new = settled_clean(alike(pairs, sets, percent), "links")
        if new.isEmpty():
            break
        found = new if found is None else found.unionByName(new)
        labels = settled_clean(components(found), "labels")
    rest = labelled(members, labels).select("k", "label").distinct()
    more = settled_clean(alike(prefix_pairs(rest, sets, percent), sets, percent), "links")
    if not more.isEmpty():
        labels = components(more if found is None else found.unionByName(more))
    return labels


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 5, percent: int = 80) -> DataFrame:
    """(key, n_shingles, component_id) for every row; component_id is the smallest key that links reach."""
    marks = settled_clean(sketched(docs, key, text, shingle), "sketches")
    classes = settled_clean(marks.where("n > 0 AND k IS NOT NULL").groupBy("n", "f1", "f2").agg(F.min("k").alias("rep")), "classes")
    named = classes.select(F.col("n").alias("_n"), F.col("f1").alias("_f1"), F.col("f2").alias("_f2"), "rep")
    same = (F.col("n") == F.col("_n")) & (F.col("f1") == F.col("_f1")) & (F.col("f2") == F.col("_f2"))
    bands = marks.join(named, same).where("k = rep").select("k", F.explode("bands").alias("band"))
    shared = bands.groupBy("band").agg(F.min("k").alias("_lo"), F.max("k").alias("_hi")).where("_lo < _hi").select("band")
    members = settled_clean(bands.join(shared, "band", "left_semi").distinct(), "members")
    ids = settled_clean(members.select("k").distinct(), "candidates")
    sets = settled_clean(full_sets(docs, ids, key, text, shingle), "sets")
    labels = links(members, sets, percent)
    rows = marks.drop("bands").join(named, same, "left").withColumn("rep", F.when((F.col("n") > 0) & F.col("k").isNotNull(), F.col("rep")).otherwise(F.col("k")))
    if labels is not None:
        rows = rows.join(labels.select(F.col("k").alias("rep"), "label"), "rep", "left").withColumn("rep", F.coalesce("label", "rep"))
    return rows.select(F.col("k").alias(key), F.col("n").alias("n_shingles"), F.col("rep").alias("component_id"))


def representatives(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 5, percent: int = 80) -> DataFrame:
    """One document of each component, that with the smallest key, with all its columns.

    Equal rows of one key are copies, of which one stays; rows without key all stay.
    """
    found = settled_clean(near_duplicates(docs, key, text, shingle, percent).select(F.col(key).alias("k"), "component_id"), "components")
    kept = matching(docs, settled_clean(found.where("k <> component_id").select("k").distinct(), "dropped"), key, "left_anti")
    repeated = settled_clean(found.where("k IS NOT NULL").groupBy("k").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("k"), "repeated")
    if repeated.isEmpty():
        return kept
    return matching(kept, repeated, key, "left_anti").unionByName(matching(kept, repeated, key, "left_semi").dropDuplicates([key, text]))
