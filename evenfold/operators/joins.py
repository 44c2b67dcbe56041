"""Joins with checked cardinality, nearest and range matches, matched conditions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from evenfold.operators.contracts import all_of, duplicates, require
from evenfold.operators.quantiles import value_bucket
from evenfold.session import settle


def one_to_one(a: DataFrame, b: DataFrame, on: list[str], how: str = "inner", check: bool = True) -> DataFrame:
    if check:
        require(all_of(duplicates(a, on), duplicates(b, on)), "one-to-one join")
    return a.join(b, on, how)


def many_to_one(facts: DataFrame, dimension: DataFrame, on: list[str], how: str = "inner", check: bool = True) -> DataFrame:
    if check:
        require(duplicates(dimension, on), "many-to-one join")
    return facts.join(dimension, on, how)


def lookup(df: DataFrame, mapping: DataFrame, key: str, value: str, out: str) -> DataFrame:
    """Value of each key in a mapping table, null for a key it does not have."""
    return df.join(mapping.select(key, F.col(value).alias(out)), key, "left")


def left_zero(df: DataFrame, counts: DataFrame, on: list[str], columns: list[str]) -> DataFrame:
    return df.join(counts, on, "left").fillna(0, columns)


def unmatched(a: DataFrame, b: DataFrame, on: list[str]) -> DataFrame:
    """Keys that only one side has."""
    left = a.select(*on).distinct().withColumn("_l", F.lit(True))
    right = b.select(*on).distinct().withColumn("_r", F.lit(True))
    both = left.join(right, on, "full_outer")
    side = F.when(F.col("_r").isNull(), "left").when(F.col("_l").isNull(), "right")
    return both.withColumn("only_in", side).where("only_in IS NOT NULL").select(*on, "only_in")


def side_by_side(df: DataFrame, other: DataFrame, key: list[str], columns: list[str], suffixes: tuple[str, str]) -> DataFrame:
    """The same rows under two scenarios, next to each other."""
    a = df.select(*key, *[c for c in df.columns if c not in key and c not in columns], *[F.col(c).alias(c + suffixes[0]) for c in columns])
    return a.join(other.select(*key, *[F.col(c).alias(c + suffixes[1]) for c in columns]), key)


# ------------------------------------------------------------------ one dimension

def nearest_distance(queries: DataFrame, train: DataFrame, scope: list[str], value: str, out: str = "distance") -> DataFrame:
    """Distance from every query value to the nearest training value of its scope.

    Works on distinct values: inside an order-preserving bucket the neighbours come from a
    window, beyond it from the bucket extremes, so no scope is put into one task. Both
    neighbours are running values, the upper one in falling order: a frame that ends at the
    end of its partition would be read again for every row. Null where the scope has no
    training value.
    """
    q = queries.select(*scope, F.col(value).cast("double").alias("_v")).distinct().withColumn("_t", F.lit(None).cast("double"))
    t = train.select(*scope, F.col(value).cast("double").alias("_v")).distinct().withColumn("_t", F.col("_v"))
    points = q.unionByName(t).withColumn("_b", value_bucket(F.col("_v"), 10))
    ends = points.groupBy(*scope, "_b").agg(F.min("_t").alias("_lo"), F.max("_t").alias("_hi"))
    before = Window.partitionBy(*scope).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy(*scope).orderBy(F.col("_b").desc()).rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select(*scope, "_b", F.max("_hi").over(before).alias("_below"), F.min("_lo").over(after).alias("_above"))
    rising = Window.partitionBy(*scope, "_b").orderBy("_v").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    falling = Window.partitionBy(*scope, "_b").orderBy(F.col("_v").desc()).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    near = (
        points.join(ends, [*scope, "_b"])
        .withColumn("_prev", F.coalesce(F.max("_t").over(rising), "_below"))
        .withColumn("_next", F.coalesce(F.min("_t").over(falling), "_above"))
        .where(F.col("_t").isNull())
        .select(*scope, "_v", F.least(F.col("_v") - F.col("_prev"), F.col("_next") - F.col("_v")).alias(out)))
    keyed = queries.withColumn("_v", F.col(value).cast("double"))
    return keyed.join(settle(near, "near"), [*scope, "_v"], "left").drop("_v")


def within_tolerance(queries: DataFrame, train: DataFrame, scope: list[str], value: str, tolerance: float,
                     out: str = "supported") -> DataFrame:
    """Whether a training value lies within ``tolerance``."""
    near = nearest_distance(queries, train, scope, value, "_d")
    return near.withColumn(out, F.coalesce(F.col("_d") <= tolerance, F.lit(False))).drop("_d")


# ------------------------------------------------------------------ several dimensions

def nearest_point_distance(queries: DataFrame, train: DataFrame, scope: list[str], dims: list[str], out: str = "distance",
                           leaf: int = 32, finest: int = 40) -> DataFrame:
    """Exact Euclidean distance to the nearest training point of the scope.

    Training points are put in nested grid cells. Every query starts with the coarsest
    cells, gets an upper bound from one real point of each cell and a lower bound from the
    cell's box, and follows only cells that may still hold the nearest point into the next
    level. Points are compared only in the last cells, which hold few distinct points.
    """
    def cell(level: int) -> Column:
        return F.array(*[F.floor(F.col(d) * (2.0**level)).cast("long") for d in dims])

    points = settle(train.select(*scope, *dims).distinct(), "points")
    wanted = settle(queries.select(*scope, *dims).distinct(), "wanted")
    spread = points.agg(*[F.max(F.abs(F.col(d))).alias(d) for d in dims]).first()
    top = max([abs(spread[d]) for d in dims if spread[d] is not None] or [1.0])
    level = 0
    while top * 2.0**level > 1.0:
        level -= 1
    best = F.min(F.least("_up", "_bound")).over(Window.partitionBy(*scope, *dims))
    state = wanted.select(*scope, *dims, F.lit(float("inf")).alias("_bound"))
    parent: int | None = None
    while True:
        boxes = points.groupBy(*scope, *([cell(parent).alias("_p")] if parent is not None else []), cell(level).alias("_c")).agg(
            F.count(F.lit(1)).alias("_n"), F.min(F.struct(*dims)).alias("_one"),
            *[F.min(d).alias(f"_lo_{d}") for d in dims], *[F.max(d).alias(f"_hi_{d}") for d in dims])
        boxes = settle(boxes, "boxes")
        keys = [*scope, "_p"] if parent is not None else scope
        pairs = state.join(boxes, keys)
        up = F.lit(0.0)
        low = F.lit(0.0)
        for d in dims:
            up = up + F.pow(F.col(d) - F.col(f"_one.{d}"), F.lit(2.0))
            gap = F.greatest(F.col(f"_lo_{d}") - F.col(d), F.col(d) - F.col(f"_hi_{d}"), F.lit(0.0))
            low = low + gap * gap
        pairs = pairs.withColumns({"_up": up, "_low": low}).where(F.col("_low") <= F.col("_bound"))
        pairs = pairs.withColumn("_best", best).where(F.col("_low") <= F.col("_best"))
        biggest = boxes.agg(F.max("_n").alias("n")).first()["n"]
        state = settle(pairs.select(*scope, *dims, F.col("_best").alias("_bound"), F.col("_c").alias("_p")), "state")
        parent = level
        if biggest is None or biggest <= leaf or level >= finest:
            break
        level += 2
    last = points.select(*scope, cell(parent).alias("_p"), *[F.col(d).alias(f"_t_{d}") for d in dims])
    square = F.lit(0.0)
    for d in dims:
        square = square + F.pow(F.col(d) - F.col(f"_t_{d}"), F.lit(2.0))
    found = state.join(last, [*scope, "_p"]).groupBy(*scope, *dims).agg(F.sqrt(F.min(square)).alias(out))
    return queries.join(settle(found, "found"), [*scope, *dims], "left")


# ------------------------------------------------------------------ matched conditions

def matched_conditions(df: DataFrame, level: str, key_sets: dict[str, list[str]]) -> DataFrame:
    """For each pair of levels: condition cells seen under both, and the rows in them.

    Rows are counted per (condition, level) first; a condition then lists its levels, of
    which there are as many as the factor has.
    """
    names = df.agg(F.array_sort(F.collect_set(level)).alias("_all"))
    pairs = names.select(F.explode("_all").alias("level_a"), "_all").select(
        "level_a", F.explode("_all").alias("level_b")).where("level_a < level_b")
    parts = []
    for scope, keys in key_sets.items():
        cells = df.groupBy(*keys, level).agg(F.count(F.lit(1)).alias("_n"))
        lists = cells.groupBy(*keys).agg(F.collect_list(F.struct(F.col(level).alias("l"), F.col("_n").alias("n"))).alias("_levels"))
        both = (
            lists.where(F.size("_levels") > 1)
            .select("_levels", F.explode("_levels").alias("a")).select("a", F.explode("_levels").alias("b"))
            .where("a.l < b.l"))
        found = both.groupBy(F.col("a.l").alias("level_a"), F.col("b.l").alias("level_b")).agg(
            F.count(F.lit(1)).alias("matched_cells"), F.sum("a.n").alias("rows_a"), F.sum("b.n").alias("rows_b"))
        counts = left_zero(pairs, found, ["level_a", "level_b"], ["matched_cells", "rows_a", "rows_b"])
        parts.append(counts.withColumn("scope", F.lit(scope)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
