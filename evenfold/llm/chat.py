"""Chat logs: collapse cumulative snapshots, then render what remains.

A log that stores a conversation anew after every turn holds many conversations
that are prefixes of longer ones. Each turn gets a hash of its position, role and
text; the sum of the hashes up to a turn (two independent sums of 64-bit hashes)
identifies the prefix that ends there. A conversation whose whole sum is the prefix
sum of a longer one is dropped by an anti join, and of equal conversations the
smallest id stays.

Sums can be taken in parts, so a conversation of any length is cut into blocks of
turns: sums within a block, then over blocks. The distinct prefix sums are combined
before the shuffle, so a first turn shared by a third of all rows is one row.

Defined results: turns are ordered by turn number, then role, then text, nulls
first; a null role or text is a value of its own in comparisons and renders as
nothing; repeated turns count each; rows with a null conversation id form one
conversation; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from evenfold.session import settle

BLOCK_TURNS = 256
PART_TURNS = 64


def _sum_before(value: str, keys: list[str], order: str) -> Column:
    return F.coalesce(F.sum(value).over(Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("decimal(20,0)"))


def positioned(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(c, block, place, pos, role, text) per turn: ``pos`` counts the turns of a conversation from 1, in blocks of turn numbers."""
    rows = turns.select(F.col(conv).alias("c"), F.col(turn).alias("turn"), F.col(role).alias("role"), F.col(text).alias("text"))
    rows = rows.withColumn("block", F.floor(F.coalesce(F.col("turn"), F.lit(-1)) / BLOCK_TURNS))
    placed = rows.withColumn("place", F.row_number().over(Window.partitionBy("c", "block").orderBy("turn", "role", "text")))
    sizes = rows.groupBy("c", "block").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select(F.col("c").alias("_c"), F.col("block").alias("_b"), _sum_before("n", ["c"], "block").cast("long").alias("_before"))
    joined = placed.join(before, F.col("c").eqNullSafe(F.col("_c")) & (F.col("block") == F.col("_b")))
    return joined.select("c", "block", "place", (F.col("_before") + F.col("place")).alias("pos"), "role", "text")


def prefix_sums(turns: DataFrame, **columns: str) -> DataFrame:
    """(c, pos, role, text, p1, p2): the sums that identify the first ``pos`` turns."""
    rows = positioned(turns, **columns)
    for i in (1, 2):
        rows = rows.withColumn(f"h{i}", F.xxhash64(F.lit(i), "pos", F.col("role").isNull(), "role", F.col("text").isNull(), "text").cast("decimal(20,0)"))
    rows = settle(rows, "turns")
    blocks = rows.groupBy("c", "block").agg(F.sum("h1").alias("h1"), F.sum("h2").alias("h2"))
    before = blocks.select(F.col("c").alias("_c"), F.col("block").alias("_b"), _sum_before("h1", ["c"], "block").alias("_p1"), _sum_before("h2", ["c"], "block").alias("_p2"))
    inside = Window.partitionBy("c", "block").orderBy("place")
    run = rows.select("*", F.sum("h1").over(inside).alias("_s1"), F.sum("h2").over(inside).alias("_s2"))
    joined = run.join(before, F.col("c").eqNullSafe(F.col("_c")) & (F.col("block") == F.col("_b")))
    return joined.select("c", "pos", "role", "text", (F.col("_s1") + F.col("_p1")).cast("decimal(38,0)").alias("p1"), (F.col("_s2") + F.col("_p2")).cast("decimal(38,0)").alias("p2"))


def maximal(sums: DataFrame) -> DataFrame:
    """(c, n): the conversations that are no prefix of a longer one, each once."""
    lengths = sums.groupBy("c").agg(F.max("pos").alias("n"))
    ends = lengths.withColumnRenamed("c", "_c").join(sums.select("c", "pos", "p1", "p2"), F.col("_c").eqNullSafe(F.col("c")) & (F.col("n") == F.col("pos"))).select("c", "n", "p1", "p2")
    once = ends.groupBy("n", "p1", "p2").agg(F.min("c").alias("c"))
    inner = sums.select("c", "pos", "p1", "p2").join(lengths.withColumnRenamed("c", "_c"), F.col("c").eqNullSafe(F.col("_c")) & (F.col("pos") < F.col("n"))).select(F.col("pos").alias("n"), "p1", "p2").distinct()
    return once.join(inner, ["n", "p1", "p2"], "left_anti").select("c", "n")


def rendered(sums: DataFrame, keep: DataFrame, part_turns: int = PART_TURNS) -> DataFrame:
    """(c, n_turns, part, text): the turns of the kept conversations in a chat template, ``part_turns`` turns to a row.

    A conversation is the concatenation of its parts; no conversation is gathered whole.
    """
    line = F.concat(F.lit("<|"), F.coalesce("role", F.lit("")), F.lit("|>\n"), F.coalesce("text", F.lit("")), F.lit("\n"))
    rows = sums.join(keep.withColumnRenamed("c", "_c"), F.col("c").eqNullSafe(F.col("_c"))).select("c", "n", F.floor((F.col("pos") - 1) / part_turns).alias("part"), "pos", line.alias("line"))
    parts = rows.groupBy("c", "n", "part").agg(F.array_sort(F.collect_list(F.struct("pos", "line"))).alias("lines"))
    return parts.select("c", F.col("n").alias("n_turns"), "part", F.array_join(F.transform("lines", lambda x: x["line"]), "").alias("text"))


def collapsed(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Rendered parts of every maximal conversation."""
    sums = settle(prefix_sums(turns, conv=conv, turn=turn, role=role, text=text), "prefixes")
    return rendered(sums, maximal(sums)).withColumnRenamed("c", conv)
