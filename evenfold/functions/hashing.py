"""Portable draws and fingerprints from md5."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def draw(*parts: Column) -> Column:
    """32 hash bits of the joined parts, the same in every engine that has md5."""
    text = F.concat_ws("|", *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def set_fingerprint(*columns: Column) -> list[Column]:
    """Order-free aggregate fingerprint of a row set of any size: count, sum and xor."""
    # 60 bits of md5, which every engine has; a null is told apart from any text.
    text = F.concat_ws("|", *[F.coalesce(c.cast("string"), F.lit("\\N")) for c in columns])
    h = F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")
    return [
        F.count(F.lit(1)).alias("n_rows"),
        F.sum(h.cast("decimal(38,0)")).cast("string").alias("hash_sum"),
        F.bit_xor(h).alias("hash_xor"),
    ]


def id_list_sha(key: Column) -> Column:
    """Aggregate sha256 of the sorted id list, for the small row sets of one fold."""
    return F.sha2(F.array_join(F.array_sort(F.collect_list(key.cast("string"))), ","), 256)
