"""Counts of waiting predictions kept inside a stream, over restarts."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from evenfold.streaming import jobs as J
from evenfold.streaming import pending as PD

DAY = datetime(2024, 1, 1)
SCHEMA = "id string, at timestamp, seen boolean"


def minute(n):
    return DAY + timedelta(minutes=n)


class Feed:
    """A folder of arrivals that one stream reads, a run per added file, from one checkpoint."""

    def __init__(self, spark, path):
        self.spark, self.path = spark, path

    def run(self, rows):
        self.spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{self.path}/in")
        stream = self.spark.readStream.schema(SCHEMA).parquet(f"{self.path}/in")
        changes = PD.follow(stream.where("NOT seen"), stream.where("seen"), "id", "at", "at", 60 * 60_000, "10 minutes")
        J.write_available(changes, f"{self.path}/out", f"{self.path}/log").awaitTermination()
        return self.spark.read.parquet(f"{self.path}/out")

    @staticmethod
    def counts(changes):
        return {r["status"]: r["n"] for r in changes.groupBy("status").agg(F.sum("change").alias("n")).collect() if r["n"]}


def test_counts_over_restarts(spark, tmp_path):
    feed = Feed(spark, tmp_path)
    first = feed.run([("a", minute(0), False), ("b", minute(1), False), ("b", minute(1), False), ("c", minute(2), False), ("a", minute(30), True), (None, minute(3), False), ("x", None, False)])
    assert feed.counts(first) == {"pending": 2, "observed": 1}
    # b gets its outcome in a later run; an outcome comes before its prediction.
    second = feed.run([("b", minute(61), True), ("d", minute(70), True)])
    assert feed.counts(second) == {"pending": 1, "observed": 2}
    third = feed.run([("d", minute(65), False), ("e", minute(66), False), ("f", minute(67), True)])
    assert feed.counts(third) == {"pending": 2, "observed": 3}
    # The watermark passes the horizon of c and e, and the outcome f, which has no prediction; a late outcome ends g.
    fourth = feed.run([("g", minute(200), False), ("g", minute(290), True)])
    assert feed.counts(fourth) == {"observed": 3, "expired": 2, "late": 1, "unmatched": 1}
    keys = {(r["id"], r["status"]) for r in fourth.where("change > 0").collect()}
    assert {("c", "expired"), ("e", "expired"), ("f", "unmatched"), ("g", "late")} <= keys
    windows = {r["window_start"]: r["n_observed"] for r in PD.window_counts(fourth, "1 hour").collect()}
    assert sum(windows.values()) == 3 and windows[minute(0)] == 2


def test_keys_of_a_bucket_are_followed_together(spark, tmp_path, monkeypatch):
    """As many keys as buckets of a few: no bucket mixes them up, and one step serves many keys."""
    monkeypatch.setattr(PD, "BUCKETS", 3)
    feed = Feed(spark, tmp_path)
    feed.run([(f"k{i}", minute(i % 5), False) for i in range(400)])
    out = feed.run([(f"k{i}", minute(30 if i % 2 else 90), True) for i in range(200)] + [("z", minute(0), False)])
    assert feed.counts(out) == {"observed": 100, "late": 100, "expired": 201}
    assert out.where("status = 'observed'").count() == out.where("status = 'observed'").select("id").distinct().count()
