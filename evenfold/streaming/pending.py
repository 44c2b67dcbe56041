"""Pending, observed, late and expired predictions, followed inside one stream.

Keys are dealt by hash to ``BUCKETS`` states. A state holds the predictions of its keys that
wait for their outcomes, and a timer at the first end of a horizon; all keys of a bucket
are followed in one step of a few sorts. What happens to a prediction comes out as changes of counts: +1 pending
when it arrives, then -1 pending and +1 of ``observed`` (outcome within the horizon),
``late`` (outcome after it) or ``expired`` (the watermark passed the horizon). The sums of
the changes are the counts at any time, and an exactly-once sink keeps them right over
restarts. State is bounded by horizon and watermark delay.

Defined results: an outcome may arrive before its prediction and waits until the
watermark has passed it, then it is ``unmatched``, as is one seen before its prediction
was made; repeated rows of a waiting key count once; rows with a null key or time are
ignored; rows older than the watermark are dropped by Spark before they get here.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

STATUSES = ("pending", "observed", "late", "expired", "unmatched")

#: A checkpoint keeps its states by bucket, so this number stays.
BUCKETS = 1_024


def moved(at: pd.Series, to, known: pd.Series) -> list[pd.DataFrame]:
    """Predictions of index ``k`` made at ``at`` get a final status; those ``known`` were counted as pending before."""
    over = pd.DataFrame({"ms": at, "status": to, "change": 1}, index=at.index)
    return [pd.DataFrame({"ms": at[known], "status": "pending", "change": -1}, index=at[known].index), over]


def arrived(waiting: pd.DataFrame, new: pd.DataFrame, horizon_ms: int, now: int) -> tuple[pd.DataFrame, list[pd.DataFrame]]:
    """What waits afterwards, and the changes, of keys with new rows; ``waiting`` has at most one row a key."""
    rows = pd.concat([waiting.assign(old=True), new.assign(old=False)], ignore_index=True)
    predicted = rows[~rows["seen"]]
    # The prediction that waits stays; of several new ones the earliest counts.
    predicted = predicted.assign(new=~predicted["old"]).sort_values(["new", "ms"], kind="stable").drop_duplicates("k").set_index("k")
    observed = rows[rows["seen"]].drop_duplicates(["k", "ms"]).sort_values("ms", kind="stable")
    at = observed["k"].map(predicted["ms"])
    alone = observed[at.isna()].drop_duplicates("k")
    early = observed[observed["ms"] < at]
    first = observed[observed["ms"] >= at].drop_duplicates("k").set_index("k")["ms"]
    changes = [pd.DataFrame({"ms": f["ms"].to_numpy(), "status": "unmatched", "change": 1}, index=f["k"]) for f in (early, alone[alone["ms"] <= now])]
    ended = predicted.index.isin(first.index)
    done, open_ = predicted[ended], predicted[~ended]
    status = np.where(first.reindex(done.index).to_numpy() <= done["ms"].to_numpy() + horizon_ms, "observed", "late")
    changes += moved(done["ms"], status, done["old"])
    over = open_["ms"] + horizon_ms <= now
    changes += moved(open_["ms"][over], "expired", open_["old"][over])
    stays = open_[~over]
    begun = stays[~stays["old"]]
    changes.append(pd.DataFrame({"ms": begun["ms"], "status": "pending", "change": 1}, index=begun.index))
    return pd.concat([stays.reset_index()[["k", "ms", "seen"]], alone.loc[alone["ms"] > now, ["k", "ms", "seen"]]], ignore_index=True), changes


def ends_of(waiting: pd.DataFrame, horizon_ms: int) -> pd.Series:
    """Until when each key waits: a prediction to the end of its horizon, an outcome for the watermark."""
    return waiting["ms"].where(waiting["seen"], waiting["ms"] + horizon_ms)


def follow(predictions: DataFrame, outcomes: DataFrame, key: str, predicted_at: str, observed_at: str, horizon_ms: int, delay: str) -> DataFrame:
    """A stream of changes (key, at, status, change); ``at`` is the time of the prediction, or of an unmatched outcome."""
    sides = [df.select(F.col(key).alias("k"), F.col(t).alias("at"), F.lit(seen).alias("seen")) for df, t, seen in ((predictions, predicted_at, False), (outcomes, observed_at, True))]
    rows = sides[0].unionByName(sides[1]).where(F.col("k").isNotNull() & F.col("at").isNotNull()).withWatermark("at", delay).withColumn("ms", F.unix_millis("at"))
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("k"), F.lit(BUCKETS)))
    kind = rows.schema["k"].dataType.simpleString()

    def step(group: tuple, frames: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = state.get if state.exists else ([], [], [])
        waiting = pd.DataFrame({"k": pd.Series(held[0], dtype=None if len(held[0]) else object), "ms": pd.Series(held[1], dtype="int64"), "seen": pd.Series(held[2], dtype=bool)})
        now = state.getCurrentWatermarkMs()
        new = [] if state.hasTimedOut else [f[["k", "ms", "seen"]] for f in frames]
        new = pd.concat(new, ignore_index=True) if new else waiting[:0]
        met = waiting["k"].isin(new["k"])
        rest = waiting[~met]
        # Keys without new rows end once the watermark has passed the end of their wait.
        late = ends_of(rest, horizon_ms) < now
        gone = rest[late].set_index("k")
        changes = moved(gone["ms"][~gone["seen"]], "expired", pd.Series(True, index=gone.index[~gone["seen"]]))
        changes.append(pd.DataFrame({"ms": gone["ms"][gone["seen"]], "status": "unmatched", "change": 1}, index=gone.index[gone["seen"]]))
        waiting, rest = rest[~late], waiting[met]
        if len(new):
            stays, more = arrived(rest, new, horizon_ms, now)
            waiting, changes = pd.concat([f for f in (waiting, stays) if len(f)] or [stays], ignore_index=True), changes + more
        if len(waiting):
            state.update((waiting["k"].tolist(), waiting["ms"].tolist(), waiting["seen"].tolist()))
            state.setTimeoutTimestamp(max(int(ends_of(waiting, horizon_ms).min()), now + 1))
        elif state.exists:
            state.remove()
        changes = [c for c in changes if len(c)]
        if changes:
            yield pd.concat(changes).rename_axis("k").reset_index()[["k", "ms", "status", "change"]]

    changes = rows.groupBy("bucket").applyInPandasWithState(step, f"k {kind}, ms bigint, status string, change int", f"k array<{kind}>, ms array<bigint>, seen array<boolean>", "append", GroupStateTimeout.EventTimeTimeout)
    return changes.select(F.col("k").alias(key), F.timestamp_millis("ms").alias("at"), "status", "change")


def window_counts(changes: DataFrame, width: str) -> DataFrame:
    """Counts per window of time and status, from all changes so far."""
    counts = [F.sum(F.when(F.col("status") == s, F.col("change")).otherwise(0)).alias(f"n_{s}") for s in STATUSES]
    return changes.groupBy(F.window("at", width).alias("_w")).agg(*counts).select(F.col("_w.start").alias("window_start"), *[f"n_{s}" for s in STATUSES])
