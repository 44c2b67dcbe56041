"""Duplicate clusters, evidence and invariance audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evenfold.functions import text as X
from evenfold.functions.hashing import id_list_sha, set_fingerprint
from evenfold.roles import DEFAULT, Roles
from evenfold.session import parallelism

# Accepted kinds of documented stops.
STOP_TYPES = ("unreviewed", "unknown", "administrative_cycle_limit", "damage_threshold",
              "equipment_or_interruption", "other_documented")

#: Parts that clusters are dealt to, per partition of the raw rows.
CLUSTER_PARTS = 16


def cluster_stats(raw: DataFrame, roles: Roles = DEFAULT) -> DataFrame:
    """Size, sources and label conflict of every physical-duplicate cluster.

    Most clusters have one row, so sums hardly shrink before they are sent. The two groupings are therefore kept out of one
    task, and the second is done in parts whose number grows with the partitions of ``raw``.
    """
    named = raw.where(X.trimmed(F.col(roles.equiv)) != "")
    reduced = named.groupBy(roles.equiv, roles.source).agg(
        F.count(F.lit(1)).alias("_n"), F.min(roles.censored).alias("_lo"), F.max(roles.censored).alias("_hi"))
    parts = max(parallelism(raw.sparkSession), CLUSTER_PARTS * raw.rdd.getNumPartitions())
    return reduced.repartition(parts, roles.equiv).groupBy(roles.equiv).agg(
        F.sum("_n").alias("cluster_size"), F.count(roles.source).alias("cluster_sources"),
        (F.count(roles.source) > 1).alias("cross_source"), (F.min("_lo") != F.max("_hi")).alias("label_conflict"))


def enrich(df: DataFrame, stats: DataFrame, audit_fields: tuple[str, ...], roles: Roles = DEFAULT) -> DataFrame:
    """Put cluster facts and audit flags on records; a record without a cluster stands alone."""
    out = df.join(stats, roles.equiv, "left").withColumns({
        "cluster_size": F.coalesce("cluster_size", F.lit(1).cast("long")),
        "cluster_sources": F.coalesce("cluster_sources", F.lit(1).cast("long")),
        "cross_source": F.coalesce("cross_source", F.lit(False)),
        "label_conflict": F.coalesce("label_conflict", F.lit(False)),
        **{f: X.trimmed(F.col(f)) for f in audit_fields},
    })
    complete = F.lit(True)
    for f in audit_fields:
        complete = complete & (F.col(f) != "")
    return out.withColumns({
        "mapping_status": F.when(F.col("audit_status") != "", F.concat(F.lit("audited_"), F.col("audit_status"))).otherwise("not_audited"),
        "secondary": F.contains(F.lower("record_role"), F.lit("secondary")),
        "audit_complete": complete,
    })


def cluster_members(raw: DataFrame, stats: DataFrame, roles: Roles = DEFAULT) -> DataFrame:
    """Rows of clusters that have more than one member, with the cluster facts."""
    return raw.join(stats.where("cluster_size > 1"), roles.equiv)


def group_source_map(df: DataFrame, roles: Roles = DEFAULT) -> DataFrame:
    """One row per group and source with counts and whether the group has several sources."""
    cells = df.groupBy(roles.group, roles.source).agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum(F.col(roles.event).cast("long")).alias("n_events"),
        F.min(roles.row).alias("first_row"))
    per = cells.groupBy(roles.group).agg(F.count(F.lit(1)).alias("n_sources"),
                                         F.min_by(roles.source, "first_row").alias("representative_source"))
    return cells.join(per, roles.group).withColumn("is_representative", F.col(roles.source) == F.col("representative_source"))


def fold_fingerprints(df: DataFrame, keys: list[str], roles: Roles = DEFAULT) -> DataFrame:
    """Order-free fingerprint of the row set of each key, for sets of any size."""
    return df.groupBy(*keys).agg(*set_fingerprint(F.col(roles.row)))


def fold_id_hashes(df: DataFrame, keys: list[str], roles: Roles = DEFAULT, digits: int = 3) -> DataFrame:
    """sha256 over the sorted ids of each key, built from the hashes of 16^``digits`` parts.

    Parts are cut by md5 of the id, so no task ever holds more than its share of a hot key.
    The hash depends on ``digits``: both sides of a comparison use the same, more for larger tables.
    """
    part = F.substring(F.md5(F.col(roles.row).cast("string")), 1, digits)
    small = df.groupBy(*keys, part.alias("_part")).agg(
        id_list_sha(F.col(roles.row)).alias("_sha"), F.count(F.lit(1)).alias("_n"))
    return small.groupBy(*keys).agg(
        F.sum("_n").alias("n_rows"),
        F.sha2(F.concat_ws(",", F.transform(F.array_sort(F.collect_list(F.struct("_part", "_sha"))), lambda s: s["_sha"])), 256).alias("ids_sha"))


def calibration_trace(oof: DataFrame, source: DataFrame, keys: list[str], inner: str, tolerance: float = 1e-12,
                      roles: Roles = DEFAULT) -> DataFrame:
    """Per task and inner fold: rows, events, and whether outcomes equal those of the source."""
    truth = source.select(roles.row, F.col(roles.y).alias("_y"), F.col(roles.event).alias("_event"))
    joined = oof.join(truth, roles.row, "left")
    same = (F.abs(F.col(roles.y) - F.col("_y")) <= tolerance) & (F.col(roles.event) == F.col("_event"))
    return joined.groupBy(*keys, inner).agg(
        F.count(F.lit(1)).alias("n_validation"), F.sum(F.col(roles.event).cast("long")).alias("n_events"),
        F.count(F.when(~F.coalesce(same, F.lit(False)), 1)).alias("n_mismatch"),
        F.count(F.when(F.col("_y").isNull(), 1)).alias("n_unknown"))


def order_audit(df: DataFrame, low: Column, high: Column, base_low: Column, base_high: Column, keep: list[str],
                tolerance: float = 1e-10) -> DataFrame:
    """Counterfactual pair on the same row: ``low`` must not exceed ``high``, in the trunk and
    in the whole prediction, and the rest must be shared."""
    return df.select(
        *keep, (base_low - base_high).alias("trunk_change"), (low - high).alias("total_change"),
        ((low - base_low) - (high - base_high)).alias("residual_change"),
        (low > high + tolerance).alias("total_reversal"), (base_low > base_high + tolerance).alias("trunk_reversal"))


def order_summary(audit: DataFrame, keys: list[str]) -> DataFrame:
    return audit.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_conditions"),
        F.sum(F.col("total_reversal").cast("long")).alias("total_reversals"),
        F.max("trunk_change").alias("max_trunk_change"), F.max("total_change").alias("max_total_change"))


def invariance_audit(df: DataFrame, first: Column, second: Column, keys: list[str]) -> DataFrame:
    """Largest difference of two expressions that must agree."""
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_rows"), F.max(F.abs(first - second)).alias("max_abs_difference"))


def censoring_evidence(df: DataFrame, evidence: DataFrame | None, required: tuple[str, ...], roles: Roles = DEFAULT) -> DataFrame:
    """Completeness status of the stopping evidence of every censored row."""
    rows = df.where(F.col(roles.censored)).select(roles.row, roles.source, roles.group)
    if evidence is not None:
        rows = rows.join(evidence.select(roles.row, "stop_type", *required), roles.row, "left")
    else:
        rows = rows.withColumns({f: F.lit("") for f in ("stop_type", *required)})
    rows = rows.withColumns({
        "stop_type": F.when(X.trimmed(F.col("stop_type")) == "", "unreviewed").otherwise(X.trimmed(F.col("stop_type"))),
        **{f: X.trimmed(F.col(f)) for f in required}})
    complete = F.lit(True)
    for f in required:
        complete = complete & (F.col(f) != "")
    documented = ~F.col("stop_type").isin("unreviewed", "unknown")
    return rows.select(
        roles.row, roles.source, roles.group, "stop_type", complete.alias("evidence_complete"),
        F.when(documented & complete, "documented_pending_review").when(documented, "incomplete_evidence")
        .otherwise(F.col("stop_type")).alias("audit_status"))


def evidence_problems(df: DataFrame, evidence: DataFrame, roles: Roles = DEFAULT) -> DataFrame:
    """Evidence rows that cannot be used: repeated, not censored, unknown type, other source."""
    counted = evidence.groupBy(roles.row).agg(F.count(F.lit(1)).alias("_n"), F.first("stop_type").alias("stop_type"),
                                             F.first(roles.source).alias("_source"))
    joined = counted.join(df.where(F.col(roles.censored)).select(roles.row, roles.source), roles.row, "left")
    rule = (
        F.when(F.col("_n") > 1, "repeated_row")
        .when(F.col(roles.source).isNull(), "not_a_censored_row")
        .when(~F.col("stop_type").isin(*STOP_TYPES), "unknown_stop_type")
        .when(F.col("_source") != F.col(roles.source), "other_source"))
    return joined.select(rule.alias("rule"), F.col(roles.row).cast("string").alias("key")).where("rule IS NOT NULL")


def evidence_gaps(audit: DataFrame, roles: Roles = DEFAULT) -> DataFrame:
    return audit.groupBy(roles.source, "stop_type", "audit_status").agg(F.count(F.lit(1)).alias("n_rows"))


