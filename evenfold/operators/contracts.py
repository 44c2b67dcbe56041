"""Data contracts and leakage checks.

Each check returns a table of violations (rule, key, detail); an empty table is a pass and
``require`` turns a non-empty one into an error.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evenfold.functions.families import FAMILIES
from evenfold.roles import DEFAULT, Roles


class ContractError(ValueError):
    """A table breaks its contract; the message shows the first violations."""


def violation(df: DataFrame, rule, key: Column, detail: Column) -> DataFrame:
    rule = rule if isinstance(rule, Column) else F.lit(rule)
    return df.select(rule.alias("rule"), key.cast("string").alias("key"), detail.cast("string").alias("detail"))


def all_of(*checks: DataFrame) -> DataFrame:
    out = checks[0]
    for c in checks[1:]:
        out = out.unionByName(c)
    return out


def require(violations: DataFrame, what: str, show: int = 20) -> None:
    """Raise with a few examples if there is any violation; nothing is collected beyond them."""
    first = violations.limit(show).collect()
    if first:
        raise ContractError(f"{what}: " + "; ".join(f"{r['rule']} at {r['key']} ({r['detail']})" for r in first))


def require_columns(df: DataFrame, names: set[str] | list[str], what: str) -> None:
    missing = sorted(set(names) - set(df.columns))
    if missing:
        raise ContractError(f"{what}: missing columns {missing}")


# ------------------------------------------------------------------ row rules

@dataclass(frozen=True)
class Contract:
    """Required columns and row rules; a rule is true for a bad row and must not be null."""

    columns: tuple[str, ...]
    key: str
    rules: dict[str, tuple[Column, Column]] = field(default_factory=dict)
    unique: tuple[tuple[str, ...], ...] = ()

    def violations(self, df: DataFrame) -> DataFrame:
        require_columns(df, list(self.columns), "contract")
        # All row rules are tested in one pass over the table.
        tests = F.array_compact(F.array(*[
            F.when(F.coalesce(bad, F.lit(True)), F.struct(F.lit(name).alias("rule"), F.coalesce(detail.cast("string"), F.lit("null")).alias("detail")))
            for name, (bad, detail) in self.rules.items()
        ]))
        rows = df.select(F.col(self.key).cast("string").alias("key"), F.explode(tests).alias("_t"))
        out = rows.select("_t.rule", "key", "_t.detail")
        for columns in self.unique:
            out = out.unionByName(duplicates(df, list(columns)))
        return out


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    """Key values that occur more than once."""
    counted = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return violation(counted, "not_unique:" + ",".join(keys), F.concat_ws("|", *[F.col(k).cast("string") for k in keys]), F.col("n"))


def blank(df: DataFrame, column: str, key: str) -> DataFrame:
    bad = F.trim(F.coalesce(F.col(column).cast("string"), F.lit(""))) == ""
    return violation(df.where(bad), f"blank:{column}", F.col(key), F.lit("blank"))


def not_finite(c: Column) -> Column:
    return c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))


def label_rules(roles: Roles = DEFAULT) -> dict[str, tuple[Column, Column]]:
    """Event and censored flags are complements; further labels, if given, follow from them."""
    e, z = F.col(roles.event), F.col(roles.censored)
    return {"labels_not_complementary": ((e == z), F.concat_ws("/", e.cast("string"), z.cast("string")))}


def implied_label(event: Column, value: Column, if_event: str, if_censored: str) -> tuple[Column, Column]:
    return value != F.when(event, if_event).otherwise(if_censored), value


def unit_weight(value: Column) -> tuple[Column, Column]:
    return not_finite(value) | (F.abs(value - 1.0) > 1e-8 + 1e-5), value


def range_rules(finite: tuple[str, ...], positive: tuple[str, ...], below: dict[str, float]) -> dict[str, tuple[Column, Column]]:
    rules = {f"not_finite:{c}": (not_finite(F.col(c)), F.col(c)) for c in finite}
    rules |= {f"not_positive:{c}": (F.col(c) <= 0, F.col(c)) for c in positive}
    rules |= {f"not_below_{limit:g}:{c}": (F.col(c) >= limit, F.col(c)) for c, limit in below.items()}
    return rules


# ------------------------------------------------------------------ table rules

def functional_dependency(df: DataFrame, determinant: str, dependent: str) -> DataFrame:
    """Values of the determinant with more than one dependent value."""
    per = df.groupBy(determinant).agg(F.min(dependent).alias("_lo"), F.max(dependent).alias("_hi"))
    return violation(per.where(F.col("_lo") != F.col("_hi")), f"{determinant}_has_many:{dependent}", F.col(determinant),
                     F.concat_ws("..", F.col("_lo").cast("string"), F.col("_hi").cast("string")))


def coverage(expected: DataFrame, actual: DataFrame, keys: list[str]) -> DataFrame:
    """Each expected key must occur exactly once in ``actual``, and nothing else may.

    Both sides are counted in one aggregation over their union.
    """
    both = expected.select(*keys, F.lit(1).alias("_e"), F.lit(0).alias("_a")).unionByName(
        actual.select(*keys, F.lit(0).alias("_e"), F.lit(1).alias("_a")))
    per = both.groupBy(*keys).agg(F.sum("_e").alias("_e"), F.sum("_a").alias("_a"))
    rule = F.when(F.col("_e") == 0, "unexpected").when(F.col("_a") == 0, "missing").otherwise("repeated")
    return violation(per.where((F.col("_a") != 1) | (F.col("_e") == 0)), rule,
                     F.concat_ws("|", *[F.col(k).cast("string") for k in keys]), F.col("_a"))


def overlap(train: DataFrame, test: DataFrame, keys: list[str]) -> DataFrame:
    """Key values present on both sides, checked for each key column."""
    return all_of(*[
        violation(train.select(k).distinct().join(test.select(k).distinct(), k, "left_semi"), f"overlap:{k}", F.col(k), F.lit("train and test"))
        for k in keys
    ])


def role_overlap(members: DataFrame, keys: list[str]) -> DataFrame:
    """The same for a (task, row, role) relation: keys of a task that play both roles."""
    parts = []
    # Numbers are summed up in a hash table; the least and largest of texts would have every row sorted.
    test = (F.col("role") == "test").cast("int")
    for k in keys:
        per = members.groupBy("task", k).agg(F.min(test).alias("_a"), F.max(test).alias("_b"))
        parts.append(violation(per.where("_a <> _b"), f"overlap:{k}", F.concat_ws("|", F.col("task").cast("string"), F.col(k).cast("string")), F.lit("train and test")))
    return all_of(*parts)


def partition_complement(whole: DataFrame, part: DataFrame, rest: DataFrame, key: str) -> DataFrame:
    """``part`` and ``rest`` must split ``whole`` without overlap or gap."""
    tagged = (
        whole.select(key, F.lit(1).alias("w"), F.lit(0).alias("p"), F.lit(0).alias("r"))
        .unionByName(part.select(key, F.lit(0).alias("w"), F.lit(1).alias("p"), F.lit(0).alias("r")))
        .unionByName(rest.select(key, F.lit(0).alias("w"), F.lit(0).alias("p"), F.lit(1).alias("r"))))
    per = tagged.groupBy(key).agg(*[F.sum(c).alias(c) for c in ("w", "p", "r")])
    bad = (F.col("w") != 1) | (F.col("p") + F.col("r") != 1)
    return violation(per.where(bad), "not_a_partition", F.col(key), F.concat_ws(",", *[F.col(c).cast("string") for c in ("w", "p", "r")]))


def identical_rows(a: DataFrame, b: DataFrame, key: str, columns: list[str], tolerance: float = 1e-12) -> DataFrame:
    """Paired tables must describe the same observations; numbers may differ by ``tolerance``."""
    left = a.select(F.col(key), F.struct(*columns).alias("_a"))
    right = b.select(F.col(key), F.struct(*columns).alias("_b"))
    types = dict(a.dtypes)
    same = F.lit(True)
    for c in columns:
        x, z = F.col(f"_a.{c}"), F.col(f"_b.{c}")
        equal = x.eqNullSafe(z)
        if types[c] in ("double", "float"):
            equal = equal | F.coalesce(F.abs(x - z) <= tolerance, F.lit(False))
        same = same & equal
    joined = left.join(right, key, "full_outer")
    rule = F.when(F.col("_b").isNull(), "only_left").when(F.col("_a").isNull(), "only_right").when(~same, "values_differ")
    return violation(joined.withColumn("_rule", rule).where("_rule IS NOT NULL"), F.col("_rule"), F.col(key), F.lit(",".join(columns)))


def prediction_contract(roles: Roles = DEFAULT, families: tuple[str, ...] = ("normal", "lognormal", "weibull")) -> Contract:
    """Prediction fact table: identities, finite numbers, positive scale, known family."""
    r = roles
    text = lambda n: (F.trim(F.coalesce(F.col(n).cast("string"), F.lit(""))) == "", F.col(n))
    rules = {f"blank:{n}": text(n) for n in (r.model, r.row, r.group, r.equiv, r.scenario)}
    rules |= label_rules(r)
    rules |= {f"not_finite:{n}": (not_finite(F.col(n)), F.col(n)) for n in (r.y, r.pred, r.scale)}
    rules |= {f"not_positive:{r.scale}": (F.col(r.scale) <= 0, F.col(r.scale))}
    rules |= {"unknown_family": (~F.lower(F.trim(F.col(r.family))).isin(*families), F.col(r.family))}
    unknown = set(families) - set(FAMILIES)
    if unknown:
        raise ValueError(f"families not registered: {sorted(unknown)}")
    return Contract(
        (r.model, r.row, r.group, r.equiv, r.y, r.event, r.censored, r.pred, r.scale, r.family, r.scenario, r.fold, r.holdout),
        r.row, rules, ((r.scenario, r.model, r.holdout, r.row),))


def outcome_leak(conditions: DataFrame, outcome_columns: list[str], training_groups: DataFrame, key: str,
                 roles: Roles = DEFAULT) -> DataFrame:
    """Conditions to be scored must carry no outcome and no group seen in training."""
    present = [c for c in outcome_columns if c in conditions.columns]
    parts = [violation(conditions.where(F.col(c).isNotNull()), f"outcome_present:{c}", F.col(key), F.col(c)) for c in present]
    seen = conditions.select(roles.group).distinct().join(training_groups.select(roles.group).distinct(), roles.group, "left_semi")
    return all_of(*parts, violation(seen, "group_seen_in_training", F.col(roles.group), F.lit("training")))


def outcome_table(outcomes: DataFrame, predicted: DataFrame, key: str, life: str) -> DataFrame:
    """Observed outcomes: unique non-blank ids, all of them predicted, positive finite lives."""
    contract = Contract((key, life), key, {
        f"blank:{key}": (F.trim(F.coalesce(F.col(key).cast("string"), F.lit(""))) == "", F.col(key)),
        f"not_finite:{life}": (not_finite(F.col(life)), F.col(life)),
        f"not_positive:{life}": (F.col(life) <= 0, F.col(life))}, ((key,),))
    stray = outcomes.select(key).distinct().join(predicted.select(key), key, "left_anti")
    return all_of(contract.violations(outcomes), violation(stray, "not_predicted", F.col(key), F.lit("outcome")))
