"""Distribution families by name: row loss, its derivatives and standard quantiles.

Two Weibull forms exist: ``weibull`` has the prediction as its location parameter,
``weibull_median`` has it as the median. They are never mixed.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from evenfold.functions.damage import sigmoid, softplus
from evenfold.functions.normal import HALF_LOG_2PI, hazard, log_sf, normal_quantile

LN2 = math.log(2.0)
LN_LN2 = math.log(LN2)


@dataclass(frozen=True)
class Family:
    """Losses of the standardised residual z; ``event`` leaves out the ln(scale) term.

    ``event_d`` and ``censored_d`` give the first and second derivative in z.
    """

    event: Callable[[Column], Column]
    censored: Callable[[Column], Column]
    event_d: Callable[[Column], tuple[Column, Column]]
    censored_d: Callable[[Column], tuple[Column, Column]]
    quantile: Callable[[float], float]
    # Columns of z that a fit computes once, in this order, and the censored loss with both
    # derivatives in terms of them.
    shared: tuple[tuple[str, Callable[[Column], Column]], ...] = ()
    censored_shared: Callable[[Column], tuple[Column, Column, Column]] | None = None

    def censored_all(self, z: Column) -> tuple[Column, Column, Column]:
        if self.censored_shared is not None:
            return self.censored_shared(z)
        return self.censored(z), *self.censored_d(z)


def _normal_censored_d(z: Column) -> tuple[Column, Column]:
    h = hazard(z, log_sf(z))
    return h, h * (h - z)


def _logistic_censored_d(z: Column) -> tuple[Column, Column]:
    s = sigmoid(z)
    return s, s * (1.0 - s)


def _logistic_event_d(z: Column) -> tuple[Column, Column]:
    s = sigmoid(z)
    return 2.0 * s - 1.0, 2.0 * s * (1.0 - s)


_NORMAL = Family(
    event=lambda z: HALF_LOG_2PI + 0.5 * z * z,
    censored=lambda z: -log_sf(z),
    event_d=lambda z: (z, F.lit(1.0)),
    censored_d=_normal_censored_d,
    quantile=normal_quantile,
    shared=(("_log_sf", log_sf), ("_hazard", lambda z: hazard(z, F.col("_log_sf")))),
    censored_shared=lambda z: (-F.col("_log_sf"), F.col("_hazard"), F.col("_hazard") * (F.col("_hazard") - z)),
)

FAMILIES: dict[str, Family] = {
    "normal": _NORMAL,
    "lognormal": _NORMAL,
    "weibull": Family(
        event=lambda z: F.exp(z) - z,
        censored=F.exp,
        event_d=lambda z: (F.exp(z) - 1.0, F.exp(z)),
        censored_d=lambda z: (F.exp(z), F.exp(z)),
        quantile=lambda p: math.log(-math.log1p(-p)),
    ),
    "weibull_median": Family(
        event=lambda z: LN2 * F.exp(z) - z - LN_LN2,
        censored=lambda z: LN2 * F.exp(z),
        event_d=lambda z: (LN2 * F.exp(z) - 1.0, LN2 * F.exp(z)),
        censored_d=lambda z: (LN2 * F.exp(z), LN2 * F.exp(z)),
        quantile=lambda p: math.log(-math.log1p(-p) / LN2),
    ),
    "loglogistic": Family(
        event=lambda z: softplus(z) + softplus(-z),
        censored=softplus,
        event_d=_logistic_event_d,
        censored_d=_logistic_censored_d,
        quantile=lambda p: math.log(p) - math.log1p(-p),
    ),
}


def register(name: str, family: Family) -> None:
    """Add a family of the user's own under a new name."""
    if name in FAMILIES:
        raise ValueError(f"family {name} exists")
    FAMILIES[name] = family


def row_loss(family: str, y: Column, pred: Column, scale: Column, is_event: Column) -> Column:
    """Negative log density of an event, negative log survival of a censored row."""
    fam = FAMILIES[family]
    z = (y - pred) / scale
    return F.when(is_event, F.log(scale) + fam.event(z)).otherwise(fam.censored(z))


def row_loss_by_name(family: Column, y: Column, pred: Column, scale: Column, is_event: Column,
                     names: tuple[str, ...] = ("normal", "lognormal", "weibull")) -> Column:
    """Row loss with the family read from a column; null for a name not listed."""
    return _by_family(family, names, lambda n: row_loss(n, y, pred, scale, is_event))


def _by_family(family: Column, names: tuple[str, ...], of: Callable[[str], Column]) -> Column:
    """One branch per distinct family; names of the same family share it."""
    shared: dict[int, list[str]] = {}
    for n in names:
        shared.setdefault(id(FAMILIES[n]), []).append(n)
    name = F.lower(F.trim(family))
    out: Column | None = None
    for same in shared.values():
        test, value = name.isin(*same), of(same[0])
        out = F.when(test, value) if out is None else out.when(test, value)
    return out


def quantile(family: str, pred: Column, scale: Column, p: float) -> Column:
    return pred + scale * F.lit(FAMILIES[family].quantile(p))


def quantile_by_name(family: Column, pred: Column, scale: Column, p: float,
                     names: tuple[str, ...] = ("normal", "lognormal", "weibull")) -> Column:
    return _by_family(family, names, lambda n: quantile(n, pred, scale, p))


def interval(pred: Column, half_width: Column) -> tuple[Column, Column]:
    return pred - half_width, pred + half_width


def covered(y: Column, lower: Column, upper: Column) -> Column:
    return (y >= lower) & (y <= upper)


def interval_score(y: Column, lower: Column, upper: Column, level: float) -> Column:
    """Width plus the penalty for values outside (Gneiting and Raftery 2007)."""
    rate = 2.0 / (1.0 - level)
    zero = F.lit(0.0)
    return (upper - lower) + rate * F.greatest(lower - y, zero) + rate * F.greatest(y - upper, zero)
