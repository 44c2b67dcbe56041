"""Normal tail probabilities as column expressions.

Spark has no error function. ``log_sf`` is the log of the upper tail, from W. J. Cody's
rational approximations of erf and erfc (Math. Comp. 23, 1969), good to about 1e-15.
"""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import Column
from pyspark.sql import functions as F

# Published coefficients, numerator then denominator, constant term last.
ERF_SMALL = (
    (1.85777706184603153e-1, 3.16112374387056560, 1.13864154151050156e2,
     3.77485237685302021e2, 3.20937758913846947e3),
    (1.0, 2.36012909523441209e1, 2.44024637934444173e2,
     1.28261652607737228e3, 2.84423683343917062e3),
)
ERFC_MIDDLE = (
    (2.15311535474403846e-8, 5.64188496988670089e-1, 8.88314979438837594, 6.61191906371416295e1,
     2.98635138197400131e2, 8.81952221241769090e2, 1.71204761263407058e3,
     2.05107837782607147e3, 1.23033935479799725e3),
    (1.0, 1.57449261107098347e1, 1.17693950891312499e2, 5.37181101862009858e2,
     1.62138957456669019e3, 3.29079923573345963e3, 4.36261909014324716e3,
     3.43936767414372164e3, 1.23033935480374942e3),
)
ERFC_LARGE = (
    (1.63153871373020978e-2, 3.05326634961232344e-1, 3.60344899949804439e-1,
     1.25781726111229246e-1, 1.60837851487422766e-2, 6.58749161529837803e-4),
    (1.0, 2.56852019228982242, 1.87295284992346725, 5.27905102951428412e-1,
     6.05183413124413191e-2, 2.33520497626869185e-3),
)
INV_SQRT_PI = 5.6418958354775628695e-1
HALF_LOG_2PI = 0.5 * math.log(2.0 * math.pi)
SQRT_2 = math.sqrt(2.0)


def _poly(coefficients: tuple[float, ...], x: Column) -> Column:
    out = F.lit(coefficients[0])
    for c in coefficients[1:]:
        out = out * x + F.lit(c)
    return out


def _scaled_erfc(t: Column) -> Column:
    """exp(t^2) erfc(t) for t > 0.46875."""
    middle = _poly(ERFC_MIDDLE[0], t) / _poly(ERFC_MIDDLE[1], t)
    u = 1.0 / (t * t)
    large = (INV_SQRT_PI - u * _poly(ERFC_LARGE[0], u) / _poly(ERFC_LARGE[1], u)) / t
    return F.when(t <= 4.0, middle).otherwise(large)


def log_sf(z: Column) -> Column:
    """ln P(Z > z) of a standard normal variable, without cancellation in either tail."""
    t = F.abs(z) / SQRT_2
    erf = t * _poly(ERF_SMALL[0], t * t) / _poly(ERF_SMALL[1], t * t)
    tail = F.log(0.5 * _scaled_erfc(t)) - t * t
    small = F.when(z >= 0, F.log(0.5 * (1.0 - erf))).otherwise(F.log(0.5 * (1.0 + erf)))
    return (
        F.when(t <= 0.46875, small)
        .when(z > 0, tail)
        .otherwise(F.log1p(-F.exp(tail)))
    )


def hazard(z: Column, log_survival: Column) -> Column:
    """phi(z) / P(Z > z), given ``log_sf(z)``."""
    return F.exp(-0.5 * z * z - HALF_LOG_2PI - log_survival)


def normal_quantile(p: float) -> float:
    return NormalDist().inv_cdf(p)


def log_sf_sql(z: str) -> str:
    """The same formula as SQL text, for engines that are asked to check the result."""
    def poly(cs, x):
        out = repr(cs[0])
        for c in cs[1:]:
            out = f"({out}*({x})+{c!r}::double)" if out.startswith("(") else f"({out}::double*({x})+{c!r}::double)"
        return out

    t = f"(abs({z})/{SQRT_2!r}::double)"
    t2 = f"({t}*{t})"
    u = f"(1.0::double/{t2})"
    erf = f"({t}*{poly(ERF_SMALL[0], t2)}/{poly(ERF_SMALL[1], t2)})"
    middle = f"({poly(ERFC_MIDDLE[0], t)}/{poly(ERFC_MIDDLE[1], t)})"
    large = f"(({INV_SQRT_PI!r}::double-{u}*{poly(ERFC_LARGE[0], u)}/{poly(ERFC_LARGE[1], u)})/{t})"
    tail = f"(ln(0.5::double*(CASE WHEN {t}<=4 THEN {middle} ELSE {large} END))-{t2})"
    return (
        f"(CASE WHEN {t}<=0.46875 THEN (CASE WHEN {z}>=0 THEN ln(0.5::double*(1-{erf})) ELSE ln(0.5::double*(1+{erf})) END)"
        f" WHEN {z}>0 THEN {tail} ELSE ln(1-exp({tail})) END)"
    )
