"""Stress, temperature and environment expressions of the location model."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the location model.
REFERENCE_C = 800.0
DRIVE_SCALE = 1000.0
KELVIN = 273.15
WALKER_FLOOR = 1e-6
LOG_FLOOR = 1e-8
SUPPORT_WIDTH = 250.0
LN10 = math.log(10.0)


def _col(v) -> Column:
    return v if isinstance(v, Column) else F.lit(float(v))


def sigmoid(x: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-F.greatest(F.least(x, F.lit(40.0)), F.lit(-40.0))))


def softplus(x: Column) -> Column:
    """ln(1 + e^x) without overflow."""
    return F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))


def floored_log10(x: Column, floor: float = LOG_FLOOR) -> Column:
    return F.log10(F.greatest(x, F.lit(floor)))


def clipped(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.least(x, F.lit(high)), F.lit(low))


def loading_features(s: Column, r: Column, freq: Column, uts: Column, temp_c: Column) -> dict[str, Column]:
    return {
        "log_s": floored_log10(s),
        "log_f": floored_log10(freq),
        "log_uts": floored_log10(uts),
        "temp_n": (temp_c - 25.0) / 1000.0,
        "s_amp": 0.5 * s * clipped(1.0 - r, 0.0, 2.0),
        "s_mean": 0.5 * s * (1.0 + r),
    }


def thermal_drive(temp_c: Column, reference_c=REFERENCE_C, scale=DRIVE_SCALE) -> Column:
    """Arrhenius drive, null at or below absolute zero so that a contract can report it."""
    kelvin = temp_c + KELVIN
    drive = _col(scale) * (1.0 / (_col(reference_c) + KELVIN) - 1.0 / kelvin)
    return F.when(kelvin > 0, drive)


def proxies(s: Column, temp_c: Column, log_f: Column, inert: Column, wet: Column) -> dict[str, Column]:
    """Damage proxies and their row means."""
    heat = sigmoid((temp_c - 800.0) / 200.0)
    slow = sigmoid(-log_f)
    dry = F.when(inert, 0.0).otherwise(heat * (0.5 + 0.5 * slow))
    humid = F.when(wet, heat).otherwise(0.0)
    oxidation = clipped(F.greatest(dry, humid), 0.0, 1.0)
    stress = clipped(s, 0.0, 1.0)
    interface = clipped(stress * (0.60 + 0.40 * oxidation), 0.0, 1.0)
    fibre = clipped(stress * stress, 0.0, 1.0)
    return {
        "oxidation": oxidation,
        "d_m": stress,
        "d_i": interface,
        "d_f": fibre,
        "d_ox": oxidation,
        "m_mean": (stress + interface + fibre) / 3.0,
        "q_mean": (stress + interface + fibre + oxidation) / 4.0,
    }


def walker(log_s: Column, r: Column, gamma) -> Column:
    """Log stress corrected for the stress ratio; ``gamma`` is a number or a column."""
    return log_s + _col(gamma) * F.log10(F.greatest((1.0 - r) / 2.0, F.lit(WALKER_FLOOR)))


def linear_location(coef: list[Column], features: list[Column]) -> Column:
    """Intercept minus the sum of coefficient times feature."""
    out = coef[0]
    for c, x in zip(coef[1:], features, strict=True):
        out = out - c * x
    return out


def damage_ratio(k, m, q, x: Column, exposed: Column, drive: Column, freq_drive: Column,
                 wet_shift=0.0, stress_on=1.0) -> Column:
    """log10 of environmental over mechanical damage, null where nothing is exposed."""
    r = (
        _col(k) + F.log10(exposed) + _col(wet_shift) + _col(q) * drive / LN10
        + _col(m) * x * _col(stress_on) - freq_drive
    )
    return F.when(exposed > 0, r)


def decrement(ratio: Column) -> Column:
    """log10(1 + 10^ratio), 0 where the ratio is null (no exposure)."""
    return F.coalesce(softplus(ratio * LN10) / LN10, F.lit(0.0))


def competing_location(a, b, x: Column, ratio: Column) -> Column:
    """Location when mechanical and environmental damage rates add up.

    -log10(10^(b x - a) + 10^(b x - a + ratio)) in the form that cannot overflow.
    """
    return _col(a) - _col(b) * x - decrement(ratio)


def class_shift(mask: Column, enabled: Column, beta) -> Column:
    return F.when(mask & enabled, _col(beta)).otherwise(0.0)


def power_of_ten(x: Column, bound: float = 300.0) -> Column:
    return F.pow(F.lit(10.0), clipped(x, -bound, bound))


def multiplier(beta: Column) -> Column:
    """10^beta, null once it could not be represented."""
    return F.when(beta <= 300, F.pow(F.lit(10.0), beta))


def support_weight(distance: Column, width: float = SUPPORT_WIDTH) -> Column:
    """Soft support by distance to training conditions; no training event gives 0."""
    return F.coalesce(F.exp(-F.pow(distance / width, F.lit(2.0))), F.lit(0.0))


def gated_blend(base: Column, correction: Column, support: Column, eta) -> Column:
    return base + _col(eta) * support * correction
