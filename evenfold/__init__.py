"""evenfold: grouped, leakage-checked evaluation of predictions for right-censored outcomes, on Spark."""

from evenfold.roles import Roles

__all__ = ["Roles"]
