"""Column-name settings shared by all operators."""

from __future__ import annotations

from dataclasses import dataclass, replace


@dataclass(frozen=True)
class Roles:
    """Names of the columns that carry a meaning; everything else passes through."""

    row: str = "row_id"
    group: str = "group_id"
    source: str = "source_id"
    equiv: str = "equiv_id"
    y: str = "y"
    event: str = "is_event"
    censored: str = "is_censored"
    pred: str = "pred"
    scale: str = "scale"
    family: str = "family"
    scenario: str = "scenario"
    model: str = "model"
    fold: str = "fold"
    holdout: str = "holdout"
    temperature: str = "temp_c"

    def but(self, **changes: str) -> "Roles":
        return replace(self, **changes)


DEFAULT = Roles()
