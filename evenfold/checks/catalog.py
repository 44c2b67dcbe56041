"""All registered queries."""

from __future__ import annotations

import importlib

from evenfold.checks.registry import QUERIES, SQL

MODULES = ("basics", "projections", "contract_checks", "join_checks", "score_checks", "selection_checks", "audit_checks", "model_checks", "learner_checks")

for _name in MODULES:
    importlib.import_module(f"evenfold.checks.{_name}")

__all__ = ["QUERIES", "SQL"]
