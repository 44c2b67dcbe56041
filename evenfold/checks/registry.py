"""Registry of runnable queries with the SQL that must give the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evenfold.plans import standins as S

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

DIGITS = 6

XLAB = """xlab AS (SELECT 1), x AS (SELECT row_id, is_event, CASE WHEN row_id % 97 = 0 THEN is_event ELSE is_censored END AS z,
  CASE WHEN n_lines > 6 THEN 'exact' WHEN is_event THEN 'exact' ELSE 'censored' END AS role, CASE WHEN n_lines > 7 THEN 2.0::double ELSE 1.0::double END AS w FROM rec)"""


def rounded(df: DataFrame) -> DataFrame:
    """Round doubles, whose last bits depend on the order of summation."""
    return df.select(*[
        F.round(f.name, DIGITS).alias(f.name) if isinstance(f.dataType, T.DoubleType) else F.col(f.name)
        for f in df.schema
    ])


def query(name: str, sql: str | None = None, exact: str = "", num: str = "", views: str = ""):
    """Register a query; ``sql`` selects the ``exact`` columns as they are and rounds ``num``.

    ``views`` names the stand-in views the SQL builds on: rec, dup, recf, pred, sco, fpred.
    """
    def wrap(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = lambda spark, sf: rounded(fn(spark, sf))
        if sql is not None:
            cols = [c for c in exact.split()] + [f"round({c}, {DIGITS}) + 0.0::double AS {c}" for c in num.split()]
            SQL[name] = f"{with_clause(views)} SELECT {', '.join(cols)} FROM ({sql})" if cols else f"{with_clause(views)} {sql}"
        return fn
    return wrap


def with_clause(views: str) -> str:
    wanted = set(views.split())
    needs = {"recf": ["rec"], "pred": ["recf"], "sco": ["pred"], "fpred": ["rec"], "folds": ["recf"]}
    todo = list(wanted)
    while todo:
        for n in needs.get(todo.pop(), []):
            if n not in wanted:
                wanted.add(n)
                todo.append(n)
    parts = []
    for name, text in (("rec", S.REC_SQL), ("dup", S.DUP_SQL), ("recf", S.FOLD_SQL + ", " + S.FOLDED_SQL),
                       ("pred", S.PRED_SQL), ("sco", S.scored_sql()), ("fpred", S.FACTOR_SQL), ("xlab", XLAB)):
        if name in wanted:
            parts.append(text.strip())
    return ("WITH RECURSIVE " + ", ".join(parts)) if parts else ""
