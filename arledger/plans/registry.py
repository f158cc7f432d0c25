"""Registered queries: one callable (spark, sf_dir) -> DataFrame per operator, plus DuckDB SQL.

Every query reads the whole driver tables through the adapters in ``sources.testdata``; double
columns are rounded to 6 decimals on both sides (comparison precision only).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..functions.expressions import round_doubles
from .inputs import Inputs

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
DIGITS: dict[str, dict] = {}


def register(name: str, sql: str | None = None, rounded: bool = True):
    """Decorator: ``fn(inputs) -> DataFrame`` registered under ``name`` with optional SQL."""

    def deco(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = fn(Inputs(spark, sf_dir))
            return round_doubles(df, overrides=DIGITS.get(name)) if rounded else df

        run.__name__ = name
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = sql
        fn.query_name = name
        return fn

    return deco


def precision(digits: dict):
    """Decorator placed above ``register``: compare the listed columns at other precisions
    (money sums at cents, bin edges at 9 places) on both the Spark and the SQL side."""

    def deco(fn):
        name = fn.query_name
        DIGITS[name] = dict(digits)
        if name in ORACLE:
            repl = ", ".join(f'round("{c}", {d}) AS "{c}"' for c, d in digits.items())
            ORACLE[name] = f"SELECT * REPLACE ({repl}) FROM (\n{ORACLE[name]}\n) AS _p"
        return fn

    return deco


def load_all() -> None:
    """Import the modules that register queries."""
    from . import queries, standin  # noqa: F401
