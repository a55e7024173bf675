"""Registered queries: one Spark callable and, where SQL can express it, its check SQL."""

from __future__ import annotations

import functools
import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import require_runtime_conf

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECKS: dict[str, str] = {}
#: named sub-selects the check SQL may build on
VIEWS: dict[str, str] = {}


def view(name: str, sql: str) -> None:
    VIEWS[name] = sql.strip()


@functools.cache
def _mentioned(sql: str) -> tuple[str, ...]:
    """Names that follow FROM or JOIN, in order."""
    return tuple(dict.fromkeys(re.findall(r"(?i)\b(?:from|join)\s+(\w+)", sql)))


def _needed(sql: str, seen: list[str]) -> list[str]:
    for name in _mentioned(sql):
        if name in VIEWS and name not in seen:
            _needed(VIEWS[name], seen)
            if name not in seen:
                seen.append(name)
    return seen


def with_views(sql: str) -> str:
    """Prefix ``sql`` with the sub-selects it mentions, dependencies first."""
    names = _needed(sql, [])
    if not names:
        return sql
    ctes = ",\n".join(f"{n} AS (\n{VIEWS[n]}\n)" for n in names)
    body = sql.strip()
    if body.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {ctes},\n{body[15:]}"
    if body.upper().startswith("WITH "):
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"


def query(name: str, sql: str | None = None):
    """Register a query under ``name`` with its check SQL."""

    def register(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            require_runtime_conf(spark)
            return fn(spark, sf_dir)

        run.__name__ = name
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            CHECKS[name] = sql
        return fn

    return register


def check_sql() -> dict[str, str]:
    """The complete check SQL of every query that has one."""
    return {name: with_views(sql) for name, sql in CHECKS.items()}
