"""Queries by name, with their SQL for another engine where it can express them."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tallyforge.plans.bindings import CTES, TABLES, VIEWS, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _views(text: str) -> list[str]:
    return [v for v in dict.fromkeys(re.findall(r"\{(\w+)\}", text))]


def declare(name: str, spark_text: str, sql_text: str | None = None) -> None:
    """A query in SQL over ``{view}`` or ``{table}``; sql_text where the other dialect differs."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return spark.sql(spark_text, **{v: VIEWS[v](spark, sf_dir) if v in VIEWS else table(spark, sf_dir, v) for v in _views(spark_text)})

    QUERIES[name] = run
    text = sql_text or spark_text
    needed = [v for v in _views(text) if v in VIEWS]
    body = text.format(**{v: v for v in [*VIEWS, *TABLES]})
    if needed:
        body = body.strip()
        own = re.match(r"with\s+(recursive\s+)?", body, re.IGNORECASE)
        ctes = ",\n".join(CTES[v] for v in needed)
        body = f"with {'recursive ' if own and own[1] else ''}{ctes}" + (",\n" + body[own.end() :] if own else "\n" + body)
    SQL[name] = body


def register(name: str, sql: str | None = None):
    """Decorator for a query written with DataFrames."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[name] = f
        if sql:
            needed = [v for v in _views(sql) if v in VIEWS]
            body = sql.format(**{v: v for v in [*VIEWS, *TABLES]}).strip()
            if needed:
                own = re.match(r"with\s+(recursive\s+)?", body, re.IGNORECASE)
                ctes = ",\n".join(CTES[v] for v in needed)
                body = f"with {'recursive ' if own and own[1] else ''}{ctes}" + (",\n" + body[own.end() :] if own else "\n" + body)
            SQL[name] = body
        return f

    return add
