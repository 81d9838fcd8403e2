"""Named queries, each with its Spark plan and, where SQL can say it, an oracle."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import views

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded for comparison.

    The small shift keeps exact decimal halves from rounding either way with
    the order of summation; adding zero folds -0.0 into 0.0.
    """
    return df.select(
        *[
            (F.round(F.col(c) + F.lit(1e-9), digits) + F.lit(0.0)).alias(c) if kind == "double" else F.col(c)
            for c, kind in df.dtypes
        ]
    )


def R(expression: str) -> str:
    return f"(round(({expression})::double + 1e-9::double, 6) + 0.0::double)"


def with_views(body: str) -> str:
    """The oracle text with the views it names as common table expressions."""
    text = body.strip()
    needed: list[str] = []

    def add(name: str) -> None:
        for other in views.NEEDS.get(name, []):
            add(other)
        if name not in needed:
            needed.append(name)

    for name in views.DUCKDB:
        if re.search(rf"\b{name}\b", text):
            add(name)
    tables = [f"{name} as materialized ({views.DUCKDB[name]})" for name in needed]
    head = re.match(r"with(\s+recursive)?\s+", text, re.IGNORECASE)
    if head:
        rest = text[head.end():]
        return "with recursive " + ", ".join([*tables, rest]) if tables else text
    return ("with recursive " + ", ".join(tables) + " " + text) if tables else text


def query(name: str, sql: str | None = None):
    """Register a query under ``name``; ``sql`` may name any view."""

    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = lambda spark, path: rounded(fn(spark, path))
        if sql:
            ORACLES[name] = with_views(sql)
        return fn

    return add
