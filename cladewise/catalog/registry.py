"""Named queries, each with the SQL that gives the same rows."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .tables import VIEW_SQL, Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register fn(t: Tables) under a name; ``sql`` may use the proxy views by name."""

    def wrap(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(Tables(spark, sf_dir))

        run.__name__ = name
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = with_views(sql.strip())
        return fn

    return wrap


def with_views(sql: str) -> str:
    """Put the views a statement names in front of it, inner ones first."""
    order: list[str] = []

    def visit(text: str) -> None:
        for view in VIEW_SQL:
            if view not in order and re.search(rf"\b{view}\b", text):
                visit(VIEW_SQL[view])
                if view not in order:
                    order.append(view)

    visit(sql)
    if not order:
        return sql
    head = ",\n".join(f"{v} AS ({VIEW_SQL[v].strip()})" for v in order)
    own = re.match(r"WITH\s+(RECURSIVE\s+)?", sql, flags=re.I)
    if own:
        return f"WITH {own.group(1) or ''}{head},\n{sql[own.end():]}"
    return f"WITH {head}\n{sql}"
