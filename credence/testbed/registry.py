"""Registered queries: what each computes over the test tables, and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame

from credence.testbed.tables import BASE_TABLES, VIEWS, Tables

# SQL-only steps that several checks share: name -> (names it reads, SQL).
SQL_STEPS: dict[str, tuple[list[str], str]] = {}


@dataclass(frozen=True)
class Query:
    run: Callable[[Tables], DataFrame]
    sql: str | None = None


QUERIES: dict[str, Query] = {}


def query(name: str, reads: list[str] | None = None, sql: str | None = None):
    """Registers a function of Tables; `sql` may name the views and steps listed in `reads`."""

    def register(run: Callable[[Tables], DataFrame]):
        QUERIES[name] = Query(run, with_views(reads or [], sql) if sql else None)
        return run

    return register


def with_views(names: list[str], body: str) -> str:
    """The body behind a WITH clause that defines the named views and all they need."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        if name in BASE_TABLES or name in ordered:
            return
        for needed in _definition(name)[0]:
            visit(needed)
        ordered.append(name)

    for name in names:
        visit(name)
    parts = []
    for name in ordered:
        inputs, text = _definition(name)
        parts.append(f"{name} as ({text.format(**{n: n for n in inputs}) if '{' in text else text})")
    return ("with recursive " + ",\n".join(parts) + "\n" if parts else "") + body


def _definition(name: str) -> tuple[list[str], str]:
    return VIEWS[name] if name in VIEWS else SQL_STEPS[name]
