"""Registration of queries and their SQL twins.

``@query(name, sql, doubles)`` registers ``fn(views) -> DataFrame``.  The SQL may
use the fixture views by name; the ones it mentions are put in front of it.
``doubles`` lists the floating columns, rounded alike on both sides."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dipsift.plans.fixtures import VIEW_SQL, Views

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}
DIGITS = 8


def _with_views(body: str) -> str:
    needed: list[str] = []

    def visit(text: str) -> None:
        for name, definition in VIEW_SQL.items():
            if name not in needed and re.search(rf"\b{name}\b", text):
                visit(definition)
                if name not in needed:
                    needed.append(name)

    visit(body)
    parts = [f"{n} AS ({VIEW_SQL[n].strip()})" for n in needed]
    body = body.strip()
    if body.upper().startswith("WITH "):
        own, head = body[5:].lstrip(), "WITH "
        if own.upper().startswith("RECURSIVE "):
            own, head = own[10:].lstrip(), "WITH RECURSIVE "
        return head + ",\n".join([*parts, own])
    return ("WITH " + ",\n".join(parts) + "\n" if parts else "") + body


def query(name: str, sql: str | None = None, doubles: str = "", digits: int = DIGITS):
    columns = doubles.split()

    def register(fn: Callable[[Views], DataFrame]):
        def run(spark, sf_dir: str) -> DataFrame:
            df = fn(Views(spark, sf_dir))
            return df.withColumns({c: F.round(F.col(c), digits) for c in columns})

        run.__name__ = name
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            text = _with_views(sql)
            if columns:
                rounded = ", ".join(f"round({c}, {digits}) + 0e0 AS {c}" for c in columns)
                text = f"SELECT * REPLACE ({rounded}) FROM (\n{text}\n)"
            ORACLES[name] = text
        return fn

    return register
