"""Registered queries: a Spark callable and, where SQL can say it, its check."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cuewise.plans.stage import STAGE_SQL, Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECKS: dict[str, str] = {}


def with_stage(uses: str, body: str) -> str:
    """Prefix `body` with the staging views it names and all they need."""
    need: list[str] = []

    def add(name: str) -> None:
        deps, _ = STAGE_SQL[name]
        for dep in deps.split():
            add(dep)
        if name not in need:
            need.append(name)

    for name in uses.split():
        add(name)
    body = body.strip()
    if not need:
        return body
    views = ",\n".join(f"{n} AS ({STAGE_SQL[n][1].strip()})" for n in need)
    if body.upper().startswith("WITH RECURSIVE"):
        return f"WITH RECURSIVE {views},\n{body[14:].strip()}"
    if body.upper().startswith("WITH"):
        return f"WITH {views},\n{body[4:].strip()}"
    return f"WITH {views}\n{body}"


def query(name: str, uses: str = "", sql: str | None = None):
    """Register `fn(tables)`; `sql` reads the staging views in `uses`."""

    def register(fn: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: fn(Tables(spark, sf_dir))
        if sql is not None:
            CHECKS[name] = with_stage(uses, sql)
        return fn

    return register
