"""Registered queries: each runs an operator over whole given tables, most with equivalent SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Run = Callable[[SparkSession, str], DataFrame]


class Queries:
    """Named queries and, where SQL can say the same, the SQL."""

    def __init__(self) -> None:
        self.runs: dict[str, Run] = {}
        self.sql: dict[str, str] = {}

    def add(self, name: str, sql: str | None = None) -> Callable[[Run], Run]:
        def register(run: Run) -> Run:
            self.runs[name] = run
            if sql is not None:
                self.sql[name] = sql.strip()
            return run

        return register

    def merge(self, *others: "Queries") -> "Queries":
        for other in others:
            overlap = self.runs.keys() & other.runs.keys()
            if overlap:
                raise ValueError(f"registered twice: {sorted(overlap)}")
            self.runs.update(other.runs)
            self.sql.update(other.sql)
        return self


def collect() -> Queries:
    from fleetsight.plans.queries import (
        alerting,
        changing,
        functions,
        ingesting,
        merging,
        operations,
        postings,
        reading,
        reporting,
        scoring,
        searching,
        statistics,
        streams,
    )

    modules = (
        statistics, functions, scoring, merging, alerting, searching, operations, reading, ingesting, changing,
        reporting, streams, postings,
    )
    return Queries().merge(*[module.QUERIES for module in modules])
