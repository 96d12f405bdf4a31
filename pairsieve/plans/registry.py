"""The catalogue: a name, a function of (session, folder), and its SQL counterpart."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

Runner = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Entry:
    run: Runner
    sql: str | None = None


ENTRIES: dict[str, Entry] = {}


def register(name: str, sql: str | None = None) -> Callable[[Runner], Runner]:
    """Add a query; ``sql`` gives the same rows from the same tables in plain SQL."""

    def add(run: Runner) -> Runner:
        if name in ENTRIES:
            raise ValueError(f"query {name} is registered twice")
        ENTRIES[name] = Entry(run, sql)
        return run

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")

