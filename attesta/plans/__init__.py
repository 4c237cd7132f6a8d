"""Registered queries: a name, the Spark program over the driver tables, and DuckDB SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a program that takes a table reader (name -> DataFrame)."""

    def keep(program: Callable[[Callable[[str], DataFrame]], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return program(lambda table: spark.read.parquet(f"{sf_dir}/{table}.parquet"))

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return program

    return keep


def load() -> None:
    """Imports every module of queries once."""
    from attesta.plans import aggregates, calendar, correlation, decisions, evidence, extraction, fields, fusion, heuristics, intake, listings, records, regions, screening, streams, textboxes  # noqa: F401
