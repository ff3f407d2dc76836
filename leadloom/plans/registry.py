"""Queries by name, each with SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.files import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


class Tables:
    """Tables of a folder, read on access."""

    def __init__(self, spark: SparkSession, folder: str):
        self._spark, self._folder = spark, folder

    @property
    def spark(self) -> SparkSession:
        return self._spark

    @property
    def folder(self) -> str:
        return self._folder

    def __getattr__(self, name: str) -> DataFrame:
        return table(self._spark, self._folder, name)


def query(sql: str | None = None):
    def register(f: Callable[[Tables], DataFrame]):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register
