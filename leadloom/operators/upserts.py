"""Merges of incoming rows into a table, as joins, and state kept over events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..params import DEFAULT, Params


def conditional(old: DataFrame, new: DataFrame, key: str, columns: list[str], take: Column) -> DataFrame:
    """Insert missing rows; of known ones take the new columns only where ``take`` (over o.* and n.*) holds."""
    joined = old.alias("o").join(new.alias("n"), F.col(f"o.{key}") == F.col(f"n.{key}"), "full_outer")
    fresh = F.col(f"o.{key}").isNull() | (F.col(f"n.{key}").isNotNull() & F.coalesce(take, F.lit(False)))
    return joined.select(F.coalesce(f"o.{key}", f"n.{key}").alias(key), *(F.when(fresh, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c) for c in columns))


def coalescing(old: DataFrame, new: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """New values win where they are not null."""
    joined = old.alias("o").join(new.alias("n"), F.col(f"o.{key}") == F.col(f"n.{key}"), "full_outer")
    return joined.select(F.coalesce(f"o.{key}", f"n.{key}").alias(key), *(F.coalesce(f"n.{c}", f"o.{c}").alias(c) for c in columns))


def insert_absent(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    return old.unionByName(new.dropDuplicates([key]).join(old, key, "left_anti"))


def delete(old: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    return old.join(gone, key, "left_anti")


def streaks(events: DataFrame, by: str, state: str, order: list[str]) -> DataFrame:
    """Runs of one state: first and last time and length."""
    own = Window.partitionBy(by).orderBy(*order)
    marked = events.withColumn("fresh", (~F.col(state).eqNullSafe(F.lag(state).over(own))).cast("int"))
    runs = marked.withColumn("run", F.sum("fresh").over(own.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy(by, "run", state).agg(F.min(order[0]).alias("since"), F.max(order[0]).alias("until"), F.count("*").alias("n"))


def quarantines(runs: DataFrame, bad: str, state: str, *, params: Params = DEFAULT) -> DataFrame:
    """For runs of the bad state: when it ends, later from the third strike on."""
    wait = F.when(F.col("n") >= params.strikes, F.expr(f"INTERVAL {params.quarantine_long_h} HOURS")).otherwise(F.expr(f"INTERVAL {params.quarantine_min} MINUTES"))
    return runs.where(F.col(state) == bad).withColumn("back_at", F.col("until") + wait)


def append_unique(events: DataFrame, by: str, value: str) -> DataFrame:
    """Values seen per key, each once, and how often any came."""
    return events.groupBy(by).agg(F.array_join(F.array_sort(F.collect_set(value)), ",").alias("seen"), F.count("*").alias("n"))
