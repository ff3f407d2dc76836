"""Row numbers within groups of any size, and fields written so that they can be told apart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import written

#: Range partitions of a ranking at least, whatever the session's shuffle partitions are.
LEAST_RANGES = 8


def field(value: Column) -> Column:
    """A value as `-` if null, else its UTF-8 byte count, `:` and the value (integers in decimal)."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def numbered(rows: DataFrame, group: str, order: list[str], name: str) -> DataFrame:
    """Adds idx, the number from 0 of each row in its group by ``order`` (nulls first), and n, the rows of the group.

    Ranges of (group, order) are numbered by themselves and moved up by the rows
    of the ranges before, so a group may hold most of all rows.  Rows equal in
    ``order`` are dealt out by where they stood; they take neighbouring numbers in
    no stated order.
    """
    spark = rows.sparkSession
    ranges = max(LEAST_RANGES, int(spark.conf.get("spark.sql.shuffle.partitions")))
    tagged = rows.withColumn("tie", F.monotonically_increasing_id())
    tagged = tagged.repartitionByRange(ranges, group, *order, "tie").withColumn("range", F.spark_partition_id())
    # Written, so that both readers below see the same ranges.
    tagged = written(tagged, name)
    before = Window.partitionBy(group).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    own = Window.partitionBy(group)
    # As many rows as ranges and groups together.
    bases = tagged.groupBy(group, "range").agg(F.count("*").alias("rows")).select(group, "range", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("base"), F.sum("rows").over(own).alias("n"))
    inside = Window.partitionBy(group, "range").orderBy(*order, "tie")
    placed = tagged.withColumn("place", F.row_number().over(inside) - 1).join(bases, [group, "range"])
    return placed.withColumn("idx", F.col("base") + F.col("place")).drop("tie", "range", "base", "place")
