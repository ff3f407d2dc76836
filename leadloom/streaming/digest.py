"""Records of what became of posts, and a night's digest that marks what it sent."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..params import DEFAULT, Params
from .ladder import ON_RECORD
from .ledger import LedgerTable, append_absent

RECORDS = "post string, channel string, digest string"
#: Posts of a digest at most.
TOP = 20


def records(spark: SparkSession, path: str) -> LedgerTable:
    return LedgerTable(spark, path, RECORDS, "post")


def record(table: LedgerTable, batch: str, decisions: DataFrame) -> bool:
    """Write down posts (post, decision) that were sent, or held back by the limit, as animals or as offers; the others stay open for the digest."""
    channel = F.when(F.col("decision") == "send", "alert").otherwise(F.concat(F.lit("skipped_"), "decision"))
    rows = decisions.where(F.col("decision").isin(*ON_RECORD) & F.col("post").isNotNull()).select(F.col("post").cast("string").alias("post"), channel.alias("channel"), F.lit(None).cast("string").alias("digest"))
    return table.commit(batch, rows, append_absent("post"))


def send(table: LedgerTable, posts: DataFrame, now: datetime, *, top: int = TOP, params: Params = DEFAULT) -> DataFrame:
    """The posts of this night's digest, newest first; none if it was sent before.

    ``posts`` has post, is_order, status, fetched_at and published_at.  The marks and
    the digest are one commit: what the ledger holds is what is sent, and a second
    run finds its night there.
    """
    night = now.strftime("%Y-%m-%d")
    hours = (params.quiet_to - params.quiet_from) % 24 or 24
    since = F.lit(now).cast("timestamp") - F.expr(f"INTERVAL {hours} HOURS")
    open_ = posts.where("is_order and status = 'new' and post is not null").where((F.col("fetched_at").cast("timestamp") > since) & (F.col("fetched_at").cast("timestamp") <= F.lit(now).cast("timestamp")))
    rows = open_.withColumn("post", F.col("post").cast("string")).join(table.read().select("post"), "post", "left_anti")
    newest = rows.groupBy("post").agg(F.max("published_at").alias("published_at")).orderBy(F.col("published_at").desc_nulls_last(), "post").limit(top)
    fresh = table.commit(f"digest-{night}", newest.select("post", F.lit("digest").alias("channel"), F.lit(night).alias("digest")), append_absent("post"))
    sent = table.read().where((F.col("digest") == night) & F.lit(fresh))
    return sent.join(posts.select(F.col("post").cast("string").alias("post"), "published_at").groupBy("post").agg(F.max("published_at").alias("published_at")), "post")
