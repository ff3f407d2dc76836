"""The alert ladder: facts first, then limits that depend on what was sent before."""

from __future__ import annotations

from collections import OrderedDict, deque

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..params import DEFAULT, Params


def quiet(hour: Column, start: int, stop: int) -> Column:
    if start == stop:
        return F.lit(False)
    return (hour >= start) & (hour < stop) if start < stop else (hour >= start) | (hour < stop)


def static_ladder(events: DataFrame, *, params: Params = DEFAULT) -> DataFrame:
    """The first reason against an alert, from facts of the event alone; an unknown value passes the threshold."""
    reason = (
        F.when(F.col("event_type") == "error", "animal")
        .when(F.col("event_type") == "view", "offer")
        .when(F.col("value").isNotNull() & (F.col("value") < params.min_confidence), "confidence")
        .when(quiet(F.hour("ts"), params.quiet_from, params.quiet_to), "quiet")
        .otherwise("send")
    )
    return events.withColumn("decision", reason)


def crossposts(events: DataFrame, *, params: Params = DEFAULT) -> DataFrame:
    """For each event the best earlier one within the window: the same user before the same content, then the latest.

    Keys are cut into days, and what the next day may refer to is in both, so a
    hot key is many partitions.  The latest earlier row of a key is the only
    one that can be in the window at all if any is.
    """
    window, day = params.dedup_hours * 3_600_000_000, 86_400_000_000
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    rows = events.select("event_id", at.alias("at"), "user_id", "props")

    def latest(key: str) -> DataFrame:
        own = rows.where(F.col(key).isNotNull()).select("event_id", "at", key, F.floor(F.col("at") / day).alias("day"), F.lit(False).alias("past"))
        late = own.where(F.col("at") >= (F.col("day") + 1) * day - window).select("event_id", "at", key, (F.col("day") + 1).alias("day"), F.lit(True).alias("past"))
        before = Window.partitionBy(key, "day").orderBy("at").rangeBetween(Window.unboundedPreceding, -1)
        found = own.unionAll(late).withColumn("prev", F.max(F.struct("at", "event_id")).over(before))
        return found.where(~F.col("past") & (F.col("prev.at") >= F.col("at") - window)).select("event_id", F.col("prev.event_id").alias(key))

    best = latest("user_id").join(latest("props"), "event_id", "full")
    return best.select("event_id", F.coalesce("user_id", "props").alias("prev_id"))


def fold(events: DataFrame, *, tenant: str, params: Params = DEFAULT) -> DataFrame:
    """Decisions in time order within a tenant: crosspost within the window, then the hourly limit on what was sent.

    No state outlives the longer window, so a tenant is cut into segments where
    no event came for so long, and segments are folded apart.  A task streams
    its sorted rows and holds what the windows hold, however dense a tenant is.
    """
    limit, window, hour = params.alerts_per_hour, params.dedup_hours * 3_600_000_000, 3_600_000_000
    rows = events.select("event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), F.col(tenant).alias("tenant"), F.col("props"))
    order = Window.partitionBy("tenant").orderBy("at", "event_id")
    fresh = F.coalesce((F.col("at") - F.lag("at").over(order) > max(window, hour)).cast("long"), F.lit(0))
    rows = rows.withColumn("fresh", fresh).withColumn("segment", F.sum("fresh").over(order.rowsBetween(Window.unboundedPreceding, 0)))

    def decide(batches):
        now, sent, last = None, deque(), OrderedDict()
        for batch in batches:
            out = []
            for tenant, segment, at, props in zip(*(batch.column(k).to_pylist() for k in range(1, 5))):
                if now != (tenant, segment):
                    now, sent, last = (tenant, segment), deque(), OrderedDict()
                if at is None:
                    out.append("send")
                    continue
                while sent and sent[0] <= at - hour:
                    sent.popleft()
                while last and next(iter(last.values())) < at - window:
                    last.popitem(last=False)
                if props in last:
                    out.append("crosspost")
                elif len(sent) >= limit:
                    out.append("limit")
                else:
                    sent.append(at)
                    last[props] = at
                    out.append("send")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], ["event_id", "decision"])

    dealt = rows.repartition("tenant", "segment").sortWithinPartitions("tenant", "segment", "at", "event_id")
    return dealt.select("event_id", "tenant", "segment", "at", "props").mapInArrow(decide, "event_id long, decision string")


def hourly_counts(events: DataFrame) -> DataFrame:
    """Events of the same user in the hour up to each event."""
    seconds = F.unix_micros(F.col("ts").cast("timestamp"))
    trailing = Window.partitionBy("user_id").orderBy(seconds).rangeBetween(-3_600_000_000, 0)
    return events.withColumn("n_hour", F.count("*").over(trailing))


def paused(events: DataFrame) -> DataFrame:
    """Last pause or resume per user: signup resumes, error pauses."""
    states = events.where(F.col("event_type").isin("signup", "error"))
    return states.groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("state")).withColumn("paused", F.col("state") == "error")


def night_digest(events: DataFrame, *, top: int = 20, params: Params = DEFAULT) -> DataFrame:
    """Latest views of the last quiet window whose user bought nothing then: an anti-join, then the top."""
    hours = (params.quiet_from - params.quiet_to) % 24
    recent = events.where(F.col("ts") > F.lit(params.as_of).cast("timestamp_ntz") - F.expr(f"INTERVAL {hours} HOURS"))
    unsent = recent.where("event_type = 'view'").join(recent.where("event_type = 'purchase'").select("user_id"), "user_id", "left_anti")
    return unsent.orderBy(F.col("ts").desc(), "event_id").limit(top)
