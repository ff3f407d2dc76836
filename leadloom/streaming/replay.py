"""Streams over tables that grow by files: deduplication and limits with bounded state."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..params import DEFAULT, Params
from ..session import shared_dir


def events(spark: SparkSession, path: str) -> DataFrame:
    schema = spark.read.parquet(path).schema
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder = where.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(where).isDirectory()
    # A stream reads a folder: of a single file, its folder with this very name alone.
    reader = spark.readStream.schema(schema)
    rows = reader.parquet(path) if folder else reader.option("pathGlobFilter", path.rpartition("/")[2]).parquet(path.rpartition("/")[0])
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


#: The store that streams with timers and several states need.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def drained(stream: DataFrame, name: str, *, store: tuple[str, str] | None = None) -> DataFrame:
    """Run a stream over what is there, with its checkpoint in the shared folder, and read what it wrote."""
    spark = stream.sparkSession
    base = f"{shared_dir(spark)}/leadloom-stream-{name}-{uuid.uuid4().hex[:12]}"
    before = spark.conf.get(store[0]) if store else None
    if store:
        spark.conf.set(*store)
    try:
        query = stream.writeStream.format("parquet").option("checkpointLocation", f"{base}/checkpoint").option("path", f"{base}/out").outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        if store:
            spark.conf.set(store[0], before)
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


def first_seen(stream: DataFrame, key: str, *, params: Params = DEFAULT) -> DataFrame:
    """The first row of each key within the watermark; late rows within it count."""
    return stream.withWatermark("ts", f"{params.max_age_h} hours").dropDuplicatesWithinWatermark([key])


HOUR = 3_600_000_000


def limited(stream: DataFrame, *, params: Params = DEFAULT) -> DataFrame:
    """Per user and hour at most so many rows are sent, the earliest of each trigger first.

    State is one row a user with the counts of the hours that may still get rows; an hour
    goes when the watermark has passed its end, as later rows of it are dropped as late.
    """
    keyed = stream.withWatermark("ts", f"{params.max_age_h} hours").select("event_id", "user_id", "ts", F.unix_micros("ts").alias("at"), F.unix_micros(F.date_trunc("HOUR", "ts")).alias("hour"))
    limit, keep = params.alerts_per_hour, (params.max_age_h + 1) * HOUR

    def step(key, batches, state):
        sent = dict(zip(*state.get)) if state.exists else {}
        watermark = state.getCurrentWatermarkMs()
        # All of a user's rows: a key comes in several chunks, which are ordered together.
        rows = [] if state.hasTimedOut else [r for b in batches for r in zip(b["at"].tolist(), b["event_id"].tolist(), b["hour"].tolist())]
        ids, decisions = [], []
        for at, event_id, hour in sorted(rows, key=lambda r: (r[0] == r[0], r[0], r[1])):
            # Rows without a time share an hour of their own.
            hour = int(hour) if hour == hour else None
            n = sent.get(hour, 0)
            sent[hour] = min(limit, n + 1)
            ids.append(event_id)
            decisions.append("send" if n < limit else "limit")
        sent = {h: n for h, n in sent.items() if h is None or h + HOUR > watermark * 1000}
        if sent:
            state.update((list(sent), list(sent.values())))
        elif state.exists:
            state.remove()
        timed = [h for h in sent if h is not None]
        if timed:
            state.setTimeoutTimestamp(max((min(timed) + keep) // 1000, watermark + 1))
        if ids:
            yield pd.DataFrame({"event_id": ids, "decision": decisions})

    return keyed.groupBy("user_id").applyInPandasWithState(step, "event_id long, decision string", "hours array<long>, sent array<long>", "append", "EventTimeTimeout")
