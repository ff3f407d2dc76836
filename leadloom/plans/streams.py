"""Streams run over what a table holds now."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions.text import first_phone
from ..operators import alerts
from ..params import DEFAULT
from ..session import shared_dir
from ..streaming import digest, ladder, ledger, replay
from .registry import query


@query("SELECT event_type, count(*) n FROM events GROUP BY event_type")
def stream_dedup_count(t):
    rows = replay.first_seen(replay.events(t.spark, f"{t.folder}/events.parquet"), "event_id")
    return replay.drained(rows.select("event_id", "event_type"), "dedup").groupBy("event_type").agg(F.count("*").alias("n"))


@query("SELECT event_id, CASE WHEN row_number() OVER (PARTITION BY user_id, date_trunc('hour', ts) ORDER BY ts, event_id) <= 15 THEN 'send' ELSE 'limit' END decision FROM events")
def stream_rate_limit(t):
    return replay.drained(replay.limited(replay.events(t.spark, f"{t.folder}/events.parquet")), "limit")


def _alerts(events):
    """Events as what the ladder takes: errors pause a user's alerts and signups resume them; the props stand for the content."""
    kind = F.when(F.col("event_type") == "error", "pause").when(F.col("event_type") == "signup", "resume").otherwise("post")
    shown = events.select(
        F.col("event_id").alias("alert_id"), F.col("ts").cast("timestamp").alias("time"), "user_id", kind.alias("kind"), F.concat(F.lit("p"), F.col("event_id").cast("string")).alias("post"),
        first_phone(F.concat(F.lit("tel 600"), F.lpad(F.floor(F.col("value") * 100).cast("string"), 6, "0"))).alias("phone"), F.col("props").alias("content"),
        (F.col("value") > 95).alias("animal"), F.when(F.col("value") < 5, "offer").alias("direction"), F.floor(F.col("value") * 2).cast("int").alias("confidence"),
    )
    return ladder.prepared(shown, "user_id")


@query()
def alert_stream(t):
    """S-13 to S-16, SNK-15 as a stream: the ladder with its limits, crossposts, pauses and hourly digests; tests compare it with the fold and with plain loops."""
    return replay.drained(ladder.stream(_alerts(replay.events(t.spark, f"{t.folder}/events.parquet"))), "ladder", store=replay.STORE)


@query()
def alert_history(t):
    """S-13 to S-16 over the table at once."""
    return ladder.fold(_alerts(t.events))


@query("""WITH e AS (SELECT user_id, event_type, ts, row_number() OVER w - row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_type) run, max(CASE WHEN event_type <> 'error' THEN ts END) OVER (PARTITION BY user_id) good, last_value(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_type ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) final, max(ts) OVER (PARTITION BY user_id) last FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_type)),
r AS (SELECT user_id, event_type state, run, min(ts) since, max(ts) last, count(*) n FROM e GROUP BY user_id, event_type, run QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY max(ts) DESC, event_type DESC) = 1)
SELECT user_id, state, since, last, n, CASE WHEN state = 'error' THEN n ELSE 0 END failures FROM r""")
def state_ledger(t):
    """SRC-9, SNK-3 to SNK-5 as a stream: states with counters, each batch committed once."""
    table = ledger.LedgerTable(t.spark, f"{shared_dir(t.spark)}/leadloom-ledger-{uuid.uuid4().hex[:12]}", "user_id long, state string, since timestamp_ntz, last timestamp_ntz, n long, failures long", "user_id")
    rows = replay.events(t.spark, f"{t.folder}/events.parquet").select("user_id", "event_type", F.col("ts").cast("timestamp_ntz").alias("ts"))
    put = table.sink(ledger.state_counters("user_id", "event_type", "ts"), "events")
    rows.writeStream.foreachBatch(put).option("checkpointLocation", f"{table.path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return table.read()


@query("""WITH d AS (SELECT event_id, event_type, ts, CASE WHEN event_type = 'error' THEN 'animal' WHEN event_type = 'view' THEN 'offer' WHEN value < 40 THEN 'confidence' WHEN hour(ts) >= 22 OR hour(ts) < 6 THEN 'quiet' ELSE 'send' END s FROM events),
o AS (SELECT event_id FROM d WHERE s IN ('confidence', 'quiet') AND event_type <> 'signup' AND ts > (SELECT max(ts) FROM events) - INTERVAL 8 HOUR ORDER BY ts DESC, CAST(event_id AS VARCHAR) LIMIT 20)
SELECT CAST(event_id AS VARCHAR) post, CASE s WHEN 'send' THEN 'alert' ELSE 'skipped_' || s END channel FROM d WHERE s IN ('send', 'animal', 'offer') UNION ALL SELECT CAST(event_id AS VARCHAR), 'digest' FROM o""")
def digest_marks(t):
    """S-17, S-18, SNK-6: records of decisions, and a digest that marks what it sent; sent twice, it changes nothing."""
    now = t.events.agg(F.max("ts")).first()[0]
    table = digest.records(t.spark, f"{shared_dir(t.spark)}/leadloom-records-{uuid.uuid4().hex[:12]}")
    digest.record(table, "ladder", alerts.static_ladder(t.events, params=DEFAULT).select(F.col("event_id").alias("post"), "decision"))
    posts = t.events.select(F.col("event_id").alias("post"), (F.col("event_type") != "signup").alias("is_order"), F.lit("new").alias("status"), F.col("ts").alias("fetched_at"), F.col("ts").alias("published_at"))
    for _ in range(2):
        digest.send(table, posts, now)
    return table.read().select("post", "channel")
