"""The alert ladder over a stream and over a table, by the same steps.

Whether an alert is sent depends on those sent before: a post that is on record is a
duplicate, one with the phone or content of an alert of the last hours a crosspost,
and an alert held back does not count towards the hour's limit.  While the limit
holds, one digest an hour tells how many wait.  A tenant's rows are taken in order of
time; what is kept of them is bounded by the windows.

A stream takes the rows of each trigger in order, behind those of earlier triggers;
rows later than the watermark are dropped by Spark.  Null phones and contents match
nothing, a null kind is a post, an unknown confidence passes, and rows without a time
are sent and remembered by nobody.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from ..params import DEFAULT, Params

HOUR = 3_600_000_000
#: Columns of the rows that come in: at is in microseconds, kind is post, pause or resume.
ROWS = ("alert_id", "at", "kind", "post", "phone", "content", "animal", "direction", "confidence", "quiet")
FOUND = "tenant long, at long, alert_id long, decision string, crosspost_of long, waiting long"
#: Decisions that leave a record: the post is a duplicate from then on.
ON_RECORD = ("send", "limit", "animal", "offer")


@dataclass
class Memory:
    """What a tenant's next decisions depend on: sent alerts (at, alert_id, phone, content) of the window, times of held-back ones of the hour."""

    paused: bool = False
    digest_at: int | None = None
    sent: list[tuple] = field(default_factory=list)
    limited: list[int] = field(default_factory=list)


def steps(memory: Memory, seen, row: tuple, p: Params) -> Iterator[tuple]:
    """(decision, crosspost_of, waiting) for one row, and a digest behind it where one is due.  ``seen`` has get and put of a post's time."""
    alert_id, at, kind, post, phone, content, animal, direction, confidence, quiet = row
    if kind in ("pause", "resume"):
        memory.paused = kind == "pause"
        yield kind, None, None
        return
    if at is None:
        yield "send", None, None
        return
    memory.sent = [s for s in memory.sent if s[0] > at - p.dedup_hours * HOUR]
    memory.limited = [t for t in memory.limited if t > at - HOUR]
    known = seen.get(post) if post is not None else None
    alike = [((phone is not None and s[2] == phone), s[0], s[1]) for s in memory.sent if (phone is not None and s[2] == phone) or (content is not None and s[3] == content)]
    crosspost = max(alike)[2] if alike else None
    if known is not None and known > at - p.remember_hours * HOUR:
        decision, crosspost = "duplicate", None
    elif crosspost is not None:
        decision = "crosspost"
    elif memory.paused:
        decision = "paused"
    elif animal:
        decision = "animal"
    elif direction == "offer":
        decision = "offer"
    elif confidence is not None and confidence < p.min_confidence:
        decision = "confidence"
    elif quiet:
        decision = "quiet"
    elif 0 < p.alerts_per_hour <= sum(s[0] > at - HOUR for s in memory.sent):
        decision = "limit"
    else:
        decision = "send"
        memory.sent.append((at, alert_id, phone, content))
    if decision in ON_RECORD and post is not None:
        seen.put(post, at)
    yield decision, crosspost, None
    if decision == "limit":
        memory.limited.append(at)
        if memory.digest_at is None or memory.digest_at <= at - HOUR:
            memory.digest_at = at
            yield "digest", None, len(memory.limited)


def prepared(rows: DataFrame, tenant: str, *, params: Params = DEFAULT) -> DataFrame:
    """The columns of ROWS behind tenant and time (a timestamp); quiet hours by the session's time zone."""
    hour, start, stop = F.hour("time"), params.quiet_from, params.quiet_to
    quiet = F.lit(False) if start == stop else ((hour >= start) & (hour < stop) if start < stop else (hour >= start) | (hour < stop))
    out = rows.withColumns({"at": F.unix_micros("time"), "quiet": F.coalesce(quiet, F.lit(False))})
    return out.select(F.col(tenant).cast("long").alias("tenant"), "time", *ROWS)


class _Seen(dict):
    put = dict.__setitem__


def fold(rows: DataFrame, *, params: Params = DEFAULT) -> DataFrame:
    """Decisions over a table of prepared rows: a task streams its tenants' rows in order and holds one tenant's memory.

    Each decision depends on the one before, so a tenant is one task's work; its
    rows are never gathered.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tenant, memory, seen, since = object(), Memory(), _Seen(), None
        for batch in batches:
            out = []
            for row in zip(*(batch.column(c).to_pylist() for c in ("tenant", *ROWS))):
                if row[0] != tenant:
                    tenant, memory, seen, since = row[0], Memory(), _Seen(), row[2]
                at = row[2]
                if at is not None and since is not None and at - since > params.remember_hours * HOUR:
                    for post in [k for k, t in seen.items() if t <= at - params.remember_hours * HOUR]:
                        del seen[post]
                    since = at
                for k, (decision, crosspost, waiting) in enumerate(steps(memory, seen, row[1:], params)):
                    out.append((tenant, at, None if k else row[1], decision, crosspost, waiting))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
            names = ["tenant", "at", "alert_id", "decision", "crosspost_of", "waiting"]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], names)

    return rows.drop("time").repartition("tenant").sortWithinPartitions("tenant", "at", "alert_id").mapInArrow(work, FOUND)


class _Kept(dict):
    """Posts on record, with those that a trigger puts there."""

    def __init__(self, known=()):
        super().__init__(known)
        self.fresh = {}

    def put(self, post, at):
        self[post] = self.fresh[post] = at


def _plain(x):
    return None if x is None or x != x else x


class _Ladder(StatefulProcessor):
    """A tenant's memory is read once a trigger and written once, however many rows it has."""

    def __init__(self, params: Params):
        self.params = params

    def init(self, handle) -> None:
        self.handle = handle
        self.memory = handle.getValueState("memory", "paused boolean, digest_at long, sent array<struct<at: long, alert_id: long, phone: string, content: string>>, limited array<long>, timer long")
        self.posts = handle.getListState("posts", "post string, at long")

    def handleInputRows(self, key, rows, timerValues):
        p = self.params
        memory, seen, timer = Memory(), _Kept(), None
        if self.memory.exists():
            paused, digest_at, sent, limited, timer = self.memory.get()
            memory = Memory(paused, digest_at, [tuple(s) for s in sent], list(limited))
            seen = _Kept(self.posts.get())
        taken = [tuple(map(_plain, row)) for frame in rows for row in zip(*(frame[c].tolist() for c in ROWS))]
        out = []
        for row in sorted(taken, key=lambda r: (r[1] is not None, r[1] or 0, r[0] is None, r[0] or 0)):
            row = (*(None if x is None else int(x) for x in row[:2]), *row[2:])
            for k, (decision, crosspost, waiting) in enumerate(steps(memory, seen, row, p)):
                out.append((key[0], row[1], None if k else row[0], decision, crosspost, waiting))
        last = max((r[1] for r in out if r[1] is not None), default=None)
        # Rows of later triggers are behind this trigger's watermark: what is too old for them goes.
        before = timerValues.getCurrentWatermarkInMs() * 1000 - p.remember_hours * HOUR
        kept = {post: at for post, at in seen.items() if at > before}
        if len(kept) < len(seen):
            self.posts.put(list(kept.items())) if kept else self.posts.clear()
        elif seen.fresh:
            self.posts.appendList(list(seen.fresh.items()))
        if last is not None:
            # One timer a tenant: when it fires, what is older than the bound goes, and all of it once nothing is left.
            if timer is not None:
                self.handle.deleteTimer(timer)
            timer = last // 1000 + p.remember_hours * 3_600_000
            self.handle.registerTimer(timer)
        self.memory.update((memory.paused, memory.digest_at, memory.sent, memory.limited, timer))
        names = ["tenant", "at", "alert_id", "decision", "crosspost_of", "waiting"]
        yield pd.DataFrame({c: list(x) if c == "decision" else pd.array(x, "Int64") for c, x in zip(names, zip(*out))})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        before = expiredTimerInfo.getExpiryTimeInMs() * 1000 - self.params.remember_hours * HOUR
        kept = {post: at for post, at in dict(self.posts.get()).items() if at > before} if self.posts.exists() else {}
        if kept:
            self.posts.put(list(kept.items()))
        else:
            self.posts.clear()
        if self.memory.exists():
            memory = self.memory.get()
            if kept or memory[0]:
                self.memory.update((*memory[:4], None))
            else:
                self.memory.clear()
        yield pd.DataFrame({c: pd.Series([], dtype="object" if c == "decision" else "Int64") for c in ("tenant", "at", "alert_id", "decision", "crosspost_of", "waiting")})

    def close(self) -> None:
        pass


def stream(rows: DataFrame, *, params: Params = DEFAULT) -> DataFrame:
    """Decisions over a stream of prepared rows; a tenant's memory ends when nothing came for the remembered time."""
    late = rows.withWatermark("time", f"{params.max_age_h} hours")
    return late.groupBy("tenant").transformWithStateInPandas(_Ladder(params), FOUND, "Append", "EventTime")


def groups_of(found: DataFrame, rows: DataFrame, group: str) -> DataFrame:
    """alert_id and the groups in which a sent alert's crossposts stood, each once."""
    posts = found.where("decision = 'crosspost'").select("alert_id", F.col("crosspost_of").alias("sent_id"))
    return posts.join(rows.select("alert_id", group), "alert_id").groupBy(F.col("sent_id").alias("alert_id")).agg(F.array_sort(F.collect_set(group)).alias("groups"))
