"""The alert ladder as a stream, as a fold and by plain queries over the whole history; ledgers that are replayed."""

import random
from dataclasses import replace
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from leadloom.params import DEFAULT
from leadloom.streaming import digest, ladder, ledger, replay

SCHEMA = "alert_id long, time timestamp, owner long, kind string, post string, phone string, content string, animal boolean, direction string, confidence int, grp string"
START = datetime(2024, 1, 3, 3)
P = replace(DEFAULT, alerts_per_hour=3, remember_hours=30)


def made(n, seed, step=400):
    rng = random.Random(seed)
    rows, at = [], START
    for k in range(n):
        at += timedelta(seconds=rng.randrange(step))
        kind = rng.choice(["post"] * 30 + [None, "pause", "resume", "resume"])
        rows.append((k, at, rng.choice([1, 1, 1, 2, 3]), kind, rng.choice([f"p{k}", f"p{rng.randrange(n)}", None]), rng.choice([None, None, str(rng.randrange(40))]), rng.choice([None, f"c{rng.randrange(60)}"]), rng.random() < 0.05, rng.choice(["demand"] * 9 + ["offer", None]), rng.choice([None, 10, 80, 90, 95]), f"g{k % 4}"))
    return rows


def history(rows, p):
    """Decisions by looking through all that was written down before, row by row."""
    out = []
    for owner in sorted({r[2] for r in rows}):
        paused, book = False, []  # (at, channel, post, alert_id, phone, content)
        for k, at, _, kind, post, phone, content, animal, direction, confidence, _ in sorted((r for r in rows if r[2] == owner), key=lambda r: (r[1], r[0])):
            if kind in ("pause", "resume"):
                paused = kind == "pause"
                out.append((owner, k, kind, None, None))
                continue
            within = lambda hours, now=at: [b for b in book if b[0] > now - timedelta(hours=hours)]
            sent = [b for b in within(p.dedup_hours) if b[1] == "send"]
            alike = sorted((b for b in sent if (phone and b[4] == phone) or (content and b[5] == content)), key=lambda b: (bool(phone) and b[4] == phone, b[0], b[3]))
            quiet = p.quiet_from != p.quiet_to and (at.hour >= p.quiet_from or at.hour < p.quiet_to)
            of = None
            if post and any(b[2] == post for b in within(p.remember_hours)):
                what = "duplicate"
            elif alike:
                what, of = "crosspost", alike[-1][3]
            elif paused:
                what = "paused"
            elif animal:
                what = "animal"
            elif direction == "offer":
                what = "offer"
            elif confidence is not None and confidence < p.min_confidence:
                what = "confidence"
            elif quiet:
                what = "quiet"
            elif p.alerts_per_hour > 0 and len([b for b in within(1) if b[1] == "send"]) >= p.alerts_per_hour:
                what = "limit"
            else:
                what = "send"
            if what in ("send", "limit", "animal", "offer"):
                book.append((at, what, post, k, phone, content))
            out.append((owner, k, what, of, None))
            if what == "limit" and not any(b[1] == "digest" for b in within(1)):
                out.append((owner, None, "digest", None, len([b for b in within(1) if b[1] == "limit"])))
                book.append((at, "digest", None, None, None, None))
    return sorted(out, key=str)


def rows_of(found):
    return sorted(((r["tenant"], r["alert_id"], r["decision"], r["crosspost_of"], r["waiting"]) for r in found.collect()), key=str)


@pytest.mark.parametrize("seed, params", [(1, P), (2, replace(P, alerts_per_hour=0)), (3, replace(P, quiet_from=0, quiet_to=0))])
def test_fold_equals_history(spark, seed, params):
    rows = made(500, seed)
    frame = ladder.prepared(spark.createDataFrame(rows, SCHEMA).repartition(3), "owner", params=params)
    got = rows_of(ladder.fold(frame, params=params))
    assert got == history(rows, params)
    assert {r[2] for r in got} >= {"send", "duplicate", "crosspost", "animal", "offer", "confidence"} | ({"limit", "digest"} if params.alerts_per_hour else set())


def test_stream_equals_fold(spark, tmp_path):
    rows = made(360, 5, step=900)
    for k in range(0, len(rows), 120):
        part = spark.createDataFrame(rows[k : k + 120], SCHEMA).coalesce(1)
        part.write.mode("append").parquet(f"{tmp_path}/in/part={k:04d}")
    source = spark.readStream.schema(part.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    source = source.select(*part.columns)
    found = replay.drained(ladder.stream(ladder.prepared(source, "owner", params=P), params=P), "ladder", store=replay.STORE)
    assert rows_of(found) == history(rows, P)


def test_groups_of_crossposts(spark):
    at = START + timedelta(hours=6)
    rows = [(k, at + timedelta(minutes=k), 1, "post", f"p{k}", "77", None, False, "demand", 90, f"g{k % 2}") for k in range(5)]
    frame = spark.createDataFrame(rows, SCHEMA)
    found = ladder.fold(ladder.prepared(frame, "owner", params=P), params=P)
    assert [(r["alert_id"], r["groups"]) for r in ladder.groups_of(found, frame, "grp").collect()] == [(0, ["g0", "g1"])]


def test_empty_and_timeless_rows(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert ladder.fold(ladder.prepared(empty, "owner")).collect() == []
    rows = [(1, None, 1, "post", "p", "7", None, False, None, None, "g"), (2, None, 1, "post", "p", "7", None, False, None, None, "g")]
    assert [r["decision"] for r in ladder.fold(ladder.prepared(spark.createDataFrame(rows, SCHEMA), "owner")).collect()] == ["send", "send"]


STATES = "user long, state string, since timestamp, last timestamp, n long, failures long"


def states(rows):
    """Last run of states and errors in a row, key by key."""
    out = {}
    for user, state, at in sorted(rows, key=lambda r: (r[2], r[1])):
        old = out.get(user)
        same = old is not None and old[0] == state
        out[user] = (state, old[1] if same else at, at, old[3] + 1 if same else 1, (old[4] if old else 0) + 1 if state == "error" else 0)
    return {(k, *v) for k, v in out.items()}


@pytest.mark.parametrize("seed", range(3))
def test_batches_merge_like_the_whole(spark, tmp_path, seed):
    rng = random.Random(seed)
    rows = [(rng.choice([1, 1, 1, 2, 3, 4]), rng.choice(["ok", "error", "error"]), START + timedelta(minutes=k)) for k in range(90)]
    table = ledger.LedgerTable(spark, f"file://{tmp_path}/t", STATES, "user", buckets=4)
    merge = ledger.state_counters("user", "kind", "at")
    for k in range(0, 90, 30):
        part = spark.createDataFrame(rows[k : k + 30], "user long, kind string, at timestamp")
        assert table.commit(f"b{k}", part, merge)
        assert not table.commit(f"b{k}", part, merge)
    assert {tuple(r) for r in table.read().collect()} == states(rows)
    late = spark.createDataFrame([(1, "ok", START - timedelta(days=1))], "user long, kind string, at timestamp")
    assert table.commit("late", late, merge)
    assert {tuple(r) for r in table.read().collect()} == states(rows)


def test_a_batch_that_fails_between_write_and_commit(spark, tmp_path, monkeypatch):
    table = ledger.LedgerTable(spark, f"file://{tmp_path}/t", STATES, "user", buckets=4)
    merge = ledger.state_counters("user", "kind", "at")
    part = [spark.createDataFrame([(1, "ok", START + timedelta(minutes=k)), (2, "error", START + timedelta(minutes=k))], "user long, kind string, at timestamp") for k in range(2)]
    table.commit("b0", part[0], merge)
    before = sorted(map(tuple, table.read().collect()))
    with monkeypatch.context() as m:
        m.setattr(table, "_publish", lambda entry: (_ for _ in ()).throw(OSError("killed")))
        with pytest.raises(OSError):
            table.commit("b1", part[1], merge)
    assert sorted(map(tuple, table.read().collect())) == before
    assert table.commit("b1", part[1], merge)
    assert {(r["user"], r["n"], r["failures"]) for r in table.read().collect()} == {(1, 2, 0), (2, 2, 2)}
    stale = table.entry()
    with pytest.raises(Exception, match="(?i)exist"):
        table._publish({**stale, "batches": []})  # another writer took this number
    assert table.entry() == stale


def test_a_stream_replayed_after_a_failure(spark, tmp_path):
    rows = [(k % 3, "ok", START + timedelta(minutes=k)) for k in range(30)]
    for k in range(3):
        spark.createDataFrame(rows[10 * k : 10 * k + 10], "user long, kind string, at timestamp").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    table = ledger.LedgerTable(spark, f"file://{tmp_path}/t", STATES, "user", buckets=2)
    put = table.sink(ledger.state_counters("user", "kind", "at"), "feed")
    source = spark.readStream.schema("user long, kind string, at timestamp").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")

    def once_broken(frame, number):
        put(frame, number)
        if number == 1 and not broken:
            broken.append(number)
            raise OSError("killed behind the commit")

    broken = []
    for _ in range(2):
        query = source.writeStream.foreachBatch(once_broken).option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
        try:
            query.awaitTermination()
        except Exception as problem:
            assert "killed" in str(problem)
    assert broken == [1]
    assert {(r["user"], r["n"]) for r in table.read().collect()} == {(0, 10), (1, 10), (2, 10)}
    assert table.entry()["batches"] == ["feed-0", "feed-1", "feed-2"]


def test_a_digest_marks_what_it_sent(spark, tmp_path):
    now = datetime(2024, 1, 3, 6)
    kinds = ["send", "limit", "animal", "offer", "quiet", "confidence", "paused", None]
    posts = spark.createDataFrame([(str(k), k % 9 != 8, "new" if k % 11 else "seen", now - timedelta(minutes=13 * k), now - timedelta(minutes=13 * k) if k % 5 else None) for k in range(60)], "post string, is_order boolean, status string, fetched_at timestamp, published_at timestamp")
    table = digest.records(spark, f"file://{tmp_path}/r")
    decisions = spark.createDataFrame([(str(k), kinds[k % 8]) for k in range(60)], "post string, decision string")
    assert digest.record(table, "ladder", decisions) and not digest.record(table, "ladder", decisions)
    open_ = [k for k in range(60) if kinds[k % 8] not in ("send", "limit", "animal", "offer") and k % 9 != 8 and k % 11 and 13 * k < 8 * 60]
    want = sorted(open_, key=lambda k: (k % 5 == 0, k if k % 5 else 0, str(k)))[:6]
    assert sorted(int(r["post"]) for r in digest.send(table, posts, now, top=6).collect()) == sorted(want)
    assert digest.send(table, posts, now, top=6).collect() == []
    tomorrow = digest.send(table, posts, now + timedelta(minutes=1), top=60).collect()
    assert tomorrow == []  # the same night
    channels = {r["channel"]: r["n"] for r in table.read().groupBy("channel").agg(F.count("*").alias("n")).collect()}
    assert channels["digest"] == 6 and set(channels) == {"alert", "skipped_limit", "skipped_animal", "skipped_offer", "digest"}
