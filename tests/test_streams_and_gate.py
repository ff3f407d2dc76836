"""Streams with dense keys, the gate's packs and columns, and answers without SQL of their own."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from leadloom.functions import records, text
from leadloom.operators import extraction, gate, leads
from leadloom.sources import files
from leadloom.streaming import replay


def test_rate_limit_takes_the_earliest_of_a_dense_hour(spark, tmp_path):
    rng = random.Random(3)
    order = list(range(30_000))
    rng.shuffle(order)
    rows = [(k, datetime(2024, 1, 1, 5) + timedelta(milliseconds=100 * k), 1) for k in order]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    found = replay.drained(replay.limited(replay.events(spark, f"{tmp_path}/events.parquet")), "dense").where("decision = 'send'").collect()
    assert sorted(r["event_id"] for r in found) == list(range(15))


def test_stream_reads_its_own_file_alone(spark, tmp_path):
    one = spark.createDataFrame([(1, datetime(2024, 1, 1))], "event_id long, ts timestamp_ntz")
    one.toPandas().to_parquet(f"{tmp_path}/events.parquet", coerce_timestamps="us")
    one.toPandas().to_parquet(f"{tmp_path}/events_old.parquet", coerce_timestamps="us")
    assert replay.drained(replay.events(spark, f"{tmp_path}/events.parquet"), "alone").count() == 1


ORDERS = ["I need the river boat with that crew, is it free?", "suche den river market und nicht weit", "cherche un bateau pour une semaine dans les alpes", "busco una barca para los lunes del market"]
JUNK = ["you idiot", "wir bieten billig", "all rights reserved", "short", "sans rien du tout, vraiment", "ofrezco sin nada"]


def test_packs_pass_orders_and_reject_junk(spark):
    rows = [(k, t, lang) for k, (t, lang) in enumerate(zip(ORDERS + JUNK, ["en", "de", "fr", "es", "en", "de", "en", "en", "fr", "es"]))]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = {r["doc_id"]: r for r in gate.orchestrated(df, gate.PACKS, lang="lang").collect()}
    assert all(found[k]["verdict"] and found[k]["passes"] for k in range(len(ORDERS)))
    assert not any(found[k]["verdict"] for k in range(len(ORDERS), len(rows)))
    assert found[5]["layer"] == "offer" and found[6]["layer"] == "extinguish" and found[4]["rule"] == "idiot"


def test_gate_keeps_the_callers_columns(spark):
    df = spark.createDataFrame([(1, "the and that with", "mine", 7, "b")], "doc_id long, text string, e string, a long, r string")
    assert gate.evaluate(df).columns == [*df.columns, "layer", "rule", "points", "verdict"]
    with pytest.raises(ValueError, match="points"):
        gate.evaluate(df.withColumn("points", F.lit(1)))


def test_odd_values(spark):
    df = spark.createDataFrame([("12,5 tys. members",), ("1.2K and 3",), ("none at all",), (None,)], "v string")
    assert [r[0] for r in df.select(records.humanised(F.col("v"))).collect()] == [12500, 1200, None, None]
    df = spark.createDataFrame([("2024-01-05T10:00:00Z",), ("1704448800",), ("1704448800000",), ("1",), ("soon",), ("",), (None,)], "v string")
    seconds = [r[0] for r in df.select(F.unix_timestamp(records.when_posted(F.col("v")))).collect()]
    assert seconds == [1704448800, 1704448800, 1704448800, 1, None, None, None]
    sane = [r[0] is not None for r in df.select(records.sane_date(F.col("v"), F.lit(datetime(2025, 1, 1)))).collect()]
    assert sane == [True, True, True, False, False, False, False]
    df = spark.createDataFrame([("tak", "x"), ("No", None), (None, "n/a"), ("?", " y ")], "a string, b string")
    assert [tuple(r) for r in df.select(text.as_bool(F.col("a")), text.text_or_null(F.col("b")), text.confidence(F.col("a"))).collect()] == [(True, "x", 0), (False, None, 0), (False, None, 0), (False, "y", 0)]


def test_answers(spark):
    df = spark.createDataFrame([("go 11-222 to 33-444", '{"is_order": true, "direction": "offer"}'), ("", '{"is_order": "yes"}'), ("x", "no object"), (None, None)], "text string, answer string")
    found = [r["record"] for r in extraction.answered(df, "text", "answer").collect()]
    assert [(r["is_order"], r["direction"], r["from_code"], r["to_code"], r["confidence"]) for r in found] == [(False, "offer", "11222", "33444", 0), (False, "unclear", None, None, 0), (False, "unclear", None, None, 0), (False, "unclear", None, None, 0)]


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert gate.orchestrated(empty, gate.PACKS).count() == 0
    assert leads.filtered(empty).count() == 0
    assert leads.patched(spark.createDataFrame([], "k long, status string, status_at string"), spark.createDataFrame([], "k long, status string, now string"), "k").count() == 0


def test_sources(spark, tmp_path):
    spark.range(3).write.parquet(f"{tmp_path}/t.parquet")
    assert files.has_table(spark, str(tmp_path), "t") and not files.has_table(spark, str(tmp_path), "u")
    assert files.has_columns(spark, str(tmp_path), "t", "id") and not files.has_columns(spark, str(tmp_path), "t", "id", "x")
    (tmp_path / "pool.json").write_text('[{"url": "a", "n": 1}, {"url": "b", "n": 2}, {"url": "a", "n": 3}, {"n": 4}]')
    assert sorted(tuple(r) for r in files.keyed_json(spark, f"{tmp_path}/pool.json", "url string, n long").collect()) == [("a", 3), ("b", 2)]
    (tmp_path / "one.txt").write_text("1.2.3.4:80\n# no\n\nsocks5://h:1\n")
    (tmp_path / "two.txt").write_text("x:9\n")
    found = files.text_lists(spark, {"one": f"{tmp_path}/one.txt", "two": f"{tmp_path}/two.txt"}, {"two": "socks4"}).collect()
    assert sorted((r["source"], r["url"]) for r in found) == [("one", "http://1.2.3.4:80"), ("one", "socks5://h:1"), ("two", "socks4://x:9")]
    (tmp_path / "g.csv").write_text("country,code,name,region,lat,lng,population\nPL,00-1,A,r,1.5,2.5,x\nPL,00-2,B,r,,2.5,3\n")
    assert [(r["name"], r["lat"], r["population"]) for r in files.gazetteer(spark, f"{tmp_path}/g.csv").collect()] == [("A", 1.5, None)]
    (tmp_path / "l.jsonl").write_text('# c\n\n{"a": 1}\nbad\n')
    assert [(r["a"], r["corrupt"]) for r in files.jsonl(spark, f"{tmp_path}/l.jsonl", "a long").collect()] == [(1, None), (None, "bad")]
    assert files.csv_or_empty(spark, f"{tmp_path}/none.csv", "a long").count() == 0
    files.write_sorted_csv(spark.createDataFrame([(2,), (1,), (2,)], "a long").coalesce(1), f"{tmp_path}/out")
    assert [r["a"] for r in files.csv_or_empty(spark, f"{tmp_path}/out", "a long").collect()] == [1, 2]
    assert files.missing_columns(spark.range(1), {"id": "first", "x": "second"}) == ["second"]


def test_members_among_other_numbers(spark):
    known = {
        "350 members": 350, "5 km away": 5, "12.500 członków": 12500, "12 500 members": 12500, "3 posts a day · 1,1 tys. people": 1100, "1.2K": 1200,
        "2 mln": 2_000_000, "since 2011, 40 Mitglieder": 40, "7 kittens and 9 more": 9, "none": None, "": None, None: None,
    }
    df = spark.createDataFrame([(k,) for k in known], "v string")
    assert {r["v"]: r["n"] for r in df.select("v", records.humanised(F.col("v")).alias("n")).collect()} == known


def test_changes_of_a_key_count_as_one(spark):
    base = spark.createDataFrame([(1, "new", "t0", "a"), (2, "new", "t0", "b"), (3, "new", "t0", "c")], "k long, status string, status_at string, note string")
    changes = spark.createDataFrame([(1, "seen", None, "t1"), (1, "done", None, "t2"), (1, None, "x", "t3"), (2, "new", "y", "t4"), (9, "done", None, "t5")], "k long, status string, note string, now string")
    assert sorted(map(tuple, leads.patched(base, changes, "k").collect())) == [(1, "done", "t2", "x"), (2, "new", "t0", "y"), (3, "new", "t0", "c")]


def test_waits_and_sizes_of_runs(spark):
    rows = [(0.0, "A", 10.0, None), (4.0, "A", 10.0, None), (30.0, "A", 0.0, 0.9), (0.5, "A", 0.0, 0.1), (0.0, "B", 30.0, None), (4.0, "B", 2.0, None), (4.0, "B", 96.0, 0.9), (40.0, "B", 96.0, None)]
    df = spark.createDataFrame(rows, "rate double, path string, share double, used double")
    df = df.withColumn("m", leads.interval_minutes(F.col("rate"), F.col("used"), F.col("path"), F.col("share")))
    size = leads.run_size(F.col("rate"), F.col("m"), F.col("path"))
    assert [tuple(r) for r in df.select("m", *size).collect()] == [(5, 10, 30), (15, 6, 30), (5, 45, 30), (5, 2, 30), (96, 10, 1440), (120, 12, 1440), (45, 9, 1440), (120, 12, 1440)]


def test_no_hourly_limit_holds_nothing_back(spark):
    from dataclasses import replace

    from leadloom.params import DEFAULT

    no, row = F.lit(False), spark.range(1)
    steps = [leads.alert_step(no, no, no, no, F.lit("demand"), F.lit(90), no, F.lit(99), replace(DEFAULT, alerts_per_hour=n)) for n in (0, 5)]
    assert list(row.select(*steps).first()) == ["send", "limit"]
