"""Queries over whole tables, and the parts that no SQL checks, by brute force on small fixtures."""

import hashlib
import json
import random
import re
from collections import Counter, defaultdict
from datetime import datetime, timedelta

import numpy as np
from pyspark.sql import functions as F

from leadloom import catalogue
from leadloom.operators import alerts, schedule, stats

FOLDER = "/root/testdata/sf0.001"


def test_hallucination_covers_all_items_and_stems(spark):
    found = {r["item_id"]: (r["n_docs"], r["n_missing"]) for r in catalogue.QUERIES["hallucination_rate"](spark, FOLDER).collect()}
    texts = [r["text"].lower() for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]
    wanted = {}
    for item in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect():
        words = re.split("[^a-z]+", item["text"].lower())
        stems = [w for w in (w[:-2] if len(w) > 5 else w for w in words) if len(w) >= 4]
        wanted[item["item_id"]] = (len(texts), sum(not all(s in t for s in stems) for t in texts))
    assert len(wanted) > 10
    assert found == wanted


def test_missing_names_in_blocks(spark):
    docs = spark.createDataFrame([("Alpha beta GAMMA delta",), ("alpha beta gamma",), ("",), (None,)], "text string").repartition(3)
    names = [(1, ["alpha", "beta", "gamma", "delta"]), (2, ["alpha"]), (3, []), (4, None), (5, ["omega"])]
    table = spark.createDataFrame(names, "item_id long, stems array<string>")
    for block in (1, 2, 1000):
        rows = stats.missing_names(docs, table, block=block).collect()
        assert {r["item_id"]: (r["n_docs"], r["n_missing"]) for r in rows} == {1: (4, 2), 2: (4, 1), 3: (4, 0), 4: (4, 0), 5: (4, 3)}
    assert stats.missing_names(docs.limit(0), table).count() == 0
    assert stats.missing_names(docs, table.limit(0)).count() == 0


def test_hrw_takes_the_whole_pool(spark):
    weight = lambda c, m: hashlib.sha256(f"{c}|{m}".encode()).hexdigest()
    keys, pool = spark.range(40).withColumnRenamed("id", "c"), spark.range(250).withColumnRenamed("id", "m")
    wanted = {c: max(range(250), key=lambda m: weight(c, m)) for c in range(40)}
    for block in (7, 100, 1000):
        assert dict(map(tuple, schedule.rendezvous(keys, pool, "c", "m", block=block).collect())) == wanted
    assert schedule.rendezvous(keys, pool.limit(0), "c", "m").count() == 0
    members = [r[0] for r in spark.read.parquet(f"{FOLDER}/supplier.parquet").select("s_suppkey").collect()]
    for c, m in catalogue.QUERIES["hrw_assignment"](spark, FOLDER).limit(50).collect():
        assert m == max(members, key=lambda x: weight(c, x))


def executed(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_budget_cutoff_in_blocks(spark):
    costs = [(k, (k * 37) % 11) for k in range(2000)]
    plan = spark.createDataFrame(costs, "user_id long, cost long").repartition(5)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # else so few rows make one block
    try:
        found = schedule.budget_cutoff(plan, ["user_id"], "cost", 3000)
        assert "windowspecdefinition(block" in executed(found)
        rows = {r["user_id"]: (r["running"], r["runs"]) for r in found.collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    total = 0
    for k, cost in costs:
        total += cost
        assert rows[k] == (total, total <= 3000)
    assert schedule.budget_cutoff(plan.limit(0), ["user_id"], "cost", 1).count() == 0


def test_intervals_without_a_global_window(spark):
    rates = spark.createDataFrame([(1, 1000, 4.0), (2, 900, 0.0), (3, 100, 0.1)], "user_id long, n_2 long, per_hour double")
    found = schedule.intervals(rates)
    assert "Window" not in executed(found)
    assert found.columns == [*rates.columns, "interval_min"]
    assert {r["user_id"]: r["interval_min"] for r in found.collect()} == {1: 15.0, 2: 120.0, 3: 120.0}
    assert {r["interval_min"] for r in schedule.intervals(rates.where("user_id = 1")).collect()} == {5.0}


def folded(rows):
    """event_id -> decision, with all of a tenant's history held."""
    out, tenants = {}, defaultdict(list)
    for event, ts, tenant, props in rows:
        tenants[tenant].append((ts, event, props))
    for own in tenants.values():
        sent = []
        for ts, event, props in sorted(own):
            if any(p == props and t >= ts - timedelta(hours=6) for t, p in sent):
                out[event] = "crosspost"
            elif sum(t > ts - timedelta(hours=1) for t, _ in sent) >= 15:
                out[event] = "limit"
            else:
                sent.append((ts, props))
                out[event] = "send"
    return out


def test_alert_fold(spark):
    rng = random.Random(3)
    start, rows = datetime(2024, 1, 1), []
    for k in range(3000):  # a dense tenant in bursts with gaps of a day, and sparse ones
        tenant = 1 if k % 3 else rng.randrange(2, 6)
        minutes = (rng.randrange(8) * 30 * 60 + rng.randrange(240)) if tenant == 1 else rng.randrange(14000)
        rows.append((k, start + timedelta(minutes=minutes), tenant, f"p{rng.randrange(400)}"))
    a = start + timedelta(days=20)
    rows += [(9000, a, 9, "x"), (9001, a + timedelta(hours=6), 9, "x"), (9002, a + timedelta(hours=6, seconds=1), 9, "x"), (9003, a + timedelta(hours=13), 9, "x")]
    rows += [(9100 + k, a + timedelta(seconds=k), 10, f"q{k}") for k in range(16)] + [(9200, a + timedelta(hours=1), 10, "z"), (9201, a + timedelta(hours=1), 10, "y")]
    events = spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, props string").repartition(5)
    found = alerts.fold(events.withColumn("value", events.event_id * 1.0), tenant="user_id")
    assert "FlatMapGroups" not in executed(found)
    wanted = folded(rows)
    assert set(wanted.values()) == {"send", "crosspost", "limit"}
    assert dict(map(tuple, found.collect())) == wanted


def test_alert_fold_query(spark):
    rows = spark.read.parquet(f"{FOLDER}/events.parquet").select("event_id", "ts", "user_id", "props").collect()
    assert dict(map(tuple, catalogue.QUERIES["alert_fold"](spark, FOLDER).collect())) == folded(map(tuple, rows))


def test_bandit_allocation(spark):
    """The query against a simulation with Python's own Beta draws: shares of the picks within five deviations."""
    rng = random.Random(1)
    found = sorted(map(tuple, catalogue.QUERIES["bandit_posterior"](spark, FOLDER).select("user_id", "alpha", "beta").collect()))
    simulated, trials = Counter(), 4000
    for _ in range(trials):
        simulated[max((rng.betavariate(a, b), -u) for u, a, b in found)[1] * -1] += 1
    rows = dict(map(tuple, catalogue.QUERIES["bandit_allocation"](spark, FOLDER).collect()))
    assert sum(rows.values()) == 2000 and set(rows) == {u for u, _, _ in found}
    for u in rows:
        share = (simulated[u] + rows[u]) / (trials + 2000)
        assert abs(rows[u] / 2000 - simulated[u] / trials) <= 5 * (share * (1 - share) * (1 / 2000 + 1 / trials)) ** 0.5 + 1e-9


def test_allocation_is_the_best_draw_of_each_pick(spark):
    rows = [(f"g{k}", float(k % 5) + 0.0, 2.0 + k % 3) for k in range(40)]
    frame = spark.createDataFrame(rows, "g string, alpha double, beta double")
    own = {r["g"]: r["own"] for r in frame.select("g", F.pmod(F.xxhash64("g"), F.lit(2**31)).alias("own")).collect()}
    draws = {g: np.random.default_rng([3, own[g]]).beta(max(a, 0.01), b, 300) for g, a, b in rows}
    wanted = Counter(min(draws, key=lambda g: (-draws[g][k], g)) for k in range(300))
    for parts in (1, 7):
        got = dict(map(tuple, schedule.allocation(frame.repartition(parts), "g", 300, seed=3).collect()))
        assert got == {g: wanted[g] for g, _, _ in rows}
    assert schedule.allocation(frame.limit(0), "g", 300).collect() == []
    assert sum(r["picked"] for r in schedule.allocation(frame, "g", 0).collect()) == 0


def test_preferred_groups_get_a_bonus(spark):
    frame = spark.createDataFrame([(1, 20, 5, True), (2, 20, 5, False), (3, 2, 1, None)], "g long, trials long, wins long, liked boolean")
    found = {r["g"]: (r["alpha"], r["beta"]) for r in schedule.posteriors(frame, "g", preferred="liked").collect()}
    assert found == {1: (6.5, 16.0), 2: (6.0, 16.0), 3: (round(2 + 0.3 * 11, 4), round(2 + 0.3 * 31, 4))}


def test_nested_strip_nulls(spark):
    rows = {r["o_orderkey"]: json.loads(r["doc"]) for r in catalogue.QUERIES["nested_strip_nulls"](spark, FOLDER).collect()}
    orders = spark.read.parquet(f"{FOLDER}/orders.parquet").collect()
    assert rows == {r["o_orderkey"]: {"o_orderstatus": r["o_orderstatus"]} | ({"price": r["o_totalprice"]} if r["o_totalprice"] > 1000 else {}) for r in orders}


def test_masked_text(spark):
    found = {r["doc_id"]: r["masked"] for r in catalogue.QUERIES["masked_text"](spark, FOLDER).collect()}
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").collect()
    changed = 0
    for r in docs:
        out = re.sub(r"(?i)(password|token|secret|api_key)=[^ \n]+", r"\1=***", r["text"])
        out = re.sub(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[a-z]{2,}", "***@***", out)
        out = re.sub(r"\+?[0-9](?:[ .()-]?[0-9]){8,14}", "***", out)
        changed += out != r["text"]
        assert found[r["doc_id"]] == out
    assert changed and len(found) == len(docs)
