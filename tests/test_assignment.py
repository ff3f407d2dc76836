"""Rendezvous by the best few, candidates folded in order, and files that are replaced, against plain loops."""

import csv
import hashlib
import json
import random
import threading

import pytest
from pyspark.sql import functions as F

from leadloom.operators import assignment, leads, schedule
from leadloom.sources import files


def weight(key, member):
    return hashlib.sha256(f"{key}|{member}".encode()).hexdigest()


def in_turn(keys, pool):
    """Owners of their best member first, then the others in turn from what is free, then shared ones."""
    order = {k: sorted(pool, key=lambda m: weight(k, m), reverse=True) for k in keys}
    out, taken = {}, set()
    for k in keys:
        if order[k] and order[k][0] not in taken:
            out[k] = order[k][0]
            taken.add(order[k][0])
    free = [m for m in pool if m not in taken]
    for k in keys:
        if k not in out and order[k]:
            best = next((m for m in order[k] if m in free), None)
            if best is not None:
                free.remove(best)
            out[k] = best if best is not None else order[k][0]
    return out


@pytest.mark.parametrize("n_keys, n_pool, few", [(30, 30, 1), (40, 45, 3), (25, 10, 2), (6, 60, 8), (5, 0, 2)])
def test_balanced_like_keys_in_turn(spark, n_keys, n_pool, few):
    keys = spark.createDataFrame([(k,) for k in [*range(n_keys), None]], "k long").repartition(3)
    pool = spark.createDataFrame([(f"m{j}",) for j in range(n_pool)] + [(None,), ("m0",)][: 1 if not n_pool else 2], "m string")
    rows = assignment.balanced(keys, pool, "k", "m", few=few).collect()
    assert len(rows) == len({r["k"] for r in rows})
    assert {r["k"]: r["m"] for r in rows} == in_turn(range(n_keys), [f"m{j}" for j in range(n_pool)])


def test_ranking_and_first_live(spark):
    keys, pool = spark.range(12).withColumnRenamed("id", "k"), spark.range(90).withColumnRenamed("id", "m")
    want = {k: sorted(range(90), key=lambda m: weight(k, m), reverse=True) for k in range(12)}
    for block in (7, 1000):
        got = {(r["k"], r["rank"]): r["m"] for r in assignment.ranking(keys, pool, "k", "m", few=4, block=block).collect()}
        assert got == {(k, j + 1): want[k][j] for k in range(12) for j in range(4)}
    dead = spark.createDataFrame([(want[k][0],) for k in range(12)] + [(want[0][1],)], "m long")
    gone = {r["m"] for r in dead.collect()}
    assert dict(map(tuple, assignment.first_live(keys, pool, dead, "k", "m").collect())) == {k: next(m for m in want[k] if m not in gone) for k in range(12)}


@pytest.mark.parametrize("seed", range(3))
def test_candidates_like_a_run_in_order(spark, seed):
    rng = random.Random(seed)
    words = ["tow", "tow truck", "truck", "car", "carrier", "", None]
    rows = [(k, rng.choice(["u1", "u1", "u2", "u3", "u4"]), rng.choice([None, 0, 5, 40, 200]), rng.choice(words), f"n{k}") for k in range(60)]
    seen, order = {}, []
    small, twice = {}, {}
    for at, url, members, phrase, name in rows:
        members, phrase = members or 0, phrase or ""
        if url in seen:
            twice[url] += 1
            if phrase and phrase not in seen[url][3]:
                seen[url][3] += f", {phrase}"
            seen[url][2] = max(seen[url][2], members)
        elif 0 < members < 50:
            small[url] = small.get(url, 0) + 1
        else:
            seen[url], twice[url] = [at, name, members, phrase], 0
            order.append(url)
    df = spark.createDataFrame(rows, "at long, url string, members int, phrase string, name string").repartition(4)
    got = {r["url"]: (r["at"], r["name"], r["members"], r["phrases"], r["duplicates"], r["too_small"]) for r in leads.candidates_folded(df, least=50).collect()}
    assert got == {u: (*seen[u], twice[u], small.get(u, 0)) for u in seen}
    assert leads.candidates_folded(df.limit(0), least=50).collect() == []


def test_a_file_is_replaced_whole(spark, tmp_path):
    path = tmp_path / "pool.csv"
    rows = spark.createDataFrame([("b, c", 2), ("a", 10), ("a", 10), ('x"y', None)], "name string, n int")
    files.replace_csv(rows, f"file://{path}", ["n", "name"])
    assert list(csv.reader(path.open(), escapechar="\\")) == [["n", "name"], ["", 'x"y'], ["10", "a"], ["2", "b, c"]]
    files.replace_csv(rows, f"file://{path}", ["name"], order=["n"])
    assert [x[0] for x in csv.reader(path.open(), escapechar="\\")] == ["name", 'x"y', "b, c", "a"]
    before = path.read_bytes()
    broken = rows.withColumn("name", F.when(F.col("n") == 10, F.raise_error(F.lit("no more"))).otherwise(F.col("name")))
    with pytest.raises(Exception, match="no more"):
        files.replace_csv(broken, f"file://{path}", ["name"])
    assert path.read_bytes() == before and [p.name for p in tmp_path.iterdir() if not p.name.endswith(".crc")] == ["pool.csv"]


def test_json_pools_and_readers(spark, tmp_path):
    path = tmp_path / "pool.json"
    for n in (0, 1, 3):
        rows = spark.range(n).select(F.concat(F.lit("u"), "id").alias("url"), "id")
        files.replace_json(rows, f"file://{path}", "url")
        assert json.loads(path.read_text()) == [{"url": f"u{k}", "id": k} for k in range(n)]
    seen, stop = [], threading.Event()

    def look():
        while not stop.is_set():
            seen.append(len(json.loads(path.read_text())))

    reader = threading.Thread(target=look)
    reader.start()
    for n in (2000, 3, 2000):
        files.replace_json(spark.range(n).select(F.col("id").alias("url")), f"file://{path}", "url")
    stop.set()
    reader.join()
    assert set(seen) <= {3, 2000} and len(seen) > 2


def test_turns_are_few_and_work_is_dealt_by_pairs(spark, monkeypatch):
    keys, pool = spark.range(220).withColumnRenamed("id", "k"), spark.range(220).select(F.concat(F.lit("m"), "id").alias("m"))
    asked, plain = [], assignment.ranking
    monkeypatch.setattr(assignment, "ranking", lambda *a, **kw: (asked.append(kw["few"]), plain(*a, **kw))[1])
    rows = assignment.balanced(keys.coalesce(1), pool, "k", "m", few=6).collect()
    assert {r["k"]: r["m"] for r in rows} == in_turn(range(220), [f"m{j}" for j in range(220)])
    # Some 80 keys are left over: the last of them used to fetch their members six by six.
    assert len(asked) <= 8
    monkeypatch.setattr(assignment, "PAIRS", 5000)
    for found in (plain(keys.coalesce(1), pool, "k", "m", few=1), schedule.rendezvous(keys.coalesce(1), pool, "k", "m")):
        tasks = found.select("k").distinct().withColumn("task", F.spark_partition_id()).agg(F.count_distinct("task")).first()[0]
        assert tasks > 4


@pytest.mark.parametrize("few", [1, 5])
def test_keys_below_the_bar_meet_the_pool_again(spark, monkeypatch, few):
    """Bars that nothing, few, many or all members pass, and a pool in pieces, give the same rows."""
    keys, pool = spark.createDataFrame([(k,) for k in [*range(30), None]], "k long").repartition(3), spark.range(60).union(spark.range(7)).withColumnRenamed("id", "m")
    want = {(k, j + 1): m for k in range(30) for j, m in enumerate(sorted(range(60), key=lambda m: weight(k, m), reverse=True)[:few])}
    want |= {(None, j + 1): m for j, m in enumerate(sorted(range(60), key=lambda m: hashlib.sha256(str(m).encode()).hexdigest(), reverse=True)[:few])}
    for bar in ("g", "f8", "e", ""):
        monkeypatch.setattr(assignment, "bar_of", lambda few, n: bar)
        assert {(r["k"], r["rank"]): r["m"] for r in assignment.ranking(keys, pool, "k", "m", few=few, block=7).collect()} == want
    monkeypatch.setattr(assignment, "SENT", 20)
    monkeypatch.setattr(assignment, "bar_of", lambda few, n: "f")
    assert {(r["k"], r["rank"]): r["m"] for r in assignment.ranking(keys, pool, "k", "m", few=few, block=7).collect()} == want


def test_pairs_are_hashed_in_the_join(spark):
    """Members far from a key's best few make no entry anywhere: each pair used to become one that was sorted."""
    keys, pool = spark.range(40).withColumnRenamed("id", "k"), spark.range(5000).withColumnRenamed("id", "m")
    found = assignment.ranking(keys, pool, "k", "m", few=3)
    assert found.count() == 120
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastNestedLoopJoin BuildRight, LeftOuter, (sha2(" in plan and "BuildRight, Cross" not in plan
    # Expected at 5000 members: 3 + 8 * sqrt(3) + 16 above the bar.
    bar = assignment.bar_of(3, 5000)
    above = [sum(weight(k, m) >= bar for m in range(5000)) for k in range(40)]
    assert 10 < min(above) and max(above) < 70 and assignment.bar_of(3, 20) == ""
