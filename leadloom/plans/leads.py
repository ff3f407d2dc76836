"""Queries over posts, groups, accounts and plans."""

from __future__ import annotations

from dataclasses import replace
from datetime import datetime

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import records as rc
from ..operators import geo
from ..operators import leads as ld
from ..params import DEFAULT
from .registry import query

NOW = "TIMESTAMP '2024-01-31 00:00:00'"


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'O' AND o_totalprice >= 1000 AND o_totalprice <= 200000 AND o_orderpriority IN ('1-URGENT', '2-HIGH')")
def filter_builder(t):
    """FLT-1: conditions from whatever is given."""
    rows = ld.filtered(t.orders, o_orderstatus="O", o_totalprice_from=1000, o_totalprice_to=200000, o_orderpriority_any=["1-URGENT", "2-HIGH"], o_orderdate_from=None)
    return rows.select("o_orderkey", "o_totalprice")


@query("SELECT o_orderstatus, count(*) n FROM orders WHERE coalesce(CASE WHEN o_orderstatus = 'F' THEN o_orderdate + INTERVAL 30 DAY END, o_orderdate) >= TIMESTAMP '1998-01-01' GROUP BY 1")
def effective_time(t):
    """FLT-2."""
    at = F.coalesce(F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate") + F.expr("INTERVAL 30 DAYS")), F.col("o_orderdate"))
    return t.orders.where(at >= F.lit(datetime(1998, 1, 1))).groupBy("o_orderstatus").agg(F.count("*").alias("n"))


@query("SELECT user_id, coalesce(list_contains(list(DISTINCT event_type) FILTER (value > 90), 'purchase'), false) AS big_buyer FROM events GROUP BY user_id")
def array_membership(t):
    """FLT-9."""
    kinds = F.collect_set(F.when(F.col("value") > 90, F.col("event_type")))
    return t.events.groupBy("user_id").agg(F.array_contains(F.coalesce(kinds, F.array().cast("array<string>")), "purchase").alias("big_buyer"))


@query("SELECT page_id FROM pages LEFT JOIN labels ON doc_id = page_id WHERE trim(url) <> '' AND coalesce(CASE quality WHEN 0 THEN 'off' WHEN 1 THEN 'ok' END, 'ok') = 'ok'")
def eligible_groups(t):
    """FLT-11: a group without a status counts as ok."""
    status = F.when(F.col("quality") == 0, "off").when(F.col("quality") == 1, "ok")
    rows = t.pages.join(t.labels.select(F.col("doc_id").alias("page_id"), "quality"), "page_id", "left")
    return rows.where((F.trim("url") != "") & (F.coalesce(status, F.lit("ok")) == "ok")).select("page_id")


@query("SELECT doc_id FROM documents LEFT JOIN labels USING (doc_id) WHERE quality IS NULL AND (text IS NOT NULL OR source IS NOT NULL) ORDER BY doc_id DESC LIMIT 50")
def backfill_candidates(t):
    """FLT-12, S-29: one bounded run of 50 rows."""
    return ld.backfill(t.documents.join(t.labels.drop("toxic"), "doc_id", "left").select("doc_id", "quality", "text", "source"), "quality", ["text", "source"], "doc_id", 50).select("doc_id")


VIEW = """SELECT CASE WHEN l_tax > 0.01 THEN CAST(floor(l_extendedprice / 50) AS BIGINT) END km, CASE WHEN p.n_name = 'NATION_3' AND d.n_name = 'NATION_3' THEN 'domestic' WHEN d.n_name = 'NATION_3' THEN 'import' WHEN p.n_name = 'NATION_3' THEN 'export' ELSE 'transit' END direction, date_diff('day', l_shipdate, TIMESTAMP '2001-09-01') age_days, o_orderpriority = '1-URGENT' urgent
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation p ON p.n_nationkey = s_nationkey JOIN nation d ON d.n_nationkey = c_nationkey"""


def _trips(t):
    """Order lines as trips from the supplier's nation to the customer's."""
    ends = [t.nation.select(F.col("n_nationkey").alias(k), F.col("n_name").alias(n)) for k, n in (("s_nationkey", "pickup"), ("c_nationkey", "delivery"))]
    rows = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).join(t.customer, F.col("o_custkey") == F.col("c_custkey")).join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey"))
    return rows.join(ends[0], "s_nationkey").join(ends[1], "c_nationkey")


@query(f"""WITH v AS ({VIEW}) SELECT 'near' preset, count(*) FILTER (km <= 50) n FROM v UNION ALL SELECT 'today', count(*) FILTER (age_days < 1) FROM v UNION ALL SELECT 'export', count(*) FILTER (direction = 'export') FROM v UNION ALL SELECT 'import', count(*) FILTER (direction = 'import') FROM v
UNION ALL SELECT 'domestic', count(*) FILTER (direction = 'domestic') FROM v UNION ALL SELECT 'urgent', count(*) FILTER (urgent) FROM v UNION ALL SELECT 'unplaced', count(*) FILTER (km IS NULL) FROM v UNION ALL SELECT 'all', count(*) FROM v""")
def view_presets(t):
    """FLT-14, FLT-15: named filters over trips."""
    age = F.datediff(F.lit("2001-09-01").cast("date"), F.col("l_shipdate").cast("date"))
    km = F.when(F.col("l_tax") > 0.01, F.floor(F.col("l_extendedprice") / 50))
    return ld.preset_counts(_trips(t).select(km.alias("km"), geo.direction(F.col("pickup"), F.col("delivery"), "NATION_3").alias("direction"), age.alias("age_days"), (F.col("o_orderpriority") == "1-URGENT").alias("urgent")))


@query(f"SELECT event_id, coalesce(CASE WHEN event_type <> 'error' THEN ts END < {NOW} - INTERVAL 6 HOUR, false) AS stale FROM events")
def stale_posts(t):
    """FLT-16."""
    return t.events.select("event_id", ld.stale(F.when(F.col("event_type") != "error", F.col("ts").cast("timestamp")), F.lit(DEFAULT.as_of)).alias("stale"))


@query("SELECT * FROM customer WHERE c_custkey = 7")
def point_lookup(t):
    """FLT-17."""
    return t.customer.where("c_custkey = 7")


@query("""WITH c AS (SELECT l_orderkey, CASE WHEN l_returnflag <> 'N' THEN l_linestatus END status, CASE WHEN l_discount > 0.05 THEN l_extendedprice END price, l_shipdate AS now FROM lineitem),
l AS (SELECT l_orderkey, arg_max(status, (now, status)) FILTER (status IS NOT NULL) status, max(now) FILTER (status IS NOT NULL) status_now, arg_max(price, (now, price)) FILTER (price IS NOT NULL) price FROM c GROUP BY 1)
SELECT o_orderkey, coalesce(status, o_orderstatus) AS o_orderstatus, coalesce(price, o_totalprice) AS o_totalprice, CASE WHEN status <> o_orderstatus THEN status_now ELSE o_orderdate END AS o_orderdate FROM orders LEFT JOIN l ON l_orderkey = o_orderkey""")
def partial_update(t):
    """SNK-9, SNK-10: several changes of a key count as one, a status that differs sets its time."""
    changes = t.lineitem.select(F.col("l_orderkey").alias("o_orderkey"), F.when(F.col("l_returnflag") != "N", F.col("l_linestatus")).alias("o_orderstatus"), F.when(F.col("l_discount") > 0.05, F.col("l_extendedprice")).alias("o_totalprice"), F.col("l_shipdate").alias("now"))
    base = t.orders.select("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderdate")
    return ld.patched(base, changes, "o_orderkey", status="o_orderstatus", at="o_orderdate")


@query("""WITH l AS (SELECT l_suppkey, count(*) FILTER (l_returnflag = 'R') failures, max(l_shipdate) FILTER (l_returnflag = 'R') back_at, arg_max(l_returnflag, (l_shipdate, l_orderkey, l_linenumber)) flag FROM lineitem GROUP BY 1)
SELECT s_suppkey, CASE WHEN flag = 'N' THEN 0 ELSE coalesce(failures, 0) END failures, CASE WHEN flag <> 'N' THEN back_at END back_at FROM supplier LEFT JOIN l ON l_suppkey = s_suppkey""")
def reactivation(t):
    """SNK-5, SNK-13: success clears the counter and the time of return."""
    bad = F.col("l_returnflag") == "R"
    seen = t.lineitem.groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.count_if(bad).alias("failures"), F.max(F.when(bad, F.col("l_shipdate"))).alias("back_at"), F.max_by("l_returnflag", F.struct("l_shipdate", "l_orderkey", "l_linenumber")).alias("flag"))
    good = F.coalesce(F.col("flag") == "N", F.lit(True))
    return t.supplier.join(seen, "s_suppkey", "left").select("s_suppkey", F.when(good, 0).otherwise(F.col("failures")).cast("long").alias("failures"), F.when(~good, F.col("back_at")).alias("back_at"))


@query("""WITH l AS (SELECT l_suppkey, arg_max(l_returnflag, (l_shipdate, l_orderkey, l_linenumber)) flag FROM lineitem GROUP BY 1)
SELECT s_suppkey, CASE flag WHEN 'A' THEN 'paused' WHEN 'R' THEN 'quarantined' ELSE 'active' END state FROM supplier LEFT JOIN l ON l_suppkey = s_suppkey""")
def state_by_hash(t):
    """JN-11, JN-15, JN-15b: states are kept by a hash of the name; without one a key is active."""
    hashed = t.supplier.select("s_suppkey", rc.short_hash(F.col("s_name"), 24).alias("h"))
    last = t.lineitem.groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.max_by("l_returnflag", F.struct("l_shipdate", "l_orderkey", "l_linenumber")).alias("flag")).where("flag in ('A', 'R')")
    states = last.join(hashed, "s_suppkey").select("h", F.when(F.col("flag") == "A", "paused").otherwise("quarantined").alias("state"))
    return hashed.join(states, "h", "left").select("s_suppkey", F.coalesce("state", F.lit("active")).alias("state"))


@query("""WITH d AS (SELECT DISTINCT user_id, CAST(ts AS DATE) on_day FROM events), i AS (SELECT user_id, on_day, on_day - CAST(row_number() OVER (PARTITION BY user_id ORDER BY on_day) AS INTEGER) isle FROM d WHERE on_day < DATE '2024-01-28'),
p AS (SELECT user_id, count(*) n FROM i GROUP BY user_id, isle HAVING max(on_day) = DATE '2024-01-27') SELECT user_id, coalesce(n, 0) + 1 AS streak FROM d LEFT JOIN p USING (user_id) WHERE on_day = DATE '2024-01-28'""")
def presence_streak(t):
    """JN-13: users of a day with one more than their streak up to the day before, or the first."""
    days = t.events.select("user_id", F.col("ts").cast("date").alias("day")).distinct()
    before = days.where("day < date'2024-01-28'").withColumn("isle", F.date_sub("day", F.row_number().over(Window.partitionBy("user_id").orderBy("day"))))
    last = before.groupBy("user_id", "isle").agg(F.count("*").alias("n"), F.max("day").alias("end")).where("end = date'2024-01-27'").select("user_id", "n")
    return days.where("day = date'2024-01-28'").join(last, "user_id", "left").select("user_id", (F.coalesce("n", F.lit(0)) + 1).alias("streak"))


@query(f"WITH u AS (SELECT user_id, count(*) n, count(*) FILTER (event_type = 'purchase') orders FROM events GROUP BY 1), s AS (SELECT user_id, max(ts) last FROM events WHERE event_type = 'view' GROUP BY 1) SELECT user_id, coalesce(n, 0) n, coalesce(orders, 0) orders, coalesce(last < {NOW} - INTERVAL 1 DAY, true) due FROM u LEFT JOIN s USING (user_id)")
def groups_with_state(t):
    """JN-10: groups with their statistics and schedule; what is missing has a default."""
    stats = t.events.groupBy("user_id").agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "purchase").alias("orders"))
    last = t.events.where("event_type = 'view'").groupBy("user_id").agg(F.max("ts").alias("last"))
    due = F.coalesce(F.col("last").cast("timestamp") < F.lit(DEFAULT.as_of) - F.expr("INTERVAL 1 DAY"), F.lit(True))
    return stats.join(last, "user_id", "left").select("user_id", "n", "orders", due.alias("due"))


@query(f"SELECT user_id, CASE WHEN date_diff('second', min(ts), {NOW}) >= 43200 THEN round(count(*) / (date_diff('second', min(ts), {NOW}) / 86400.0) * 0.0026 * 30, 4) END AS month_cost FROM events GROUP BY 1")
def spend_forecast(t):
    """AGG-9: none before twelve hours of history."""
    seconds = F.unix_timestamp(F.lit(DEFAULT.as_of)) - F.unix_timestamp(F.min(F.col("ts").cast("timestamp")))
    rows = t.events.groupBy("user_id").agg(F.count("*").alias("n"), seconds.alias("s"))
    return rows.select("user_id", F.when(F.col("s") >= 43200, F.round(F.col("n") / (F.col("s") / 86400) * 0.0026 * 30, 4)).alias("month_cost"))


@query("WITH f AS (SELECT count(*) n, regr_slope(l_extendedprice, l_quantity) a, regr_intercept(l_extendedprice, l_quantity) b, regr_r2(l_extendedprice, l_quantity) r, regr_intercept(l_extendedprice, l_tax) b2, regr_r2(l_extendedprice, l_tax) r2 FROM lineitem) SELECT n, round(a, 4) slope, CASE WHEN n >= 3 AND b >= 0 AND r IS NOT NULL AND NOT (b2 >= 0 AND r2 > r + 0.15) THEN 'l_quantity' WHEN n >= 3 AND b2 >= 0 AND r2 IS NOT NULL THEN 'l_tax' ELSE 'none' END model FROM f")
def cost_model_choice(t):
    """AGG-22."""
    return ld.cost_model(t.lineitem, "l_extendedprice", "l_quantity", "l_tax").select("n", F.round("slope_l_quantity", 4).alias("slope"), "model")


@query("SELECT CASE WHEN count(*) FILTER (event_id % 4 <> 3) >= count(*) FILTER (event_id % 2 = 0) THEN 'posted' ELSE 'edited' END field, greatest(count(*) FILTER (event_id % 4 <> 3), count(*) FILTER (event_id % 2 = 0)) n FROM events")
def best_date_field(t):
    """AGG-23."""
    at, k = F.col("ts").cast("timestamp"), F.col("event_id")
    posted = rc.when_posted(F.when(k % 4 != 3, F.unix_timestamp(at).cast("string")).otherwise("soon"))
    edited = rc.when_posted(F.when(k % 2 == 0, F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'")).otherwise(""))
    return ld.best_date_field(t.events, {"posted": posted, "edited": edited})


@query("SELECT (SELECT count(*) FROM ((SELECT o_custkey FROM orders WHERE o_orderstatus = 'O' EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'F') UNION ALL (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'O'))) n_apart")
def id_sets_apart(t):
    """AGG-24, SET-2: ids in one run but not in the other."""
    ids = t.orders.where("o_orderstatus in ('O', 'F')").groupBy("o_custkey").agg(F.countDistinct("o_orderstatus").alias("n"))
    return ids.agg(F.count_if(F.col("n") == 1).alias("n_apart"))


@query("SELECT CAST(sum(s_suppkey % 37) AS BIGINT) used, CAST(sum(CASE WHEN s_suppkey % 5 <> 0 THEN 40 END) AS BIGINT) most, round(100.0 * sum(CASE WHEN s_suppkey % 5 <> 0 THEN s_suppkey % 37 END) / sum(CASE WHEN s_suppkey % 5 <> 0 THEN 40 END), 2) percent, round(sum(CASE WHEN s_suppkey % 5 <> 0 THEN 40 - s_suppkey % 37 END) / 12.5, 4) days_left, count(*) FILTER (s_suppkey % 4 <> 0) live FROM supplier")
def pool_totals(t):
    """AGG-25, AGG-33."""
    k = F.col("s_suppkey")
    known = k % 5 != 0
    used, most = k % 37, F.when(known, 40)
    return t.supplier.agg(
        F.sum(used).alias("used"), F.sum(most).cast("long").alias("most"), F.round(100 * F.sum(F.when(known, used)) / F.sum(most), 2).alias("percent"),
        F.round(F.sum(F.when(known, 40 - used)) / 12.5, 4).alias("days_left"), F.count_if(k % 4 != 0).alias("live"),
    )


@query("WITH c AS (SELECT user_id, CAST(floor(epoch(ts) / 86400) AS BIGINT) run, count(*) n FROM events GROUP BY ALL), r AS (SELECT run, count(*) groups, max(n) most, sum(n) total FROM c GROUP BY 1) SELECT run, groups, CAST(total AS BIGINT) total, CASE WHEN most >= 10 AND total > 20 * groups THEN 'per group' WHEN total < 50 THEN 'too few' ELSE 'global' END verdict FROM r")
def limit_mode(t):
    """AGG-30, AGG-31, AGG-38: items of each group within a run, and what kind of limit they show."""
    run = F.floor(F.unix_timestamp(F.col("ts").cast("timestamp")) / 86400).alias("run")
    counts = t.events.groupBy("user_id", run).agg(F.count("*").alias("n"))
    runs = counts.groupBy("run").agg(F.count("*").alias("groups"), F.max("n").alias("most"), F.sum("n").alias("total"))
    return runs.select("run", "groups", "total", ld.ladder([((F.col("most") >= 10) & (F.col("total") > 20 * F.col("groups")), "per group"), (F.col("total") < 50, "too few")], "global").alias("verdict"))


@query("SELECT source, count(*) raw, count(*) FILTER (first) AS kept FROM (SELECT source, row_number() OVER (PARTITION BY text ORDER BY source, doc_id) = 1 AS first FROM documents) GROUP BY source")
def source_yield(t):
    """AGG-32, SET-4: rows of each source before and after the first source wins."""
    own = t.documents.select("source", F.sha2("text", 256).alias("h"), "doc_id")
    kept = own.groupBy("h").agg(F.min(F.struct("source", "doc_id")).alias("x")).groupBy("x.source").agg(F.count("*").alias("kept"))
    return own.groupBy("source").agg(F.count("*").alias("raw")).join(kept, "source", "left").select("source", "raw", F.coalesce("kept", F.lit(0)).alias("kept"))


@query("""WITH f AS (SELECT event_id, value, hour(ts) h, row_number() OVER (PARTITION BY user_id, props ORDER BY ts, event_id) > 1 twice, coalesce(ts - lag(ts) OVER u < INTERVAL 20 MINUTE, false) near, coalesce(lag(event_type) OVER u = 'error', false) paused, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 24 HOUR PRECEDING AND CURRENT ROW) n_day FROM events WINDOW u AS (PARTITION BY user_id ORDER BY ts, event_id)),
g AS (SELECT CASE WHEN twice THEN 'duplicate' WHEN near THEN 'crosspost' WHEN paused THEN 'paused' WHEN value > 97 THEN 'animal' WHEN value < 3 THEN 'offer' WHEN floor(value * 2) < 40 THEN 'confidence' WHEN h >= 22 OR h < 6 THEN 'quiet' WHEN n_day >= 3 THEN 'limit' ELSE 'send' END step FROM f)
SELECT step, count(*) n, step IN ('limit', 'animal', 'offer', 'send') AS on_record FROM g GROUP BY step""")
def alert_ladder(t):
    """S-13, S-18: all rungs by facts of the events, and which of them leave a row."""
    own = Window.partitionBy("user_id").orderBy("ts", "event_id")
    seconds = F.unix_micros(F.col("ts").cast("timestamp"))
    day = Window.partitionBy("user_id").orderBy(seconds).rangeBetween(-86_400_000_000, 0)
    facts = t.events.select(
        "value", F.hour("ts").alias("h"), (F.row_number().over(Window.partitionBy("user_id", "props").orderBy("ts", "event_id")) > 1).alias("twice"), F.coalesce(seconds - F.lag(seconds).over(own) < 1_200_000_000, F.lit(False)).alias("near"),
        F.coalesce(F.lag("event_type").over(own) == "error", F.lit(False)).alias("paused"), F.count("*").over(day).alias("day"),
    )
    quiet = (F.col("h") >= DEFAULT.quiet_from) | (F.col("h") < DEFAULT.quiet_to)
    value = F.col("value")
    step = ld.alert_step(F.col("twice"), F.col("near"), F.col("paused"), value > 97, F.when(value < 3, "offer").otherwise("demand"), F.floor(value * 2), quiet, F.col("day"), replace(DEFAULT, alerts_per_hour=3))
    return facts.groupBy(step.alias("step")).agg(F.count("*").alias("n")).select("step", "n", F.col("step").isin(*ld.KEPT_ON_RECORD, "send").alias("on_record"))


PACES = f"""g AS (SELECT user_id, count(*) FILTER (ts >= {NOW} - INTERVAL 3 DAY) / 72.0::DOUBLE rate, count(*) FILTER (event_type = 'purchase') AS share, CASE WHEN count(*) FILTER (event_type = 'click') > count(*) FILTER (event_type = 'view') THEN 'A' ELSE 'B' END path, round(avg(value) / 100, 4) used FROM events GROUP BY 1),
h AS (SELECT *, CASE path WHEN 'A' THEN 5.0::DOUBLE ELSE 15.0 END AS least_min FROM g), i AS (SELECT *, greatest(2.0::DOUBLE, ceil(rate * (least_min / 60.0) * 3)) AS cost FROM h),
j AS (SELECT *, CASE WHEN used < 0.5 THEN 5 ELSE CAST(least(120.0::DOUBLE, greatest(least_min, round_even(CASE WHEN path = 'A' THEN CASE WHEN rate > 0 THEN 60.0 / rate ELSE least_min END WHEN share / cost >= 1.0 THEN 1440.0 / (share / cost) ELSE 120.0 END, 0))) AS INTEGER) END AS minutes FROM i),
k AS (SELECT *, CAST(CASE WHEN path = 'A' THEN greatest(minutes * 2, 30) ELSE 1440 END AS INTEGER) AS window_min, CASE path WHEN 'A' THEN 50 ELSE 12 END most FROM j)"""


@query(f"WITH {PACES} SELECT user_id, minutes, CAST(CASE WHEN rate <= 0 THEN least(most, 10) ELSE least(most, greatest(2, ceil(rate * CASE WHEN path = 'A' THEN window_min / 60.0::DOUBLE ELSE minutes / 60.0::DOUBLE END * 3))) END AS INTEGER) AS run_limit, window_min FROM k")
def run_intervals(t):
    """S-6, S-7, S-36: wait, limit and window of every group on both paths, from its posts."""
    kind, at = F.col("event_type"), F.col("ts").cast("timestamp")
    recent = F.count_if(at >= F.lit(DEFAULT.as_of) - F.expr("INTERVAL 3 DAYS")) / F.lit(72.0)
    path = F.when(F.count_if(kind == "click") > F.count_if(kind == "view"), "A").otherwise("B")
    rows = t.events.groupBy("user_id").agg(recent.alias("rate"), F.count_if(kind == "purchase").alias("share"), path.alias("path"), F.round(F.avg("value") / 100, 4).alias("used"))
    pace = replace(DEFAULT, budget_slack=0.5)
    rows = rows.withColumn("minutes", ld.interval_minutes(F.col("rate"), F.col("used"), F.col("path"), F.col("share"), pace))
    limit, window = ld.run_size(F.col("rate"), F.col("minutes"), F.col("path"), pace)
    return rows.select("user_id", "minutes", limit.alias("run_limit"), window.alias("window_min"))


@query(f"""WITH g AS (SELECT user_id, count(*) FILTER (event_type = 'purchase') > 8 AS ready, arg_max(event_type, (ts, event_id)) = 'error' AS held, coalesce(max(ts) FILTER (event_type = 'view') < {NOW} - INTERVAL 2 DAY, true) AS due, 6 - count(*) FILTER (ts >= {NOW} - INTERVAL 3 DAY) AS budget FROM events GROUP BY 1)
SELECT reason, count(*) n FROM (SELECT CASE WHEN NOT ready THEN 'not ready' WHEN held THEN 'quarantined' WHEN NOT due THEN 'not due' WHEN budget <= 0 THEN 'no budget' ELSE 'planned' END reason FROM g) GROUP BY 1""")
def run_plan(t):
    """S-8, S-20, AGG-34: why groups are left out of a run, from their events."""
    at, kind = F.col("ts").cast("timestamp"), F.col("event_type")
    ago = lambda days: F.lit(DEFAULT.as_of) - F.expr(f"INTERVAL {days} DAYS")
    groups = t.events.groupBy("user_id").agg(
        (F.count_if(kind == "purchase") > 8).alias("ready"), (F.max_by(kind, F.struct("ts", "event_id")) == "error").alias("held"),
        F.coalesce(F.max(F.when(kind == "view", at)) < ago(2), F.lit(True)).alias("due"), (6 - F.count_if(at >= ago(3))).alias("budget"),
    )
    reason = ld.skip_reason(F.col("ready"), F.col("held"), F.col("due"), F.col("budget"))
    return groups.groupBy(F.coalesce(reason, F.lit("planned")).alias("reason")).agg(F.count("*").alias("n"))


@query(f"WITH g AS (SELECT user_id, date_diff('hour', max(ts), {NOW}) h, count(*) FILTER (event_type = 'error') > 10 bad FROM events GROUP BY 1) SELECT count(*) groups, count(*) FILTER (h > 6 OR bad) silent, CASE WHEN count(*) FILTER (h > 6 OR bad) = 0 THEN 'ok' WHEN count(*) FILTER (h > 6 OR bad) * 2 < count(*) THEN 'watch' ELSE 'down' END verdict FROM g")
def health_verdict(t):
    """S-26, S-39."""
    rows = t.events.groupBy("user_id").agg(F.max(F.col("ts").cast("timestamp")).alias("last"), (F.count_if(F.col("event_type") == "error") > 10).alias("bad"))
    hours = F.floor(F.unix_timestamp(F.lit(DEFAULT.as_of)) / 3600) - F.floor(F.unix_timestamp("last") / 3600)
    silent = F.count_if(ld.health(hours, F.col("bad")))
    return rows.agg(F.count("*").alias("groups"), silent.alias("silent")).select("groups", "silent", ld.ladder([(F.col("silent") == 0, "ok"), (F.col("silent") * 2 < F.col("groups"), "watch")], "down").alias("verdict"))


@query("SELECT doc_id, CASE WHEN len(v) > 0 THEN array_to_string(v, ',') ELSE 'de,en,es,fr' END AS langs FROM (SELECT doc_id, list_filter(['de', 'en', 'es', 'fr'], lambda x: x = lang OR (doc_id % 5 = 0 AND x = 'it')) v FROM (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'it' ELSE lang END lang FROM documents))")
def soft_filtered(t):
    """GEO-10."""
    wanted = F.when(F.col("doc_id") % 5 == 0, "it").otherwise(F.col("lang"))
    return t.documents.select("doc_id", F.array_join(ld.soft_filter(F.array(*map(F.lit, ("de", "en", "es", "fr"))), lambda x: x == wanted), ",").alias("langs"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN NULL WHEN c_custkey % 4 = 3 THEN 'https://maps.example/at/1.5,2.5' WHEN c_custkey % 4 = 2 THEN 'https://maps.example/at/3.5,4.5' ELSE 'https://maps.example/dir/1.5,2.5/3.5,4.5' END link, printf('%.3f:%.3f:%s', c_custkey / 7.0, c_nationkey / 3.0, 'sure') AS cache_key FROM customer")
def trip_links(t):
    """GEO-18, GEO-18b, GEO-22."""
    k = F.col("c_custkey") % 4
    here, there = (k == 1) | (k == 3), (k == 1) | (k == 2)
    link = rc.endpoints_link(F.when(here, 1.5), F.when(here, 2.5), F.when(there, 3.5), F.when(there, 4.5))
    return t.customer.select("c_custkey", link.alias("link"), F.format_string("%.3f:%.3f:%s", F.col("c_custkey") / 7.0, F.col("c_nationkey") / 3.0, F.lit("sure")).alias("cache_key"))


@query(f"SELECT count(*) kept FROM events WHERE ts >= {NOW} - INTERVAL 7 DAY")
def cache_eviction(t):
    """GEO-23, S-24."""
    return t.events.where(F.col("ts").cast("timestamp") >= F.lit(DEFAULT.as_of) - F.expr("INTERVAL 7 DAYS")).agg(F.count("*").alias("kept"))


@query("SELECT s_suppkey, s_name FROM supplier ORDER BY s_acctbal DESC, lower(s_name) LIMIT 30")
def latest_clamped(t):
    """SRT-6, SRT-8: as many as asked for, within 1 and 30."""
    asked = 55
    return t.supplier.orderBy(F.col("s_acctbal").desc(), F.lower("s_name")).limit(max(1, min(asked, 30))).select("s_suppkey", "s_name")


@query("SELECT event_type, share FROM (SELECT event_type, round(100.0 * count(*) / sum(count(*)) OVER (), 2) share FROM events GROUP BY 1)")
def funnel_shares(t):
    """S-32."""
    counts = t.events.groupBy("event_type").agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    return counts.join(F.broadcast(total)).select("event_type", F.round(100 * F.col("n") / F.col("total"), 2).alias("share"))


@query("SELECT p_brand, count(*) n FROM (SELECT p_brand, p_size, row_number() OVER (PARTITION BY p_brand ORDER BY p_size) r FROM (SELECT DISTINCT p_brand, p_size FROM part)) WHERE p_size = r GROUP BY p_brand")
def numbered_series(t):
    """S-34: numbers from 1 on up to the first gap."""
    order = Window.partitionBy("p_brand").orderBy("p_size")
    rows = t.part.select("p_brand", "p_size").distinct().withColumn("r", F.row_number().over(order))
    return rows.where("p_size = r").groupBy("p_brand").agg(F.count("*").alias("n"))


@query("""WITH c AS (SELECT * FROM (VALUES (0, 'off'), (1, 'always'), (2, 'critical'), (3, 'loud')) v(r, said)), g AS (SELECT n_nationkey, n_regionkey, count(*) FILTER (s_acctbal > 5000) live FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1, 2),
m AS (SELECT n_nationkey, live, CASE WHEN said IN ('off', 'always', 'critical') THEN said ELSE 'critical' END mode FROM g LEFT JOIN c ON r = n_regionkey) SELECT n_nationkey, mode, live, CASE mode WHEN 'off' THEN false WHEN 'always' THEN true ELSE live < 2 END alert FROM m""")
def degradation_alert(t):
    """S-37, GT-13: whether a pool of few live members is told of; an unknown or missing mode is taken for the default."""
    said = t.spark.createDataFrame([(0, "off"), (1, "always"), (2, "critical"), (3, "loud")], "n_regionkey int, said string")
    live = t.supplier.groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.count_if(F.col("s_acctbal") > 5000).alias("live"))
    mode = F.when(F.col("said").isin("off", "always", "critical"), F.col("said")).otherwise("critical")
    rows = t.nation.join(live, "n_nationkey", "left").join(F.broadcast(said), "n_regionkey", "left").select("n_nationkey", mode.alias("mode"), F.coalesce("live", F.lit(0)).alias("live"))
    return rows.select("n_nationkey", "mode", "live", F.when(F.col("mode") == "off", False).when(F.col("mode") == "always", True).otherwise(F.col("live") < 2).alias("alert"))


@query("SELECT c_custkey, concat_ws(chr(10), 'Lead ' || c_custkey, CASE WHEN c_acctbal > 0 THEN 'worth ' || CAST(round(c_acctbal) AS BIGINT) END, CASE WHEN c_custkey % 2 = 0 THEN 'Missing: phone' || CASE WHEN c_custkey % 6 = 0 THEN ', date' ELSE '' END END) AS body, len(list_filter(['Map', CASE WHEN c_custkey % 3 = 0 THEN 'Post' END], lambda x: x IS NOT NULL)) AS buttons FROM customer")
def alert_text(t):
    """FN-30, FN-30b, FN-30c, PRJ-13: lines and buttons, those without a value left out."""
    k = F.col("c_custkey")
    missing = F.array_compact(F.array(F.when(k % 2 == 0, "phone"), F.when(k % 6 == 0, "date")))
    lines = [F.concat(F.lit("Lead "), k.cast("string")), F.when(F.col("c_acctbal") > 0, F.concat(F.lit("worth "), F.round("c_acctbal").cast("long").cast("string"))), F.when(F.size(missing) > 0, F.concat(F.lit("Missing: "), F.array_join(missing, ", ")))]
    buttons = F.array_compact(F.array(F.lit("Map"), F.when(k % 3 == 0, "Post")))
    return t.customer.select("c_custkey", F.concat_ws("\n", *lines).alias("body"), F.size(buttons).cast("long").alias("buttons"))


@query("""SELECT direction, count(*) n FROM (SELECT CASE WHEN p.n_name IS NULL OR d.n_name IS NULL THEN 'unknown' WHEN p.n_name = 'NATION_3' AND d.n_name = 'NATION_3' THEN 'domestic' WHEN d.n_name = 'NATION_3' THEN 'import' WHEN p.n_name = 'NATION_3' THEN 'export' ELSE 'transit' END direction
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey LEFT JOIN nation p ON p.n_nationkey = s_nationkey AND s_acctbal > 1000 LEFT JOIN nation d ON d.n_nationkey = c_nationkey AND c_acctbal > 1000) GROUP BY 1""")
def trip_direction(t):
    """GEO-15, GEO-24: directions of trips; an end whose balance is low counts as unknown."""
    known = lambda name, money: F.when(F.col(money) > 1000, F.col(name))
    found = geo.direction(known("pickup", "s_acctbal"), known("delivery", "c_acctbal"), "NATION_3")
    return _trips(t).groupBy(found.alias("direction")).agg(F.count("*").alias("n"))


