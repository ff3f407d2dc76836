"""Reports over events, orders and labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import alerts, schedule, stats, upserts
from ..params import DEFAULT
from .registry import query

NOW = "TIMESTAMP '2024-01-31 00:00:00'"
LATER = "TIMESTAMP '2001-12-01 00:00:00'"
MONEY = "CAST(coalesce(sum(CASE WHEN event_type='purchase' THEN CAST(value AS DECIMAL(18,2)) END),0) AS DOUBLE)"


@query(f"SELECT count(*) n_all, count(*) FILTER (event_type='view') n_view, count(*) FILTER (event_type='click') n_click, count(*) FILTER (event_type='signup') n_signup, count(*) FILTER (event_type='purchase') n_purchase, count(*) FILTER (event_type='error') n_error, {MONEY} revenue FROM events WHERE ts > {NOW} - INTERVAL 7 DAY")
def funnel_window(t):
    return stats.funnel(t.events, days=7)


@query(f"SELECT days, count(*) n_all, count(*) FILTER (event_type='purchase') n_purchase, {MONEY} revenue FROM events, (SELECT CAST(unnest([7,30]) AS INTEGER) AS days) WHERE ts > {NOW} - days * INTERVAL 1 DAY GROUP BY days")
def funnel_multi_window(t):
    return stats.funnels(t.events)


@query(f"SELECT user_id, count(*) n_posts, count(*) FILTER (event_type='purchase') n_orders, count(*) FILTER (event_type='signup') n_won, max(ts) last_ts, round(count(*) FILTER (event_type='purchase') / count(*), 4) ratio, count(*) >= 30 reliable, round(count(*) * 0.0026::DOUBLE, 4) cost FROM events WHERE ts > {NOW} - INTERVAL 30 DAY GROUP BY user_id")
def group_effectiveness(t):
    return stats.effectiveness(t.events).orderBy(F.col("reliable").desc(), F.col("ratio").desc(), "user_id")


@query("SELECT event_type, count(*) n FROM events WHERE event_type IN ('click','error','view') GROUP BY event_type")
def channel_counts(t):
    return t.events.where(F.col("event_type").isin("click", "error", "view")).groupBy("event_type").agg(F.count("*").alias("n"))


@query(f"SELECT user_id, count(*) FILTER (ts > {NOW} - INTERVAL 30 DAY) n_30, count(*) FILTER (ts > {NOW} - INTERVAL 7 DAY) n_7, count(*) FILTER (ts > {NOW} - INTERVAL 2 DAY) n_2, min(ts) first_ts, round(count(*) FILTER (ts > {NOW} - INTERVAL 7 DAY) / greatest(1.0, least(168.0, floor(epoch({NOW})-epoch(date_trunc('second', min(ts))))/3600.0)), 6) per_hour FROM events GROUP BY user_id")
def group_rate_stats(t):
    return stats.rates(t.events)


@query("SELECT round(quantile_cont(date_diff('second', o_orderdate, l_shipdate)/3600.0, 0.5), 4) median_hours FROM orders JOIN lineitem ON o_orderkey = l_orderkey")
def latency_median(t):
    hours = F.timestamp_diff("SECOND", F.col("o_orderdate"), F.col("l_shipdate")) / 3600.0
    return t.orders.join(t.lineitem, F.col("o_orderkey") == F.col("l_orderkey")).select(hours.alias("hours")).transform(stats.median, "hours").select(F.round("median", 4).alias("median_hours"))


@query("SELECT c_custkey, (SELECT max(o_orderdate) FROM orders WHERE o_custkey = c_custkey) last_order FROM customer")
def health_last_post(t):
    last = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_orderdate").alias("last_order"))
    return t.customer.select("c_custkey").join(last, "c_custkey", "left").orderBy(F.col("last_order").desc_nulls_first(), "c_custkey")


@query("SELECT c_custkey, c_acctbal FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus='F') ORDER BY c_acctbal DESC, c_custkey LIMIT 20")
def unsent_orders(t):
    done = t.orders.where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return t.customer.join(done, "c_custkey", "left_anti").select("c_custkey", "c_acctbal").orderBy(F.col("c_acctbal").desc(), "c_custkey").limit(20)


@query("SELECT coalesce(CAST(quality AS VARCHAR), '(none)') quality, count(*) n, round(count(*) / sum(count(*)) OVER (), 4) AS share FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1")
def feedback_left_join(t):
    rows = t.documents.select("doc_id").join(t.labels, "doc_id", "left").select(F.coalesce(F.col("quality").cast("string"), F.lit("(none)")).alias("quality"))
    return stats.shares(rows, "quality")


@query("SELECT o_orderkey, o_orderstatus, o_orderdate, o_totalprice FROM orders WHERE o_orderstatus IN ('O','F') AND o_orderdate >= TIMESTAMP '1998-01-01' AND o_orderdate < TIMESTAMP '1999-01-01' ORDER BY (o_orderpriority = '5-LOW'), o_orderdate DESC NULLS LAST, o_orderkey LIMIT 50")
def order_list_page(t):
    rows = t.orders.where(F.col("o_orderstatus").isin("O", "F") & (F.col("o_orderdate") >= "1998-01-01") & (F.col("o_orderdate") < "1999-01-01"))
    return rows.orderBy(F.col("o_orderpriority") == "5-LOW", F.col("o_orderdate").desc_nulls_last(), "o_orderkey").limit(50).select("o_orderkey", "o_orderstatus", "o_orderdate", "o_totalprice")


@query("SELECT doc_id, quality FROM documents LEFT JOIN labels USING (doc_id) WHERE quality IS NULL OR quality <= 0")
def keep_null_filter(t):
    return t.documents.join(t.labels, "doc_id", "left").where("quality is null or quality <= 0").select("doc_id", "quality")


@query("SELECT doc_id, CASE WHEN quality IS NOT NULL THEN toxic = 1 END verdict, (toxic = 0) IS TRUE AS surely_clean FROM documents LEFT JOIN labels USING (doc_id)")
def three_state_verdict(t):
    rows = t.documents.select("doc_id").join(t.labels, "doc_id", "left")
    return rows.select("doc_id", F.when(F.col("quality").isNotNull(), F.col("toxic") == 1).alias("verdict"), F.col("toxic").eqNullSafe(0).alias("surely_clean"))


@query(f"SELECT count(*) n, count(*) FILTER (event_type='purchase') n_taken, {MONEY} revenue FROM events WHERE ts > date_trunc('day', {NOW} - INTERVAL 1 DAY)")
def daily_report(t):
    day = F.date_trunc("DAY", F.lit(DEFAULT.as_of) - F.expr("INTERVAL 1 DAY")).cast("timestamp_ntz")
    return t.events.where(F.col("ts") > day).agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "purchase").alias("n_taken"), stats.money(F.when(F.col("event_type") == "purchase", F.col("value"))).alias("revenue"))


@query("WITH p AS (SELECT cn.n_name c_nation, sn.n_name s_nation, count(*) n FROM lineitem JOIN orders ON l_orderkey=o_orderkey JOIN customer ON o_custkey=c_custkey JOIN supplier ON l_suppkey=s_suppkey JOIN nation cn ON c_nationkey=cn.n_nationkey JOIN nation sn ON s_nationkey=sn.n_nationkey GROUP BY ALL) SELECT *, CASE WHEN c_nation=s_nation THEN 'domestic' WHEN c_nation='POLAND' THEN 'import' WHEN s_nation='POLAND' THEN 'export' ELSE 'transit' END direction, count(*) OVER () total FROM p ORDER BY n DESC, c_nation, s_nation LIMIT 20")
def direction_top_with_total(t):
    from pyspark.sql import Window

    nation = t.nation.select("n_nationkey", "n_name")
    rows = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("o_custkey", "l_suppkey").agg(F.count("*").alias("m"))
    rows = rows.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey"))
    rows = rows.groupBy("c_nationkey", "s_nationkey").agg(F.sum("m").alias("n"))
    rows = rows.join(nation.select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("c_nation")), "c_nationkey").join(nation.select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("s_nation")), "s_nationkey")
    rows = rows.select("c_nation", "s_nation", "n", F.when(F.col("c_nation") == F.col("s_nation"), "domestic").when(F.col("c_nation") == "POLAND", "import").when(F.col("s_nation") == "POLAND", "export").otherwise("transit").alias("direction"), F.count("*").over(Window.partitionBy()).alias("total"))
    return rows.orderBy(F.col("n").desc(), "c_nation", "s_nation").limit(20)


@query(f"SELECT o_custkey, max(o_orderdate) last_order, CASE WHEN max(o_orderdate) < date_trunc('month', {LATER} - INTERVAL 4 MONTH) THEN 'exhausted' ELSE 'live' END status FROM orders GROUP BY o_custkey")
def live_keys_month(t):
    edge = F.lit("2001-08-01").cast("timestamp_ntz")
    return t.orders.groupBy("o_custkey").agg(F.max("o_orderdate").alias("last_order")).withColumn("status", F.when(F.col("last_order") < edge, "exhausted").otherwise("live"))


@query("SELECT l_returnflag, count(*) n, round(regr_slope(l_extendedprice, l_quantity), 4) slope, round(regr_intercept(l_extendedprice, l_quantity), 4) intercept, round(regr_r2(l_extendedprice, l_quantity), 4) r2 FROM lineitem GROUP BY l_returnflag")
def linear_cost_model(t):
    return stats.regression(t.lineitem, "l_quantity", "l_extendedprice", "l_returnflag")


@query("WITH e AS (SELECT event_id, ts, event_type, value FROM events) SELECT event_id, CASE WHEN event_type='error' THEN 'animal' WHEN event_type='view' THEN 'offer' WHEN value IS NOT NULL AND value < 40 THEN 'confidence' WHEN hour(ts) >= 22 OR hour(ts) < 6 THEN 'quiet' ELSE 'send' END decision FROM e")
def alert_ladder_static(t):
    return alerts.static_ladder(t.events).select("event_id", "decision")


@query("SELECT event_id, hour(ts) >= 22 OR hour(ts) < 6 AS is_quiet FROM events")
def quiet_hours(t):
    return t.events.select("event_id", alerts.quiet(F.hour("ts"), 22, 6).alias("is_quiet"))


@query(f"WITH r AS (SELECT * FROM events WHERE ts > {NOW} - INTERVAL 16 HOUR) SELECT event_id, ts, user_id FROM r WHERE event_type='view' AND user_id NOT IN (SELECT user_id FROM r WHERE event_type='purchase') ORDER BY ts DESC, event_id LIMIT 20")
def night_digest(t):
    return alerts.night_digest(t.events).select("event_id", "ts", "user_id")


@query("WITH c AS (SELECT e.event_id, p.event_id prev_id, (e.user_id = p.user_id)::INT r, p.ts pts FROM events e JOIN events p ON (e.user_id=p.user_id OR e.props=p.props) AND p.ts < e.ts AND p.ts >= e.ts - INTERVAL 6 HOUR) SELECT event_id, prev_id FROM c QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY r DESC, pts DESC, prev_id DESC) = 1")
def crosspost_batch(t):
    return alerts.crossposts(t.events)


@query("SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND CURRENT ROW) n_hour FROM events")
def hourly_rate(t):
    return alerts.hourly_counts(t.events).select("event_id", "n_hour")


@query("SELECT user_id, arg_max(event_type, (ts, event_id)) state, arg_max(event_type, (ts, event_id)) = 'error' paused FROM events WHERE event_type IN ('signup','error') GROUP BY user_id")
def pause_state_asof(t):
    return alerts.paused(t.events)


@query()
def alert_fold(t):
    return alerts.fold(t.events, tenant="user_id")


@query("WITH o AS (SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderkey % 3 <> 0), n AS (SELECT o_orderkey, 'N' o_orderstatus, o_totalprice * 2 o_totalprice FROM orders WHERE o_orderkey % 2 = 0) SELECT coalesce(o.o_orderkey, n.o_orderkey) o_orderkey, CASE WHEN o.o_orderkey IS NULL OR (n.o_orderkey IS NOT NULL AND o.o_orderstatus <> 'F') THEN n.o_orderstatus ELSE o.o_orderstatus END o_orderstatus, CASE WHEN o.o_orderkey IS NULL OR (n.o_orderkey IS NOT NULL AND o.o_orderstatus <> 'F') THEN n.o_totalprice ELSE o.o_totalprice END o_totalprice FROM o FULL JOIN n ON o.o_orderkey = n.o_orderkey")
def conditional_upsert(t):
    rows = t.orders.select("o_orderkey", "o_orderstatus", "o_totalprice")
    new = rows.where("o_orderkey % 2 = 0").withColumns({"o_orderstatus": F.lit("N"), "o_totalprice": F.col("o_totalprice") * 2})
    return upserts.conditional(rows.where("o_orderkey % 3 <> 0"), new, "o_orderkey", ["o_orderstatus", "o_totalprice"], F.col("o.o_orderstatus") != "F")


@query("WITH o AS (SELECT o_orderkey, o_orderpriority, o_totalprice FROM orders WHERE o_orderkey % 3 <> 0), n AS (SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN 'X' END o_orderpriority, o_totalprice + 1 o_totalprice FROM orders WHERE o_orderkey % 2 = 0) SELECT coalesce(n.o_orderkey, o.o_orderkey) o_orderkey, coalesce(n.o_orderpriority, o.o_orderpriority) o_orderpriority, coalesce(n.o_totalprice, o.o_totalprice) o_totalprice FROM o FULL JOIN n ON o.o_orderkey = n.o_orderkey")
def coalesce_upsert(t):
    rows = t.orders.select("o_orderkey", "o_orderpriority", "o_totalprice")
    new = rows.where("o_orderkey % 2 = 0").withColumns({"o_orderpriority": F.when(F.col("o_orderkey") % 4 == 0, "X"), "o_totalprice": F.col("o_totalprice") + 1})
    return upserts.coalescing(rows.where("o_orderkey % 3 <> 0"), new, "o_orderkey", ["o_orderpriority", "o_totalprice"])


RUNS = "m AS (SELECT *, CASE WHEN event_type IS NOT DISTINCT FROM lag(event_type) OVER w THEN 0 ELSE 1 END f FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), r AS (SELECT *, sum(f) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) run FROM m), s AS (SELECT user_id, CAST(run AS BIGINT) run, event_type, min(ts) since, max(ts) until, count(*) n FROM r GROUP BY ALL)"


@query(f"WITH {RUNS} SELECT * FROM s")
def state_streak(t):
    return upserts.streaks(t.events, "user_id", "event_type", ["ts", "event_id"])


@query(f"WITH {RUNS} SELECT *, until + CASE WHEN n >= 3 THEN INTERVAL 24 HOUR ELSE INTERVAL 30 MINUTE END back_at FROM s WHERE event_type = 'error'")
def quarantine_escalation(t):
    return upserts.quarantines(upserts.streaks(t.events, "user_id", "event_type", ["ts", "event_id"]), "error", "event_type")


@query("SELECT user_id, string_agg(DISTINCT event_type, ',' ORDER BY event_type) seen, count(*) n FROM events GROUP BY user_id")
def array_append_unique(t):
    return upserts.append_unique(t.events, "user_id", "event_type")


@query("SELECT c_custkey, arg_max(s_suppkey, sha256(c_custkey || '|' || s_suppkey)) s_suppkey FROM customer, supplier GROUP BY c_custkey")
def hrw_assignment(t):
    """S-21, SRT-9: the whole pool."""
    return schedule.rendezvous(t.customer, t.supplier, "c_custkey", "s_suppkey")


TRIALS = "t AS (SELECT user_id, count(*) FILTER (event_type IN ('click','purchase')) trials, count(*) FILTER (event_type='purchase') wins FROM events GROUP BY user_id)"


def _trials(t):
    return t.events.groupBy("user_id").agg(F.count_if(F.col("event_type").isin("click", "purchase")).alias("trials"), F.count_if(F.col("event_type") == "purchase").alias("wins"))


@query(f"WITH {TRIALS}, a AS (SELECT sum(trials) x, sum(wins) y FROM t) SELECT user_id, trials, wins, round(CAST(1 + wins + CASE WHEN trials >= 15 THEN 0 ELSE 0.3::DOUBLE * y END AS DOUBLE), 4) alpha, round(CAST(1 + trials - wins + CASE WHEN trials >= 15 THEN 0 ELSE 0.3::DOUBLE * (x - y) END AS DOUBLE), 4) beta FROM t, a")
def bandit_posterior(t):
    return schedule.posteriors(_trials(t), "user_id")


@query()
def bandit_allocation(t):
    return schedule.allocation(schedule.posteriors(_trials(t), "user_id"), "user_id", 2000)


@query(f"WITH r AS (SELECT user_id, count(*) FILTER (ts > {NOW} - INTERVAL 2 DAY) n_2, round(count(*) FILTER (ts > {NOW} - INTERVAL 7 DAY) / greatest(1.0, least(168.0, floor(epoch({NOW})-epoch(date_trunc('second', min(ts))))/3600.0)), 6) per_hour FROM events GROUP BY user_id) SELECT user_id, round(greatest(5.0, least(120.0, CASE WHEN (SELECT sum(n_2) FROM r) / 2000.0 < 0.7 THEN 5.0 WHEN per_hour > 0 THEN 60.0::DOUBLE / per_hour ELSE 120.0 END))::DOUBLE, 2) interval_min FROM r")
def adaptive_interval(t):
    return schedule.intervals(stats.rates(t.events)).select("user_id", "interval_min")


@query("WITH c AS (SELECT user_id, count(*) cost FROM events GROUP BY user_id) SELECT user_id, cost, CAST(sum(cost) OVER (ORDER BY user_id ROWS UNBOUNDED PRECEDING) AS BIGINT) running, sum(cost) OVER (ORDER BY user_id ROWS UNBOUNDED PRECEDING) <= 2000 runs FROM c")
def budget_cutoff(t):
    costs = t.events.groupBy("user_id").agg(F.count("*").alias("cost"))
    return schedule.budget_cutoff(costs, ["user_id"], "cost", DEFAULT.daily_budget)


@query(f"SELECT user_id, count(*) FILTER (CAST(ts AS DATE) = DATE '2024-01-30') today, max(ts) last_ts FROM events GROUP BY user_id")
def daily_reset(t):
    return t.events.groupBy("user_id").agg(F.count_if(F.col("ts").cast("date") == F.lit("2024-01-30").cast("date")).alias("today"), F.max("ts").alias("last_ts"))


@query("WITH r AS (SELECT s_nationkey, s_suppkey, s_acctbal, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) k FROM supplier WHERE s_acctbal <= 0 OR s_acctbal >= 1000) SELECT s_nationkey, min(s_suppkey) FILTER (k = 1) AS accepted, count(*) - 1 AS duplicates, max(s_acctbal) best FROM r GROUP BY s_nationkey")
def candidate_fold(t):
    rows = t.supplier.where("s_acctbal <= 0 or s_acctbal >= 1000")
    return rows.groupBy("s_nationkey").agg(F.min("s_suppkey").alias("accepted"), (F.count("*") - 1).alias("duplicates"), F.max("s_acctbal").alias("best"))


@query("WITH o AS (SELECT p_partkey, p_brand, p_size FROM part WHERE p_partkey % 5 <> 0), n AS (SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'edited' ELSE '' END p_brand, p_size + 1 p_size FROM part WHERE p_partkey % 3 = 0) SELECT coalesce(o.p_partkey, n.p_partkey) p_partkey, coalesce(nullif(n.p_brand, ''), o.p_brand) p_brand, greatest(o.p_size, n.p_size) p_size FROM o FULL JOIN n ON o.p_partkey = n.p_partkey")
def candidate_merge(t):
    rows = t.part.select("p_partkey", "p_brand", "p_size")
    new = rows.where("p_partkey % 3 = 0").withColumns({"p_brand": F.when(F.col("p_partkey") % 2 == 0, "edited").otherwise(""), "p_size": F.col("p_size") + 1}).alias("n")
    old = rows.where("p_partkey % 5 <> 0").alias("o")
    joined = old.join(new, F.col("o.p_partkey") == F.col("n.p_partkey"), "full_outer")
    return joined.select(F.coalesce("o.p_partkey", "n.p_partkey").alias("p_partkey"), F.coalesce(F.nullif(F.col("n.p_brand"), F.lit("")), F.col("o.p_brand")).alias("p_brand"), F.greatest("o.p_size", "n.p_size").alias("p_size"))


@query("SELECT s_suppkey, unnest(range(s_suppkey, s_suppkey + 3)) AS port FROM supplier")
def expand_ranges(t):
    return t.supplier.select("s_suppkey", F.explode(F.sequence(F.col("s_suppkey"), F.col("s_suppkey") + 2)).alias("port"))


@query("WITH r AS (SELECT conv_id, string_agg(DISTINCT role, ',' ORDER BY role) roles, count(*) turns FROM conversations GROUP BY conv_id) SELECT roles, count(*) n, CAST(sum(turns) AS BIGINT) turns FROM r GROUP BY roles")
def token_runs(t):
    sets = t.conversations.groupBy("conv_id").agg(F.array_join(F.array_sort(F.collect_set("role")), ",").alias("roles"), F.count("*").alias("turns"))
    return sets.groupBy("roles").agg(F.count("*").alias("n"), F.sum("turns").alias("turns"))
