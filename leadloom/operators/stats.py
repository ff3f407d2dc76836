"""Funnels, group effectiveness, confusion matrices and other reports, each in one scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.parts import parts_in
from ..functions.text import normal
from ..params import DEFAULT, Params
from ..session import ship, written


def money(c: Column) -> Column:
    """Exact sums of amounts: the order of rows doesn't show."""
    return F.coalesce(F.sum(c.cast("decimal(18,2)")), F.lit(0)).cast("double")


def since(ts: Column, as_of, days: int) -> Column:
    return ts > F.lit(as_of).cast("timestamp_ntz") - F.expr(f"INTERVAL {days} DAYS")


def funnel(events: DataFrame, *, days: int, params: Params = DEFAULT) -> DataFrame:
    kinds = ["view", "click", "signup", "purchase", "error"]
    return events.where(since(F.col("ts"), params.as_of, days)).agg(
        F.count("*").alias("n_all"), *(F.count_if(F.col("event_type") == k).alias(f"n_{k}") for k in kinds), money(F.when(F.col("event_type") == "purchase", F.col("value"))).alias("revenue")
    )


def funnels(events: DataFrame, *, params: Params = DEFAULT) -> DataFrame:
    """One scan for several windows: each row counts in every window that holds it."""
    days = F.explode(F.array(*map(F.lit, params.windows))).alias("days")
    rows = events.where(since(F.col("ts"), params.as_of, max(params.windows))).select("*", days)
    rows = rows.where(F.col("ts") > F.lit(params.as_of).cast("timestamp_ntz") - F.make_dt_interval(F.col("days")))
    return rows.groupBy("days").agg(F.count("*").alias("n_all"), F.count_if(F.col("event_type") == "purchase").alias("n_purchase"), money(F.when(F.col("event_type") == "purchase", F.col("value"))).alias("revenue"))


def effectiveness(events: DataFrame, *, days: int = 30, params: Params = DEFAULT) -> DataFrame:
    """Orders per group with ratio, reliability and cost."""
    found = events.where(since(F.col("ts"), params.as_of, days)).groupBy("user_id").agg(
        F.count("*").alias("n_posts"), F.count_if(F.col("event_type") == "purchase").alias("n_orders"), F.count_if(F.col("event_type") == "signup").alias("n_won"), F.max("ts").alias("last_ts")
    )
    return found.select("*", F.round(F.col("n_orders") / F.col("n_posts"), 4).alias("ratio"), (F.col("n_posts") >= params.reliable_sample).alias("reliable"), F.round(F.col("n_posts") * params.cost_per_post, 4).alias("cost"))


def rates(events: DataFrame, *, params: Params = DEFAULT) -> DataFrame:
    """Counts over three windows and the hourly rate over the last, at least an hour of it known."""
    ts = F.col("ts")
    found = events.groupBy("user_id").agg(
        F.count_if(since(ts, params.as_of, 30)).alias("n_30"), F.count_if(since(ts, params.as_of, 7)).alias("n_7"), F.count_if(since(ts, params.as_of, 2)).alias("n_2"), F.min("ts").alias("first_ts")
    )
    hours = (F.unix_timestamp(F.lit(params.as_of)) - F.unix_timestamp(F.col("first_ts").cast("timestamp"))) / 3600.0
    return found.withColumn("per_hour", F.round(F.col("n_7") / F.greatest(F.lit(1.0), F.least(F.lit(168.0), hours)), 6))


def confusion(judged: DataFrame, verdict: str, truth: str) -> DataFrame:
    v, t = F.col(verdict), F.col(truth) == 1
    rows = judged.where(v.isNotNull() & F.col(truth).isNotNull())
    return rows.agg(F.count_if(v & t).alias("tp"), F.count_if(v & ~t).alias("fp"), F.count_if(~v & t).alias("fn"), F.count_if(~v & ~t).alias("tn"))


def sweep(judged: DataFrame, truth: str, *, highest: int = 15) -> DataFrame:
    """For every threshold: what would be rejected and missed.  Only rows that points decide move."""
    spark = judged.sparkSession
    light = judged.groupBy("layer", "points", "verdict", F.col(truth).alias("truth")).agg(F.count("*").alias("n"))
    rows = light.join(F.broadcast(spark.range(highest + 1).withColumnRenamed("id", "threshold")))
    verdict = F.when(F.col("layer") == "score", F.col("points") >= F.col("threshold")).otherwise(F.col("verdict"))
    rejected = F.coalesce(F.sum(F.when(~verdict, F.col("n"))), F.lit(0))
    return rows.groupBy("threshold").agg(rejected.alias("rejected"), F.coalesce(F.sum(F.when(~verdict & (F.col("truth") == 1), F.col("n"))), F.lit(0)).alias("fn"), F.round(100.0 * rejected / F.sum("n"), 2).alias("pct"))


def histogram(judged: DataFrame, value: str, split: str, *, width: int = 40) -> DataFrame:
    counts = judged.groupBy(value).agg(F.count("*").alias("n"), F.count_if(F.col(split)).alias("n_pass"))
    return counts.withColumn("top", F.max("n").over(Window.partitionBy())).select(value, "n", "n_pass", F.expr(f"repeat('#', cast(ceil(n * {width} / top) as int))").alias("bar"))


def median(df: DataFrame, value: str) -> DataFrame:
    """The middle value, or the mean of the two; values are counted, cut into ranges and summed up, so no task holds them all."""
    counts = written(df.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("v")).agg(F.count("*").alias("n")).repartitionByRange("v").withColumn("block", F.spark_partition_id()), "counts")
    before = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = counts.groupBy("block").agg(F.sum("n").alias("own")).select("block", F.coalesce(F.sum("own").over(before), F.lit(0)).alias("before"), F.sum("own").over(Window.partitionBy()).alias("all"))
    inside = F.sum("n").over(Window.partitionBy("block").orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
    rows = counts.join(F.broadcast(blocks), "block").select("v", (inside + F.col("before")).alias("running"), "all")
    low, high = F.floor((F.col("all") - 1) / 2), F.floor(F.col("all") / 2)
    return rows.agg(((F.min(F.when(F.col("running") > low, F.col("v"))) + F.min(F.when(F.col("running") > high, F.col("v")))) / 2).alias("median"))


def shares(df: DataFrame, column: str) -> DataFrame:
    counts = df.groupBy(column).agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 4))


def regression(df: DataFrame, x: str, y: str, by: str) -> DataFrame:
    """Slope, intercept and R2 per group; null under three points or without variance."""
    found = df.groupBy(by).agg(F.count("*").alias("n"), F.regr_slope(y, x).alias("s"), F.regr_intercept(y, x).alias("i"), F.regr_r2(y, x).alias("r"))
    return found.select(by, "n", *(F.round(F.when(F.col("n") >= 3, F.col(c)), 4).alias(name) for c, name in (("s", "slope"), ("i", "intercept"), ("r", "r2"))))


#: Stems of one automaton; all of them go to every task.
STEMS_AT_ONCE = 50_000
#: Names that go to every task at a time, with the numbers of their stems.
NAMES_AT_ONCE = 50_000


def missing_names(docs: DataFrame, names: DataFrame, *, text: str = "text", key: str = "item_id", stems: str = "stems", block: int = STEMS_AT_ONCE, together: int = NAMES_AT_ONCE) -> DataFrame:
    """For every name the documents, and those of them that lack one of its stems: all names against all documents.

    An automaton over all distinct stems reads a text once (one for each ``block`` of them), and
    the numbers of the stems that it holds are written.  Of a name's stems the rarest calls for
    the name: only where it is found are the others looked for among the text's stems.  Names go
    to the texts, ``together`` at a time; no text's stems are dealt out.  A null text or a
    name without stems is not missing.
    """
    ship(docs.sparkSession)
    rows = names.select(F.col(key).alias("key"), F.array_distinct(F.filter(F.coalesce(stems, F.array().cast("array<string>")), lambda x: x.isNotNull() & (x != ""))).alias("stems"))
    named = written(rows.withColumn("id", F.monotonically_increasing_id()), "names")
    low = docs.select(F.lower(text).alias("t"))
    known = [row["stem"] for row in named.select(F.explode("stems").alias("stem")).distinct().toLocalIterator()]
    blocks = [(known[k : k + block], k) for k in range(0, len(known), block)] or [([], 0)]
    found = written(low.where("t is not null").select(F.concat(*(parts_in(F.col("t"), x, k) for x, k in blocks)).alias("found")), "found")
    often = found.select(F.explode("found").alias("stem")).groupBy("stem").agg(F.count("*").alias("df"))
    numbers = docs.sparkSession.createDataFrame(list(enumerate(known)), "stem int, name string")
    rare = named.select("id", F.explode("stems").alias("name")).join(numbers, "name").join(often, "stem", "left")
    calls = rare.groupBy("id").agg(F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "stem")).alias("x"), F.collect_list("stem").alias("stems")).where("x.df > 0").select("id", "stems", F.col("x.stem").alias("stem"))
    calls = written(calls, "calls")
    parts = max(1, -(-calls.count() // together))
    whole = None
    for k in range(parts):
        called = F.broadcast(calls.where(F.pmod(F.xxhash64("id"), F.lit(parts)) == k))
        close = found.select("found", F.explode("found").alias("stem")).join(called, "stem")
        part = close.where(F.size(F.array_except("stems", "found")) == 0).groupBy("id").agg(F.count("*").alias("whole"))
        whole = part if whole is None else whole.unionAll(part)
    sizes = low.agg(F.count("*").alias("n_docs"), F.count("t").alias("texts")).where("n_docs > 0")
    # One row of sizes stands beside each name; names may have a key in common.
    missing = F.when(F.size("stems") == 0, 0).otherwise(F.col("texts") - F.coalesce("whole", F.lit(0)))
    each = named.join(whole, "id", "left").crossJoin(F.broadcast(sizes)).select(F.col("key").alias(key), "n_docs", missing.cast("long").alias("n_missing"))
    return each.groupBy(key).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_missing").alias("n_missing"))


def field_accuracy(rows: DataFrame, fields: list[str], *, by: str, expected: str = "expected", answer: str = "answer") -> DataFrame:
    """by, field, scored, right, accuracy, invented and missed: how often answers hold what was expected.

    Both are JSON objects.  A field that is absent from what was expected is not scored,
    so each field has its own denominator; null there means that nothing should be found.
    Values are compared in their normal form.  invented counts answers where nothing
    was expected, missed the other way round.  What is no JSON expects and answers nothing.
    """
    read = lambda c: F.coalesce(F.from_json(c, "map<string,string>"), F.create_map().cast("map<string,string>"))
    pairs = rows.select(by, read(F.col(expected)).alias("e"), read(F.col(answer)).alias("a")).select(by, F.explode(F.array_intersect(F.map_keys("e"), F.array(*map(F.lit, fields)))).alias("field"), "e", "a")
    plain = lambda m: F.nullif(normal(F.element_at(m, F.col("field"))), F.lit(""))
    said = pairs.select(by, "field", plain("e").alias("want"), plain("a").alias("got"))
    right = F.count_if(F.col("want").eqNullSafe(F.col("got")))
    counts = [F.count("*").alias("scored"), right.alias("right"), F.round(right / F.count("*"), 4).alias("accuracy"), F.count_if(F.col("want").isNull() & F.col("got").isNotNull()).alias("invented"), F.count_if(F.col("want").isNotNull() & F.col("got").isNull()).alias("missed")]
    return said.groupBy(by, "field").agg(*counts)
