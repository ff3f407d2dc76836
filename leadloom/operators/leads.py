"""Operators over posts, groups and accounts: filters, plans, decisions, measurements and health."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..params import DEFAULT, Params
from ..session import written

#: Named presets of a list; each is a condition over km, direction, age in days and urgency.
PRESETS: dict[str, Callable[[], Column]] = {
    "near": lambda: F.col("km") <= 50,
    "today": lambda: F.col("age_days") < 1,
    "export": lambda: F.col("direction") == "export",
    "import": lambda: F.col("direction") == "import",
    "domestic": lambda: F.col("direction") == "domestic",
    "urgent": lambda: F.col("urgent"),
    "unplaced": lambda: F.col("km").isNull(),
    "all": lambda: F.lit(True),
}


def filtered(rows: DataFrame, **wanted) -> DataFrame:
    """Rows that meet every condition given: ``name`` equal, ``name_from`` and ``name_to`` bounds, ``name_any`` one of; None is no condition."""
    conditions = []
    for key, value in wanted.items():
        name, _, kind = key.rpartition("_")
        if value is None:
            continue
        if kind == "from" and name in rows.columns:
            conditions.append(F.col(name) >= value)
        elif kind == "to" and name in rows.columns:
            conditions.append(F.col(name) <= value)
        elif kind == "any" and name in rows.columns:
            conditions.append(F.col(name).isin(*value))
        else:
            conditions.append(F.col(key) == value)
    return rows.where(reduce(lambda a, b: a & b, conditions)) if conditions else rows


def preset_counts(rows: DataFrame) -> DataFrame:
    """preset and n for every preset, in one pass; unknown values meet no preset but all."""
    counts = rows.agg(*(F.count_if(F.coalesce(condition(), F.lit(False))).alias(name) for name, condition in PRESETS.items()))
    return counts.unpivot([], list(PRESETS), "preset", "n")


def stale(at: Column, now: Column, p: Params = DEFAULT) -> Column:
    """Older than the bound; an unknown date is fresh."""
    return F.coalesce(at < now - F.expr(f"INTERVAL {p.max_age_h} HOURS"), F.lit(False))


def backfill(rows: DataFrame, target: str, sources: list[str], newest: str, most: int) -> DataFrame:
    """The newest rows that lack ``target`` and have some source; ``most`` is the size of one run."""
    some = reduce(lambda a, b: a | b, [F.col(c).isNotNull() for c in sources])
    return rows.where(F.col(target).isNull() & some).orderBy(F.col(newest).desc_nulls_last(), *rows.columns).limit(most)


def patched(base: DataFrame, changes: DataFrame, key: str, *, status: str = "status", at: str = "status_at") -> DataFrame:
    """Base rows with what the changes set; a status that differs also sets its time (column ``now`` of the changes).

    Several changes of a key count as one: each column takes its latest value that is
    given, by ``now`` and then by value.  Nulls change nothing, unknown keys neither.
    """
    given = [c for c in changes.columns if c not in (key, "now")]
    latest = [F.max(F.when(F.col(c).isNotNull(), F.struct("now", F.col(c).alias("v")))).alias(f"_{c}") for c in given]
    joined = base.join(changes.groupBy(key).agg(*latest), key, "left")
    new = {c: F.col(f"_{c}.v") for c in given}
    moved = new[status].isNotNull() & ~new[status].eqNullSafe(F.col(status)) if status in new else F.lit(False)
    value = lambda c: F.when(moved, F.col(f"_{status}.now")).otherwise(F.coalesce(new[c], F.col(c)) if c in new else F.col(c)) if c == at and status in new else F.coalesce(new[c], F.col(c)) if c in new else F.col(c)
    return joined.select(*(value(c).alias(c) for c in base.columns))


def decision(direction: Column, gate: Column, is_stale: Column, model: Column) -> Column:
    """What becomes of a post: an offer and a reject end it, then age, then the model's verdict."""
    return F.when(direction == "offer", "offer").when(~gate, "gate").when(is_stale, "stale").when(model.isNull(), "no_answer").when(model, "order").otherwise("model")


def alert_step(duplicate: Column, crosspost: Column, paused: Column, animal: Column, direction: Column, confidence: Column, quiet: Column, sent_last_hour: Column, p: Params = DEFAULT) -> Column:
    """The first rung of the ladder that holds an alert back, or send; an hourly limit of 0 or less is none."""
    return (
        F.when(duplicate, "duplicate").when(crosspost, "crosspost").when(paused, "paused").when(animal, "animal").when(direction == "offer", "offer")
        .when(confidence < p.min_confidence, "confidence").when(quiet, "quiet").when(sent_last_hour >= p.alerts_per_hour if p.alerts_per_hour > 0 else F.lit(False), "limit").otherwise("send")
    )


#: Rungs whose held-back alerts are written down all the same.
KEPT_ON_RECORD = ("limit", "animal", "offer")


def interval_minutes(rate: Column, used_share: Column, path: Column, share: Column, p: Params = DEFAULT) -> Column:
    """Minutes to the next run of a group with ``rate`` posts an hour and ``share`` posts of the day's budget.

    While the budget has slack, or its use is known and low, the least.  On path A a
    run costs what is new, so it waits for one post; a silent group takes the least.
    On path B a run costs its whole limit, so as many runs a day as the share pays for,
    the longest wait if it pays for none.
    """
    least = F.when(path == "A", F.lit(float(p.min_interval))).otherwise(float(p.min_interval_b))
    cost = F.greatest(F.lit(float(p.posts_least)), F.ceil(rate * (least / 60.0) * p.posts_margin).cast("double"))
    runs = share / cost
    wanted = F.when(path == "A", F.when(rate > 0, 60.0 / rate).otherwise(least)).otherwise(F.when(runs >= 1.0, 1440.0 / runs).otherwise(float(p.max_interval)))
    formula = F.least(F.lit(float(p.max_interval)), F.greatest(least, F.bround(wanted)))
    return F.when(F.coalesce(used_share < p.budget_slack, F.lit(False)), p.min_interval).otherwise(formula).cast("int")


def run_size(rate: Column, minutes: Column, path: Column, p: Params = DEFAULT) -> tuple[Column, Column]:
    """(limit, window in minutes) of a group's run.

    The limit covers the window on path A and the wait on path B, with a margin, within
    bounds; a group without posts gets the limit for the unknown.
    """
    window = F.when(path == "A", F.greatest(minutes * p.window_factor, F.lit(p.window_least))).otherwise(1440).cast("int")
    most = F.when(path == "A", p.posts_most_a).otherwise(p.posts_most_b)
    hours = F.when(path == "A", window / 60.0).otherwise(minutes / 60.0)
    limit = F.least(most, F.greatest(F.lit(p.posts_least), F.ceil(rate * hours * p.posts_margin)))
    return F.when(rate <= 0, F.least(most, F.lit(p.posts_unknown))).otherwise(limit).cast("int"), window


def skip_reason(ready: Column, quarantined: Column, due: Column, budget_left: Column) -> Column:
    """Why a group is not in this run's plan; null where it is."""
    return F.when(~ready, "not ready").when(quarantined, "quarantined").when(~due, "not due").when(budget_left <= 0, "no budget")


def cost_model(rows: DataFrame, cost: str, items: str, seconds: str, margin: float = 0.15) -> DataFrame:
    """Which of two regressions explains cost: by items or by seconds.

    A fit with a negative intercept or of under three rows is out; the one by
    items stands unless the other is better by ``margin`` in R2.
    """

    def fit(x: str) -> list[Column]:
        return [F.regr_slope(cost, x).alias(f"slope_{x}"), F.regr_intercept(cost, x).alias(f"base_{x}"), F.regr_r2(cost, x).alias(f"r2_{x}")]

    found = rows.agg(F.count("*").alias("n"), *fit(items), *fit(seconds))
    sound = {x: (F.col("n") >= 3) & (F.col(f"base_{x}") >= 0) & F.col(f"r2_{x}").isNotNull() for x in (items, seconds)}
    better = F.col(f"r2_{seconds}") > F.col(f"r2_{items}") + margin
    return found.withColumn("model", F.when(sound[items] & ~(sound[seconds] & better), items).when(sound[seconds], seconds).otherwise("none"))


def best_date_field(rows: DataFrame, parsed: dict[str, Column]) -> DataFrame:
    """field and n: the field with most values that parse; the first of equals."""
    counts = rows.agg(*(F.count(c).alias(name) for name, c in parsed.items()))
    ranked = F.array_sort(F.array(*(F.struct((-F.col(name)).alias("n"), F.lit(k).alias("k"), F.lit(name).alias("field")) for k, name in enumerate(parsed))))
    return counts.select(F.element_at(ranked, 1).alias("x")).select("x.field", (-F.col("x.n")).alias("n"))


def ladder(first: list[tuple[Column, str]], otherwise: str) -> Column:
    """The first verdict whose condition holds."""
    out = F
    for condition, verdict in first:
        out = out.when(condition, verdict)
    return out.otherwise(otherwise)


def health(hours_since_run: Column, failed: Column, p: Params = DEFAULT) -> Column:
    """silent where a group never ran, not for long, or failed."""
    return F.coalesce(hours_since_run > p.max_age_h, F.lit(True)) | F.coalesce(failed, F.lit(False))


def balanced_owners(ranked: DataFrame, key: str, member: str) -> DataFrame:
    """One member a key and one key a member: in the order of keys, each takes its best member that is free.

    ``ranked`` has key, member and rank.  In rounds every key without a member
    asks its best one that has not turned it down, and a member stays with the
    least key that asked; this ends where the keys in turn would.  Keys beyond
    the pool get none.
    """
    open_ = written(ranked.select(key, member, "rank"), "ranked")
    while True:
        asks = open_.groupBy(key).agg(F.min_by(member, "rank").alias(member))
        now = written(asks.groupBy(member).agg(F.min(key).alias(key), F.count("*").alias("asked")), "held")
        # Where nobody was turned down, all keep what they hold.
        if now.where("asked > 1").limit(1).count() == 0:
            return now.select(key, member)
        # A member that holds a key turns down every later one for good.
        holder = now.select(member, F.col(key).alias("_holder"))
        open_ = written(open_.join(holder, member, "left").where(F.col("_holder").isNull() | (F.col(key) <= F.col("_holder"))).drop("_holder"), "ranked")


def soft_filter(values: Column, keep: Callable[[Column], Column]) -> Column:
    """Values that are kept, or all where none is."""
    some = F.filter(values, keep)
    return F.when(F.size(some) > 0, some).otherwise(values)


def candidates_folded(rows: DataFrame, *, least: int, url: str = "url", order: str = "at", members: str = "members", phrase: str = "phrase", name: str = "name") -> DataFrame:
    """One candidate a url, as a run in order would leave it: url, at, name, members, phrases, duplicates and too_small.

    A row with fewer members than ``least`` is dropped and forgotten, unless its url was
    accepted before; 0 members are unknown and pass.  Later rows of an accepted url count
    as duplicates, raise its members, and add their phrase behind a comma if the phrases
    so far don't hold it as a part.  Urls that are never accepted have no row.
    """
    count = F.coalesce(F.col(members), F.lit(0))
    known = rows.select(F.col(url).alias("url"), F.col(order).alias("at"), F.coalesce(F.col(name), F.lit("")).alias("name"), count.alias("members"), F.coalesce(F.col(phrase), F.lit("")).alias("phrase"), ((count > 0) & (count < least)).alias("small"))
    first = known.where("not small").groupBy("url").agg(F.min(F.struct("at", "name", "members", "phrase")).alias("first"))
    both = known.join(first, "url")
    later = F.struct("at", "name", "members", "phrase") > F.col("first")
    # A phrase is told of once, so what a url gathers is bounded by the phrases there are.
    said = both.where(later & (F.col("phrase") != "")).groupBy("url", "phrase").agg(F.min("at").alias("at")).groupBy("url").agg(F.array_sort(F.collect_list(F.struct("at", "phrase"))).alias("said"))
    counts = both.groupBy("url", "first").agg(F.max(F.when(later, F.col("members"))).alias("more"), F.count_if(later).alias("duplicates"), F.count_if(F.col("small") & (F.col("at") < F.col("first.at"))).alias("too_small"))
    merged = F.aggregate(F.coalesce("said", F.array().cast("array<struct<at:bigint,phrase:string>>")), F.col("first.phrase"), lambda acc, x: F.when(F.contains(acc, x["phrase"]), acc).otherwise(F.concat(acc, F.lit(", "), x["phrase"])))
    out = counts.join(said, "url", "left")
    return out.select(F.col("url").alias(url), F.col("first.at").alias("at"), F.col("first.name").alias("name"), F.greatest("first.members", "more").alias("members"), merged.alias("phrases"), "duplicates", "too_small")
