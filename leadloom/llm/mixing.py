"""Mixing sources to target weights by hash thresholds.

Each source has a budget of words.  Whole repeats of the source come first; for
the rest, documents whose hash lies under the source's threshold are taken once
more.  Thresholds come from histograms: words are summed by source and hash
bucket, the bucket in which the budget ends is found, and only its documents are
looked at again in finer buckets.  No document is sorted.  Thresholds of growing
budgets nest: a larger mix holds all of a smaller one.

Null texts have no words, a null source is a source of its own (the last one).
Documents with equal ids and texts have equal hashes; at the threshold they share
what is left of the budget evenly, each giving its first words.  So does the one
document at the threshold otherwise, and taken words meet each budget but for
rounding.  An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import written
from .ranks import field, numbered

#: Hashes have 60 bits; a round looks at the next 12 of them.
HASH_BITS = 60
ROUND_BITS = 12
#: Weights by the sources' order, repeating; words of the mix by words there are; repeats of a source at most.
WEIGHTS = (3, 1, 2)
SHARE = 1.5
REPEATS = 2


def words(text: Column) -> Column:
    r"""The number of runs of characters other than \x20 and \x09-\x0D; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long"), F.lit(0).cast("long"))


def place(key: Column, text: Column, seed: str) -> Column:
    """60 bits that a document's id and text decide."""
    digest = F.md5(F.concat(F.lit(seed), field(key), F.coalesce(text, F.lit(""))).cast("binary"))
    return F.conv(F.substring(digest, 1, HASH_BITS // 4), 16, 10).cast("long")


def sized(docs: DataFrame, *, key: str = "doc_id", text: str = "text", source: str = "source", seed: str = "mix") -> DataFrame:
    """id, name (null sources: `0`, others with `1` before them), size and hash of every document: a written table without texts."""
    name = F.when(docs[source].isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), docs[source].cast("string")))
    body = docs[text].cast("string")
    return written(docs.select(docs[key].alias("id"), name.alias("name"), words(body).alias("size"), place(docs[key], body, seed).alias("hash")), "sized")


def targets(rows: DataFrame, *, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, repeats: int = REPEATS) -> DataFrame:
    """name, source_size and target of each source: a written table.

    Water filling: sources that a common level would take beyond their limit get
    the limit, the level rises for the others, until none is above.  A round is one
    aggregate; the driver holds the level alone.
    """
    sums = written(rows.groupBy("name").agg(F.sum("size").alias("source_size")), "sources")
    # Sources in order of code points, which is the order of their UTF-8 bytes; null last.
    ranked = numbered(sums.select("name", "source_size", F.lit("all").alias("all"), F.when(F.col("name") == "0", F.lit("2")).otherwise(F.col("name")).alias("order")), "all", ["order"], "ranked")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("idx") % len(weights)).cast("int") + 1)
    found = written(ranked.select("name", "source_size", weight.cast("long").alias("weight")), "weights")
    whole = share * (found.agg(F.sum("source_size")).first()[0] or 0)
    level, full = 0.0, -1
    while True:
        above = F.lit(repeats) * F.col("source_size") < F.lit(level) * F.col("weight")
        state = found.agg(F.sum(F.when(above, F.lit(repeats) * F.col("source_size")).otherwise(0)), F.sum(F.when(above, 0).otherwise(F.col("weight"))), F.sum(above.cast("long"))).first()
        if state[2] is None or state[2] == full or not state[1]:
            break
        full = state[2]
        level = (whole - state[0]) / state[1]
    target = F.least(F.lit(float(repeats)) * F.col("source_size"), F.lit(float(level)) * F.col("weight"))
    return written(found.select("name", "source_size", target.alias("target")), "targets")


def thresholds(rows: DataFrame, budgets: DataFrame) -> DataFrame:
    """name, threshold, rest and rest_size: documents under the threshold fit into ``extra`` words, those at it (rest_size words) share the rest.

    ``rows`` has name, size and hash; ``budgets`` name and extra.  A budget that no
    document ends (0, or all of the source) has no row.
    """
    inside = rows
    open_budgets = budgets.where("extra > 0").select("name", "extra")
    for shift in range(HASH_BITS - ROUND_BITS, -1, -ROUND_BITS):
        bucket = F.shiftright("hash", shift)
        sums = inside.groupBy("name", bucket.alias("bucket")).agg(F.sum("size").alias("in_bucket"))
        # At most 2 ** ROUND_BITS rows a source.
        under = Window.partitionBy("name").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
        summed = sums.withColumn("under", F.coalesce(F.sum("in_bucket").over(under), F.lit(0))).join(open_budgets.select("name", "extra"), "name")
        ends = summed.where("under < extra and under + in_bucket >= extra")
        open_budgets = written(ends.select("name", (F.col("extra") - F.col("under")).alias("extra"), F.col("bucket").alias("prefix"), "in_bucket"), f"budgets-{shift}")
        if shift:
            # One row a source: small enough tables are broadcast by their size on disk, others are joined by sorting, with hot sources split.
            inside = written(inside.join(open_budgets.select("name", "prefix"), "name").where(F.shiftright("hash", shift) == F.col("prefix")).drop("prefix"), f"inside-{shift}")
    return open_budgets.select("name", F.col("prefix").alias("threshold"), F.col("extra").alias("rest"), F.col("in_bucket").alias("rest_size"))


def mixed(docs: DataFrame, *, key: str = "doc_id", text: str = "text", source: str = "source", seed: str = "mix", weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, repeats: int = REPEATS) -> DataFrame:
    """key, size, source_size, target and taken (words) of every document."""
    rows = sized(docs, key=key, text=text, source=source, seed=seed)
    plan = targets(rows, weights=weights, share=share, repeats=repeats)
    want = F.round("target").cast("long")
    plan = plan.select("name", "source_size", "target", F.when(F.col("source_size") > 0, F.floor(want / F.col("source_size"))).otherwise(0).cast("long").alias("turns"))
    plan = plan.withColumn("extra", F.round("target").cast("long") - F.col("turns") * F.col("source_size"))
    budgets = written(plan, "plan")
    ends = thresholds(rows, budgets.select("name", "extra"))
    rule = written(budgets.join(ends, "name", "left"), "rule")
    part = F.floor(F.col("size").cast("decimal(38,0)") * F.col("rest") / F.col("rest_size")).cast("long")
    more = F.when(F.col("hash") < F.col("threshold"), F.col("size")).when((F.col("hash") == F.col("threshold")) & (F.col("rest_size") > 0), part).otherwise(0)
    return rows.join(rule, "name").select(F.col("id").alias(key), "size", "source_size", "target", (F.col("turns") * F.col("size") + more).cast("long").alias("taken"))


def repeated(docs: DataFrame, mix: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The mix itself: a row for each repeat of a document, with copy (from 0) and the text, cut behind its last word taken.

    ``key`` has to name one document each in ``docs``.
    """
    taken = mix.select(F.col(key).alias("k"), F.col("taken").alias("t"), F.col("size").alias("s")).where("t > 0")
    rows = docs.join(taken, docs[key] == F.col("k"))
    copies = F.explode(F.sequence(F.lit(0), (F.ceil(F.col("t") / F.col("s")) - 1).cast("int"))).alias("copy")
    opened = rows.select(*(docs[c] for c in docs.columns if c != text), docs[text].alias("whole"), "t", "s", copies)
    left = F.col("t") - F.col("copy") * F.col("s")
    pieces = F.regexp_extract_all("whole", F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0))
    return opened.select(*(c for c in docs.columns if c != text), "copy", F.when(left >= F.col("s"), F.col("whole")).otherwise(F.array_join(F.slice(pieces, 1, left.cast("int")), "")).alias(text))
