"""Severity of toxic language by cumulative-link ordinal regression on sparse text features.

Features are hashed words (runs of letters, A-Z lowered) and word beginnings, one
for each that occurs.  One weight vector serves all thresholds: P(grade > k) is
the logistic function of the weighted sum less threshold k.  Labels say toxic
or not; grades 1 and 2 part the toxic labelled rows at the median of a score
that a two-grade model of the other half of the labels gives them, so no row's
grade comes from a model that saw the row.  The model is fitted on a bounded
sample of labelled rows and scores every whole text.

A null or empty text has no feature and gets the prior.  Repeated rows give
repeated results; an empty table gives no rows.  Without toxic labels every
severity is 0.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship, written
from .blocks import TO_LOWER, U, find_words, span_hashes
from .quality import labelled_sample
from .tokens import text_blocks

#: Labelled rows in the fit at most, hash buckets, features kept (those that mark toxic rows best), and rows that must have a feature.
LABELLED_ROWS, BUCKETS, FEATURES, LEAST_ROWS = 20_000, 1 << 20, 1024, 4
#: A feature's excess in toxic rows, in standard deviations and as a share of the strongest feature's.
LEAST_Z, LEAST_PART = 5.0, 0.2
STEPS, RATE, RIDGE = 1500, 0.3, 1e-5
#: Bytes of the word beginnings that are features beside whole words.
BEGINNINGS = (4, 5, 6)

#: Bytes that part words of letters: ASCII other than letters.
NOT_LETTER = np.ones(256, bool)
NOT_LETTER[65:91] = NOT_LETTER[97:123] = NOT_LETTER[128:] = False


@dataclass
class SeverityModel:
    """Buckets (sorted) and weights of features, and ascending thresholds between grades."""

    buckets: np.ndarray
    weights: np.ndarray
    cuts: np.ndarray

    def above(self, sums: np.ndarray) -> np.ndarray:
        """P(grade > k), a column for each threshold."""
        return 1 / (1 + np.exp(-(sums[:, None] - self.cuts[None, :])))


def document_features(data: np.ndarray, offsets: np.ndarray, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Owner and bucket of every distinct feature of a document (of those ``wanted``, a flag for each bucket), and each document's words."""
    start, stop, at = find_words(data, offsets, NOT_LETTER)
    lowered = TO_LOWER[data]
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(at))
    pairs = []
    for size in (None, *BEGINNINGS):
        long = slice(None) if size is None else stop - start > size
        a, b, who = start[long], stop[long] if size is None else start[long] + size, owner[long]
        bucket = (span_hashes(lowered, a, b, seed=size or 0) & U(BUCKETS - 1)).astype(np.int64)
        if wanted is not None:
            bucket, who = bucket[wanted[bucket]], who[wanted[bucket]]
        pairs.append(who * BUCKETS + bucket)
    found = np.unique(np.concatenate(pairs))
    return found // BUCKETS, found % BUCKETS, np.diff(at)


def flags(buckets: np.ndarray) -> np.ndarray:
    out = np.zeros(BUCKETS, bool)
    out[buckets] = True
    return out


def fit(docs: DataFrame, labels: DataFrame, *, rows: int = LABELLED_ROWS, text: str = "text", key: str = "doc_id") -> SeverityModel:
    ship(docs.sparkSession)
    sample = F.broadcast(labelled_sample(labels, "toxic", rows))
    marked = written(docs.select(docs[key].cast("long").alias("l_id"), docs[text].cast("string").alias("text")).join(sample, "l_id").withColumn("body", F.xxhash64("text", F.octet_length("text"))), "labelled")
    # Copies of one text count once: else their other words would mark toxicity.
    firsts = marked.groupBy("body").agg(F.min("l_id").alias("l_id"), F.max("label").alias("label"))  # as many as labelled rows
    marked = marked.drop("label").join(F.broadcast(firsts), ["body", "l_id"]).select("label", "text", F.pmod("body", F.lit(2)).cast("int").alias("half"))
    blank = SeverityModel(np.zeros(0, np.int64), np.zeros(0), np.array([50.0, 51.0]))

    def count(batches):
        seen = np.zeros((2, BUCKETS), np.int32)
        n = [0, 0]
        for rows_, offsets, data in text_blocks(batches):
            label = rows_.column(0).to_numpy()
            owner, bucket, _ = document_features(data, offsets)
            for k in (0, 1):
                seen[k] += np.bincount(bucket[label[owner] == k], minlength=BUCKETS).astype(np.int32)
                n[k] += int((label == k).sum())
        at = np.flatnonzero(seen.sum(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(seen[0][at], n[0]).astype(np.int64)), pa.array(np.append(seen[1][at], n[1]).astype(np.int64))], ["bucket", "clean", "toxic"])

    counts = marked.mapInArrow(count, "bucket long, clean long, toxic long").groupBy("bucket").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    total = counts.where("bucket = -1").collect()
    n0, n1 = (total[0]["clean"] or 0, total[0]["toxic"] or 0) if total else (0, 0)
    if not n0 or not n1:
        return blank
    share, p0, p1 = (F.col("clean") + F.col("toxic")) / F.lit(float(n0 + n1)), F.col("clean") / F.lit(float(n0)), F.col("toxic") / F.lit(float(n1))
    z = (p1 - p0) / F.sqrt(share * (1 - share) * F.lit(1.0 / n0 + 1.0 / n1) + F.lit(1e-12))
    ranked = counts.where((F.col("bucket") >= 0) & (F.col("clean") + F.col("toxic") >= LEAST_ROWS)).withColumn("z", z).where(F.col("z") >= LEAST_Z)
    top = ranked.orderBy(F.col("z").desc(), "bucket").limit(FEATURES).select("bucket", "z").collect()
    buckets = np.array(sorted(r["bucket"] for r in top if r["z"] >= LEAST_PART * top[0]["z"]), np.int64)
    if not len(buckets):
        return blank

    def rows_of(batches):
        wanted = flags(buckets)
        for rows_, offsets, data in text_blocks(batches):
            owner, bucket, _ = document_features(data, offsets, wanted)
            bounds = np.searchsorted(owner, np.arange(len(offsets)))
            features = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(np.searchsorted(buckets, bucket).astype(np.int32)))
            yield pa.RecordBatch.from_arrays([rows_.column(0), features, rows_.column(2)], ["label", "features", "half"])

    table = marked.mapInArrow(rows_of, "label int, features array<int>, half int")
    found = table.groupBy("label", "features", "half").agg(F.count("*").alias("n")).orderBy("label", "features", "half").collect()  # at most `rows` rows of at most FEATURES numbers
    return SeverityModel(buckets, *ordinal_fit([(r["label"], r["features"], r["half"], r["n"]) for r in found], len(buckets)))


def ordinal_fit(rows: list[tuple[int, list[int], int, int]], features: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights and two thresholds from rows (label, features, half, times).

    Toxic rows of each half get grade 2 where the other half's two-grade model
    scores them above its median, else grade 1.
    """
    label, half, times = (np.array([r[k] for r in rows]) for k in (0, 2, 3))
    marks = np.array([len(r[1]) for r in rows])
    owner = np.repeat(np.arange(len(rows)), marks)
    column = np.fromiter((c for r in rows for c in r[1]), np.int64, len(owner))
    grade = np.minimum(label, 1)
    for own in (0, 1):
        taught = half != own
        toxic = (half == own) & (label == 1)
        if not toxic.any() or not (taught & (label == 1)).any():
            continue
        weights, _ = climb(np.minimum(grade, 1), owner, column, times * taught, features, 1)
        sums = np.bincount(owner, weights[column], len(rows))
        grade[toxic & (sums > np.median(np.repeat(sums[toxic], times[toxic])))] = 2
    return climb(grade, owner, column, times, features, 2)


def climb(grade: np.ndarray, owner: np.ndarray, column: np.ndarray, times: np.ndarray, features: int, cuts: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights and so many ascending thresholds by adaptive gradient steps on the cumulative-link likelihood.

    ``owner`` and ``column`` list the features of the rows, ``times`` how often a row counts.
    """
    rows = len(grade)
    # Toxic rows are few: each side has the same say.
    weight = times * np.where(grade > 0, times[grade == 0].sum() / max(times[grade > 0].sum(), 1), 1.0)
    weight = weight / max(weight.sum(), 1e-12)
    w, free = np.zeros(features), np.zeros(cuts)  # thresholds: the first, then logarithms of the steps between them
    past = np.zeros(features + cuts)
    at = np.arange(rows)

    def thresholds() -> np.ndarray:
        return np.cumsum(np.concatenate([free[:1], np.exp(free[1:])]))

    for _ in range(STEPS):
        sums = np.bincount(owner, w[column], rows)
        above = np.concatenate([np.ones((rows, 1)), 1 / (1 + np.exp(-(sums[:, None] - thresholds()))), np.zeros((rows, 1))], axis=1)
        slope = above * (1 - above)
        p = np.maximum(above[at, grade] - above[at, grade + 1], 1e-12)
        upper, lower = slope[at, grade] / p, slope[at, grade + 1] / p
        d_sum = weight * (upper - lower)
        d_cut = np.array([float((weight * (np.where(grade == k, lower, 0) - np.where(grade == k + 1, upper, 0))).sum()) for k in range(cuts)])
        behind = np.cumsum(d_cut[::-1])[::-1]  # a threshold's step moves all behind it
        step = np.concatenate([np.bincount(column, d_sum[owner], features) - RIDGE * w, behind[:1], behind[1:] * np.exp(free[1:])])
        past += step * step
        step = RATE * step / np.sqrt(past + 1e-12)
        # Features mark toxicity, none speaks against it.
        w, free = np.maximum(w + step[:features], 0), free + step[features:]
    return w.round(9), thresholds().round(9)


def grade_documents(docs: DataFrame, model: SeverityModel, *, text: str = "text", key: str = "doc_id", carry: tuple[str, ...] = ()) -> DataFrame:
    """p_any and p_severe (the chances of a grade above 0 and above 1), expected_severity, grade and toxic, with the columns of ``carry``."""
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast((model.buckets, model.weights, model.cuts))
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema.fields}

    def work(batches):
        own = SeverityModel(*shared.value)
        wanted = flags(own.buckets)
        for rows, offsets, data in text_blocks(batches):
            owner, bucket, _ = document_features(data, offsets, wanted)
            sums = np.bincount(owner, own.weights[np.searchsorted(own.buckets, bucket)], len(offsets) - 1)
            above = own.above(sums).round(9)
            grade = (above >= 0.5).sum(axis=1)
            columns = [rows.column(0), pa.array(above[:, 0]), pa.array(above[:, 1]), pa.array(above.sum(axis=1).round(9)), pa.array(grade.astype(np.int32)), pa.array(grade > 0), *rows.columns[2:]]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "p_any", "p_severe", "expected_severity", "grade", "toxic", *(f"c_{k}" for k in range(len(carry)))])

    schema = ", ".join(["doc_id long, p_any double, p_severe double, expected_severity double, grade int, toxic boolean", *(f"c_{k} {kinds[c]}" for k, c in enumerate(carry))])
    rows = docs.select(docs[key].cast("long").alias("doc_id"), docs[text].cast("string").alias("text"), *(docs[c].alias(f"c_{k}") for k, c in enumerate(carry)))
    return rows.mapInArrow(work, schema)
