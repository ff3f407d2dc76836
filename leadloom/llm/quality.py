"""Quality rules: counts of a text's words and lines, and a hashed n-gram log-likelihood ratio.

The ratio compares a multinomial of trusted documents with one of the raw
corpus over hashed byte n-grams, divided by the number of n-grams.  The corpus
multinomial counts every document; the trusted one comes from a bounded sample
of labelled rows.  The threshold follows from the labelled scores by a fixed
rule, and every document is compared with it.

A null text has no words and fails.  Repeated rows give repeated results; an
empty table gives no rows.  Without labels of both kinds nothing is rejected by
the ratio.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship
from .blocks import IS_SEPARATOR, U, chained, find_words, span_hashes
from .tokens import text_blocks

#: Labelled rows that the model is fitted on, at most; those with the least hash of their id.
LABELLED_ROWS = 20_000
#: Hash buckets of n-grams, the length of an n-gram in bytes, and the count added to each bucket.
BUCKETS, GRAM, PRIOR = 1 << 16, 3, 0.5
#: The threshold lies so low that at most this share of trusted labelled documents is rejected.
TRUSTED_LOSS = 0.001

IS_SYMBOL = np.zeros(256, bool)
IS_SYMBOL[list(b"#*$%&|<>")] = True
WINDOW = 8


def repeats(keys: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """True where another entry of the same owner has the same key."""
    order = np.lexsort((keys, owner))
    k, o = keys[order], owner[order]
    same = np.zeros(len(k) + 1, bool)
    same[1:-1] = (k[1:] == k[:-1]) & (o[1:] == o[:-1])
    out = np.empty(len(k), bool)
    out[order] = same[1:] | same[:-1]
    return out


def text_counts(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of each document of a block."""
    docs = len(offsets) - 1
    start, stop, at = find_words(data, offsets)

    def per_document(flags: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
        return total[offsets[1:]] - total[offsets[:-1]]

    out = {"n_words": np.diff(at), "word_chars": per_document(~IS_SEPARATOR[data] & ((data & 0xC0) != 0x80)), "n_symbols": per_document(IS_SYMBOL[data])}

    breaks = np.flatnonzero(data == 10)
    line_start = np.unique(np.concatenate([offsets[:-1][offsets[:-1] < len(data)], breaks + 1]))
    line_start = line_start[line_start < len(data)]
    owner = np.searchsorted(offsets, line_start, "right") - 1
    line_stop = np.append(line_start[1:], len(data))
    line_stop = line_stop - (data[line_stop - 1] == 10) if len(line_start) else line_stop
    has_word = np.searchsorted(start, line_stop) > np.searchsorted(start, line_start)
    a, b, owner = line_start[has_word], line_stop[has_word], owner[has_word]
    lines = span_hashes(data, a, b)
    pairs = np.unique(np.stack([owner.astype(U), lines]), axis=1) if len(lines) else np.zeros((2, 0), U)
    out["n_dup_lines"] = np.bincount(owner, minlength=docs) - np.bincount(pairs[0].astype(np.int64), minlength=docs)

    words = span_hashes(data, start, stop)
    grams = chained(words, WINDOW)
    place = np.arange(len(grams))
    owner = np.repeat(np.arange(docs), np.diff(at))
    inside = owner[place] == owner[place + WINDOW - 1] if len(grams) else np.zeros(0, bool)
    place, grams = place[inside], grams[inside]
    twice = place[repeats(grams, owner[place])]
    cover = np.zeros(len(words) + 1, np.int64)
    np.add.at(cover, twice, 1)
    np.add.at(cover, twice + WINDOW, -1)
    covered = np.concatenate([[0], np.cumsum(np.cumsum(cover[:-1]) > 0)])
    out["n_repeat_words"] = covered[at[1:]] - covered[at[:-1]]
    return out


def gram_buckets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of every n-gram within a document, and the documents' bounds among them."""
    n = len(data) - GRAM + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    code = np.zeros(n, np.uint32)
    for k in range(GRAM):
        code = (code << np.uint32(8)) | data[k : k + n]
    bucket = ((code * np.uint32(0x9E3779B1)) >> np.uint32(32 - BUCKETS.bit_length() + 1)).astype(np.int64)
    inside = np.ones(n, bool)
    for k in range(1, GRAM):
        cut = offsets[1:-1] - k
        inside[cut[(cut >= 0) & (cut < n)]] = False
    bounds = np.concatenate([[0], np.cumsum(inside)])[np.clip(offsets, 0, n)]
    return bucket[inside], bounds


@dataclass
class QualityModel:
    ratio: np.ndarray
    threshold: float

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        bucket, bounds = gram_buckets(data, offsets)
        total = np.concatenate([[0.0], np.cumsum(self.ratio[bucket])])
        n = np.diff(bounds)
        return np.where(n > 0, (total[bounds[1:]] - total[bounds[:-1]]) / np.maximum(n, 1), 0.0).round(9)


def labelled_sample(labels: DataFrame, column: str, rows: int) -> DataFrame:
    """At most ``rows`` labelled ids, one row an id (the largest label where they differ), chosen by hash."""
    ids = labels.where(F.col("doc_id").isNotNull() & F.col(column).isNotNull()).groupBy(F.col("doc_id").cast("long").alias("l_id")).agg(F.max(F.col(column).cast("int")).alias("label"))
    return ids.orderBy(F.xxhash64("l_id"), "l_id").limit(rows)


def fit(docs: DataFrame, labels: DataFrame, *, rows: int = LABELLED_ROWS, text: str = "text", key: str = "doc_id") -> QualityModel:
    ship(docs.sparkSession)
    sample = F.broadcast(labelled_sample(labels, "quality", rows))
    marked = docs.select(docs[key].cast("long").alias("l_id"), docs[text].cast("string").alias("text")).join(sample, "l_id", "left").select("label", "text")

    def count(batches):
        seen = np.zeros((2, BUCKETS), np.int64)
        for rows_, offsets, data in text_blocks(batches):
            bucket, bounds = gram_buckets(data, offsets)
            seen[0] += np.bincount(bucket, minlength=BUCKETS)
            trusted = np.repeat(rows_.column(0).fill_null(0).to_numpy() == 1, np.diff(bounds))
            seen[1] += np.bincount(bucket[trusted], minlength=BUCKETS)
        at = np.flatnonzero(seen[0])
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(seen[0][at]), pa.array(seen[1][at])], ["bucket", "raw", "trusted"])

    found = marked.mapInArrow(count, "bucket long, raw long, trusted long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("trusted").alias("trusted")).collect()  # at most BUCKETS rows
    counts = np.zeros((2, BUCKETS))
    for r in found:
        counts[:, r["bucket"]] = r["raw"], r["trusted"]
    logs = np.log(counts + PRIOR) - np.log(counts.sum(axis=1, keepdims=True) + PRIOR * BUCKETS)
    model = QualityModel(logs[1] - logs[0], -np.inf)
    if not counts[1].any():
        return model
    ratio = docs.sparkSession.sparkContext.broadcast(model.ratio)

    def score(batches):
        own = QualityModel(ratio.value, 0.0)
        for rows_, offsets, data in text_blocks(batches):
            yield pa.RecordBatch.from_arrays([rows_.column(0), pa.array(own.scores(data, offsets))], ["label", "score"])

    scored = marked.where("label is not null").mapInArrow(score, "label int, score double").groupBy("label", F.round("score", 4).alias("score")).agg(F.count("*").alias("n"))
    return QualityModel(model.ratio, threshold([(r["label"], r["score"], r["n"]) for r in scored.collect()]))


def threshold(scored: list[tuple[int, float, int]]) -> float:
    """The score that parts labels best (most rejected bad less rejected trusted, as shares), or a lower one where it would reject more trusted documents than TRUSTED_LOSS."""
    good, bad = (sum(n for label, _, n in scored if (label == 1) == kind) for kind in (True, False))
    if not good or not bad:
        return -np.inf
    at_score: dict[float, list[int]] = {}
    for label, score, n in scored:
        at_score.setdefault(score, [0, 0])[label != 1] += n
    best, at, lost, caught = 0.0, -np.inf, 0, 0
    for value, (trusted, other) in sorted(at_score.items()):
        if lost > TRUSTED_LOSS * good:
            break
        if caught / bad - lost / good > best:
            best, at = caught / bad - lost / good, value - 0.00005
        lost, caught = lost + trusted, caught + other
    return at


def assess(docs: DataFrame, model: QualityModel, *, text: str = "text", key: str = "doc_id", carry: tuple[str, ...] = ()) -> DataFrame:
    """The five counts, base_failed, score and kept of every document, with the columns named in ``carry`` behind them."""
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast((model.ratio, model.threshold))
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def work(batches):
        own = QualityModel(*shared.value)
        for rows, offsets, data in text_blocks(batches):
            counts = text_counts(data, offsets)
            scores = own.scores(data, offsets)
            failed = (counts["n_words"] < 20) | (100 * counts["n_repeat_words"] > 30 * counts["n_words"])
            columns = [rows.column(0), *(pa.array(counts[n].astype(np.int64)) for n in names), pa.array(failed), pa.array(scores), pa.array(~failed & (scores >= own.threshold)), *rows.columns[2:]]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", *names, "base_failed", "score", "kept", *(f"c_{k}" for k in range(len(carry)))])

    schema = ", ".join(["doc_id long", *(f"{n} long" for n in names), "base_failed boolean, score double, kept boolean", *(f"c_{k} {kinds[c]}" for k, c in enumerate(carry))])
    rows = docs.select(docs[key].cast("long").alias("doc_id"), docs[text].cast("string").alias("text"), *(docs[c].alias(f"c_{k}") for k, c in enumerate(carry)))
    return rows.mapInArrow(work, schema)
