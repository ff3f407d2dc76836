"""Best-fit packing with large-item matching.

The plan is made on a histogram of lengths, which has at most ``capacity``
rows for any corpus: pieces above a third of the capacity are paired greedily
(a bin holds two of them at most), smaller ones go to the tightest gap that
holds them.  Bins with equal gaps are interchangeable, so the plan is a list of
runs, each for many bins at once.  Pieces find their place by their rank among
pieces of equal length.

Null texts are empty and give one piece of the end id.  Rows repeated in the
input are packed as often as they occur.  An empty table gives no rows.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import ship, written
from .tokens import encoder, text_blocks

#: Pieces of one length that are ranked in one task.
RANKED_TOGETHER = 50_000


def pieces(docs: DataFrame, tokenizer: str, *, capacity: int = 2048, end_id: int = 0, with_ids: bool = False, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Token pieces of at most ``capacity`` ids: doc_id, piece, start, length, ids_crc32 and, if asked, ids.

    Only a document of more tokens than ``capacity`` is cut; its first piece takes the remainder.
    """
    ship(docs.sparkSession)
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids

    def cut(batches):
        ids_of = encoder(tokenizer)
        for rows, offsets, data in text_blocks(batches):
            ids, bounds = ids_of.encode(data, offsets)
            out: list[list] = [[], [], [], [], [], []]
            names = rows.column(0).to_pylist()
            for k, name in enumerate(names):
                own = np.append(ids[bounds[k] : bounds[k + 1]], np.uint32(end_id)).astype("<u4")
                first = len(own) % capacity if len(own) > capacity else 0
                starts = [*([0] if first else []), *range(first, len(own), capacity)]
                for piece, (a, b) in enumerate(zip(starts, [*starts[1:], len(own)])):
                    for column, value in zip(out, (name, piece, a, b - a, zlib.crc32(own[a:b].tobytes()), own[a:b].astype(np.int32) if with_ids else None)):
                        column.append(value)
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()] + [pa.list_(pa.int32())] * with_ids
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, kinds)], ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids)

    return docs.select(docs[key].cast("long").alias("doc_id"), docs[text].cast("string").alias("text")).mapInArrow(cut, schema)


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Runs (length, first rank, pieces, pieces a bin, first bin, offset of the first piece) for a histogram."""
    left, used, runs = dict(counts), dict.fromkeys(counts, 0), []
    gaps: dict[int, list[list[int]]] = {}
    sizes: list[int] = []
    bins = 0

    def put(length: int, n: int, per_bin: int, first_bin: int, offset: int) -> None:
        runs.append((length, used[length], n, per_bin, first_bin, offset))
        used[length] += n
        left[length] -= n

    def free(gap: int, first_bin: int, n: int) -> None:
        if gap and n:
            if gap not in gaps:
                gaps[gap] = []
                insort(sizes, gap)
            gaps[gap].append([first_bin, n])

    large = sorted(x for x, n in counts.items() if 3 * x > capacity and n)
    while large:
        a = large[-1]
        n = left[a]
        at = bisect_right(large, min(a, capacity - a)) - 1
        if at >= 0 and large[at] == a and n == 1:
            at -= 1
        if at < 0:
            put(a, n, 1, bins, 0)
            free(capacity - a, bins, n)
            bins += n
        elif large[at] == a:
            pairs = n // 2
            put(a, 2 * pairs, 2, bins, 0)
            free(capacity - 2 * a, bins, pairs)
            bins += pairs
        else:
            b = large[at]
            pairs = min(n, left[b])
            put(a, pairs, 1, bins, 0)
            put(b, pairs, 1, bins, a)
            free(capacity - a - b, bins, pairs)
            bins += pairs
            if not left[b]:
                large.pop(at)
        if not left[a]:
            large.pop()
    for s in sorted((x for x, n in counts.items() if 3 * x <= capacity and n), reverse=True):
        while left[s]:
            at = bisect_left(sizes, s)
            if at == len(sizes):
                n = -(-left[s] // (capacity // s))
                free(capacity, bins, n)
                bins += n
                at = bisect_left(sizes, s)
            gap = sizes[at]
            first_bin, n = gaps[gap].pop()
            if not gaps[gap]:
                del gaps[gap]
                sizes.pop(at)
            per_bin = gap // s
            whole = min(n, left[s] // per_bin)
            if whole:
                put(s, whole * per_bin, per_bin, first_bin, capacity - gap)
                free(gap - per_bin * s, first_bin, whole)
            rest = left[s] if whole < n and left[s] < per_bin else 0
            if rest:
                put(s, rest, rest, first_bin + whole, capacity - gap)
                free(gap - rest * s, first_bin + whole, 1)
            free(gap, first_bin + whole + bool(rest), n - whole - bool(rest))
    return runs


def pack(items: DataFrame, *, capacity: int = 2048) -> DataFrame:
    """Adds sequence_id and offset to rows with a ``length`` of 1 to ``capacity``.

    ``items`` is read three times: pass a written table.
    """
    spark = items.sparkSession
    counts = {r["length"]: r["n"] for r in items.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    runs = plan(counts, capacity)
    groups = spark.createDataFrame([(x, -(-n // RANKED_TOGETHER)) for x, n in counts.items()], "length long, groups long")
    table = spark.createDataFrame(runs, "length long, run_first long, run_pieces long, per_bin long, first_bin long, run_offset long")
    # The caller's columns travel as one struct: no name of theirs can clash with ours.
    rows = items.select(F.struct(*(items[c] for c in items.columns)).alias("row"), items["length"].alias("length"))
    salted = rows.join(F.broadcast(groups), "length").withColumn("salt", F.pmod(F.xxhash64("row"), F.col("groups"))).drop("groups")
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    bases = salted.groupBy("length", "salt").agg(F.count("*").alias("n")).select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("length", "salt").orderBy("row")
    ranked = salted.withColumn("rank", F.row_number().over(within) - 1).join(bases, ["length", "salt"]).withColumn("rank", F.col("rank") + F.col("base"))
    placed = ranked.join(F.broadcast(table), "length").where("rank >= run_first and rank < run_first + run_pieces")
    step = F.col("rank") - F.col("run_first")
    return placed.select(
        "row.*",
        (F.col("first_bin") + F.floor(step / F.col("per_bin"))).cast("long").alias("sequence_id"),
        (F.col("run_offset") + (step % F.col("per_bin")) * F.col("length")).cast("long").alias("offset"),
    )


def packed_documents(docs: DataFrame, tokenizer: str, *, capacity: int = 2048) -> DataFrame:
    return pack(written(pieces(docs, tokenizer, capacity=capacity), "pieces"), capacity=capacity)
