"""Language-model scores from a log-frequency Bloom filter of quantised bigram counts.

Counts of bigrams and of the distinct words behind each word are quantised to
levels on a logarithmic scale; a gram of level j enters the filter once for
each level up to j.  Its level is read back by probing levels until one is
missing, and stands for its least count, so that the chances behind a word sum
to at most 1.  Word counts are exact.  A word's chance is

    p(w | v) = max(c(v w) - d, 0) / c(v) + d * t(v) / c(v) * p(w)

with the discount d from the numbers of bigrams seen once and twice, t(v) the
distinct words behind v, and p(w) the smoothed share of w.

The filter is built in segments by the hash of the first word, each by one
group; bigrams behind a heavy word are dealt over the segments by their own
hash.  Filter and words are broadcast while they are no larger than stated
bounds.  Beyond those the probes travel to the segments instead, with the same
result: a block of documents sends a segment its distinct bigrams as one row
of packed numbers and gets their levels, and the counts of their first words,
as another.  Every word but the end is the first of some bigram of its block,
so no word is looked up by itself.

A null or empty text has the end token alone.  Repeated rows count as often as
they occur and get equal scores.  An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import releasing, ship, written
from .blocks import BASE, U, column_bytes, mix, word_hashes
from .tokens import text_blocks

#: Base of the quantisation, bits of filter for an entry, probes within a 64-bit word, and entries in a segment, about.
LOG_BASE, ENTRY_BITS, BITS_SET, SEGMENT_ENTRIES = 1.5, 10, 4, 1 << 19
#: Tasks that build segments at most; each builds its segments in turn.
MOST_TASKS = 20_000
#: Tokens in a block of documents, about; occurrences from which a word is heavy; parts that documents are scored in where probes travel, and blocks that a task scores then.
BLOCK_TOKENS, HEAVY, PARTS, SETTLED = 1 << 20, 1 << 20, 4, 16
#: Largest filter that is broadcast, and most words.
BROADCAST_BYTES, BROADCAST_WORDS = 128 << 20, 400_000
#: Rows that Parquet's reader takes at a time.
READ_ROWS = "spark.sql.parquet.columnarReaderBatchSize"
#: The token behind each text's last word, and the mark of counts of distinct followers.
END = U(0x5851F42D4C957F2D)
FOLLOWERS = U(0x14057B7EF767814F)


def token_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every token, ends among them, and the documents' bounds."""
    words, at = word_hashes(data, offsets, lower=True)
    docs = len(offsets) - 1
    bounds = at + np.arange(docs + 1)
    out = np.empty(int(bounds[-1]), U)
    out[bounds[1:] - 1] = END
    out[np.arange(len(words)) + np.repeat(np.arange(docs), np.diff(at))] = words
    return out, bounds


def token_blocks(batches, most: int = BLOCK_TOKENS) -> Iterator[tuple[list[pa.RecordBatch], np.ndarray, np.ndarray]]:
    """Documents of about ``most`` tokens: their rows, tokens and bounds."""
    parts, held, ends, n = [], [], [np.zeros(1, np.int64)], 0
    for part, offsets, data in text_blocks(batches):
        tokens, bounds = token_hashes(data, offsets)
        parts.append(part), held.append(tokens), ends.append(bounds[1:] + n)
        n += len(tokens)
        if n >= most:
            yield parts, np.concatenate(held), np.concatenate(ends)
            parts, held, ends, n = [], [], [np.zeros(1, np.int64)], 0
    if parts:
        yield parts, np.concatenate(held), np.concatenate(ends)


def distinct(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values, sorted, and which of them each one is."""
    order = np.argsort(values)
    ranked = values[order]
    new = np.ones(len(values), bool)
    new[1:] = ranked[1:] != ranked[:-1]
    which = np.empty(len(values), np.int64)
    which[order] = np.cumsum(new) - 1
    return ranked[new], which


def chained_places(bounds: np.ndarray) -> np.ndarray:
    """Places of the tokens that have one before them in their document."""
    inside = np.ones(int(bounds[-1]), bool)
    inside[bounds[:-1]] = False
    return np.flatnonzero(inside)


def number_in(values: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each value is in a sorted table, and its number there."""
    if not len(table):
        return np.zeros(len(values), bool), np.zeros(len(values), np.int64)
    at = np.minimum(np.searchsorted(table, values), len(table) - 1)
    return table[at] == values, at


def segment_of(heads: np.ndarray, pairs: np.ndarray, segments: int, heavy: np.ndarray) -> np.ndarray:
    """Segment of each bigram: by its first word, but by itself behind a heavy word."""
    return ((np.where(number_in(heads, heavy)[0], pairs, heads) >> U(1)) % U(segments)).astype(np.int64)


def arranged(codes: np.ndarray, words: np.ndarray, segments: int, heavy: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The order by segment and first word of bigrams given as sorted numbers, and in this order their first words' numbers, keys and segments."""
    head, follower = np.divmod(codes, max(len(words), 1))
    pairs = mix(words[head] * BASE + words[follower])
    segment = segment_of(words[head], pairs, segments, heavy)
    order = np.argsort(segment.astype(np.uint16) if segments <= 1 << 16 else segment, kind="stable")
    return order, head[order], pairs[order], segment[order]


def packed(values: np.ndarray, cuts: np.ndarray) -> pa.Array:
    """Rows that hold the bytes of the values between cuts."""
    return pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer((cuts * values.itemsize).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))])


def unpacked(column: pa.ChunkedArray, kind) -> np.ndarray:
    """The values of all rows, one after another."""
    return np.concatenate([column_bytes(c)[1].view(kind) for c in column.chunks] or [np.zeros(0, kind)])


def packed_requests(head: np.ndarray, words: np.ndarray, pairs: np.ndarray, segment: np.ndarray) -> tuple[np.ndarray, list[pa.Array], np.ndarray, np.ndarray, np.ndarray]:
    """A row a segment with its first words, the number of bigrams behind each, and the bigrams; where rows begin, and the runs' words and lengths."""
    new = np.ones(len(head), bool)
    new[1:] = (head[1:] != head[:-1]) | (segment[1:] != segment[:-1])
    starts = np.flatnonzero(new)
    length = np.diff(np.append(starts, len(head)))
    names, first = np.unique(segment, return_index=True)
    cuts = np.append(first, len(head))
    run_cuts = np.append(np.searchsorted(starts, first), len(starts))
    columns = [pa.array(names), packed(words[head[starts]], run_cuts), packed(length.astype(np.uint32), run_cuts), packed(pairs, cuts)]
    return cuts, columns, head[starts], length, run_cuts


def level(count: np.ndarray) -> np.ndarray:
    return 1 + np.floor(np.log(np.maximum(count, 1)) / np.log(LOG_BASE) + 1e-9).astype(np.int64)


#: Least count of each level, from 0 on.
LEVEL_COUNT = np.concatenate([[0.0], np.ceil(LOG_BASE ** np.arange(0, 105) - 1e-9)])


def entry_words(keys: np.ndarray, levels: np.ndarray | int, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Word and bits of the entries (key, level) in a filter of so many 64-bit words."""
    h = mix(keys + np.asarray(levels).astype(U) * U(0x9E3779B97F4A7C15))
    bits = np.zeros(len(keys), U)
    for k in range(BITS_SET):
        bits |= U(1) << ((h >> U(6 * k)) & U(63))
    return (((h >> U(32)) * U(words)) >> U(32)).astype(np.int64), bits


def probe(keys: np.ndarray, segment: np.ndarray, filters: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Level of each key: levels are probed until one is missing."""
    out = np.zeros(len(keys), np.int64)
    live, sizes = np.arange(len(keys)), np.diff(starts)
    while len(live):
        own = segment[live]
        h = mix(keys[live] + (out[live] + 1).astype(U) * U(0x9E3779B97F4A7C15))
        bits = np.zeros(len(live), U)
        for k in range(BITS_SET):
            bits |= U(1) << ((h >> U(6 * k)) & U(63))
        word = (((h >> U(32)) * sizes[own].astype(U)) >> U(32)).astype(np.int64)
        seen = (filters[starts[own] + word] & bits) == bits
        live = live[seen]
        out[live] += 1
        live = live[out[live] < len(LEVEL_COUNT) - 1]
    return out


@dataclass
class Model:
    """Training totals, the discount, segments (a table of segment, bits, and first words with their counts), their number and bytes, word counts, and heavy words (sorted) with counts and levels of followers."""

    total: int
    distinct: int
    discount: float
    segments: int
    bytes: int
    filters: DataFrame
    words: DataFrame
    heavy: tuple[np.ndarray, np.ndarray, np.ndarray]


def training(docs: DataFrame, key: str) -> DataFrame:
    return docs.where(F.pmod(F.crc32(F.coalesce(docs[key].cast("long").cast("string"), F.lit("")).cast("binary")), F.lit(5)) != 1)


def filter_of(keys: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Bits of a segment with these keys and counts."""
    levels = level(n)
    entries = int(levels.sum())
    size = max(1, -(-entries * ENTRY_BITS // 64))
    bits = np.zeros(size, U)
    keys, depth = np.repeat(keys, levels), np.arange(entries) - np.repeat(np.cumsum(levels) - levels, levels) + 1
    at, own = entry_words(keys, depth, size)
    order = np.argsort(at)
    at, own = at[order], own[order]
    first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]]) if len(at) else np.zeros(0, np.int64)
    if len(first):
        bits[at[first]] = np.bitwise_or.reduceat(own, first)
    return bits


def tasks(spark, groups: int) -> int:
    return min(max(groups, int(spark.conf.get("spark.sql.shuffle.partitions"))), MOST_TASKS)


def fit(docs: DataFrame, *, text: str = "text", key: str = "doc_id", segment_entries: int = SEGMENT_ENTRIES, heavy: int = HEAVY) -> Model:
    """Count words and bigrams of the training documents and build the filter."""
    spark = docs.sparkSession
    ship(spark)
    texts = training(docs, key).select(docs[text].cast("string").alias("text"))

    def count_words(batches):
        for _, tokens, _ in token_blocks(batches):
            tokens = np.sort(tokens)
            first = np.flatnonzero(np.r_[True, tokens[1:] != tokens[:-1]])
            yield pa.RecordBatch.from_arrays([pa.array(tokens[first].view(np.int64)), pa.array(np.diff(np.append(first, len(tokens))))], ["word", "n"])

    words = written(texts.mapInArrow(count_words, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")), "words")
    total, distinct_words = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    # There are at most as many bigrams as tokens: segments of bounded size for any corpus.
    segments = max(1, -(-total // segment_entries))
    # At most one word in ``heavy`` tokens, and the end, whose count no bigram tells.
    often = sorted((r["word"] % 2**64, r["n"]) for r in words.where((F.col("n") >= heavy) | (F.col("word") == F.lit(int(END.astype(np.int64))))).collect())
    many, many_n = np.array([w for w, _ in often], U), np.array([n for _, n in often], np.int64)

    def count_pairs(batches):
        for _, tokens, bounds in token_blocks(batches):
            own_words, own = distinct(tokens)
            place = chained_places(bounds)
            if not len(place):
                continue
            codes = np.sort(own[place - 1] * len(own_words) + own[place])
            first = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]])
            n = np.diff(np.append(first, len(codes))).astype(np.uint32)
            order, head, pairs, segment = arranged(codes[first], own_words, segments, many)
            cuts, columns, *_ = packed_requests(head, own_words, pairs, segment)
            yield pa.RecordBatch.from_arrays([*columns, packed(n[order], cuts)], ["segment", "heads", "runs", "pairs", "n"])

    def build(key, rows):
        """Bits of a segment, its first words and their counts, and counts that later steps need."""
        heads = np.repeat(unpacked(rows.column("heads"), U), unpacked(rows.column("runs"), np.uint32))
        pairs, n = unpacked(rows.column("pairs"), U), unpacked(rows.column("n"), np.uint32).astype(np.int64)
        order = np.argsort(pairs)
        pairs = pairs[order]
        first = np.flatnonzero(np.r_[True, pairs[1:] != pairs[:-1]])
        pairs, n, heads = pairs[first], np.add.reduceat(n[order], first), heads[order][first]
        own_words, own = distinct(heads)
        behind, count = np.bincount(own), np.bincount(own, n).astype(np.int64)
        apart = number_in(own_words, many)[0]
        light = own_words[~apart]
        bits = filter_of(np.concatenate([pairs, mix(light + FOLLOWERS)]), np.concatenate([n, behind[~apart]]))
        parts = [{"word": w, "n": k} for w, k in zip(own_words[apart].view(np.int64).tolist(), behind[apart].tolist())]
        return pa.table(
            {
                "segment": pa.array([key[0].as_py()], pa.int64()), "bits": pa.array([bits.tobytes()], pa.binary()), "heads": pa.array([light.tobytes()], pa.binary()), "counts": pa.array([count[~apart].tobytes()], pa.binary()),
                "parts": pa.array([parts], pa.list_(pa.struct([("word", pa.int64()), ("n", pa.int64())]))), "once": pa.array([int((n == 1).sum())], pa.int64()), "twice": pa.array([int((n == 2).sum())], pa.int64()),
            }
        )

    counted = texts.mapInArrow(count_pairs, "segment long, heads binary, runs binary, pairs binary, n binary").repartition(tasks(spark, segments), "segment")
    filters = written(counted.groupBy("segment").applyInArrow(build, "segment long, bits binary, heads binary, counts binary, parts array<struct<word: bigint, n: bigint>>, once long, twice long"), "segments")
    once, twice, size = filters.agg(*(F.coalesce(F.sum(x), F.lit(0)) for x in (F.col("once"), F.col("twice"), F.octet_length("bits").cast("long")))).first()
    # A row for each heavy word.
    behind = {r["word"] % 2**64: r["n"] for r in filters.select(F.explode("parts").alias("x")).groupBy("x.word").agg(F.sum("x.n").alias("n")).collect()}
    followers = np.array([behind.get(w, 0) for w, _ in often], np.int64)
    return Model(int(total), int(distinct_words), once / (once + 2 * twice) if once else 0.5, segments, int(size), filters.select("segment", "bits", "heads", "counts"), words, (many, many_n, np.where(followers > 0, level(followers), 0)))


def chance_of(share, pair_level, follow_level, before_count, discount: float):
    """A token's chance behind another one, from its share, the two levels read and the count of the one before."""
    c = LEVEL_COUNT[pair_level]
    d = min(discount, 1.0)
    seen = np.maximum(before_count, np.maximum(c, 1))
    rest = np.minimum(1.0, d * LEVEL_COUNT[follow_level] / seen)
    mixed = np.minimum(np.maximum(c - d, 0) / seen, 1 - rest) + rest * share
    return np.where((before_count > 0) & (follow_level > 0), mixed, share)


@dataclass
class Block:
    """Documents of a task: distinct words, each token's word, and for each place with a token before it its bigram, in the order of segments."""

    words: np.ndarray
    own: np.ndarray
    place: np.ndarray
    which: np.ndarray
    head: np.ndarray
    pairs: np.ndarray
    segment: np.ndarray


def block_of(tokens: np.ndarray, bounds: np.ndarray, segments: int, heavy: np.ndarray) -> Block:
    words, own = distinct(tokens)
    place = chained_places(bounds)
    codes, which = distinct(own[place - 1] * len(words) + own[place])
    order, head, pairs, segment = arranged(codes, words, segments, heavy)
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    return Block(words, own, place, rank[which], head, pairs, segment)


def ids_of(parts: list[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray]:
    """Ids (null: 0), and flags: 1 for held out, 2 for a null id."""
    flags = [p.column(2).to_numpy(zero_copy_only=False).astype(np.uint8) + p.column(0).is_null().to_numpy(zero_copy_only=False).astype(np.uint8) * np.uint8(2) for p in parts]
    return np.concatenate([p.column(0).fill_null(0).to_numpy() for p in parts]), np.concatenate(flags)


@contextmanager
def few_rows_at_once(spark):
    """Rows of packed numbers are large: Parquet's reader takes 64 of them at a time."""
    before = spark.conf.get(READ_ROWS)
    spark.conf.set(READ_ROWS, "64")
    try:
        yield
    finally:
        spark.conf.set(READ_ROWS, before)


def score(docs: DataFrame, model: Model, *, text: str = "text", key: str = "doc_id", segment_entries: int = SEGMENT_ENTRIES, broadcast_bytes: int = BROADCAST_BYTES, broadcast_words: int = BROADCAST_WORDS, parts: int = PARTS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every document."""
    spark = docs.sparkSession
    ship(spark)
    total, distinct_words, discount, segments = model.total, model.distinct, model.discount, model.segments
    heavy, heavy_count, heavy_behind = model.heavy
    held = F.pmod(F.crc32(F.coalesce(docs[key].cast("long").cast("string"), F.lit("")).cast("binary")), F.lit(5)) == 1
    rows = docs.select(docs[key].cast("long").alias("doc_id"), docs[text].cast("string").alias("text"), held.alias("held_out"))

    def result(ids, flags, bounds, own, place, which, head, count, behind, levels):
        """Result rows of documents, from each word's count and level of followers and each bigram's level."""
        share = (count + 0.5) / (total + 0.5 * (distinct_words + 1))
        follower = np.zeros(len(head), np.int64)
        follower[which] = own[place]
        base = np.log10(share)[own]
        chance = base.copy()
        chance[place] = np.log10(chance_of(share[follower], levels, behind[head], count[head], discount))[which]
        sums = [np.add.reduceat(x, bounds[:-1]) for x in ((count > 0).astype(np.int64)[own], base, chance)]  # every document has its end
        columns = [pa.array(ids, mask=flags > 1), pa.array((flags & 1).astype(bool)), pa.array(np.diff(bounds)), pa.array(sums[0]), pa.array(np.full(len(ids), total, np.int64)), pa.array(sums[1]), pa.array(sums[2])]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    if model.bytes <= broadcast_bytes and distinct_words <= broadcast_words:
        # At most broadcast_bytes, fetched a partition at a time into one array.  A segment that got no entry still has a word without bits.
        sizes = np.ones(segments, np.int64)
        for r in model.filters.select("segment", (F.octet_length("bits") / 8).cast("long").alias("n")).collect():  # broadcast_bytes bounds the segments too
            sizes[r["segment"]] = r["n"]
        starts = np.concatenate([[0], np.cumsum(sizes)])
        bits = np.zeros(int(starts[-1]), U)
        for r in model.filters.select("segment", "bits").toLocalIterator():
            bits[starts[r["segment"]] : starts[r["segment"] + 1]] = np.frombuffer(r["bits"], U)
        found = model.words.toArrow().combine_chunks()  # at most broadcast_words
        known, n = (np.concatenate([c.to_numpy() for c in found.column(k).chunks] or [np.zeros(0, np.int64)]) for k in ("word", "n"))
        order = np.argsort(known.view(U))
        table = spark.sparkContext.broadcast((known.view(U)[order], n[order], bits, starts))

        def whole(batches):
            known, n, bits, starts = table.value
            for part, tokens, bounds in token_blocks(batches):
                b = block_of(tokens, bounds, segments, heavy)
                hit, at = number_in(b.words, known)
                count = np.where(hit, n[at], 0) if len(n) else np.zeros(len(b.words), np.int64)
                behind = probe(mix(b.words + FOLLOWERS), segment_of(b.words, b.words, segments, heavy[:0]), bits, starts)
                apart, at = number_in(b.words, heavy)
                behind[apart] = heavy_behind[at[apart]]
                yield result(*ids_of(part), bounds, b.own, b.place, b.which, b.head, count, behind, probe(b.pairs, b.segment, bits, starts))

        return rows.mapInArrow(whole, RESULT)

    def requests(batches):
        """A row for each segment that a block asks, and one with what the block keeps, whose segment is null."""
        from pyspark import TaskContext

        serial = TaskContext.get().partitionId() << 32
        for part, tokens, bounds in token_blocks(batches):
            b = block_of(tokens, bounds, segments, heavy)
            apart, at = number_in(b.words, heavy)
            _, columns, run_word, run_length, run_cuts = packed_requests(b.head, b.words, b.pairs, b.segment)
            many = len(run_cuts) - 1
            if many:
                yield pa.RecordBatch.from_arrays([pa.array(np.full(many, serial)), *columns, *(pa.nulls(many, pa.binary()) for _ in KEPT)], names)
            kept = [*ids_of(part), *(x.astype(np.uint32) for x in (np.diff(bounds), b.own, b.which, run_word, run_length, np.flatnonzero(apart), at[apart]))]
            yield pa.RecordBatch.from_arrays([pa.array([serial], pa.int64()), pa.nulls(1, pa.int64()), *(pa.nulls(1, pa.binary()) for _ in range(3)), *(pa.array([x.tobytes()], pa.binary()) for x in kept)], names)
            serial += 1

    names = ["block", "segment", "heads", "runs", "pairs", *KEPT]
    schema = "block long, segment long, " + ", ".join(f"{x} binary" for x in names[2:])

    def answers(key, asked, segment):
        """Counts and levels of followers of first words, and levels of bigrams, in the order asked."""
        if not len(asked):
            return pa.table({x: pa.array([], t) for x, t in (("block", pa.int64()), ("segment", pa.int64()), ("counts", pa.binary()), ("behind", pa.binary()), ("levels", pa.binary()))})
        heads, pairs = unpacked(asked.column("heads"), U), unpacked(asked.column("pairs"), U)
        bits, known, n = (unpacked(segment.column(x), kind) for x, kind in (("bits", U), ("heads", U), ("counts", np.int64)))
        bits = bits if len(bits) else np.zeros(1, U)
        starts = np.array([0, len(bits)])
        hit, at = number_in(heads, known)
        count = np.where(hit, n[at], 0) if len(n) else np.zeros(len(heads), np.int64)
        behind, levels = (probe(x, np.zeros(len(x), np.int64), bits, starts).astype(np.uint8) for x in (mix(heads + FOLLOWERS), pairs))
        cuts, run_cuts = (np.concatenate([[0], np.cumsum(pc.binary_length(asked.column(x)).to_numpy() // 8)]) for x in ("pairs", "heads"))
        return pa.table({"block": asked.column("block"), "segment": asked.column("segment"), "counts": packed(count, run_cuts), "behind": packed(behind, run_cuts), "levels": packed(levels, cuts)})

    def settle(key, kept, told):
        told = told.sort_by("segment")
        ids, flags, lengths, own, which, run_word, run_length, apart, number = (unpacked(kept.column(x), kind) for x, kind in KEPT.items())
        bounds = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])
        count, behind = np.zeros((2, int(own.max()) + 1), np.int64)
        count[run_word], behind[run_word] = unpacked(told.column("counts"), np.int64), unpacked(told.column("behind"), np.uint8)
        count[apart], behind[apart] = heavy_count[number], heavy_behind[number]
        levels = unpacked(told.column("levels"), np.uint8)
        return pa.Table.from_batches([result(ids, flags, bounds, own, chained_places(bounds), which, np.repeat(run_word, run_length), count, behind, levels)])

    def scored(docs: DataFrame) -> DataFrame:
        with releasing() as kept, few_rows_at_once(spark):
            asked = written(docs.mapInArrow(requests, schema), "requests")
            told = asked.where("segment is not null").select("block", "segment", "heads", "runs", "pairs").repartition(tasks(spark, segments), "segment").groupBy("segment").cogroup(model.filters.groupBy("segment"))
            told = written(told.applyInArrow(answers, "block long, segment long, counts binary, behind binary, levels binary"), "answers")
            found = asked.where("segment is null").select("block", *KEPT).repartition(tasks(spark, blocks // SETTLED), "block").groupBy("block").cogroup(told.groupBy("block")).applyInArrow(settle, RESULT)
            kept.append(written(found, "scores"))
        return kept[0]

    blocks = total // (BLOCK_TOKENS * parts)
    # What blocks ask and keep takes several times the room of their texts, so it goes a part at a time.
    share = F.pmod(F.xxhash64("doc_id", "text"), F.lit(parts))
    return reduce(DataFrame.union, [scored(rows.where(share == k)) for k in range(parts)])


RESULT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
#: What a block keeps while its bigrams are looked up: ids and flags, tokens a document, each token's word, each place's bigram, words and lengths of runs of bigrams with one first word, and its heavy words with their numbers.
KEPT = {"ids": np.int64, "flags": np.uint8, "lengths": np.uint32, "own": np.uint32, "which": np.uint32, "run_word": np.uint32, "run_length": np.uint32, "apart": np.uint32, "number": np.uint32}
