"""Deduplication of repeated strings by bucket-pointer refinement of sampled suffixes.

A byte goes if a string of ``window`` bytes that covers it starts anywhere else
too.  Suffixes are sampled at anchors (see suffix_kernel), which equal strings
have at equal places; an anchor's number is its place in the order of all.

1. Suffixes are dealt to buckets by the q-gram at their anchor.  Buckets of one
   suffix are settled: its string occurs once.
2. In a round an open suffix reads the bucket identifiers of the suffixes 1, 2
   and 3 depths later.  Buckets are refined by own and read identifiers; a new
   bucket is named by its least suffix, so identifiers are exact, and the next
   round reads these new ones.  Each round makes the depth FAN times as large.
3. A window holds the same first and last anchor as the windows around it: a
   run.  The chain of anchors that covers a run is named by up to FAN buckets in
   a row.  Runs whose covering chain occurs twice are repeated.
4. What is left are the ends of repeated strings: runs whose inner chain occurs
   twice, but not the covering one.  The bytes around the inner chain settle
   them: runs are sorted by their bytes to the left and to the right, and the
   extents that neighbours have in common tell which windows they share.

Equal texts are refined once, and are repeated as a whole.  Texts are named by
128 bits of hashes; a 400-byte string is equal to another one only if five
64-bit q-gram hashes in a row are.

Null texts are empty.  Copies of a row count as other places.  An empty table
gives no rows.
"""

from __future__ import annotations

from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import releasing, ship, written
from .suffix_kernel import FAN, GRAM, SAMPLE, anchors, chains, deepest, gram_hashes, runs, within
from .tokens import text_blocks

#: Bytes of a repeated string, and of a repeated passage: 50 short words.
WINDOW, PASSAGE = 400, 250
NAME = ["k1", "k2"]
#: Parts in which texts are dealt out to their open runs: one part's shuffle files go before the next one's come.
DEALT = 2


def keyed(docs: DataFrame, text: str, *others) -> DataFrame:
    """k1 and k2, hashes that name equal texts, and the text."""
    body = F.coalesce(docs[text].cast("string"), F.lit(""))
    return docs.select(F.xxhash64(body, F.octet_length(body)).alias("k1"), F.xxhash64(F.lit(10), body).alias("k2"), body.alias("text"), *others)


def sampled(docs: DataFrame, text: str, windows: tuple[int, ...]) -> DataFrame:
    """A row for each text of at least the least window: doc (number of its first anchor), name, text, size, shape (two bytes an anchor), grams, and deep (last level of each anchor)."""

    def work(batches):
        number = TaskContext.get().partitionId() << 40
        for rows, offsets, data in text_blocks(batches):
            size = np.diff(offsets)
            owner, place, first = anchors(data, offsets)
            grams = gram_hashes(data, offsets, owner, place)
            bounds = np.searchsorted(owner, np.arange(len(size) + 1))
            deep = deepest(owner, place, max(windows))
            step = np.diff(place, prepend=0)
            step[bounds[:-1][np.diff(bounds) > 0]] = place[bounds[:-1][np.diff(bounds) > 0]]
            shape = np.stack([step, place - first], axis=1).astype(np.uint8).tobytes()
            keep = np.flatnonzero(size >= min(windows))
            taken = np.diff(bounds)[keep]
            doc = number + np.cumsum(taken) - taken
            number += int(taken.sum())
            lists, levels = (pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(x)).take(pa.array(keep)) for x in (grams.view(np.int64), deep))
            picked = rows.take(pa.array(keep))
            yield pa.RecordBatch.from_arrays(
                [pa.array(doc), *picked.columns, pa.array(size[keep]), pa.array([shape[2 * a : 2 * b] for a, b in zip(bounds[keep].tolist(), bounds[keep + 1].tolist())], pa.binary()), lists, levels],
                ["doc", *NAME, "text", "size", "shape", "grams", "deep"],
            )

    return keyed(docs, text).mapInArrow(work, "doc long, k1 long, k2 long, text string, size long, shape binary, grams array<long>, deep array<tinyint>")


def refined(texts: DataFrame) -> list[DataFrame]:
    """doc, i (anchor), deep, b (bucket identifier) and outer (first or last of its bucket) of the suffixes that share a bucket, a table for each level."""
    number = F.col("doc") + F.col("i")
    outer = ((number == F.col("b")) | (number == F.col("top"))).alias("outer")
    suffixes = texts.select("doc", F.posexplode(F.arrays_zip("grams", "deep")).alias("i", "x")).select("doc", "i", F.col("x.grams").alias("gram"), F.col("x.deep").alias("deep"))
    shared = suffixes.groupBy("gram").agg(F.min(number).alias("b"), F.max(number).alias("top")).where("b < top")
    levels = [written(suffixes.join(shared, "gram").select("doc", "i", "deep", "b", outer), "level")]
    for k in count():
        if not levels[-1].where(F.col("deep") > k).limit(1).count():
            return levels
        order = Window.partitionBy("doc").orderBy("i")
        later = [F.first("b").over(order.rangeBetween(j * FAN**k, j * FAN**k)).alias(f"b{j}") for j in range(1, FAN)]
        to = [f"b{j}" for j in range(1, FAN)]
        with releasing() as kept:
            read = written(levels[-1].select("*", *later).where(F.col("deep") > k).dropna(subset=to), "read")
            shared = read.groupBy("b", *to).agg(F.min(number).alias("name"), F.max(number).alias("top")).where("name < top")
            levels.append(written(read.drop("outer").join(shared, ["b", *to]).select("doc", "i", "deep", F.col("name").alias("b"), "top").select("doc", "i", "deep", "b", outer), "level"))
            kept.append(levels[-1])


RUN = ["win", "doc", "first", "more", "lead", "core", "c1", "c2", "f1", "f2", "state"]
#: A run that waits for its covering chain, one that is known to be repeated, and one of these that open runs may meet.
WAITS, REPEATED, NAMED = 0, 1, 2


def candidate_runs(texts: DataFrame, levels: list[DataFrame], windows: tuple[int, ...]) -> DataFrame:
    """Runs of windows whose inner chain occurs twice, with the names of the inner and of the covering chain.

    lead counts the first window's bytes before the inner chain, core the
    bytes of that chain.  A covering chain that occurs once has the run's own
    place for a name.  Runs that one shared bucket reaches over are repeated
    and need no name; those that touch are one row, and the first and the last
    place of the bucket also give them one by one, for open runs to meet.
    """
    entries = [x.select("doc", F.struct(F.lit(k).alias("level"), "i", "b", "outer").alias("x")) for k, x in enumerate(levels)]
    lists = entries[0]
    for x in entries[1:]:
        lists = lists.unionAll(x)
    lists = lists.groupBy("doc").agg(F.collect_list("x").alias("xs"))  # as many as the text has anchors, for each level
    joined = texts.select("doc", "size", "shape").join(lists, "doc")
    many = len(levels)

    def work(batches):
        for batch in batches:
            docs, size = (batch.column(k).to_numpy() for k in (0, 1))
            if not len(docs):
                continue
            shapes = batch.column(2).to_pylist()
            n = np.array([len(x) // 2 for x in shapes])
            bounds = np.concatenate([[0], np.cumsum(n)])
            shape = np.frombuffer(b"".join(shapes), np.uint8).reshape(-1, 2).astype(np.int64)
            place = np.cumsum(shape[:, 0])
            place -= np.repeat(place[bounds[:-1]] - shape[bounds[:-1], 0], n)
            first = place - shape[:, 1]
            lists_ = batch.column(3)
            own = np.repeat(np.arange(len(docs)), np.diff(lists_.offsets.to_numpy()))
            flat = lists_.flatten()
            table = np.full((many, len(place)), -1, np.int64)
            outer = np.zeros((many, len(place)), bool)
            level, anchor = flat.field(0).to_numpy(), bounds[own] + flat.field(1).to_numpy()
            table[level, anchor], outer[level, anchor] = flat.field(2).to_numpy(), flat.field(3).to_numpy(zero_copy_only=False)
            for number, window in enumerate(windows):
                doc, at, more, low, high, before, behind = runs(size, bounds, place, first, window)
                c1, c2, inner = chains(table, low, high)
                f1, f2, cover = chains(table, before, behind)
                f1, f2 = np.where(cover, f1, docs[doc]), np.where(cover, f2, at)
                settled, named = within(table, outer, before, behind)
                columns = [np.full(len(doc), number), docs[doc], at, more, place[low] - at, place[high] + GRAM - place[low], c1, c2, f1, f2, np.where(named, NAMED, WAITS)]
                kinds = [np.int32, np.int64, np.int64, np.int32, np.int32, np.int32, np.int64, np.int64, np.int64, np.int64, np.int32]
                keep = np.flatnonzero(inner & (~settled | named))
                yield pa.RecordBatch.from_arrays([pa.array(x[keep].astype(t)) for x, t in zip(columns, kinds)], RUN)
                keep = np.flatnonzero(settled)
                start = np.ones(len(keep), bool)
                start[1:] = (doc[keep[1:]] != doc[keep[:-1]]) | (keep[1:] != keep[:-1] + 1)
                end = np.flatnonzero(np.append(start[1:], True)) if len(keep) else keep
                head = keep[start]
                whole = [x[head] for x in columns[:3]] + [at[keep[end]] + more[keep[end]] - at[head], *[np.zeros(len(head))] * 6, np.full(len(head), REPEATED)]
                yield pa.RecordBatch.from_arrays([pa.array(x.astype(t)) for x, t in zip(whole, kinds)], RUN)

    return joined.mapInArrow(work, "win int, doc long, first long, more int, lead int, core int, c1 long, c2 long, f1 long, f2 long, state int")


END = ["win", "c1", "c2", "doc", "first", "more", "lead", "core", "open"]


def margins(texts: DataFrame, ends: DataFrame, windows: tuple[int, ...]) -> DataFrame:
    """The rows ``ends`` with the bytes that their windows take before and behind the inner chain."""
    lists = ends.groupBy("doc").agg(F.collect_list(F.struct(*(c for c in END if c != "doc"))).alias("xs"))  # as many as the text has runs at most
    joined = texts.select("doc", "text").join(lists, "doc")

    def work(batches):
        for rows, offsets, data in text_blocks(batches):
            lists_ = rows.column(2)
            flat = lists_.flatten()
            own = np.repeat(np.arange(rows.num_rows), np.diff(lists_.offsets.to_numpy()))
            fields = dict(zip([c for c in END if c != "doc"], (flat.field(j) for j in range(len(END) - 1))))
            win, first, more, lead, core = (fields[c].to_numpy().astype(np.int64) for c in ("win", "first", "more", "lead", "core"))
            start = offsets[own] + first
            inner = start + lead
            sides = []
            for x, y in ((start, inner), (inner + core, start + more + np.array(windows)[win])):
                sides.append(pa.array([data[p:q].tobytes() for p, q in zip(x.tolist(), y.tolist())], pa.binary()))
            yield pa.RecordBatch.from_arrays([*(rows.column(0).take(pa.array(own)) if c == "doc" else fields[c] for c in END), *sides], [*END, "left", "right"])

    return joined.mapInArrow(work, "win int, c1 long, c2 long, doc long, first long, more int, lead int, core int, open boolean, left binary, right binary")


def sided(found: DataFrame, windows: tuple[int, ...]) -> DataFrame:
    """The rows of ``margins`` dealt out twice, by the nearest bytes on the left and on the right of the inner chain.

    A window takes ``rest`` bytes around the chain, so at least ``half`` of them on one
    side: two rows that share a window share the nearest ``half`` bytes of that side.
    Rows of side 0 settle windows with half and more bytes on the left, those of side 1
    the others.  However many rows a chain has, only those with equal bytes meet.
    """
    window = F.element_at(F.array(*map(F.lit, windows)), F.col("win") + 1)
    rows = found.withColumn("rest", (window - F.col("core")).cast("int")).withColumn("half", F.floor(F.col("rest") / 2).cast("int"))
    left, right = F.octet_length("left"), F.octet_length("right")
    near = [F.expr("substring(left, octet_length(left) - half + 1, half)"), F.expr("substring(right, 1, rest - half)")]
    parts = [rows.where(c).select("*", F.lit(k).alias("side"), F.xxhash64("c1", "c2", "win", F.lit(k), F.col("half"), n).alias("meet")) for k, (c, n) in enumerate(zip((left >= F.col("half"), right >= F.col("rest") - F.col("half")), near))]
    both = parts[0].unionByName(parts[1])
    # Rows that meet nobody, or only settled ones, go before any bytes are sorted.
    company = both.groupBy("meet").agg(F.count("*").alias("n"), F.max("open").alias("wanted")).where("n > 1 and wanted").select("meet")
    return both.join(company, "meet", "left_semi")


def met(found: DataFrame, windows: tuple[int, ...]) -> DataFrame:
    """win, doc, first and more: windows of open rows that another row of their inner chain has too.

    Rows that meet are sorted by their bytes to the left, nearest first, and to the
    right; neighbours in these orders have the longest common extents.  For each
    number of bytes on the left, rows in one class of both orders share a window.
    """
    columns = ["meet", "win", "c1", "c2", "doc", "first", "more", "lead", "rest", "half", "side", "open", "left", "right"]
    rows = sided(found, windows).select(*columns).repartition("meet").sortWithinPartitions("meet", "win", "c1", "c2")

    def matrix(column: list[bytes], back: bool) -> tuple[np.ndarray, np.ndarray]:
        cut = [x[::-1][:GRAM] if back else x[:GRAM] for x in column]
        raw = np.frombuffer(b"".join(x.ljust(GRAM, b"\0") for x in cut), np.uint8).reshape(-1, GRAM)
        return raw, np.fromiter(map(len, cut), np.int64, len(cut))

    def ordered(group: np.ndarray, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """An order of rows by group and bytes, and how many bytes each row has in common with the one before it (-1: another group).

        Bytes behind a row's end count as 0; what they say is left out where rows are too short.
        """
        # Big-endian words compare as the bytes do.
        words = np.ascontiguousarray(raw).view(">u8")
        order = np.lexsort([*(words[:, k] for k in range(words.shape[1] - 1, -1, -1)), group])
        now, before = order[1:], order[:-1]
        same = np.concatenate([raw[now] == raw[before], np.zeros((len(now), 1), bool)], axis=1)
        return order, np.concatenate([[-1], np.where(group[now] == group[before], np.argmin(same, axis=1), -1)])

    def hits(table: pa.Table):
        win, c1, c2, doc, first, more, lead, rest, half, side = (table.column(k).to_numpy().astype(np.int64) for k in range(1, 11))
        opened = table.column(11).to_numpy(zero_copy_only=False)
        meet = table.column(0).to_numpy()
        change = np.ones(len(meet), bool)
        change[1:] = (meet[1:] != meet[:-1]) | (win[1:] != win[:-1]) | (c1[1:] != c1[:-1]) | (c2[1:] != c2[:-1])
        group = np.cumsum(change) - 1
        (left, n_left), (right, n_right) = matrix(table.column(12).to_pylist(), True), matrix(table.column(13).to_pylist(), False)
        by_left, with_left = ordered(group, left)
        by_right, with_right = ordered(group, right)
        low = np.where(side == 0, half, 0)
        high = np.where(side == 0, rest, half - 1)
        low, high = np.maximum(low, rest - n_right), np.minimum(high, n_left)
        n = len(group)
        hit = np.zeros((int(high.max(initial=-1)) + 3, n), bool)
        for size in range(int(low.min(initial=0)), int(high.max(initial=-1)) + 1):
            valid = (size >= low) & (size <= high)
            if valid.sum() < 2:
                continue
            a, b = np.empty(n, np.int64), np.empty(n, np.int64)
            a[by_left] = np.cumsum(with_left < size)
            b[by_right] = np.cumsum(with_right < (rest - size)[by_right])
            at = np.flatnonzero(valid)
            key = a[at] * (n + 1) + b[at]
            order = np.argsort(key, kind="stable")
            key = key[order]
            twice = np.zeros(len(key), bool)
            same = key[1:] == key[:-1]
            twice[1:] |= same
            twice[:-1] |= same
            hit[size + 1, at[order]] = twice
        sizes = np.arange(-1, len(hit) - 1)[:, None]
        hit &= opened & (sizes >= lead - more) & (sizes <= lead)
        # Ranges of bytes on the left are ranges of windows: more bytes, an earlier window.
        flat = hit.T.astype(np.int8)
        begin, end = np.argwhere(np.diff(flat, axis=1) == 1), np.argwhere(np.diff(flat, axis=1) == -1)
        row, least, most = begin[:, 0], begin[:, 1], end[:, 1] - 1
        return win[row], doc[row], first[row] + lead[row] - most, most - least

    def work(batches):
        held: list[pa.RecordBatch] = []

        def found_in(parts):
            win, doc, first, more = hits(pa.Table.from_batches(parts))
            return pa.RecordBatch.from_arrays([pa.array(win.astype(np.int32)), pa.array(doc), pa.array(first), pa.array(more.astype(np.int32))], ["win", "doc", "first", "more"])

        for batch in batches:
            meet = batch.column(0).to_numpy()
            change = np.flatnonzero(meet[1:] != meet[:-1]) + 1
            # The last group of a batch may go on in the next one.
            last = int(change[-1]) if len(change) else 0
            if held and len(meet) and held[-1].column(0)[-1].as_py() != int(meet[0]):
                yield found_in(held)
                held = []
            if last:
                yield found_in([*held, batch.slice(0, last)])
                held = []
            if batch.num_rows > last:
                held.append(batch.slice(last))
        if held:
            yield found_in(held)

    return rows.mapInArrow(work, "win int, doc long, first long, more int")


def repeated_windows(docs: DataFrame, *, windows: tuple[int, ...] = (WINDOW,), text: str = "text") -> DataFrame:
    """k1, k2, win, first and more: ranges of windows (of the win-th length) of each distinct text whose string starts elsewhere too."""
    if min(windows) < SAMPLE:
        raise ValueError(f"a window has at least {SAMPLE} bytes")
    ship(docs.sparkSession)
    inner, cover = ["win", "c1", "c2"], ["f1", "f2"]
    with releasing() as kept:  # texts go before ends are sorted
        found = written(sampled(docs, text, windows), "sampled")
        names = written(found.groupBy(*NAME).agg(F.min("doc").alias("doc"), F.count("*").alias("copies"), F.first("size").alias("size")), "names")
        with releasing() as ready:  # and runs before texts are dealt out
            with releasing() as early:
                lean = written(found.join(names.select("doc"), "doc", "left_semi").select("doc", "size", "shape", "grams", "deep"), "suffixes")
                candidates = written(candidate_runs(lean, refined(lean), windows), "runs")
                early.append(candidates)
            # Runs with one covering chain have equal windows at equal places around the inner chain, so any of them may stand for all; columns of plain numbers are summed up without a sort.
            one = ["doc", "first", "more", "lead", "core"]
            groups = written(candidates.where(F.col("state") != REPEATED).groupBy(*inner, *cover).agg(F.sum(F.when(F.col("state") == NAMED, 2).otherwise(1)).alias("n"), *(F.first(c).alias(c) for c in one)), "groups")
            settled = candidates.where(F.col("state") == WAITS).join(groups.where("n > 1").select(*inner, *cover), [*inner, *cover], "left_semi").select("win", "doc", "first", "more")
            settled = written(settled.unionAll(candidates.where(F.col("state") == REPEATED).select("win", "doc", "first", "more")), "settled")
            # One run stands for all with its covering chain: it is enough to meet the open ones.
            unsettled = groups.groupBy(*inner).agg(F.count("*").alias("all"), F.count(F.when(F.col("n") == 1, 1)).alias("alone")).where("all > 1 and alone > 0").select(*inner)
            ends = written(groups.join(unsettled, inner).select(*inner, *one, (F.col("n") == 1).alias("open")), "ends")
            ready += [settled, ends]
        parts = [F.pmod(F.xxhash64("doc"), F.lit(DEALT)) == k for k in range(DEALT)]
        # One folder: with a union of two in its place, ``met`` lost rows on 0.10 GB where its joins were no broadcasts.
        start, *others = (margins(found.where(x), ends.where(x), windows) for x in parts)
        sides = written(start, "margins", *others)
        kept += [names, settled, sides]
    late = met(sides, windows)
    ranges = merged(settled.unionByName(late)).join(names.where("copies = 1").select("doc", *NAME), "doc").select(*NAME, "win", "first", "more")
    whole = [names.where((F.col("copies") > 1) & (F.col("size") >= w)).select(*NAME, F.lit(k).alias("win"), F.lit(0).cast("long").alias("first"), (F.col("size") - w).cast("int").alias("more")) for k, w in enumerate(windows)]
    for x in whole:
        ranges = ranges.unionByName(x)
    return ranges


def merged(ranges: DataFrame) -> DataFrame:
    """Ranges of windows of a text in order, those that touch as one."""
    lists = ranges.groupBy("doc", "win").agg(F.collect_list(F.struct("first", "more")).alias("xs"))  # as many as the text has windows at most

    def work(batches):
        for batch in batches:
            flat, offsets = batch.column(2).flatten(), batch.column(2).offsets.to_numpy()
            own = np.repeat(np.arange(batch.num_rows), np.diff(offsets))
            first, more = (flat.field(k).to_numpy().astype(np.int64) for k in (0, 1))
            # Rows stand apart on one line, so that the highest end so far is that of the row itself.
            apart = own * (int((first + more).max(initial=0)) + 2)
            order = np.argsort(first + apart)
            own, first, last = own[order], (first + apart)[order], np.maximum.accumulate((first + more + apart)[order])
            cut = np.ones(len(own), bool)
            cut[1:] = first[1:] > last[:-1] + 1
            end = np.flatnonzero(np.append(cut[1:], True)) if len(own) else np.zeros(0, np.int64)
            row = pa.array(own[cut])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(row), batch.column(1).take(row), pa.array((first - apart[order])[cut]), pa.array((last[end] - first[cut]).astype(np.int32))], ["doc", "win", "first", "more"])

    return lists.mapInArrow(work, "doc long, win int, first long, more int")


def covered_spans(own: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, start and end of the spans that ranges of bytes cover, in order; ranges of a document that overlap or touch are one."""
    order = np.argsort(start, kind="stable")
    own, start, end = own[order], start[order], np.maximum.accumulate(end[order])
    cut = np.ones(len(own), bool)
    cut[1:] = (own[1:] != own[:-1]) | (start[1:] > end[:-1])
    return own[cut], start[cut], end[np.append(cut[1:], True)[: len(own)]]


def deduplicated(docs: DataFrame, *, window: int = WINDOW, also: tuple[int, ...] = (), text: str = "text", carry: tuple[str, ...] = (), as_text: bool = False) -> DataFrame:
    """n_bytes, n_removed, n_spans, kept (bytes) and covered of every document, with the columns of ``carry`` as c_0, c_1, ...

    ``covered`` has a number for each length of ``also``: bytes that repeated
    strings of this length cover; they are not removed.  With ``as_text`` kept
    is a string; a character of which a cut left a part goes whole.
    """
    windows = (window, *also)
    with releasing() as kept:
        kept.append(written(repeated_windows(docs, windows=windows, text=text), "ranges"))
    ranges = kept[0].groupBy(*NAME).agg(F.collect_list(F.struct("win", "first", "more")).alias("ranges"))
    rows = keyed(docs, text, *(docs[c].alias(f"c_{k}") for k, c in enumerate(carry)))
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    extra = [f"c_{k}" for k in range(len(carry))]

    def work(batches):
        for part, offsets, data in text_blocks(batches):
            lists = part.column(1)
            flat = lists.flatten()
            own = np.repeat(np.arange(part.num_rows), np.diff(lists.offsets.to_numpy())) if len(flat) else np.zeros(0, np.int64)
            win, first, more = (flat.field(k).to_numpy().astype(np.int64) for k in range(3))
            docs_, n = part.num_rows, len(data)
            begin = offsets[own] + first
            stop = begin + more + np.array(windows)[win]
            spans = [covered_spans(own[win == k], begin[win == k], stop[win == k]) for k in range(len(windows))]
            removed, *covered = (np.bincount(doc, weights=end - start, minlength=docs_).astype(np.int64) for doc, start, end in spans)
            doc, start, end = spans[0]
            edge = np.zeros(n + 1, np.int8)
            edge[start] = 1
            edge[end] -= 1
            gone = np.cumsum(edge[:n], dtype=np.int8).view(bool)
            left = data[~gone].tobytes()
            bounds = (offsets - np.append(0, np.cumsum(removed))).tolist()
            bodies = [left[a:b] for a, b in zip(bounds, bounds[1:])]
            kept = pa.array([x.decode("utf-8", "ignore") for x in bodies], pa.string()) if as_text else pa.array(bodies, pa.binary())
            table = pa.ListArray.from_arrays(pa.array(np.arange(docs_ + 1, dtype=np.int32) * len(covered)), pa.array(np.stack(covered, axis=1).ravel() if covered else np.zeros(0, np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array(np.diff(offsets)), pa.array(removed), pa.array(np.bincount(doc, minlength=docs_).astype(np.int64)), kept, table, *part.columns[2:]], ["n_bytes", "n_removed", "n_spans", "kept", "covered", *extra])

    schema = ", ".join(["n_bytes long, n_removed long, n_spans long, kept " + ("string" if as_text else "binary"), "covered array<long>", *(f"c_{k} {kinds[c]}" for k, c in enumerate(carry))])
    return rows.join(ranges, NAME, "left").select("text", F.coalesce("ranges", F.array().cast("array<struct<win:int,first:bigint,more:int>>")).alias("ranges"), *extra).mapInArrow(work, schema)
