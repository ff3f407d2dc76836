"""MinHash near-duplicates by a multi-index Hamming join of b-bit signatures.

A document's set holds its distinct word shingles.  A signature has 48 slots,
each 16 bits of a minimum over the set, in twelve chunks of four.  Two
signatures that differ in at most 23 slots differ in at most one slot of some
chunk, so listing every chunk with each of its slots left out finds all such
pairs; a pair at 0.75 differs in 12 slots on average, and no chunk finds it with
a chance of 1e-7.  Pairs that this finds are confirmed on the full sets.

Documents with equal sets form a class and count once.  A bucket holds the
classes with one chunk key.  First each class is compared with one centre, the
least class of most of its buckets; buckets whose classes are then all in one
component are left out.  In the others each class is compared with the next ones
by size.  So a hot group costs about as many comparisons as it has members.
Sets that still share a bucket across components are joined by prefix
filtering, where linked sets share one of their rarest shingles.  No pair is
left out for the distance of its signatures or the size of its bucket.

Null ids sort last.  Texts without words are linked with nothing.  Repeated
rows are in one class.  An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import releasing, ship, written
from .blocks import BASE, U, chained, mix, word_hashes
from .components import components
from .keys import NO_ID
from .tokens import text_blocks

SHINGLE, CHUNKS, CHUNK = 5, 12, 4
SLOTS = CHUNKS * CHUNK
#: Links need 100 * intersection >= PERCENT * union.
PERCENT = 75
#: Classes of a bucket that are ordered by size in one task, about.
ORDERED = 10_000
#: Places by size, within a bucket of several components, of the classes that a class is compared with before all of them are.
NEIGHBOURS = (1, 2)
#: Numbers of 64 bits in a set's parity map.
PARITY = 4
#: Texts of one class that meet its partners in one task, about.
TOGETHER = 500

_RNG = np.random.RandomState(75)
MULTIPLY = _RNG.randint(0, 2**63 - 1, SLOTS).astype(U) * U(2) + U(1)
ADD = _RNG.randint(0, 2**63 - 1, SLOTS).astype(U)


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each document, in a row, and their bounds."""
    words, at = word_hashes(data, offsets, lower=True)
    docs = len(offsets) - 1
    n = np.diff(at)
    owner = np.repeat(np.arange(docs), n)
    grams = chained(words, SHINGLE)
    place = np.arange(len(grams))
    inside = owner[place] == owner[place + SHINGLE - 1] if len(grams) else np.zeros(0, bool)
    grams, owners = grams[inside], owner[: len(grams)][inside]
    few = np.flatnonzero((n > 0) & (n < SHINGLE))
    if len(few):  # the whole sequence is the one shingle
        alone = np.array([int(mix(np.array([_fold(words[at[k] : at[k + 1]])], U))[0]) for k in few.tolist()], U)
        grams, owners = np.concatenate([grams, alone]), np.concatenate([owners, few])
    order = np.lexsort((grams, owners))
    grams, owners = grams[order], owners[order]
    fresh = np.ones(len(grams), bool)
    fresh[1:] = (grams[1:] != grams[:-1]) | (owners[1:] != owners[:-1])
    grams, owners = grams[fresh], owners[fresh]
    return grams, np.searchsorted(owners, np.arange(docs + 1))


def _fold(words: np.ndarray) -> U:
    value = U(len(words))
    with np.errstate(over="ignore"):
        for w in words:
            value = value * BASE + w
    return value


def signatures(grams: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A row of SLOTS 16-bit values for each document with a set."""
    out = np.empty((len(bounds) - 1, SLOTS), np.uint16)
    for k in range(SLOTS):
        h = (grams ^ ADD[k]) * MULTIPLY[k]
        h ^= h >> U(29)
        h *= BASE
        low = np.minimum.reduceat(h, bounds[:-1])
        out[:, k] = (mix(low) & U(0xFFFF)).astype(np.uint16)
    return out


def document_sets(docs: DataFrame, *, text: str = "text", key: str = "doc_id") -> DataFrame:
    """id (null: NO_ID), text_hash, n (set size), node (hash of the set; null without one) and signature of every document."""
    ship(docs.sparkSession)

    def work(batches):
        for rows, offsets, data in text_blocks(batches):
            grams, bounds = shingle_sets(data, offsets)
            n = np.diff(bounds)
            some = np.flatnonzero(n)
            node = np.zeros(len(n), np.int64)
            signature: list[bytes | None] = [None] * len(n)
            if len(some):
                starts = np.append(bounds[:-1][some], len(grams))
                sums = np.add.reduceat(mix(grams), starts[:-1])
                node[some] = mix(sums + n[some].astype(U)).view(np.int64)
                for k, row in zip(some.tolist(), signatures(grams, starts)):
                    signature[k] = row.tobytes()
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(2), pa.array(n.astype(np.int64)), pa.array(node, mask=n == 0), pa.array(signature, pa.binary())], ["id", "text_hash", "n", "node", "signature"])

    body = docs[text].cast("string")
    rows = docs.select(F.coalesce(docs[key].cast("long"), F.lit(NO_ID)).alias("id"), body.alias("text"), F.xxhash64(body).alias("text_hash"))
    return rows.mapInArrow(work, "id long, text_hash long, n long, node long, signature binary")


def chunk_keys(classes: DataFrame) -> DataFrame:
    """key, node and n: a row for each chunk and slot of it that is left out."""
    rest = [[j for j in range(CHUNK) if j != leave] for leave in range(CHUNK)]

    def work(batches):
        for batch in batches:
            raw = b"".join(batch.column(2).to_pylist())
            slots = np.frombuffer(raw, np.uint16).reshape(-1, CHUNKS, CHUNK).astype(U)
            keys = []
            for c in range(CHUNKS):
                for leave, others in enumerate(rest):
                    joined = (slots[:, c, others[0]] << U(32)) | (slots[:, c, others[1]] << U(16)) | slots[:, c, others[2]]
                    keys.append(mix((joined << U(16)) | U(c * CHUNK + leave)))
            flat = np.stack(keys, axis=1).ravel().view(np.int64)
            many = CHUNKS * CHUNK
            yield pa.RecordBatch.from_arrays([pa.array(flat), pa.array(np.repeat(batch.column(0).to_numpy(), many)), pa.array(np.repeat(batch.column(1).to_numpy(), many))], ["key", "node", "n"])

    return classes.select("node", "n", "signature").mapInArrow(work, "key long, node long, n long")


def _like_sizes(a: str, b: str):
    """Sets whose sizes alone rule out a link are never compared."""
    return 100 * F.least(a, b) >= PERCENT * F.greatest(a, b)


def confirmed(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Pairs (a, b) of nodes that are linked, by their full sets.

    ``texts`` has one text for each node.  A node with many partners is dealt
    to groups of TOGETHER pairs, with its text once a group.
    """
    counts = pairs.groupBy(F.col("b")).agg(F.count("*").alias("partners")).withColumn("groups", F.ceil(F.col("partners") / TOGETHER).cast("long"))
    hot = counts.where("groups > 1").select("b", "groups")
    salted = pairs.join(hot, "b", "left").withColumn("salt", F.pmod(F.xxhash64("a"), F.coalesce("groups", F.lit(1)))).select("a", "b", "salt")
    spread = counts.select("b", F.explode(F.sequence(F.lit(0).cast("long"), F.col("groups") - 1)).alias("salt"))
    centre = spread.join(texts.select(F.col("node").alias("b"), F.col("text").alias("u")), "b")
    left = salted.join(texts.select(F.col("node").alias("a"), "text"), "a")
    # All pairs of a centre and group come together, so its set is made once a batch.
    both = left.join(centre, ["b", "salt"]).select("a", "b", "text", "u")

    def sets_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        parts, sizes = [], [0]
        for rows, offsets, data in text_blocks([pa.RecordBatch.from_arrays([column], ["text"])]):
            grams, bounds = shingle_sets(data, offsets)
            parts.append(grams)
            sizes += np.diff(bounds).tolist()
        return np.concatenate(parts) if parts else np.zeros(0, U), np.cumsum(sizes)

    def work(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                a_grams, a_bounds = sets_of(batch.column(2))
                names = batch.column(1).to_numpy()
                distinct, first, which = np.unique(names, return_index=True, return_inverse=True)
                b_grams, b_bounds = sets_of(batch.column(3).take(pa.array(first)))
                keep = []
                for k, w in enumerate(which.tolist()):
                    x, y = a_grams[a_bounds[k] : a_bounds[k + 1]], b_grams[b_bounds[w] : b_bounds[w + 1]]
                    common = len(np.intersect1d(x, y, assume_unique=True))
                    keep.append(100 * common >= PERCENT * (len(x) + len(y) - common))
                mask = pa.array(keep, pa.bool_())
                yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], ["a", "b"])

    return both.mapInArrow(work, "a long, b long")


def parity_maps(grams: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """PARITY numbers for each set: a bit for each class of shingles by hash, on where the set has an odd number of them.

    Two sets differ in at least as many shingles as their maps do in bits.
    """
    docs, bits = len(bounds) - 1, 64 * PARITY
    owner = np.repeat(np.arange(docs), np.diff(bounds))
    odd = np.bincount(owner * bits + (mix(grams + U(1)) % U(bits)).astype(np.int64), minlength=docs * bits).reshape(docs, bits) & 1
    return np.packbits(odd.astype(np.uint8), axis=1).view(np.int64)


def _may_link(a: str, b: str):
    """Whether sets of n and m shingles may have a link by their parity maps: a link leaves them (100 - PERCENT) of (100 + PERCENT) shingles apart at most."""
    apart = sum((F.bit_count(F.get(a, F.lit(k)).bitwiseXOR(F.get(b, F.lit(k)))) for k in range(PARITY)), F.lit(0))
    return (100 + PERCENT) * apart <= (100 - PERCENT) * (F.col("n") + F.col("m"))


def prefix_pairs(crowd: DataFrame, texts: DataFrame) -> DataFrame:
    """Pairs (a, b) of different components that share one of their rarest shingles, among the rows (node, n, root) of ``crowd``.

    With shingles in one order for all sets, rare ones first, two linked sets
    have a shingle in common among the first n - ceil(0.75 n) + 1 of each.  Their
    first common one leaves room behind it for the rest of the overlap that a
    link needs, so ranks further back give no pair; nor do sets whose parity maps
    are too far apart.
    """
    both = written(crowd.join(texts, "node").select("node", "n", "root", "text"), "crowd-texts")

    def maps_of(batches):
        for rows, offsets, data in text_blocks(batches):
            maps = parity_maps(*shingle_sets(data, offsets))
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(list(maps), pa.list_(pa.int64()))], ["node", "map"])

    def work(batches):
        for rows, offsets, data in text_blocks(batches):
            grams, bounds = shingle_sets(data, offsets)
            own = pa.array(np.repeat(np.arange(rows.num_rows), np.diff(bounds)))
            yield pa.RecordBatch.from_arrays([*(rows.column(k).take(own) for k in range(3)), pa.array(grams.view(np.int64))], ["node", "n", "root", "shingle"])

    maps = written(both.mapInArrow(maps_of, "node long, map array<long>"), "maps")
    rows = written(both.mapInArrow(work, "node long, n long, root long, shingle long"), "shingles")
    # A shingle of one component only gives no pair, but it has its place in the order.
    often = rows.groupBy("shingle").agg(F.count("*").alias("df"), (F.min("root") != F.max("root")).alias("across")).where("df > 1")
    known = rows.join(often, "shingle", "left").select("node", "n", "root", "shingle", F.coalesce("df", F.lit(1)).alias("df"), F.coalesce("across", F.lit(False)).alias("across"))
    rarest = Window.partitionBy("node").orderBy("df", "shingle")
    first = F.col("n") - F.ceil(F.col("n") * PERCENT / 100) + 1
    prefix = written(known.withColumn("rank", F.row_number().over(rarest)).where((F.col("rank") <= first) & F.col("across")).select("shingle", "node", "n", "root", "rank").join(maps, "node"), "prefix")
    other = prefix.select("shingle", F.col("node").alias("other"), F.col("n").alias("m"), F.col("root").alias("other_root"), F.col("rank").alias("other_rank"), F.col("map").alias("other_map"))
    most = 1 + F.least(F.col("n") - F.col("rank"), F.col("m") - F.col("other_rank"))
    enough = (100 + PERCENT) * most >= PERCENT * (F.col("n") + F.col("m"))
    pairs = prefix.join(other, "shingle").where((F.col("root") < F.col("other_root")) & _like_sizes("n", "m") & enough & _may_link("map", "other_map"))
    return pairs.select(F.col("node").alias("a"), F.col("other").alias("b")).distinct()


class _Links:
    """Links found so far, pairs that were compared, and the component of each node."""

    def __init__(self, texts: DataFrame):
        self.texts, self.links, self.tested, self.roots = texts, None, None, None

    def compare(self, pairs: DataFrame, name: str) -> None:
        """Confirm the pairs (a, b) that were not compared before."""
        pairs = pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
        if self.tested is not None:
            pairs = pairs.join(self.tested, ["a", "b"], "left_anti")
        pairs = written(pairs, name)
        self.tested = pairs if self.tested is None else self.tested.unionAll(pairs)
        if not pairs.limit(1).count():
            return
        found = written(confirmed(pairs, self.texts), "links")
        if found.limit(1).count():
            self.links = found if self.links is None else self.links.unionAll(found)
            with releasing() as kept:
                self.roots = written(components(self.links), "roots")
                kept.append(self.roots)

    def rooted(self, members: DataFrame) -> DataFrame:
        """``members`` with the root of their node."""
        if self.roots is None:
            return members.withColumn("root", F.col("node"))
        return members.join(self.roots, "node", "left").withColumn("root", F.coalesce("root", "node"))

    def mixed(self, members: DataFrame) -> DataFrame:
        """key, node, n and root of the members of buckets that hold several components."""
        with releasing() as kept:
            now = written(self.rooted(members.select("key", "node", "n")), "members")
            several = now.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low != high").select("key")
            kept.append(written(now.join(several, "key", "left_semi"), "mixed"))
        return kept[0]


def linked(docs: DataFrame, *, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every document, with its class (hash of the set), the class that names its component, and text_hash."""
    sets = written(document_sets(docs, text=text, key=key), "sets")
    with releasing() as kept:
        classes = written(sets.where("node is not null").groupBy("node").agg(F.min("id").alias("id"), F.first("n").alias("n"), F.first("signature").alias("signature")), "classes")
        with releasing() as early:  # every shared bucket; later steps read those of several components
            keys = chunk_keys(classes)
            members = written(keys.join(keys.groupBy("key").agg(F.count("*").alias("many")).where("many > 1").select("key"), "key", "left_semi"), "shared")
            found = _Links(written(candidate_texts(docs, sets, classes, members, text=text, key=key), "texts"))
            centres = members.groupBy("key").agg(F.min_by("node", F.struct("n", "node")).alias("centre"), F.min("n").alias("m"))
            stars = members.join(centres, "key").where((F.col("node") != F.col("centre")) & _like_sizes("n", "m")).groupBy("node", "centre").agg(F.count("*").alias("together"))
            found.compare(stars.groupBy("node").agg(F.max_by("centre", F.struct("together", "centre")).alias("centre")).select(F.col("node").alias("a"), F.col("centre").alias("b")), "stars")
            now = found.mixed(members)
            early += [now, found.texts, found.tested, found.links, found.roots]
        salt = F.pmod(F.xxhash64("node"), F.ceil(F.col("many") / ORDERED)).alias("salt")
        by_size = Window.partitionBy("key", "salt").orderBy("n", "node")
        for away in NEIGHBOURS:
            chain = now.join(now.groupBy("key").agg(F.count("*").alias("many")), "key").select("key", "node", "n", "root", salt)
            chain = chain.select("node", "n", "root", *(F.lead(c, away).over(by_size).alias(name) for c, name in (("node", "next"), ("n", "m"), ("root", "other"))))
            found.compare(chain.where((F.col("root") != F.col("other")) & _like_sizes("n", "m")).select(F.col("node").alias("a"), F.col("next").alias("b")), "chain")
            now = found.mixed(now)
        crowd = now.select("node", "n", "root").dropDuplicates(["node"])
        if crowd.limit(1).count():
            found.compare(prefix_pairs(written(crowd, "crowd"), found.texts), "across")
        owned = found.rooted(classes.select("node", "id"))
        labels = written(owned.join(owned.groupBy("root").agg(F.min("id").alias("component")), "root").select("node", "component", "root"), "labels")
        kept.append(labels)
    doc_id = F.when(F.col("id") != NO_ID, F.col("id"))
    component = F.coalesce("component", "id")
    return sets.join(labels, "node", "left").select(
        doc_id.alias("doc_id"),
        F.col("n").alias("n_shingles"),
        F.when(component != NO_ID, component).alias("component_id"),
        (component == F.col("id")).alias("kept"),
        F.col("node").alias("set_hash"),
        F.col("root").alias("component_hash"),
        "text_hash",
    )


def candidate_texts(docs: DataFrame, sets: DataFrame, classes: DataFrame, members: DataFrame, *, text: str, key: str) -> DataFrame:
    """node and text of every class that shares a bucket: the class's least id brings the text.

    Repeated ids may bring other texts: then the nodes are found by the set itself.
    """
    wanted = classes.join(members.select("node").distinct(), "node", "left_semi").select("node", "id")
    if sets.groupBy("id").count().where("count > 1").limit(1).count():
        return node_texts(docs, text=text).join(wanted.select("node"), "node", "left_semi")
    rows = docs.select(F.coalesce(docs[key].cast("long"), F.lit(NO_ID)).alias("id"), F.coalesce(docs[text].cast("string"), F.lit("")).alias("text"))
    return wanted.join(rows, "id").select("node", "text")


def representatives(docs: DataFrame, *, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` that stay: one of each component, and all without words; of equal rows one."""
    with releasing() as kept:
        found = written(linked(docs, text=text, key=key).where("kept"), "kept")
        kept.append(found)
    ids = F.coalesce("doc_id", F.lit(NO_ID)).alias("keep_id")
    first = found.where("component_hash is not null").groupBy("component_hash").agg(F.min(F.struct(ids, "text_hash")).alias("x")).select("x.*")
    alone = found.where("component_hash is null").select(ids, "text_hash").distinct()
    chosen = first.union(alone).withColumnRenamed("text_hash", "keep_hash")
    body = docs[text].cast("string")
    marked = docs.select(F.coalesce(docs[key].cast("long"), F.lit(NO_ID)).alias("keep_id"), F.xxhash64(body).alias("keep_hash"), F.struct(*(docs[c] for c in docs.columns)).alias("row"))
    stay = marked.join(chosen, ["keep_id", "keep_hash"], "left_semi")
    if found.groupBy("doc_id", "text_hash").count().where("count > 1").limit(1).count():
        stay = stay.dropDuplicates(["keep_id", "keep_hash"])
    return stay.select("row.*")


def node_texts(docs: DataFrame, *, text: str = "text") -> DataFrame:
    """One text for every class, found by its set."""
    plain = docs.select(F.coalesce(docs[text].cast("string"), F.lit("")).alias("text"))

    def work(batches):
        for rows, offsets, data in text_blocks(batches):
            grams, bounds = shingle_sets(data, offsets)
            n = np.diff(bounds)
            some = np.flatnonzero(n)
            if len(some):
                sums = np.add.reduceat(mix(grams), bounds[:-1][some])
                yield pa.RecordBatch.from_arrays([pa.array(mix(sums + n[some].astype(U)).view(np.int64)), rows.column(0).take(pa.array(some))], ["node", "text"])

    return plain.mapInArrow(work, "node long, text string").groupBy("node").agg(F.first("text").alias("text"))
