"""Merkle manifest of a dataset: a tree of digests for each part, a root over the parts, and a proof for every row.

Levels are built by iterative DataFrame steps.  Rows are numbered in their part;
numbers divided by a power of the fanout name the group that a step gathers,
sorts and hashes into its ancestor.  A step of ``levels`` levels gathers
fanout ** levels digests at most, so a tree over any number of rows takes a few
steps: with ``levels=1`` a step is one level.  On the way back each step's joins
append the siblings above to those inside its groups.

All columns may be null: a null field is written as `-`.  Rows with equal ids are
ordered by their leaf, null ids come first; rows repeated in full have equal
leaves, and each has its own place and proof.  A null text is not an empty one.
An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import written
from .ranks import field, numbered

#: Levels of the tree in one step: 256 digests a group at a fanout of 2.
LEVELS = 8
#: The columns of a document, in the order in which its leaf takes them.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def leaf(*values: Column) -> Column:
    return F.sha2(F.concat(*map(field, values)), 256)


def _ancestors(digests: Column, n: Column, fanout: int) -> Column:
    """Digests of the next level of a group; a part that is down to one node is left as it is."""
    runs = F.sequence(F.lit(0), F.floor((F.size(digests) - 1) / fanout).cast("int"))
    return F.when(n > 1, F.transform(runs, lambda i: F.sha2(F.array_join(F.slice(digests, i * fanout + 1, F.lit(fanout)), ""), 256))).otherwise(digests)


def _grouped(nodes: DataFrame, fanout: int, levels: int) -> DataFrame:
    """A step: part, grp, n, the members in order and the digests of each level (level_0 are the members' own)."""
    width = fanout**levels
    out = nodes.groupBy("part", F.floor(F.col("idx") / width).alias("grp"), "n").agg(F.sort_array(F.collect_list(F.struct("idx", "digest", "row"))).alias("members"))
    out = out.withColumn("level_0", F.transform("members", lambda m: m["digest"]))
    for j in range(levels):
        out = out.withColumn(f"level_{j + 1}", _ancestors(F.col(f"level_{j}"), F.ceil(F.col("n") / fanout**j), fanout))
    return out


def _siblings(place: Column, n: Column, fanout: int, levels: int) -> Column:
    """For each level inside the group: the digests of the run left and right of the node, joined."""
    found = []
    for j in range(levels):
        at = F.floor(place / fanout**j).cast("int")
        first = (at - at % fanout).cast("int")
        digests = F.col(f"level_{j}")
        several = F.ceil(n / fanout**j) > 1
        left = F.when(several, F.array_join(F.slice(digests, first + 1, at - first), "")).otherwise("")
        right = F.when(several, F.array_join(F.slice(digests, at + 2, first + fanout - at - 1), "")).otherwise("")
        found.append(F.struct(several.alias("hashed"), left.alias("left"), right.alias("right")))
    return F.array(*found)


def tree(nodes: DataFrame, name: str, *, fanout: int = 2, levels: int = LEVELS) -> tuple[DataFrame, DataFrame]:
    """The trees over nodes of part, idx (from 0), n (nodes of the part), digest and a struct ``row``.

    Gives the tops (part, top) and the members: part, digest, row and path, an array
    of (hashed, left, right) from the node up to its top.
    """
    most = nodes.agg(F.max("n")).first()[0] or 0
    steps, at = [], nodes
    while True:
        steps.append(written(_grouped(at, fanout, levels), f"{name}-{len(steps)}"))
        last = steps[-1]
        most = -(-most // fanout**levels)
        at = last.select("part", F.col("grp").alias("idx"), F.ceil(F.col("n") / fanout**levels).alias("n"), F.col(f"level_{levels}")[0].alias("digest"), F.lit(None).cast("struct<none:int>").alias("row"))
        if most <= 1:
            break
    tops = at.select("part", F.col("digest").alias("top"))
    above = None
    for step in reversed(steps):
        inside = step if above is None else step.join(above, ["part", "grp"])
        place = F.col("place")
        path = _siblings(place, F.col("n"), fanout, levels)
        if above is not None:
            path = F.concat(path, "above")
        opened = inside.select("*", F.posexplode("members").alias("place", "member"))
        members = opened.select("part", F.col("member.idx").alias("grp"), F.col("member.digest").alias("digest"), F.col("member.row").alias("row"), path.alias("above"))
        above = members.select("part", "grp", "above")
    return tops, members.select("part", "digest", "row", F.col("above").alias("path"))


def folded(digest: Column, path: Column) -> Column:
    """The top that a digest leads to along its path."""
    return F.aggregate(path, digest, lambda acc, s: F.when(s["hashed"], F.sha2(F.concat(s["left"], acc, s["right"]), 256)).otherwise(acc))


def proof(path: Column) -> Column:
    """Siblings level by level, left to right, in one string of hex digests."""
    return F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), "")


def manifest(docs: DataFrame, *, part: str = "lang", key: str = "doc_id", fields: tuple[str, ...] = FIELDS, changed: dict[str, Column] | None = None, fanout: int = 2, levels: int = LEVELS) -> DataFrame:
    """key, leaf, other_leaf, subroot, root, path (to the root) and proof of every row.

    ``changed`` replaces fields in other_leaf (null: as they are), which stands for
    a row as it is found later; equal to leaf where nothing differs.
    """
    changed = changed or {}
    own = [docs[c] for c in fields]
    other = [F.coalesce(changed[c], docs[c]) if c in changed else docs[c] for c in fields]
    # A part's name sorts as its UTF-8 bytes, null first: `0` stands before every name.
    named = F.when(docs[part].isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), docs[part].cast("string")))
    leaves = docs.select(named.alias("part"), docs[key].alias("id"), leaf(*own).alias("digest"), leaf(*other).alias("other") if changed else F.lit(None).cast("string").alias("other"))
    leaves = leaves.withColumn("other", F.nullif("other", "digest"))
    rows = numbered(leaves, "part", ["id", "digest"], "leaves")
    tops, members = tree(rows.select("part", "idx", "n", "digest", F.struct("id", "other").alias("row")), "tree", fanout=fanout, levels=levels)
    tops = written(tops, "tops")
    parts = numbered(tops.select(F.lit("all").alias("part"), F.col("part").alias("name"), F.col("top").alias("digest")), "part", ["name"], "parts")
    root, above = tree(parts.select("part", "idx", "n", "digest", F.struct("name").alias("row")), "root", fanout=fanout, levels=levels)
    upper = above.join(root, "part").select(F.col("row.name").alias("part"), F.col("top").alias("root"), F.col("path").alias("upper"))
    upper = written(upper.join(tops, "part"), "upper")
    path = F.concat("path", "upper")
    return members.join(upper, "part").select(F.col("row.id").alias(key), F.col("digest").alias("leaf"), F.coalesce("row.other", "digest").alias("other_leaf"), F.col("top").alias("subroot"), "root", path.alias("path"), proof(path).alias("proof"))


def verified(found: DataFrame) -> DataFrame:
    """Adds folded_root, which other_leaf leads to along the row's path, and verified (equal to root)."""
    again = found.withColumn("folded_root", folded(F.col("other_leaf"), F.col("path")))
    return again.withColumn("verified", F.col("folded_root") == F.col("root"))


def one_in_seven(key: Column) -> Column:
    """Whether 7 divides the unsigned CRC-32 of a decimal id; false for a null id."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 7 == 0, F.lit(False))
