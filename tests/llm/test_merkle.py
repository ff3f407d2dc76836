import hashlib
import random
import zlib
from itertools import groupby

import pytest
from pyspark.sql import functions as F

from leadloom.llm import merkle, queries

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, leaf string, part string, idx int, n int"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(x):
    return "-" if x is None else f"{len(str(x).encode())}:{x}"


def climbed(nodes, fanout):
    """Top and each node's siblings as (left, right) lists of digests, level by level, by plain loops."""
    paths = [[] for _ in nodes]
    members = [[k] for k in range(len(nodes))]
    while len(nodes) > 1:
        nodes, before = [h(*nodes[k : k + fanout]) for k in range(0, len(nodes), fanout)], nodes
        for k, inside in enumerate(members):
            run = range(k // fanout * fanout, min(len(before), (k // fanout + 1) * fanout))
            for m in inside:
                paths[m].append(([before[j] for j in run if j < k], [before[j] for j in run if j > k]))
        members = [sum(members[k : k + fanout], []) for k in range(0, len(members), fanout)]
    return nodes[0], paths


def brute(rows, fanout=2):
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of rows (doc_id, source, lang, n_chars, text)."""
    leaf = lambda r: h(*map(field, r))
    first = lambda x: (x is not None, x if x is not None else 0)
    by_lang = sorted(rows, key=lambda r: (r[2] is not None, (r[2] or "").encode(), first(r[0]), leaf(r)))
    parts = [list(g) for _, g in groupby(by_lang, key=lambda r: (r[2] is not None, r[2]))]
    trees = [climbed([leaf(r) for r in p], fanout) for p in parts]
    root, upper = climbed([t for t, _ in trees], fanout) if trees else (None, [])
    out = []
    for part, (top, paths), above in zip(parts, trees, upper):
        for r, path in zip(part, paths):
            changed = r[0] is not None and r[3] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
            now = leaf((*r[:3], r[3] + 1, r[4])) if changed else leaf(r)
            for left, right in path + above:
                now = h(*left, now, *right)
            out.append((r[0], leaf(r), top, root, h(*(x for p in path + above for side in p for x in side)), now, now == root))
    return sorted(out, key=str)


def found(docs, **how):
    tampered = F.col("n_chars") + F.when(merkle.one_in_seven(F.col("doc_id")), 1).otherwise(0)
    rows = merkle.verified(merkle.manifest(docs, changed={"n_chars": tampered}, **how))
    return sorted(((r[0], r["leaf"], r["subroot"], r["root"], h(r["proof"]), r["folded_root"], r["verified"]) for r in rows.collect()), key=str)


def made(n, seed):
    rng = random.Random(seed)
    langs = ["en"] * 6 + ["de", "é", "Z", "", None]
    return [(rng.choice([k, k, k, None, 7]), rng.choice(["a", "", None]), rng.choice(langs), rng.choice([k, None]), rng.choice(["x:y", "", None, "é" * 3])) for k in range(n)]


@pytest.mark.parametrize("n, fanout, levels", [(60, 2, 8), (60, 2, 1), (60, 2, 3), (60, 3, 2), (1, 2, 8), (2, 2, 1), (5, 4, 1)])
def test_equals_plain_loops(spark, n, fanout, levels):
    rows = made(n, n + fanout)
    rows += rows[:3] if n > 5 else []
    docs = spark.createDataFrame([(*r, "own", "own", 1, 2) for r in rows], SCHEMA).repartition(3)
    assert found(docs, fanout=fanout, levels=levels) == brute(rows, fanout)


def test_one_language_holds_all_rows_over_several_steps(spark):
    rows = [(k, "s", "en", k, f"text {k}") for k in range(700)]
    docs = spark.createDataFrame([(*r, None, None, None, None) for r in rows], SCHEMA).repartition(5)
    assert found(docs) == brute(rows)
    assert found(docs, levels=4) == brute(rows)


def test_empty_table(spark):
    assert found(spark.createDataFrame([], SCHEMA)) == []


def test_long_texts_and_order_of_bytes(spark):
    rows = [(1, "s", "￿", 1, "a" * 300_000), (2, "s", "\U00010000", 1, "b"), (3, "s", "z", None, "c")]
    docs = spark.createDataFrame([(*r, None, None, None, None) for r in rows], SCHEMA)
    assert found(docs) == brute(rows)


def test_query(spark):
    folder = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "source", "lang", "n_chars", "text").collect()]
    assert sorted(map(tuple, queries.op12_merkle_manifest(spark, folder).collect()), key=str) == brute(rows)
