import random
import re

import numpy as np

from leadloom.llm import components as graph
from leadloom.llm import near_dups
from leadloom.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4)))


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    least = {}
    for k, (name, _) in enumerate(rows):
        least[find(k)] = min(least.get(find(k), 2**63), name)
    return sorted((name, len(sets[k]), least[find(k)], least[find(k)] == name) for k, (name, _) in enumerate(rows))


def results(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    return sorted((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in near_dups.linked(df).collect())


def test_against_brute_force(spark, texts):
    rng = random.Random(8)
    vocabulary = [f"w{k}" for k in range(300)]
    out = list(enumerate(texts))
    passage = [rng.choice(vocabulary) for _ in range(60)]
    for _ in range(60):
        base = [rng.choice(vocabulary) for _ in range(rng.randrange(5, 160))]
        if rng.random() < 0.4:
            base += passage
        for _ in range(rng.randrange(1, 7)):
            out.append((len(out), " ".join(base)))
            for _ in range(rng.randrange(1, 4)):  # a chain drifts away from its start
                base[rng.randrange(len(base))] = rng.choice(vocabulary)
    out += [(len(out) + k, text.upper()) for k, (_, text) in enumerate(out[-20:])]
    assert results(spark, out) == brute(out)


def test_common_passage_loses_no_link(spark):
    rng = random.Random(4)
    passage = " ".join(f"p{k}" for k in range(60))
    out = []
    for k in range(60):
        own = [f"u{rng.randrange(10**6)}" for _ in range(rng.randrange(10, 90))]
        out.append(f"{passage} {' '.join(own)}")
        if k % 3 == 0:
            own[0] = "changed"
            out.append(f"{passage} {' '.join(own)}")
    rows = list(enumerate(out))
    assert results(spark, rows) == brute(rows)


def test_recall_at_the_threshold(spark):
    """10,000 pairs of exactly 0.75: 60 of 70 shingles in common, 80 in all."""
    rows = []
    for k in range(10_000):
        first = [f"{k}a{j}" for j in range(64)]
        rows += [(2 * k, " ".join(first + [f"b{k}x{j}" for j in range(10)])), (2 * k + 1, " ".join(first + [f"c{k}y{j}" for j in range(10)]))]
    found = near_dups.linked(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert all(r["component_id"] == r["doc_id"] // 2 * 2 and r["n_shingles"] == 70 for r in found) and len(found) == 20_000


def test_documents(documents):
    rows = [(r["doc_id"], r["text"]) for r in documents.select("doc_id", "text").collect()]
    found = sorted((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in near_dups.linked(documents).collect())
    assert found == brute(rows)


def test_null_and_repeated_ids(spark, empty):
    long = " ".join(f"w{k}" for k in range(50))
    df = spark.createDataFrame([(None, long, 1), (None, "", 2), (4, long + " x", 3), (4, "other words here", 4), (4, long, 5), (9, None, 6), (9, "  ", 7), (4, long, 5)], "doc_id long, text string, node int")
    found = sorted((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in near_dups.linked(df).collect() if r["doc_id"] is not None)
    assert found == [(4, 1, 4, True), (4, 46, 4, True), (4, 46, 4, True), (4, 47, 4, True), (9, 0, 9, True), (9, 0, 9, True)]
    assert near_dups.linked(empty).count() == 0


def test_pigeonhole_finds_every_pair_within_the_distance(spark):
    rng = np.random.RandomState(2)
    base = rng.randint(0, 65536, near_dups.SLOTS).astype(np.uint16)
    rows = [(0, 10, base.tobytes())]
    for k in range(1, 200):
        other = base.copy()
        places = rng.choice(near_dups.SLOTS, 2 * near_dups.CHUNKS - 1, replace=False)
        other[places] ^= np.uint16(1 + k)
        rows.append((k, 10, other.tobytes()))
    keys = near_dups.chunk_keys(spark.createDataFrame([(a, b, bytearray(c)) for a, b, c in rows], "node long, n long, signature binary"))
    own = {}
    for r in keys.collect():
        own.setdefault(r["node"], set()).add(r["key"])
    assert all(own[0] & own[k] for k in range(1, 200))


def test_parity_maps_never_say_more_than_the_sets():
    rng = np.random.RandomState(5)
    for _ in range(300):
        both = rng.randint(0, 2**62, rng.randint(1, 400)).astype(np.uint64)
        sets = [np.unique(both[rng.rand(len(both)) < share]) for share in (0.8, 0.9)]
        maps = near_dups.parity_maps(np.concatenate(sets), np.cumsum([0, *map(len, sets)]))
        assert sum(int(x).bit_count() for x in (maps[0] ^ maps[1]).view(np.uint64)) <= len(np.setxor1d(*sets))


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(k, k + 1) for k in range(1000, 1060)] + [(2000, 2000 + k) for k in range(1, 50)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    wanted = {x: find(x) for a, b in edges if a != b for x in (a, b)}
    assert {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()} == wanted


def test_few_edges_take_no_rounds_and_give_the_roots_of_rounds(spark, monkeypatch):
    rng = random.Random(7)
    edges = spark.createDataFrame([(rng.randrange(400), rng.randrange(400)) for _ in range(230)] + [(k, k + 1) for k in range(1000, 1200)] + [(5, 5), (9000, 9000)], "a long, b long")
    stages, write = [], graph.written
    monkeypatch.setattr(graph, "written", lambda df, name: stages.append(name) or write(df, name))
    few = {(r["node"], r["root"]) for r in components(edges).collect()}
    assert stages == []
    monkeypatch.setattr(graph, "FEW", 0)
    assert few == {(r["node"], r["root"]) for r in components(edges).collect()} and len(stages) > 2
