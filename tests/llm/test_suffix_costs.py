"""What a suffix sort costs, and the steps that were made cheaper against plain loops."""

import random

import numpy as np

from leadloom.llm import blocks, suffix_dedup, suffix_kernel


def block(raw):
    return np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])


def documents(rng):
    common = bytes(rng.choices(b"abc ", k=3000))
    sizes = [0, 190, 191, 0, 0, 192, 700, 2500, 96, 191, 1200, 0]
    return [common[(at := rng.randrange(400)) : at + size] for size in rng.sample(sizes, len(sizes))]


def test_runs_are_grouped_without_a_sort(spark, monkeypatch):
    plans, real = {}, suffix_dedup.written

    def watched(df, name, *more):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return real(df, name, *more)

    monkeypatch.setattr(suffix_dedup, "written", watched)
    passage = "".join(random.Random(5).choices("abcdefgh ", k=900))
    docs = spark.createDataFrame([(0, "x" * 50 + passage), (1, passage + "y" * 50), (2, passage[100:700])], "doc_id long, text string")
    found = {r["c_0"]: (r["n_bytes"], r["n_removed"]) for r in suffix_dedup.deduplicated(docs, carry=("doc_id",)).collect()}
    assert found == {0: (950, 900), 1: (950, 900), 2: (600, 600)}
    assert "HashAggregate" in plans["groups"] and "SortAggregate" not in plans["groups"]


def test_no_gram_is_hashed_by_itself(monkeypatch):
    data, offsets = block(documents(random.Random(1)))
    monkeypatch.setattr(blocks, "xxhash", None)
    owner, place, _ = suffix_kernel.anchors(data, offsets)
    hashes = suffix_kernel.gram_hashes(data, offsets, owner, place)
    grams = [data[a : a + suffix_kernel.GRAM].tobytes() for a in (offsets[owner] + place).tolist()]
    assert len(grams) == len(hashes) > 50 and len(set(grams)) < len(grams)
    assert len(set(zip(grams, hashes.tolist()))) == len(set(grams)) == len(set(hashes.tolist()))


def test_anchors_are_those_of_each_sample(monkeypatch):
    size, gram = suffix_kernel.SAMPLE, suffix_kernel.GRAM
    for piece in (64, 701, 1 << 16):
        monkeypatch.setattr(suffix_kernel, "PIECE", piece)
        data, offsets = block(documents(random.Random(2)))
        keys = blocks.mix(blocks.lanes(data)[: len(data)] * np.uint64(0x9FB21C651E98DF25) + np.uint64(1)) >> np.uint64(24)
        wanted = []
        for doc, (a, b) in enumerate(zip(offsets.tolist(), offsets[1:].tolist())):
            for s in range(a, b - size + 1):
                at = s + int(np.argmin(keys[s : s + size - gram + 1]))
                if not wanted or wanted[-1][:2] != (doc, at - a):
                    wanted.append((doc, at - a, s - a))
        assert list(zip(*(x.tolist() for x in suffix_kernel.anchors(data, offsets)))) == wanted


def test_spans_of_ranges():
    rng = random.Random(3)
    for _ in range(200):
        bounds = np.cumsum([0, *(rng.choice([0, 5, 30]) for _ in range(6))])
        ranges = [(k, *sorted(rng.sample(range(a, b + 1), 2))) for k, (a, b) in enumerate(zip(bounds.tolist(), bounds[1:].tolist())) if b > a for _ in range(rng.randrange(5))]
        rng.shuffle(ranges)
        own, start, end = (np.array([r[k] for r in ranges], np.int64) for k in range(3))
        wanted = []
        for k, (a, b) in enumerate(zip(bounds.tolist(), bounds[1:].tolist())):
            covered = {x for o, p, q in ranges if o == k for x in range(p, q)}
            begins = [x for x in sorted(covered) if x - 1 not in covered]
            wanted += [(k, x, next(y for y in range(x, b + 1) if y not in covered)) for x in begins]
        assert list(zip(*(x.tolist() for x in suffix_dedup.covered_spans(own, start, end)))) == wanted
