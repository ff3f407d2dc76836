import math
import os
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from leadloom.llm import language_model as lm

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def tokens(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [*WORD.findall(lowered), None]


def held(name):
    return zlib.crc32(b"" if name is None else str(name).encode()) % 5 == 1


def brute(rows):
    counts = Counter(t for name, text in rows if not held(name) for t in tokens(text))
    total, distinct = sum(counts.values()), len(counts)
    out = []
    for name, text in rows:
        own = tokens(text)
        base = sum(math.log10((counts[t] + 0.5) / (total + 0.5 * (distinct + 1))) for t in own)
        out.append((name, held(name), len(own), sum(counts[t] > 0 for t in own), total, base))
    return sorted(out, key=str)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def same(found, wanted):
    assert [r[:5] for r in found] == [w[:5] for w in wanted]
    assert np.allclose([r[5] for r in found], [w[5] for w in wanted], rtol=1e-10)


@pytest.mark.parametrize("kind", ["odd", "documents"])
def test_counts_and_base_score(kind, docs, documents):
    df = docs if kind == "odd" else documents
    found = rows_of(lm.score(df, lm.fit(df)))
    same(found, brute([(r["doc_id"], r["text"]) for r in df.collect()]))
    assert all(r[6] < 0 for r in found)


def test_routed_probes_give_the_same_scores(docs):
    model = lm.fit(docs, segment_entries=500)
    direct = rows_of(lm.score(docs, model, segment_entries=500))
    routed = rows_of(lm.score(docs, model, segment_entries=500, broadcast_bytes=0, broadcast_words=10))
    partly = rows_of(lm.score(docs, model, segment_entries=500, broadcast_words=10))
    for other in (routed, partly):
        assert [r[:5] for r in direct] == [r[:5] for r in other]
        assert np.allclose([r[5:] for r in direct], [r[5:] for r in other], rtol=1e-9)


@pytest.mark.parametrize("kind, heavy", [("docs", 20), ("documents", 400), ("documents", 10**9)])
def test_travelling_probes_take_little_room(spark, kind, heavy, docs, documents, monkeypatch):
    """Packed rows of a part at a time: stages stay below the size of the texts, which one row a token took many times over."""
    df = docs if kind == "docs" else documents
    model = lm.fit(df, segment_entries=20_000, heavy=heavy)
    assert len(model.heavy[0]) == model.words.where((F.col("n") >= heavy) | (F.col("word") == int(lm.END.astype("int64")))).count()
    direct = rows_of(lm.score(df, model))
    sizes, plain = [], lm.written

    def measured(frame, name):
        stage = plain(frame, name)
        sizes.append(sum(os.path.getsize(f.removeprefix("file://")) for f in stage.inputFiles()))
        return stage

    monkeypatch.setattr(lm, "written", measured)
    routed = rows_of(lm.score(df, model, broadcast_bytes=0))
    assert [r[:5] for r in direct] == [r[:5] for r in routed] and len(routed) == df.count()
    assert np.allclose([r[5:] for r in direct], [r[5:] for r in routed], rtol=1e-9)
    size = df.agg(F.sum(F.octet_length("text"))).first()[0]
    assert kind == "docs" or (len(sizes) == 3 * lm.PARTS and max(sizes) < size)


def test_bigrams_help_on_held_out_text(spark):
    import random

    rng = random.Random(6)
    follow = {k: [rng.randrange(200) for _ in range(3)] for k in range(200)}
    rows = []
    for k in range(400):
        w, out = rng.randrange(200), []
        for _ in range(120):
            out.append(f"w{w}")
            w = rng.choice(follow[w])
        rows.append((k, " ".join(out)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = lm.score(df, lm.fit(df)).where("held_out").collect()
    assert sum(r["score"] for r in found) > 0.45 * sum(r["base_score"] for r in found)


def test_filter_keeps_every_level():
    rng = np.random.RandomState(3)
    keys = lm.mix(np.arange(1, 5001).astype(lm.U))
    counts = rng.zipf(1.5, 5000).clip(1, 10**6)
    levels = lm.level(counts)
    words = int(levels.sum()) * lm.ENTRY_BITS // 64 + 1
    bits = np.zeros(words, lm.U)
    for key, top in zip(keys, levels):
        for j in range(1, top + 1):
            at, own = lm.entry_words(np.array([key]), j, words)
            bits[at] |= own
    starts = np.array([0, words])
    found = lm.probe(keys, np.zeros(5000, np.int64), bits, starts)
    assert (found >= levels).all() and (found > levels).mean() < 0.05
    unseen = lm.probe(lm.mix(np.arange(10**6, 10**6 + 5000).astype(lm.U)), np.zeros(5000, np.int64), bits, starts)
    assert (unseen > 0).mean() < 0.05
    assert (lm.LEVEL_COUNT[levels] <= counts).all() and (lm.LEVEL_COUNT[levels + 1] > counts).all()
    assert lm.LEVEL_COUNT[:8].tolist() == [0, 1, 2, 3, 4, 6, 8, 12]


def test_chances_sum_to_at_most_one():
    """Behind every word, over all words, with counts read back from their levels."""
    rng = np.random.RandomState(8)
    for _ in range(200):
        words = rng.randint(3, 400)
        counts = rng.zipf(1.4, words).clip(1, 10**6) * (rng.rand(words) < rng.rand())
        share = rng.rand(words)
        share /= share.sum()
        levels = np.where(counts > 0, lm.level(counts), 0)
        behind = int((counts > 0).sum())
        follow = np.full(words, lm.level(np.array([behind]))[0] if behind else 0)
        total = lm.chance_of(share, levels, follow, np.full(words, counts.sum()), rng.rand()).sum()
        assert 0 < total <= 1 + 1e-9


@pytest.mark.parametrize("kind", ["docs", "documents"])
def test_model_score(kind, docs, documents):
    """Scores from a dictionary of exact counts, quantised; the filter's false hits may raise or lower a few."""
    df = docs if kind == "docs" else documents
    rows = [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]
    counts, pairs, behind = Counter(), Counter(), {}
    for name, text in rows:
        if not held(name):
            own = tokens(text)
            counts.update(own)
            for v, w in zip(own, own[1:]):
                pairs[v, w] += 1
                behind.setdefault(v, set()).add(w)
    total, distinct = sum(counts.values()), len(counts)
    once, twice = (sum(n == k for n in pairs.values()) for k in (1, 2))
    d = once / (once + 2 * twice)
    least = lambda n: next(x for x in lm.LEVEL_COUNT[::-1] if x <= n)
    close = 0
    found = {(r[0], r[2], round(r[5], 6)): r[6] for r in rows_of(lm.score(df, lm.fit(df)))}
    for name, text in rows:
        own = tokens(text)
        share = [(counts[t] + 0.5) / (total + 0.5 * (distinct + 1)) for t in own]
        score = math.log10(share[0])
        for v, w, p in zip(own, own[1:], share[1:]):
            rest = min(1, d * least(len(behind[v])) / counts[v]) if v in behind else 1
            score += math.log10(min(max(least(pairs[v, w]) - d, 0) / counts[v], 1 - rest) + rest * p if v in behind else p)
        own_score = found[name, len(own), round(sum(math.log10(p) for p in share), 6)]
        assert abs(own_score - score) < 0.25 * abs(score) + 3
        close += abs(own_score - score) < 0.03 * abs(score)
    assert close > 0.5 * len(rows)

def test_empty(empty):
    assert lm.score(empty, lm.fit(empty)).count() == 0
