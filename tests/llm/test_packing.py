import random
import zlib
from collections import Counter, defaultdict
from functools import lru_cache

import numpy as np
from tokenizers import Tokenizer

from leadloom.llm import packing, token_counts
from leadloom.llm.tokens import tokenizer_path

PATH = tokenizer_path("byte_bpe_50k.json")


@lru_cache
def library():
    return Tokenizer.from_file(PATH)


def library_ids(text):
    return library().encode(text or "", add_special_tokens=False).ids


def bins_are_whole(rows, capacity):
    """No gap, no overlap, none over capacity; the number of bins."""
    bins = defaultdict(list)
    for r in rows:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for inside in bins.values():
        at = 0
        for offset, length in sorted(inside):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins)


def test_plan_places_every_piece_once():
    rng = random.Random(3)
    for _ in range(200):
        capacity = rng.choice([10, 32, 100])
        counts = Counter(rng.randrange(1, capacity + 1) for _ in range(rng.randrange(0, 200)))
        runs = packing.plan(counts, capacity)
        rows = []
        placed = defaultdict(list)
        for length, first, n, per_bin, first_bin, offset in runs:
            placed[length].extend(range(first, first + n))
            rows += [{"sequence_id": first_bin + k // per_bin, "offset": offset + k % per_bin * length, "length": length} for k in range(n)]
        assert {x: sorted(v) for x, v in placed.items()} == {x: list(range(n)) for x, n in counts.items()}
        used = bins_are_whole(rows, capacity)
        total = sum(x * n for x, n in counts.items())
        assert used <= 11 / 9 * max(-(-total // capacity), sum(n for x, n in counts.items() if 2 * x > capacity)) + 1


def test_large_pieces_pair_at_most_twice():
    runs = packing.plan({60: 3, 50: 2, 40: 3, 34: 1, 10: 6}, 100)
    large = Counter()
    for length, _, n, per_bin, first_bin, _ in runs:
        if 3 * length > 100:
            for k in range(n):
                large[first_bin + k // per_bin] += 1
    assert max(large.values()) == 2


def test_pieces_and_places(docs):
    items = packing.written(packing.pieces(docs, PATH, capacity=64), "t")
    rows = packing.pack(items, capacity=64).collect()
    wanted = Counter()
    for r in docs.collect():
        ids = [*library_ids(r["text"]), 0]
        first = len(ids) % 64 if len(ids) > 64 else 0
        cuts = ([0] if first else []) + list(range(first, len(ids), 64))
        for piece, (a, b) in enumerate(zip(cuts, [*cuts[1:], len(ids)])):
            wanted[r["doc_id"], piece, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == wanted
    used = bins_are_whole(rows, 64)
    assert used <= 1.02 * -(-sum(r["length"] for r in rows) // 64) + 1


def test_clashing_names(spark):
    """Columns named like the operator's own keep their values."""
    rows = [(k, 7 * k, f"b{k}", None, k % 5, 1 + k % 40) for k in range(500)]
    df = spark.createDataFrame(rows, "salt long, rank long, base string, groups int, run_first int, length long")
    found = packing.pack(df, capacity=64)
    assert found.columns == [*df.columns, "sequence_id", "offset"]
    assert sorted(tuple(r)[:6] for r in found.collect()) == sorted(rows)


def test_empty_table(empty):
    assert packing.packed_documents(empty, PATH).count() == 0
    assert token_counts.length_table(token_counts.encoded_lengths(empty, PATH)).count() == 0


def test_length_histogram(docs):
    lengths = [len(library_ids(r["text"])) for r in docs.collect()]
    rows = {r["n_tokens"]: r for r in token_counts.length_table(token_counts.encoded_lengths(docs, PATH)).collect()}
    assert {x: r["n_documents"] for x, r in rows.items()} == Counter(lengths)
    for x, r in rows.items():
        longer = [n for n in lengths if n > x]
        assert (r["documents_longer"], r["tokens_longer"]) == (len(longer), sum(longer))
        assert r["truncated_total"] == sum(min(n, x) for n in lengths)
        assert abs(r["quantile"] - (1 - len(longer) / len(lengths))) < 1e-12


def test_totals_at_any_limit(spark):
    for lengths in ([5, 5, 9, 2000], [0, 0, 3, 7], [0], []):
        rows = spark.createDataFrame([(n, 1) for n in lengths], "n_tokens long, n long")
        limits = [0, 1, 4, 5, 6, 9, 1999, 2000, 5000]
        found = token_counts.totals_at(rows, tuple(limits)).collect()
        assert {r["context"]: (r["truncated_total"], r["documents_over"]) for r in found} == {c: (sum(min(n, c) for n in lengths), sum(n > c for n in lengths)) for c in limits}
