import hashlib
import os
import random
from collections import Counter

import numpy as np
import pytest

from leadloom.llm import suffix_dedup as sd
from leadloom.session import shared_dir, written


def brute(texts, window):
    bodies = [(t or "").encode() for t in texts]
    seen = Counter(b[k : k + window] for b in bodies for k in range(len(b) - window + 1))
    out = []
    for b in bodies:
        gone = np.zeros(len(b) + 1, bool)
        for k in range(len(b) - window + 1):
            if seen[b[k : k + window]] > 1:
                gone[k : k + window] = True
        spans = int((gone[1:-1] & ~gone[:-2]).sum() + gone[0]) if len(b) else 0
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


def found(df):
    return {(r["c_0"], r["n_bytes"], r["n_removed"], r["n_spans"], hashlib.sha256(bytes(r["kept"])).hexdigest()) for r in sd.deduplicated(df, carry=("doc_id",)).collect()}


def check(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    assert found(df) == {(k, *x) for k, x in enumerate(brute(texts, sd.WINDOW))}


def words(rng, n):
    return " ".join("".join(rng.choice("abcdeé") for _ in range(rng.randrange(1, 9))) for _ in range(n))


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, texts, seed):
    rng = random.Random(seed)
    out = list(texts) if seed == 1 else []
    passages = [words(rng, rng.randrange(60, 260)) for _ in range(8)]
    for _ in range(60):
        parts = [words(rng, rng.randrange(0, 120)) for _ in range(3)]
        for p in rng.sample(passages, rng.randrange(0, 3)):
            cut = rng.randrange(0, 80)
            parts.insert(rng.randrange(len(parts) + 1), p[cut : len(p) - rng.randrange(0, 80)])
        out.append(" ".join(parts))
    out += rng.sample(out, 6)  # exact copies
    for t in rng.sample(out[-60:], 20):  # near copies with single edits
        t = list(t or "")
        for _ in range(rng.randrange(1, 6)):
            if t:
                t[rng.randrange(len(t))] = "z"
        out.append("".join(t))
    out += ["x" * 399, "x" * 400, "y" * 401, "ab" * 400, "ab" * 199, "abc" * 1000 + "q" + "abc" * 150, passages[0][:400], passages[0][:399]]
    check(spark, out)


def test_exact_edges(spark):
    rng = random.Random(9)
    base = words(rng, 400)[:1600]
    check(spark, [base, "Q" * 30 + base[300:700] + "R" * 30, "Q" * 10 + base[900:1299] + "S" * 3, base[:10], ""])


def test_second_length_and_pieces(spark, monkeypatch):
    from leadloom.llm import suffix_kernel

    monkeypatch.setattr(suffix_kernel, "PIECE", 700)
    rng = random.Random(11)
    passage = words(rng, 90)
    texts = [words(rng, 300) + passage[:300] + words(rng, 80), passage[20:330] + words(rng, 200), words(rng, 900), passage[100:], "ab" * 300]
    size, shorter = [np.frombuffer((t or "").encode(), np.uint8) for t in texts], []
    seen = Counter(b[k : k + sd.PASSAGE].tobytes() for b in size for k in range(len(b) - sd.PASSAGE + 1))
    for b in size:
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - sd.PASSAGE + 1):
            if seen[b[k : k + sd.PASSAGE].tobytes()] > 1:
                gone[k : k + sd.PASSAGE] = True
        shorter.append(int(gone.sum()))
    assert shorter[0] and not shorter[2]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    own = sd.deduplicated(df, also=(sd.PASSAGE,), carry=("doc_id",)).collect()
    assert {r["c_0"]: list(r["covered"]) for r in own} == {k: [n] for k, n in enumerate(shorter)}
    assert {(r["c_0"], r["n_bytes"], r["n_removed"], r["n_spans"]) for r in own} == {(k, *x[:3]) for k, x in enumerate(brute(texts, sd.WINDOW))}


def test_very_long_text(spark):
    rng = np.random.RandomState(3)
    body = rng.randint(97, 123, 4_500_000).astype(np.uint8)
    body[4_400_000:4_400_900] = body[1000:1900]  # a repeat on both sides of the search's piece bound
    long = body.tobytes().decode()
    df = spark.createDataFrame([(1, long), (2, "short"), (3, long[4_194_000:4_194_600])], "doc_id long, text string")
    own = {r["c_0"]: r for r in sd.deduplicated(df, carry=("doc_id",)).collect()}
    assert (own[1]["n_removed"], own[1]["n_spans"], own[3]["n_removed"], own[2]["n_removed"]) == (1800 + 600, 3, 600, 0)
    assert bytes(own[1]["kept"]) == (long[:1000] + long[1900:4_194_000] + long[4_194_600:4_400_000] + long[4_400_900:]).encode()


def test_documents(documents, spark):
    rows = documents.select("doc_id", "text").collect()
    wanted = brute([r["text"] for r in rows], sd.WINDOW)
    assert found(documents) == {(r["doc_id"], *x) for r, x in zip(rows, wanted)}


def test_null_ids_and_no_rows(docs, empty):
    assert sd.deduplicated(docs).count() == docs.count()
    assert sd.deduplicated(empty).count() == 0


def test_one_passage_in_thousands_of_documents(spark):
    """All runs around the passage have one inner chain; their ends differ, and some agree in parts."""
    rng = random.Random(21)
    passage = words(rng, 75)[:395]
    texts = []
    for k in range(5000):
        left, right = (f"{rng.randrange(10**6):06d}" if rng.random() < 0.7 else rng.choice("PQR") * 6 for _ in range(2))
        texts.append(left + passage + right)
    sizes = [len(b) for b in (t.encode() for t in texts)]
    assert len(set(sizes)) == 1
    found_rows = found(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4))
    assert found_rows == {(k, *x) for k, x in enumerate(brute(texts, sd.WINDOW))}
    assert len({r[2] for r in found_rows}) > 3


def test_zero_bytes_beside_a_passage(spark):
    rng = random.Random(4)
    passage = words(rng, 70)[:380]
    ends = ["\0" * 30, "\0" * 15 + "ab", "", "\0", "\0" * 22 + "ab", "ab" + "\0" * 9]
    check(spark, [a + passage + b for a in ends for b in ends])


def test_stages_go_before_ends_are_sorted(spark, documents, monkeypatch):
    folder = shared_dir(spark).removeprefix("file://")
    before, there, write = set(os.listdir(folder)), {}, sd.written

    def seen(df, name, *more):
        found = write(df, name, *more)
        there[name] = {x.split("-", 2)[2] for x in set(os.listdir(folder)) - before}
        return found

    monkeypatch.setattr(sd, "written", seen)
    sd.deduplicated(documents, also=(sd.PASSAGE,))
    assert there["margins"] == {"sampled", "names", "settled", "ends", "margins"}
    assert there["ranges"] == {"names", "settled", "margins", "ranges"}


def test_parts_of_a_stage_are_read_as_one(spark):
    rows = spark.range(100)
    found = written(rows.where("id % 3 = 0"), "thirds", rows.where("id % 3 = 1"), rows.where("id % 3 = 2"))
    assert sorted(r["id"] for r in found.collect()) == list(range(100))
