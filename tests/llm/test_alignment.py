import hashlib
import random
from collections import Counter
from functools import lru_cache

import numpy as np
import pytest
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from leadloom.llm import alignment, queries
from leadloom.llm.tokens import tokenizer_path

A, B = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model")


@lru_cache
def libraries():
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, SentencePieceProcessor(model_file=B)


def token_bytes(text):
    """(id, bytes) of both sides by whole-text calls of the libraries; None where the bytes differ."""
    a, b = libraries()
    spaced = " " + text
    found = a.encode(spaced, add_special_tokens=False)
    of = alignment.byte_alphabet()
    left = [(i, bytes(of[c] for c in a.id_to_token(i)) if all(c in of for c in a.id_to_token(i)) else a.id_to_token(i).encode()) for i in found.ids]
    right = []
    for i in b.encode(text, num_threads=1):
        name = b.id_to_piece(i)
        right.append((i, bytes([int(name[3:5], 16)]) if b.is_byte(i) else name.replace("▁", " ").encode()))
    if any(b"".join(x for _, x in side) != spaced.encode() for side in (left, right)):
        return None
    return left, right


def brute(rows):
    """The query's rows for (doc_id, text) by walking both token lists with two pointers."""
    count, docs = Counter(), []
    for doc_id, text in rows:
        sides = token_bytes(text) if text else None
        groups, links = [], []
        if sides:
            i = j = end_a = end_b = 0
            own = ([], [])
            left, right = sides
            while i < len(left) or j < len(right):
                if end_a <= end_b and i < len(left):
                    end_a += len(left[i][1])
                    own[0].append(left[i][0])
                    i += 1
                else:
                    end_b += len(right[j][1])
                    own[1].append(right[j][0])
                    j += 1
                if end_a == end_b:
                    groups.append(",".join(map(str, own[0])) + "|" + ",".join(map(str, own[1])))
                    links.append((own[0][-1], own[1][-1]))
                    own = ([], [])
        count.update(links)
        docs.append((doc_id, *(map(len, sides) if sides else (0, 0)), groups, links))
    best = {}
    for (_, b), n in count.items():
        best[b] = max(best.get(b, 0), n)
    return sorted(((d, x, y, len(g), len(k), sum(count[p] == best[p[1]] for p in k), sum(count[p] for p in k), hashlib.sha256(";".join(g).encode()).hexdigest() if g else "") for d, x, y, g, k in docs), key=str)


def found(docs):
    return sorted(map(tuple, alignment.alignment(docs, A, B).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect()), key=str)


def test_equals_walking_whole_texts(spark, docs, texts):
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    assert any(token_bytes(t) is None for t in texts + ["a ▁ b"] if t)
    assert found(docs) == brute(rows)


def test_texts_that_are_not_given_back(spark):
    rows = [(1, "plain text"), (2, "a ▁mark"), (3, "plain text"), (4, "▁"), (5, " "), (6, "<|endoftext|> x <s></s><unk> <0x41>"), (7, None), (8, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = found(docs)
    assert got == brute(rows)
    assert [r[7] for r in got if r[0] in (2, 4, 7, 8)] == [""] * 4


def test_nothing_changes_when_a_worker_forgets(spark, texts, monkeypatch):
    own = alignment.aligner(A, B)
    blocks = [" " + t for t in texts if t] * 2
    data = [np.frombuffer(t.encode(), np.uint8) for t in blocks]
    numbers = [own.numbers(x, np.array([0, len(x)]))[0] for x in data]
    want = [own.groups(n) for n in numbers]
    monkeypatch.setattr(alignment, "CHUNKS_KEPT", 50)
    own.forget()
    for x, w in zip(data, want):
        assert own.groups(own.numbers(x, np.array([0, len(x)]))[0]) == w
    own.forget()


def test_groups_and_counts_of_the_operator(spark):
    rows = [(k, "the cat the cat") for k in range(5)] + [(9, "cat")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    table = alignment.aligned(docs, A, B, with_groups=True)
    for r in table.collect():
        assert hashlib.sha256(r["groups"].encode()).hexdigest() == r["groups_sha256"]
        assert sum(r["times"]) == r["n_links"]
    counts = {(r["a"], r["b"]): r for r in alignment.pair_counts(table).collect()}
    a, b = libraries()
    cat = counts[a.encode(" cat").ids[0], b.encode("cat")[0]]
    assert (cat["count"], cat["best_a"], cat["best_b"]) == (11, 11, 11)


def test_pairs_are_ends_of_one_another(spark, documents):
    """The bound on the table of pairs: the shorter of two linked tokens ends the longer."""
    own = alignment.aligner(A, B)
    table = alignment.pair_counts(alignment.aligned(documents, A, B)).collect()
    assert len(table) <= sum(map(len, own.a.pieces)) + sum(map(len, own.b.pieces)) < 1_000_000
    for r in table:
        x, y = own.a.pieces[r["a"]], own.b.pieces[r["b"]]
        assert x.endswith(y) or y.endswith(x)


def test_long_text_and_empty_table(spark, empty):
    rng = random.Random(2)
    rows = [(1, " ".join(rng.choice(["alpha", "beta", "gamma12", "é你"]) for _ in range(40_000)))]
    assert found(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows)
    assert found(empty) == []


@pytest.mark.parametrize("ends", [([], []), ([1, 3], []), ([1, 3, 5], [3, 4, 5])])
def test_common_ends(ends):
    p, q = alignment.common_ends(*(np.array(x, np.int64) for x in ends))
    assert [ends[0][i] for i in p] == [ends[1][j] for j in q] == sorted(set(ends[0]) & set(ends[1]))


def test_query(spark):
    folder = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(map(tuple, queries.op11_token_alignment(spark, folder).collect()), key=str) == brute(rows)
