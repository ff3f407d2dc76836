import random

import numpy as np
from tokenizers import Tokenizer

from leadloom.llm import tokens
from leadloom.llm.tokens import ChunkEncoder, tokenizer_path

PATH = tokenizer_path("byte_bpe_50k.json")
ODD = ["", " ", "\n \n", "a", " a", "a ", "  a  b\t\n", "x<|endoftext|>y", " <|endoftext|> <|endoftext|>", " a 　b\u0085", "it's 's 'S we'll", "\x00 \x00", " \U0001f600\U0001f600 é", "12 345 ---", " " + "long" * 5000, "long" * 5000]


def block(texts):
    raw = [t if isinstance(t, bytes) else t.encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])


def encoded(own, texts):
    ids, bounds = own.encode(*block(texts))
    return [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])]


def words(n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choices("abcdefghijéł,.'1", k=rng.randrange(1, 12))) for _ in range(n)]


def test_new_chunks_go_to_the_tokenizer_together():
    own, library, calls = ChunkEncoder(PATH), Tokenizer.from_file(PATH), []

    class Counted:
        def encode_batch_fast(self, texts, **options):
            calls.append(len(texts))
            return library.encode_batch_fast(texts, **options)

    own.tokenizer = Counted()
    text = " ".join(["", *dict.fromkeys(words(20_000, 1))])
    for _ in range(2):
        assert encoded(own, [text]) == [library.encode(text, add_special_tokens=False).ids]
    assert sum(calls) <= text.count(" ") / tokens.JOINED + 2  # and none for chunks that are known


def test_odd_chunks_have_the_ids_of_whole_texts(monkeypatch):
    monkeypatch.setattr(tokens, "CHUNKS_KEPT", 3000)
    own, library = ChunkEncoder(PATH), Tokenizer.from_file(PATH)
    for seed in range(6):
        texts = [*ODD, *(random.Random(seed).choice([" ", "\n\n", "  "]).join(words(50, 100 * seed + k)) + " " * (k % 2) for k in range(20))]
        random.Random(seed).shuffle(texts)
        assert encoded(own, texts) == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_chunks_with_equal_hashes_are_parted(monkeypatch):
    monkeypatch.setattr(tokens, "span_hashes", lambda data, start, stop: (stop - start).astype(np.uint64) % np.uint64(3))
    own, library = ChunkEncoder(PATH), Tokenizer.from_file(PATH)
    for seed in range(3):
        texts = [*ODD, " ".join(words(200, seed % 2))]
        assert encoded(own, texts) == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_bytes_that_are_no_utf8():
    library = Tokenizer.from_file(PATH)
    texts = [b" good \xff\xfe bad\xf0\x9f\x98 \x80", b"more \xe2\x82", " fine €".encode()]
    assert encoded(ChunkEncoder(PATH), texts) == [library.encode(t.decode("utf-8", "replace"), add_special_tokens=False).ids for t in texts]
