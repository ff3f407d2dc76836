"""Two words whose polynomial hashes modulo 2**64 agree whatever the base: a Thue-Morse word and its complement.  No operator may take one for the other."""

from tokenizers import Tokenizer

from leadloom.llm import bpe, language_model, near_dups, packing, quality, suffix_dedup, token_counts, toxicity
from leadloom.llm.blocks import distinct_spans, span_hashes
from leadloom.llm.tokens import encoder, tokenizer_path

FIRST = "".join("ab"[k.bit_count() % 2] for k in range(1024))
OTHER = FIRST.translate(str.maketrans("ab", "ba"))


def frame(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)


def block(*texts):
    import numpy as np

    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])


def test_hashes_differ_and_bytes_are_compared(monkeypatch):
    data, offsets = block(FIRST, OTHER, FIRST)
    hashes = span_hashes(data, offsets[:-1], offsets[1:])
    assert hashes[0] == hashes[2] != hashes[1]
    import numpy as np

    from leadloom.llm import blocks

    real = blocks.span_hashes
    # With a first hash that takes all spans for one, the bytes still part them.
    monkeypatch.setattr(blocks, "span_hashes", lambda d, a, b, seed=0: real(d, a, b, seed) if seed else np.zeros(len(a), np.uint64))
    first, which = distinct_spans(data, offsets[:-1], offsets[1:])
    assert len(first) == 2 and which[0] == which[2] != which[1]


def test_ids(spark):
    texts = [f"{FIRST} and {OTHER}", OTHER, FIRST]
    word, byte = tokenizer_path("word_bpe_49k.json"), tokenizer_path("byte_bpe_50k.json")
    library = Tokenizer.from_file(word)
    for r in bpe.encode(frame(spark, *texts), word).collect():
        ids = library.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        assert [int.from_bytes(bytes(r["ids"])[k : k + 4], "little") for k in range(0, len(r["ids"]), 4)] == ids
    library = Tokenizer.from_file(byte)
    own = [library.encode(t, add_special_tokens=False).ids for t in texts]
    flat, bounds = encoder(byte).encode(*block(*texts))
    assert [flat[a:b].tolist() for a, b in zip(bounds, bounds[1:])] == own
    lengths = token_counts.length_table(token_counts.encoded_lengths(frame(spark, *texts), byte)).collect()
    assert sum(r["tokens"] for r in lengths) == sum(map(len, own))
    assert sum(r["length"] for r in packing.packed_documents(frame(spark, *texts), byte).collect()) == sum(map(len, own)) + 3


def test_sets_lines_words_and_strings(spark):
    found = {r["doc_id"]: r["component_id"] for r in near_dups.linked(frame(spark, FIRST, OTHER, FIRST)).collect()}
    assert found == {0: 0, 1: 1, 2: 0}
    counts = quality.text_counts(*block(f"{FIRST}\n{OTHER}\n{FIRST}"))
    assert counts["n_dup_lines"].tolist() == [1]
    tokens, _ = language_model.token_hashes(*block(f"{FIRST} {OTHER}"))
    assert len(set(tokens.tolist())) == 3
    rows = {r["c_0"]: r["n_removed"] for r in suffix_dedup.deduplicated(frame(spark, "x" + FIRST[:500], OTHER[:500] + "y"), carry=("doc_id",)).collect()}
    seen = [("x" + FIRST[:500])[k : k + 400] for k in range(102)] + [(OTHER[:500] + "y")[k : k + 400] for k in range(102)]
    assert (rows[0] > 0) == (len(set(seen)) < len(seen))


def test_ordinal_fit_orders_grades():
    """Rows with the stronger marks get the higher expected severity, and thresholds ascend."""
    rows = [(0, [], k % 2, 30) for k in range(2)] + [(1, [0], k % 2, 6) for k in range(2)] + [(1, [0, 1], k % 2, 6) for k in range(2)] + [(0, [1], k % 2, 2) for k in range(2)]
    weights, cuts = toxicity.ordinal_fit(rows, 2)
    model = toxicity.SeverityModel([0, 1], weights, cuts)
    import numpy as np

    severity = model.above(np.array([0.0, weights[0], weights.sum()])).sum(axis=1)
    assert cuts[0] < cuts[1] and severity[0] < severity[1] <= severity[2] and severity[0] < 0.5 < severity[1]
