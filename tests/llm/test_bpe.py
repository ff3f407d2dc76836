import numpy as np
from tokenizers import Tokenizer

from leadloom.llm import bpe
from leadloom.llm.bpe import merger
from leadloom.llm.lexicon import Lexicon, compile_lexicon
from leadloom.llm.tokens import tokenizer_path

PATH = tokenizer_path("word_bpe_49k.json")


def check(df, words):
    tokenizer = Tokenizer.from_file(PATH)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    found = sorted(((r["doc_id"], bytes(r["ids"]), r["decoded"]) for r in bpe.encode(df, PATH, words=words).collect()), key=str)
    wanted = []
    for r in df.collect():
        ids = tokenizer.encode(r["text"] or "", add_special_tokens=False).ids
        wanted.append((r["doc_id"], np.array(ids, "<u4").tobytes(), tokenizer.decode(ids, skip_special_tokens=False)))
    assert found == sorted(wanted, key=str)


def test_equals_the_library_on_odd_texts(docs):
    check(docs, 40)


def test_equals_the_library_on_documents(documents):
    check(documents, 2000)


def test_no_lexicon_and_no_rows(docs, empty):
    check(docs, 0)
    assert bpe.encode(empty, PATH).count() == 0


def test_transducer_is_minimal_and_exact():
    words = {w.encode(): [k, k + 1] for k, w in enumerate(["tap", "taps", "top", "tops", "stop", "stops", "a"])}
    table = compile_lexicon(words)
    lexicon = Lexicon(table)
    # Suffixes are shared: far fewer arcs than letters.
    assert len(lexicon.keys) == 9
    probe = [*words, b"to", b"tapsx", b"", b"stopsa"]
    data = np.frombuffer(b"".join(probe), np.uint8)
    stop = np.cumsum([len(w) for w in probe])
    numbers = lexicon.numbers(data, np.array(stop - [len(w) for w in probe]), stop)
    assert (numbers[len(words) :] == -1).all()
    ids, length = lexicon.ids_of(numbers[: len(words)])
    assert ids.tolist() == [i for w in words for i in words[w]] and (length == 2).all()


def test_heap_and_plain_merges_agree_with_the_library_on_long_words():
    merge, tokenizer = merger(PATH), Tokenizer.from_file(PATH)
    for word in ["a" * 3000, "abc" * 500, "!?" * 400, "therein" * 60, "é" * 150]:
        assert merge.encode(word) == tokenizer.encode(word, add_special_tokens=False).ids
        parts = [merge.symbol[b] for b in word.encode()]
        assert merge._merged(list(parts)) == merge._merged_long(list(parts))
