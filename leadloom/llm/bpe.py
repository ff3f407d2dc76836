"""BPE encoding and decoding through a minimal acyclic transducer lexicon.

Frequent words are counted over the whole corpus and compiled into the
transducer; other words are merged exactly.  A word here is a run of bytes
other than ASCII white space: no token of a word-end BPE spans two of them.

Null and empty texts have no ids and decode to an empty text.  Repeated rows
give repeated results; an empty table gives no rows.
"""

from __future__ import annotations

import os
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship
from .blocks import distinct_spans, find_words
from .lexicon import Lexicon, Merger, compile_lexicon
from .tokens import gather, text_blocks

#: Words in the lexicon, and the longest word in it: they bound what the driver and each executor hold.
LEXICON_WORDS = 50_000
LEXICON_WORD_BYTES = 48

_mergers: dict[str, Merger] = {}
_lexicons: dict[str, Lexicon] = {}


def merger(path: str) -> Merger:
    if path not in _mergers:
        _mergers[path] = Merger(path)
    return _mergers[path]


def distinct_words(data: np.ndarray, offsets: np.ndarray):
    """First place of each distinct word of the block, which word each place has, and the documents' bounds."""
    start, stop, at = find_words(data, offsets)
    first, inverse = distinct_spans(data, start, stop)
    return start, stop, first, inverse, at


def word_counts(docs: DataFrame, *, text: str = "text") -> DataFrame:
    """word, n: occurrences in all texts, pre-summed in each block."""

    def count(batches):
        for _, offsets, data in text_blocks(batches):
            start, stop, first, inverse, _ = distinct_words(data, offsets)
            n = np.bincount(inverse, minlength=len(first)).astype(np.int64)
            short = np.flatnonzero((stop - start)[first] <= LEXICON_WORD_BYTES)
            raw = data.tobytes()
            words = [raw[a:b] for a, b in zip(start[first[short]].tolist(), stop[first[short]].tolist())]
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array(n[short])], ["word", "n"])

    return docs.select(docs[text].cast("string").alias("text")).mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def publish_lexicon(docs: DataFrame, tokenizer: str, *, words: int = LEXICON_WORDS, text: str = "text") -> str:
    """Compile the most frequent words and hand the file to all executors; returns its name."""
    spark = docs.sparkSession
    top = word_counts(docs, text=text).orderBy(F.col("n").desc(), "word").limit(words).collect()  # at most `words` rows
    merge = merger(tokenizer)
    entries = {bytes(r["word"]): merge.encode(bytes(r["word"]).decode("utf-8", "replace")) for r in top}
    name = f"lexicon-{uuid.uuid4().hex}.npy"
    path = os.path.join(tempfile.mkdtemp(prefix="leadloom-"), name)
    np.save(path, compile_lexicon(entries))
    spark.sparkContext.addFile(path)
    return name


def lexicon(name: str) -> Lexicon:
    if name not in _lexicons:
        _lexicons.clear()
        _lexicons[name] = Lexicon(np.load(SparkFiles.get(name), mmap_mode="r"))
    return _lexicons[name]


def encode(docs: DataFrame, tokenizer: str, *, words: int = LEXICON_WORDS, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, ids (little-endian unsigned 32-bit integers) and the text decoded from them."""
    ship(docs.sparkSession)
    name = publish_lexicon(docs, tokenizer, words=words, text=text)

    def work(batches):
        merge, known = merger(tokenizer), lexicon(name)
        tokens = [x.encode() + b" " for x in merge.names]
        token_length = np.fromiter(map(len, tokens), np.int64, len(tokens))
        token_start = np.cumsum(token_length) - token_length
        token_bytes = np.frombuffer(b"".join(tokens), np.uint8)
        for rows, offsets, data in text_blocks(batches):
            start, stop, first, inverse, at = distinct_words(data, offsets)
            numbers = known.numbers(data, start[first], stop[first])
            unseen = np.flatnonzero(numbers < 0)
            raw = data.tobytes()
            merged = [merge.encode(raw[a:b].decode("utf-8", "replace")) for a, b in zip(start[first[unseen]].tolist(), stop[first[unseen]].tolist())]
            known_ids, known_length = known.ids_of(numbers[numbers >= 0])
            length = np.empty(len(first), np.int64)
            length[numbers >= 0] = known_length
            length[unseen] = np.fromiter(map(len, merged), np.int64, len(merged))
            where = np.empty(len(first), np.int64)
            where[numbers >= 0] = np.cumsum(known_length) - known_length
            where[unseen] = len(known_ids) + np.cumsum(length[unseen]) - length[unseen]
            flat = np.concatenate([known_ids, np.fromiter((i for x in merged for i in x), np.int64)]) if merged else known_ids
            ids = gather(flat, where[inverse], length[inverse])
            bounds = np.concatenate([[0], np.cumsum(length[inverse])])[at]
            text_out = gather(token_bytes, token_start[ids], token_length[ids]).tobytes()
            text_bounds = np.concatenate([[0], np.cumsum(token_length[ids])])[bounds]
            packed = ids.astype("<u4").tobytes()
            yield pa.RecordBatch.from_arrays(
                [
                    rows.column(0),
                    pa.array([packed[4 * a : 4 * b] for a, b in zip(bounds.tolist(), bounds[1:].tolist())], pa.binary()),
                    pa.array([text_out[a : max(a, b - 1)].decode() for a, b in zip(text_bounds.tolist(), text_bounds[1:].tolist())], pa.string()),
                ],
                ["doc_id", "ids", "decoded"],
            )

    return docs.select(docs[key].cast("long").alias("doc_id"), docs[text].cast("string").alias("text")).mapInArrow(work, "doc_id long, ids binary, decoded string")
