"""Alignment of two tokenizers' tokens by the bytes at which they end.

Both tokenizers cut the same bytes: a space and the text.  A two-pointer merge of
the cumulative token ends gives the offsets where a token of each side ends; they
cut the tokens into groups, and the two tokens that end there are linked.  Links
are counted by pair of ids over the corpus, and counts and the maxima of each side
go back to the documents by joins.

The table of pairs is bounded: of two tokens that end together the shorter is the
end of the longer, so there are at most as many pairs as bytes in both
vocabularies (about half a million), whatever the corpus.  It is broadcast.

Null and empty texts, and those that a tokenizer does not give back byte for byte,
have no tokens: their counts are 0 and their groups are ''.  Repeated rows count
as often as they occur.  An empty table gives no rows.

A text is cut before each space behind other than white space.  Neither
tokenizer has a token over such a place (the piece vocabulary is looked through
for that), so a text's tokens are those of its chunks in a row, and each worker
encodes and aligns a distinct chunk once.
"""

from __future__ import annotations

import hashlib
import os
import re
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship, written
from .blocks import column_bytes, distinct_spans, document_blocks
from .tokens import gather, white_space

#: A worker forgets its chunks beyond this number: memory stays bounded, results don't change.
CHUNKS_KEPT = 600_000
#: Bytes of text that are aligned at once; a longer text is a block of its own.
BLOCK_BYTES = 1 << 21
#: A pair of ids as one number: a * PAIR + b.
PAIR = 1 << 32

SPACE_MARK = "▁"


def byte_alphabet() -> dict[str, int]:
    """The character that stands for each byte in byte-level vocabularies, the other way round.

    Printable characters of Latin-1 stand for themselves, the other bytes in order for those from 256 on.
    """
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class ByteSide:
    """A byte-level vocabulary in a file of the tokenizers library; special tokens' strings are plain text."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.tokenizer.encode_special_tokens = True
        of = byte_alphabet()
        self.pieces = [b""] * self.tokenizer.get_vocab_size(with_added_tokens=True)
        for name, k in self.tokenizer.get_vocab(with_added_tokens=True).items():
            self.pieces[k] = bytes(map(of.__getitem__, name)) if all(c in of for c in name) else name.encode()

    def ids(self, chunks: list[str]) -> list[list[int]]:
        return [x.ids for x in self.tokenizer.encode_batch_fast(chunks, add_special_tokens=False)]


class PieceSide:
    """A piece model in a file of the sentencepiece library, which puts a space before each text."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_file=path)
        self.space = self.model.piece_to_id(SPACE_MARK)
        names = [self.model.id_to_piece(k) for k in range(self.model.get_piece_size())]
        if any(re.search(f"[^{SPACE_MARK}]{SPACE_MARK}", x) for x in names):
            raise ValueError("a piece has a space behind another character: texts cannot be cut before spaces")
        self.pieces = [bytes([int(x[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", x) else x.replace(SPACE_MARK, " ").encode() for x in names]

    def ids(self, chunks: list[str]) -> list[list[int]]:
        """Chunks begin with a space, which the model adds itself, but not to an empty text."""
        found = self.model.encode([x[1:] for x in chunks], num_threads=1)
        return [p or [self.space] for p in found]


def _flat(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    length = np.fromiter(map(len, lists), np.int64, len(lists))
    return np.fromiter(chain.from_iterable(lists), np.int64, int(length.sum())), length


def _starts(length: np.ndarray) -> np.ndarray:
    return np.cumsum(length) - length


def common_ends(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places in two rising lists of ends at which both have the same end: a merge of the two."""
    at = np.searchsorted(b, a)
    same = at < len(b)
    same[same] = b[at[same]] == a[same]
    return np.flatnonzero(same), at[same]


class Spelled:
    """Texts of numbered entries in one buffer, to be put in a row."""

    def __init__(self, texts: list[bytes]):
        self.length = np.fromiter(map(len, texts), np.int64, len(texts))
        self.start = _starts(self.length)
        self.bytes = np.frombuffer(b"".join(texts), np.uint8)

    def row(self, numbers: np.ndarray) -> np.ndarray:
        return gather(self.bytes, self.start[numbers], self.length[numbers])


class Aligner:
    """Tokens, groups and links of chunks, remembered by their bytes; a chunk's groups each end in `;`."""

    def __init__(self, side_a, side_b):
        self.a, self.b = side_a, side_b
        self.pieces_a, self.pieces_b = Spelled(side_a.pieces), Spelled(side_b.pieces)
        # Ids in decimal with room for the mark behind them.
        self.decimal = Spelled([b"%d," % k for k in range(max(len(side_a.pieces), len(side_b.pieces)))])
        self.forget()

    def forget(self) -> None:
        self.number: dict[bytes, int] = {}
        empty = np.zeros(0, np.int64)
        self.n_a, self.n_b, self.n_links, self.start, self.links = empty, empty, empty, empty, empty
        self.group_start, self.group_length, self.group_bytes = empty, empty, np.zeros(0, np.uint8)
        self.exact = np.zeros(0, bool)

    def _given_back(self, chunks: list[bytes], sides) -> np.ndarray:
        """Whether both sides' tokens spell each chunk."""
        size = np.fromiter(map(len, chunks), np.int64, len(chunks))
        whole = np.frombuffer(b"".join(chunks), np.uint8)
        good = np.ones(len(chunks), bool)
        for flat, n, pieces in sides:
            spelled = pieces.row(flat)
            if len(spelled) == len(whole) and np.array_equal(spelled, whole):
                continue  # byte for byte, so each chunk too, if its tokens are as long as it is
            made = np.bincount(np.repeat(np.arange(len(chunks)), n), pieces.length[flat], len(chunks)).astype(np.int64)
            at, raw = _starts(made), spelled.tobytes()
            good &= np.fromiter((raw[p : p + m] == x for p, m, x in zip(at.tolist(), made.tolist(), chunks)), bool, len(chunks))
        for flat, n, pieces in sides:
            good &= np.bincount(np.repeat(np.arange(len(chunks)), n), pieces.length[flat], len(chunks)).astype(np.int64) == size
        return good

    def learn(self, chunks: list[bytes]) -> None:
        texts = [x.decode("utf-8", "replace") for x in chunks]
        (flat_a, n_a), (flat_b, n_b) = _flat(self.a.ids(texts)), _flat(self.b.ids(texts))
        exact = self._given_back(chunks, [(flat_a, n_a, self.pieces_a), (flat_b, n_b, self.pieces_b)])
        if not exact.all():
            # Chunks that are not given back count as if they had no tokens: their texts have none.
            flat_a, flat_b = flat_a[np.repeat(exact, n_a)], flat_b[np.repeat(exact, n_b)]
            n_a, n_b = np.where(exact, n_a, 0), np.where(exact, n_b, 0)
        # Chunks follow one another, so their ends rise through the whole list.
        end_a, end_b = np.cumsum(self.pieces_a.length[flat_a]), np.cumsum(self.pieces_b.length[flat_b])
        at_a, at_b = common_ends(end_a, end_b)
        links = flat_a[at_a] * PAIR + flat_b[at_b]
        n_links = np.bincount(np.searchsorted(np.cumsum(n_a), at_a, "right"), minlength=len(chunks)).astype(np.int64)
        # Tokens by group, those of a before those of b; the mark behind each tells what follows.
        group = np.concatenate([np.searchsorted(at_a, np.arange(len(flat_a))), np.searchsorted(at_b, np.arange(len(flat_b)))])
        marks = np.full(len(group), ord(","), np.uint8)
        marks[at_a], marks[len(flat_a) + at_b] = ord("|"), ord(";")
        order = np.argsort(group, kind="stable")
        ids = np.concatenate([flat_a, flat_b])[order]
        said = self.decimal.row(ids).copy()
        size = self.decimal.length[ids]
        said[np.cumsum(size) - 1] = marks[order]
        by_group = np.bincount(group[order], size, len(at_a)).astype(np.int64)
        bounds = np.concatenate([[0], np.cumsum(by_group)])[np.concatenate([[0], np.cumsum(n_links)])]
        base = len(self.n_a)
        add = lambda old, new: np.concatenate([old, new])
        self.group_start, self.group_length = add(self.group_start, len(self.group_bytes) + bounds[:-1]), add(self.group_length, np.diff(bounds))
        self.group_bytes = add(self.group_bytes, said)
        self.start = add(self.start, len(self.links) + _starts(n_links))
        self.links = add(self.links, links)
        self.n_a, self.n_b, self.n_links, self.exact = add(self.n_a, n_a), add(self.n_b, n_b), add(self.n_links, n_links), add(self.exact, exact)
        self.number.update(zip(chunks, range(base, base + len(chunks))))

    def groups(self, numbers: np.ndarray) -> bytes:
        """The groups of chunks in a row, each with `;` behind it."""
        return gather(self.group_bytes, self.group_start[numbers], self.group_length[numbers]).tobytes()

    def numbers(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The number of every chunk of the block, and each text's first chunk (one more than texts); texts begin with a space."""
        space = white_space(data)
        begins = data == 32
        begins[1:] &= ~space[:-1]
        begins[offsets[:-1]] = True
        start = np.flatnonzero(begins)
        first, which = distinct_spans(data, start, np.append(start[1:], len(data)))
        stop = np.append(start[1:], len(data))
        if len(self.number) + len(first) > CHUNKS_KEPT:
            self.forget()
        raw = data.tobytes()
        keys = [raw[p:q] for p, q in zip(start[first].tolist(), stop[first].tolist())]
        new = [x for x in keys if x not in self.number]
        if new:
            self.learn(new)
        return np.fromiter(map(self.number.__getitem__, keys), np.int64, len(keys))[which], np.searchsorted(start, offsets)


_aligners: dict[tuple[str, str], Aligner] = {}


def aligner(byte_level: str, piece_model: str) -> Aligner:
    key = (byte_level, piece_model)
    if key not in _aligners:
        _aligners[key] = Aligner(ByteSide(byte_level), PieceSide(piece_model))
    return _aligners[key]


def _spaced(texts: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of a space and the text, for texts that are not null or empty; nothing for the others."""
    return column_bytes(pa.array([" " + x if x else "" for x in texts], pa.large_string()))


def aligned(docs: DataFrame, byte_level: str, piece_model: str, *, text: str = "text", key: str = "doc_id", with_groups: bool = False) -> DataFrame:
    """A written table: key, n_a, n_b, n_groups, n_links, groups_sha256, the distinct linked pairs with their number, and the groups if asked.

    A group reads `a1,a2|b1`, groups are parted by `;`.  pairs holds a * PAIR + b.
    """
    ship(docs.sparkSession)
    schema = f"{key} long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<long>" + ", groups string" * with_groups

    def block(own: Aligner, names: pd.Series, offsets: np.ndarray, data: np.ndarray) -> pd.DataFrame:
        n = len(names)
        if len(data):
            full = np.flatnonzero(np.diff(offsets))
            number, at = own.numbers(data, np.append(offsets[full], len(data)))
        else:
            full, number, at = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(1, np.int64)
        doc = np.repeat(full, np.diff(at))
        good = np.ones(n, bool)
        good[doc[~own.exact[number]]] = False
        keep = good[doc]
        number, doc = number[keep], doc[keep]
        count = lambda each: np.bincount(doc, each[number], n).astype(np.int64)
        n_a, n_b, n_links = count(own.n_a), count(own.n_b), count(own.n_links)
        row = memoryview(own.groups(number))
        bound = np.concatenate([[0], np.cumsum(own.group_length[number])])[np.searchsorted(doc, np.arange(n + 1))].tolist()
        said = [row[p : max(p, q - 1)] for p, q in zip(bound, bound[1:])]
        links = gather(own.links, own.start[number], own.n_links[number])
        of = np.repeat(doc, own.n_links[number])
        order = np.lexsort((links, of))
        links, of = links[order], of[order]
        fresh = np.ones(len(links), bool)
        fresh[1:] = (links[1:] != links[:-1]) | (of[1:] != of[:-1])
        head = np.flatnonzero(fresh)
        times = np.diff(np.append(head, len(links)))
        cut = np.searchsorted(of[head], np.arange(1, n))
        out = {key: names, "n_a": n_a, "n_b": n_b, "n_groups": n_links, "n_links": n_links, "groups_sha256": [hashlib.sha256(x).hexdigest() if len(x) else "" for x in said], "pairs": np.split(links[head], cut), "times": np.split(times, cut)}
        return pd.DataFrame(out | ({"groups": [str(x, "ascii") for x in said]} if with_groups else {}))

    def work(frames):
        own = aligner(byte_level, piece_model)
        for frame in frames:
            offsets, data = _spaced(frame["text"])
            for p, q in document_blocks(offsets, BLOCK_BYTES):
                yield block(own, frame["id"].iloc[p:q].reset_index(drop=True).astype("Int64"), offsets[p : q + 1] - offsets[p], data[offsets[p] : offsets[q]])

    return written(docs.select(docs[key].cast("long").alias("id"), docs[text].cast("string").alias("text")).mapInPandas(work, schema), "aligned")


def pair_counts(rows: DataFrame) -> DataFrame:
    """pair, a, b, count and the highest count of each side (best_a, best_b): at most one row a byte of both vocabularies, written."""
    counts = rows.select(F.explode(F.arrays_zip("pairs", "times")).alias("x")).groupBy(F.col("x.pairs").alias("pair")).agg(F.sum("x.times").alias("count"))
    counts = written(counts.select("pair", F.shiftright("pair", 32).alias("a"), (F.col("pair") % PAIR).alias("b"), "count"), "pairs")
    best = [counts.groupBy(side).agg(F.max("count").alias(f"best_{side}")) for side in ("a", "b")]
    return written(counts.join(best[0], "a").join(best[1], "b"), "counts")


def scored(rows: DataFrame, counts: DataFrame, *, key: str = "doc_id") -> DataFrame:
    """The rows' numbers with n_best (links whose count is the highest of their b) and count_sum (over links)."""
    carried = [key, "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
    links = rows.select("*", F.monotonically_increasing_id().alias("row")).select("row", *carried, F.explode_outer(F.arrays_zip("pairs", "times")).alias("x"))
    links = links.select("row", *carried, F.col("x.pairs").alias("pair"), F.col("x.times").alias("times"))
    met = links.join(F.broadcast(counts.select("pair", "count", "best_b")), "pair", "left")
    total = lambda x: F.coalesce(F.sum(x), F.lit(0)).cast("long")
    return met.groupBy("row", *carried).agg(total(F.when(F.col("count") == F.col("best_b"), F.col("times")).otherwise(0)).alias("n_best"), total(F.col("count") * F.col("times")).alias("count_sum")).drop("row")


def alignment(docs: DataFrame, byte_level: str, piece_model: str) -> DataFrame:
    rows = aligned(docs, byte_level, piece_model)
    return scored(rows, pair_counts(rows))
