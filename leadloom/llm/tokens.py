"""Byte-level BPE ids of whole texts, worked out once per distinct chunk and worker.

A chunk is a run of white space with the run of other characters behind it.  A
byte-level pre-tokenizer never joins two chunks, so the ids of a text are the
ids of its chunks in a row.  The tokenizer sees each new chunk once, many of
them as one text, whose ids are parted by the bytes that they stand for; an
Arrow batch then gathers ids with numpy.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from .blocks import IS_SEPARATOR, column_bytes, distinct_spans, document_blocks, equal_spans, span_hashes

#: A worker forgets its chunks beyond this number or so many bytes of them: memory stays bounded, results don't change.
CHUNKS_KEPT, BYTES_KEPT = 1_000_000, 1 << 25
#: New chunks that the tokenizer gets as one text.
JOINED = 64


def text_blocks(batches, column: str = "text", limit: int = 1 << 21) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of at most ``limit`` bytes of text with their offsets and bytes."""
    for batch in batches:
        offsets, data = column_bytes(batch.column(batch.schema.get_field_index(column)))
        for a, b in document_blocks(offsets, limit):
            yield batch.slice(a, b - a), offsets[a : b + 1] - offsets[a], data[offsets[a] : offsets[b]]


#: White space beyond ASCII in UTF-8: first byte, then second byte with the third bytes (none: two bytes in all).  Fixed values.
WIDE_SPACES = {
    0xC2: [(0x85, []), (0xA0, [])],
    0xE1: [(0x9A, [0x80])],
    0xE2: [(0x80, [*range(0x80, 0x8B), 0xA8, 0xA9, 0xAF]), (0x81, [0x9F])],
    0xE3: [(0x80, [0x80])],
}


def white_space(data: np.ndarray) -> np.ndarray:
    """True for each byte of a Unicode white-space character in UTF-8."""
    space = IS_SEPARATOR[data]
    if not (data >= 0xC2).any():
        return space
    wide = np.zeros(len(data) + 2, np.uint8)
    wide[: len(data)] = data
    for lead, sets in WIDE_SPACES.items():
        at = np.flatnonzero(data == lead)
        second, third = wide[at + 1], wide[at + 2]
        for a, last in sets:
            found = at[(second == a) & (np.isin(third, last) if last else True)]
            for k in range(3 if last else 2):
                space[found + k] = True
    return space


def chunk_starts(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start of every chunk, each document's first chunk number (one more than documents), and which bytes are white space."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(len(offsets), np.int64), np.zeros(0, bool)
    space = white_space(data)
    begins = space.copy()
    begins[1:] &= ~space[:-1]
    begins[offsets[:-1][offsets[:-1] < len(data)]] = True
    start = np.flatnonzero(begins)
    return start, np.searchsorted(start, offsets), space


def is_utf8(raw: bytes) -> bool:
    try:
        raw.decode()
    except UnicodeDecodeError:
        return False
    return True


def gather(flat: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The pieces flat[start:start+length] in a row."""
    total = int(length.sum())
    ends = np.cumsum(length)
    return flat[np.repeat(start - (ends - length), length) + np.arange(total)]


class Growing:
    """An array that grows at its end."""

    def __init__(self, *first: int, kind: type):
        self.held, self.size = np.array(first, kind), len(first)

    def add(self, values: np.ndarray) -> None:
        size = self.size + len(values)
        if size > len(self.held):
            self.held = np.concatenate([self.held[: self.size], np.zeros(max(size, 2 * self.size) - self.size, self.held.dtype)])
        self.held[self.size : size] = values
        self.size = size

    def last(self) -> int:
        return int(self.held[self.size - 1])


class ChunkEncoder:
    """Ids of chunks by a tokenizer file, remembered by the chunks' hashes and bytes."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        # A character of a byte-level token's name is a byte of its text; added tokens are named by their text.
        sizes = {i: len(x) for x, i in self.tokenizer.get_vocab().items()} | {i: len(x.content.encode()) for i, x in self.tokenizer.get_added_tokens_decoder().items()}
        self.token_bytes = np.zeros(max(sizes) + 1, np.int64)
        self.token_bytes[list(sizes)] = list(sizes.values())
        self.forget()

    def forget(self) -> None:
        self.hashes, self.numbers = np.zeros(0, np.uint64), np.zeros(0, np.int32)
        self.ids, self.id_bounds = Growing(kind=np.uint32), Growing(0, kind=np.int64)
        self.text, self.text_bounds = Growing(kind=np.uint8), Growing(0, kind=np.int64)

    def known(self, hashes: np.ndarray, data: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """Numbers of the chunks data[start:stop], -1 where a chunk is new; bytes are compared, not hashes alone."""
        out = np.full(len(hashes), -1, np.int64)
        if not len(self.hashes):
            return out
        place = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        found = np.flatnonzero(self.hashes[place] == hashes)
        number = self.numbers[place[found]].astype(np.int64)
        begin = self.text_bounds.held[number]
        size = self.text_bounds.held[number + 1] - begin
        end = np.cumsum(size) + len(data)
        same = equal_spans(np.concatenate([data, gather(self.text.held, begin, size)]), start[found], stop[found], end - size, end)
        out[found[same]] = number[same]
        return out

    def tokenized(self, raw: bytes, stop: np.ndarray, alone: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the chunks of ``raw``, which end at ``stop``, and how many each chunk has; the last ``alone`` chunks can't stand beside others."""
        edges = np.append(0, stop)
        for together in (JOINED, 1):
            cuts = np.append(np.arange(0, len(stop) - alone, together), np.arange(len(stop) - alone, len(stop) + 1))
            found = self.tokenizer.encode_batch_fast([raw[a:b].decode("utf-8", "replace") for a, b in zip(edges[cuts].tolist(), edges[cuts[1:]].tolist())], add_special_tokens=False)
            ids = [np.array(x.ids, np.uint32) for x in found]
            flat = np.concatenate(ids)
            if together > 1:
                # Tokens end where chunks do, but for bytes that are no UTF-8, whose stand-ins have other sizes: their chunks go one by one.
                reached = np.cumsum(self.token_bytes[flat])
                until = np.searchsorted(reached, stop, "right")
                if is_utf8(raw) and len(reached) and (reached[until - 1] == stop).all() and until[-1] == len(reached):
                    return flat, np.diff(until, prepend=0)
        return flat, np.fromiter(map(len, ids), np.int64, len(ids))

    def learn(self, hashes: np.ndarray, data: np.ndarray, start: np.ndarray, stop: np.ndarray, alone: int) -> None:
        size = stop - start
        text = gather(data, start, size)
        ids, length = self.tokenized(text.tobytes(), np.cumsum(size), alone)
        base = self.text_bounds.size - 1
        self.ids.add(ids)
        self.id_bounds.add(self.id_bounds.last() + np.cumsum(length))
        self.text.add(text)
        self.text_bounds.add(self.text_bounds.last() + np.cumsum(size))
        # Of chunks with equal hashes one is found again, the others are new each time.
        own, at = np.unique(hashes, return_index=True)
        place = np.searchsorted(self.hashes, own)
        free = np.append(self.hashes, 0)[place] != own if len(self.hashes) else np.ones(len(own), bool)
        free |= place == len(self.hashes)
        self.hashes = np.insert(self.hashes, place[free], own[free])
        self.numbers = np.insert(self.numbers, place[free], (base + at[free]).astype(np.int32))

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the block's documents in a row, and their bounds (one more than documents)."""
        start, at, space = chunk_starts(data, offsets)
        if not len(start):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        stop = np.append(start[1:], len(data))
        first, inverse = distinct_spans(data, start, stop)
        start, stop = start[first], stop[first]
        if self.text_bounds.size + len(first) > CHUNKS_KEPT or self.text.size > BYTES_KEPT:
            self.forget()
        hashes = span_hashes(data, start, stop)
        number = self.known(hashes, data, start, stop)
        new = np.flatnonzero(number < 0)
        if len(new):
            # Between others a chunk begins with white space and ends without.
            inside = space[start[new]] & ~space[stop[new] - 1]
            new = np.concatenate([new[inside], new[~inside]])
            number[new] = self.text_bounds.size - 1 + np.arange(len(new))
            self.learn(hashes[new], data, start[new], stop[new], int((~inside).sum()))
        length = (self.id_bounds.held[number + 1] - self.id_bounds.held[number])[inverse]
        bounds = np.concatenate([[0], np.cumsum(length)])[at]
        return gather(self.ids.held, self.id_bounds.held[number][inverse], length), bounds


_encoders: dict[str, ChunkEncoder] = {}


def encoder(path: str) -> ChunkEncoder:
    if path not in _encoders:
        _encoders[path] = ChunkEncoder(path)
    return _encoders[path]


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
