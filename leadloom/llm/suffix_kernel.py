"""Sampled suffixes of byte texts: anchors, and the runs of windows between them.

A sample is a string of SAMPLE bytes; its anchor is the place whose eight bytes
have the least hash among those with a whole q-gram in the sample.  The anchor
depends on the sample's bytes only, so equal strings have equal anchors at equal
places.  Anchors lie at most q bytes apart: their q-grams leave no byte out.
"""

from __future__ import annotations

import numpy as np

from .blocks import BASE, U, lanes, mix

#: Bytes of a q-gram and of a sample; a sample has as many places for its anchor as a q-gram has bytes.
GRAM = 96
SAMPLE = 2 * GRAM - 1
#: Identifiers that a suffix's new one is made of: a chain of FAN**level anchors has a bucket at each level.
FAN = 4
#: Samples that are searched at a time: a piece's arrays stay in the processor's cache.
PIECE = 1 << 16


def sliding_argmin(keys: np.ndarray, width: int) -> np.ndarray:
    """For each window of ``width`` keys the place of its least key, the leftmost on ties of the upper 40 bits."""
    n = len(keys)
    m = n - width + 1
    tagged = (keys & ~U(0xFFFFFF)) | np.arange(n, dtype=U)
    padded = np.full(-(-n // width) * width, np.iinfo(U).max, U)
    padded[:n] = tagged
    grid = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return (np.minimum(back[:m], ahead[width - 1 : width - 1 + m]) & U(0xFFFFFF)).astype(np.int64)


def anchors(data: np.ndarray, offsets: np.ndarray):
    """Anchors of a block's documents in a row: document, place, and first sample of each (places count from the document's start)."""
    n = len(data)
    none = np.zeros(0, np.int64)
    if n < SAMPLE:
        return none, none, none
    owner, place, first = [], [], []
    for at in range(0, n - SAMPLE + 1, PIECE):
        stop = min(n, at + PIECE + SAMPLE - 1)
        keys = mix(lanes(data[at : min(n, stop + 8)])[: stop - at - GRAM + 1] * U(0x9FB21C651E98DF25) + U(1))
        own = sliding_argmin(keys, SAMPLE - GRAM + 1) + at
        # The samples inside a document follow one another: only its first one has another document's before it.
        fresh = np.ones(len(own), bool)
        fresh[1:] = own[1:] != own[:-1]
        low, high = np.searchsorted(offsets, [at, at + len(own)])
        fresh[offsets[low:high] - at] = True
        fresh = np.flatnonzero(fresh)
        start = fresh + at
        doc = np.searchsorted(offsets, start, "right") - 1
        inside = start + SAMPLE <= offsets[doc + 1]
        owner.append(doc[inside])
        place.append(own[fresh[inside]])
        first.append(start[inside])
    owner, place, first = (np.concatenate(x) for x in (owner, place, first))
    # An anchor that two pieces share comes once.
    fresh = np.ones(len(owner), bool)
    fresh[1:] = (place[1:] != place[:-1]) | (owner[1:] != owner[:-1])
    owner, place, first = owner[fresh], place[fresh], first[fresh]
    return owner, place - offsets[owner], first - offsets[owner]


def gram_hashes(data: np.ndarray, offsets: np.ndarray, owner: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Hash of each anchor's q-gram, which has whole lanes of eight bytes."""
    eight, start = lanes(data), offsets[owner] + place
    out = np.full(len(start), BASE, U)
    for k in range(0, GRAM, 8):
        out = mix((out ^ eight[start + k]) * U(0x9FB21C651E98DF25) + BASE)
    return out


def deepest(owner: np.ndarray, place: np.ndarray, window: int) -> np.ndarray:
    """For each anchor the last level that a chain over a run of windows reads there."""
    line = place + owner * (int(place.max(initial=0)) + window + 4 * GRAM)
    need = np.searchsorted(line, line + window + 2 * GRAM, "right") - np.arange(len(line))
    out = np.zeros(len(line), np.int8)
    level = 1
    while (long := np.flatnonzero(need >= FAN**level)).size:
        read = np.bincount(long, minlength=len(line) + 1) - np.bincount(long + need[long], minlength=len(line) + 1)
        out[np.cumsum(read[:-1]) > 0] = level
        level += 1
    return out


def runs(size: np.ndarray, bounds: np.ndarray, place: np.ndarray, first: np.ndarray, window: int):
    """Runs of windows that have the same first and the same last anchor.

    ``size`` has the bytes of each document, ``bounds`` its anchors.  Returns
    document, first window, windows behind it, first and last anchor within
    every window, and first and last anchor of a chain that covers all of the
    run's windows (-1 where the document has none).
    """
    docs = len(size)
    base = np.concatenate([[0], np.cumsum(size + window + 4 * GRAM)])[:-1]
    owner = np.repeat(np.arange(docs), np.diff(bounds))
    a, s = base[owner] + place, base[owner] + first
    late = window - SAMPLE
    cut = np.unique(np.concatenate([s[first <= size[owner] - window], (s - late)[(first >= late) & (first - late <= size[owner] - window)]]))
    doc = np.searchsorted(base, cut, "right") - 1
    last = np.empty(len(cut), np.int64)
    end = base[doc] + size[doc] - window
    last[:-1] = np.where(doc[1:] == doc[:-1], cut[1:] - 1, end[:-1])
    last[-1:] = end[-1:]
    low, high = np.searchsorted(s, cut, "right") - 1, np.searchsorted(s, cut + late, "right") - 1
    before, behind = np.searchsorted(a, cut, "right") - 1, np.searchsorted(a, last + window - GRAM)
    before = np.where(before >= bounds[doc], before, -1)
    behind = np.where(behind < bounds[doc + 1], behind, -1)
    return doc, cut - base[doc], last - cut, low, high, before, behind


def chains(levels: np.ndarray, low: np.ndarray, high: np.ndarray):
    """Two hashes that name the chain of anchors from ``low`` to ``high``, and whether it may occur twice.

    ``levels`` has a row of bucket identifiers for each level, -1 where a
    suffix is alone.  A chain is named by up to FAN buckets that leave no
    anchor out, and by its length.
    """
    there = (low >= 0) & (high >= 0)
    n = np.where(there, high - low + 1, 1)
    level = np.zeros(len(n), np.int64)
    while (deeper := n >= FAN ** (level + 1)).any():
        level += deeper
    there &= level < len(levels)
    level = np.minimum(level, len(levels) - 1)
    reach = FAN**level
    one, two = mix(n.astype(U) * BASE), mix(n.astype(U) + BASE)
    for k in range(FAN):
        bucket = levels[level, np.minimum(np.maximum(low, 0) + k * reach, np.maximum(high - reach + 1, 0))]
        there &= bucket >= 0
        one, two = mix((one ^ bucket.view(U)) * BASE), mix((two + bucket.view(U)) * U(0x9FB21C651E98DF25) + U(k))
    return one.view(np.int64), two.view(np.int64), there


def within(levels: np.ndarray, outer: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether a shared bucket reaches over the chain from ``low`` to ``high``, and whether this place is the bucket's first or last suffix.

    ``outer`` has a flag for each entry of ``levels``: the first or last suffix of its bucket.
    """
    there, at = (low >= 0) & (high >= 0), np.arange(levels.shape[1])
    covered, named = np.zeros(len(low), bool), np.zeros(len(low), bool)
    for level, bucket in enumerate(levels):
        for flags, out in ((bucket >= 0, covered), (outer[level], named)):
            last = np.maximum.accumulate(np.where(flags, at, -1))[np.maximum(low, 0)]
            out |= there & (last >= 0) & (last >= high - FAN**level + 1)
    return covered, named
