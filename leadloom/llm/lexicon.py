"""Minimal acyclic transducer from words to token ids, and exact merges for words outside it.

Words are added in sorted order; states with equal right languages are shared,
so the automaton is minimal.  Each arc carries the number of words that sort
before what it leads to: their sum along a path is the word's number, which
leads to its ids.  The transducer is one int64 array, mapped into memory from a
file that every executor holds once.
"""

from __future__ import annotations

import json
import unicodedata
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import regex

from .tokens import gather

#: Unicode's White_Space characters, as the tokenizer's patterns understand them.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PRE_TOKENS = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{SPACE}\p{{L}}\p{{N}}]+")

#: Rank of a pair that is never merged, and symbols beyond which a word is merged with a heap.
NO_RANK = 1 << 30
LONG = 200


class Merger:
    """Exact ids of any piece of text without white space at its ends, by the merges of a word-end BPE file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        vocabulary = model["model"]["vocab"]
        self.ids = vocabulary
        self.end = model["model"]["end_of_word_suffix"]
        self.rank = {tuple(pair): k for k, pair in enumerate(model["model"]["merges"])}
        added = {x["content"]: x["id"] for x in model["added_tokens"]}
        self.added = added
        self.splits = regex.compile("(" + "|".join(map(regex.escape, added)) + ")")
        names = {i: x for x, i in [*vocabulary.items(), *added.items()]}
        self.names = [names.get(i, "") for i in range(max(names) + 1)]
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in printable]
        self.symbol = {b: chr(b) for b in printable} | {b: chr(256 + k) for k, b in enumerate(rest)}
        self.word = lru_cache(1 << 18)(self._word)

    def _word(self, word: str) -> tuple[int, ...]:
        parts = [self.symbol[b] for b in word.encode("utf-8", "surrogatepass")]
        parts[-1] += self.end
        parts = self._merged(parts) if len(parts) <= LONG else self._merged_long(parts)
        return tuple(self.ids[p] for p in parts if p in self.ids)

    def _merged(self, parts: list[str]) -> list[str]:
        """Symbols after all merges: the pair of least rank, leftmost of equals, goes first."""
        rank = self.rank.get
        ranks = [rank(pair, NO_RANK) for pair in zip(parts, parts[1:])]
        while ranks and (best := min(ranks)) != NO_RANK:
            at = ranks.index(best)
            parts[at] += parts.pop(at + 1)
            del ranks[at]
            if at:
                ranks[at - 1] = rank((parts[at - 1], parts[at]), NO_RANK)
            if at < len(ranks):
                ranks[at] = rank((parts[at], parts[at + 1]), NO_RANK)
        return parts

    def _merged_long(self, parts: list[str]) -> list[str]:
        """The same with a heap and links: a run of a million letters takes seconds, not days."""
        n, rank = len(parts), self.rank.get
        after, before = [*range(1, n + 1)], [*range(-1, n - 1)]
        heap = [(r, k) for k, pair in enumerate(zip(parts, parts[1:])) if (r := rank(pair, NO_RANK)) != NO_RANK]
        heapify(heap)
        while heap:
            r, k = heappop(heap)
            to = after[k]
            if not parts[k] or to >= n or rank((parts[k], parts[to]), NO_RANK) != r:
                continue  # one of the two has been merged since
            parts[k] += parts[to]
            parts[to] = ""
            after[k] = after[to]
            if after[k] < n:
                before[after[k]] = k
            for a, b in ((before[k], k), (k, after[k])):
                if a >= 0 and b < n and (r := rank((parts[a], parts[b]), NO_RANK)) != NO_RANK:
                    heappush(heap, (r, a))
        return [x for x in parts if x]

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        for part in self.splits.split(text):
            if part in self.added:
                out.append(self.added[part])
            elif part:
                lowered = "".join(map(str.lower, unicodedata.normalize("NFC", part)))
                for word in PRE_TOKENS.findall(lowered):
                    out.extend(self.word(word))
        return out


def compile_lexicon(entries: dict[bytes, list[int]]) -> np.ndarray:
    """The transducer as one array: sizes, arc keys (state * 256 + byte), targets, outputs, final states, bounds of ids, ids."""
    register: dict[tuple, int] = {}
    arcs: list[dict[int, int]] = []
    final: list[bool] = []
    count: list[int] = []

    def settle(node: list) -> int:
        key = (node[0], tuple(sorted(node[1].items())))
        if key not in register:
            register[key] = len(arcs)
            arcs.append(node[1])
            final.append(node[0])
            count.append(node[0] + sum(count[t] for t in node[1].values()))
        return register[key]

    words = sorted(w for w in entries if w)
    path: list[list] = [[False, {}]]
    before = b""
    for word in [*words, b""]:
        shared = 0
        while shared < min(len(word), len(before)) and word[shared] == before[shared]:
            shared += 1
        for depth in range(len(before), shared, -1):
            path[depth - 1][1][before[depth - 1]] = settle(path.pop())
        for _ in word[shared:]:
            path.append([False, {}])
        if word:
            path[-1][0] = True
        before = word
    root = settle(path[0])
    keys, target, output = [], [], []
    for state, out in enumerate(arcs):
        seen = int(final[state])
        for byte, to in sorted(out.items()):
            keys.append(state * 256 + byte)
            target.append(to)
            output.append(seen)
            seen += count[to]
    ids = [entries[w] for w in words]
    bounds = np.cumsum([0, *map(len, ids)])
    flat = [i for x in ids for i in x]
    head = [root, len(keys), len(arcs), len(words), len(flat)]
    return np.concatenate([np.array(x, np.int64) for x in (head, keys, target, output, final, bounds, flat)])


class Lexicon:
    """Looks words up in a compiled transducer, all words of a batch at once."""

    def __init__(self, table: np.ndarray):
        self.root, n_arcs, n_states, self.n_words, n_ids = (int(x) for x in table[:5])
        cuts = np.cumsum([5, n_arcs, n_arcs, n_arcs, n_states, self.n_words + 1, n_ids])
        self.keys, self.target, self.output, self.final, self.bounds, self.ids = (table[a:b] for a, b in zip(cuts, cuts[1:]))

    def numbers(self, data: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """Number of each word data[start:stop], or -1."""
        out = np.full(len(start), -1, np.int64)
        if not len(self.keys):
            return out
        live = np.arange(len(start))
        state, number, at = np.full(len(start), self.root, np.int64), np.zeros(len(start), np.int64), start.copy()
        while len(live):
            ended = at >= stop[live]
            done = live[ended]
            out[done] = np.where(self.final[state[ended]] > 0, number[ended], -1)
            live, state, number, at = live[~ended], state[~ended], number[~ended], at[~ended]
            if not len(live):
                break
            key = state * 256 + data[at]
            arc = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            known = self.keys[arc] == key
            live, at, arc = live[known], at[known] + 1, arc[known]
            state, number = self.target[arc], number[known] + self.output[arc]
        return out

    def ids_of(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids in a row and how many each word has."""
        length = self.bounds[numbers + 1] - self.bounds[numbers]
        return gather(self.ids, self.bounds[numbers], length), length
