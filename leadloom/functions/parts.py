"""Which of many strings a text holds anywhere, by one automaton over all of them."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Automata that a worker keeps.
KEPT = 16

_automata: dict[tuple[str, ...], object] = {}


def _automaton(parts: tuple[str, ...]):
    if parts not in _automata:
        import ahocorasick

        made = ahocorasick.Automaton()
        for place, part in enumerate(parts):
            made.add_word(part, place)
        made.make_automaton()
        if len(_automata) >= KEPT:
            _automata.clear()
        _automata[parts] = made
    return _automata[parts]


def parts_in(text: Column, parts: list[str], first: int = 0) -> Column:
    """Places in ``parts`` (none empty), counted from ``first``, of the strings that a text holds, each once and in order; none for null and empty texts.

    The strings go to every task: the caller bounds their number.
    """
    known = tuple(parts)

    @F.pandas_udf("array<int>")
    def found(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        automaton = _automaton(known) if known else None
        for texts in batches:
            yield pd.Series([sorted({first + place for _, place in automaton.iter(x)}) if x and automaton else [] for x in texts], dtype=object)

    return found(text)
