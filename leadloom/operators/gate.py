"""The rule gate: dictionaries of terms in layers, looked up by one automaton.

Layers: extinguish, pass and reject by first hit in the dictionary's order, then too
short, then the sum of weights against a threshold.  All terms of all packs make one
trie with failure links, so a text is read once however many terms there are; what
the hits mean is worked out by built-in functions.

Null texts have no hits and no verdict to score; empty ones are too short.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import first_phone, normal, postcodes
from ..params import DEFAULT, Params
from ..session import ship

#: Terms of all packs together: the automaton goes to every worker, so its size is checked.
MOST_TERMS, MOST_TERM_CHARS = 50_000, 200
LAYERS = ("extinguish", "accept", "reject", "scores", "demand", "offer")


@dataclass(frozen=True)
class Rule:
    """A term with its weight; ``unless`` names a label whose hits in the same pack switch the rule off."""

    pattern: str
    weight: int = 0
    label: str = ""
    unless: str = ""


@dataclass(frozen=True)
class RulePack:
    """Terms of a dictionary.  All match from a word's start, and to its end where they end in a letter or digit; `stem*` leaves the end open."""

    name: str
    extinguish: list[str] = field(default_factory=list)
    accept: list[str] = field(default_factory=list)
    reject: list[str] = field(default_factory=list)
    scores: list[Rule] = field(default_factory=list)
    demand: list[str] = field(default_factory=list)
    offer: list[str] = field(default_factory=list)
    phone: int = 0


#: A pack for the synthetic corpus.
SAMPLE = RulePack(
    "sample",
    extinguish=["all rights reserved", "licensed under"],
    accept=["password=", "the apache license"],
    reject=["idiot", "moron", "stupid"],
    scores=[Rule("the", 1, "PLACE"), Rule("and", 2, "ROUTE"), Rule("that", 2, "ACTION"), Rule("with", 3, "VEHICLE"), Rule("der", 2, "PLACE"), Rule("und", 3, "ROUTE"), Rule("pour", 3, "ACTION"), Rule("para", 3, "ACTION"), Rule("is it", 4, "CONTACT"), Rule("trash", -4, "BRAKE")],
    demand=["is", "are", "to be"],
    offer=["for", "by"],
)


def compiled(pattern: str) -> str:
    """The regular expression that says the same of a term."""
    literal = re.sub(r"([\\.^$|()\[\]{}+?*])", r"\\\1", pattern.removesuffix("*"))
    return r"(?:^|[^a-z0-9])(?:" + literal + ")" + (r"(?:$|[^a-z0-9])" if pattern[-1].isalnum() else "")


_automata: dict[tuple, object] = {}


def _automaton(terms: tuple[tuple[str, tuple[int, ...]], ...]):
    """Term (`*` at its end: open) and its numbers, as a trie with failure links that gives length, open and numbers."""
    key = (len(terms), hash(terms))
    if key not in _automata:
        import ahocorasick

        found: dict[str, list[tuple[bool, tuple[int, ...]]]] = {}
        for term, numbers in terms:
            text = term.removesuffix("*")
            found.setdefault(text, []).append((not text[-1].isalnum() or term != text, numbers))
        made = ahocorasick.Automaton()
        for text, kinds in found.items():
            made.add_word(text, (len(text), kinds))
        made.make_automaton()
        _automata.clear()
        _automata[key] = made
    return _automata[key]


#: Letters and digits, beside which a term does not match.
_INSIDE = frozenset("abcdefghijklmnopqrstuvwxyz0123456789")


def _numbers_in(text: str, automaton) -> list[int]:
    seen: set[int] = set()
    last = len(text) - 1
    for end, (size, kinds) in automaton.iter(text):
        if end >= size and text[end - size] in _INSIDE:
            continue
        inside = end < last and text[end + 1] in _INSIDE
        for open_, numbers in kinds:
            if open_ or not inside:
                seen.update(numbers)
    return sorted(seen)


class Dictionary:
    """The terms of packs, numbered in the order of packs, layers and terms."""

    def __init__(self, packs: list[RulePack]):
        self.packs = list(packs)
        self.terms: list[str] = []
        self.bounds: dict[tuple[int, str], tuple[int, int]] = {}
        for k, pack in enumerate(self.packs):
            for layer in LAYERS:
                own = [r.pattern for r in pack.scores] if layer == "scores" else getattr(pack, layer)
                self.bounds[k, layer] = (len(self.terms), len(self.terms) + len(own))
                self.terms += own
        if len(self.terms) > MOST_TERMS or any(len(x) > MOST_TERM_CHARS or not x.strip("* ") for x in self.terms):
            raise ValueError(f"at most {MOST_TERMS} terms of 1 to {MOST_TERM_CHARS} characters")

    def hits(self, low: Column) -> Column:
        """Numbers of the terms that a normal text holds, rising."""
        numbers: dict[str, list[int]] = {}
        for k, term in enumerate(self.terms):
            numbers.setdefault(term, []).append(k)
        terms = tuple((term, tuple(ks)) for term, ks in numbers.items())

        @F.pandas_udf("array<int>")
        def found(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            automaton = _automaton(terms) if terms else None
            for texts in batches:
                yield pd.Series([_numbers_in(x, automaton) if x and automaton else [] for x in texts], dtype=object)

        return found(low)

    def among(self, hits: Column, k: int, layer: str) -> Column:
        """The hits of a pack's layer."""
        a, b = self.bounds[k, layer]
        return F.filter(hits, lambda x: (x >= a) & (x < b)) if b > a else F.array().cast("array<int>")

    def any_of(self, hits: Column, layer: str) -> Column:
        """Whether any pack's layer is hit."""
        return reduce(lambda p, q: p | q, (F.size(self.among(hits, k, layer)) > 0 for k in range(len(self.packs))), F.lit(False))

    def first(self, hits: Column, k: int, layer: str) -> Column:
        """The layer's first term, in the pack's order, that is hit."""
        a, b = self.bounds[k, layer]
        if b == a:
            return F.lit(None).cast("string")
        return F.get(F.array(*map(F.lit, self.terms[a:b])), F.array_min(self.among(hits, k, layer)) - a)

    def points(self, hits: Column, k: int) -> Column:
        """Weights of the terms that are hit; rules whose ``unless`` is hit don't count."""
        a, _ = self.bounds[k, "scores"]
        rules = self.packs[k].scores
        if not rules:
            return F.lit(0)
        own = self.among(hits, k, "scores")
        weights = F.array(*(F.lit(r.weight) for r in rules))
        total = F.aggregate(own, F.lit(0), lambda acc, x: acc + F.get(weights, x - a))
        for label in sorted({r.unless for r in rules} - {""}):
            switch, held = ([F.lit(a + j) for j, r in enumerate(rules) if x(r) == label] for x in (lambda r: r.label, lambda r: r.unless))
            if switch:
                off = F.array_intersect(own, F.array(*held))
                total = total - F.when(F.arrays_overlap(own, F.array(*switch)), F.aggregate(off, F.lit(0), lambda acc, x: acc + F.get(weights, x - a))).otherwise(0)
        return total

    def labels(self, hits: Column, k: int) -> Column:
        """`LABEL:term(+weight)` of a pack's terms that are hit."""
        a, _ = self.bounds[k, "scores"]
        names = F.array(*(F.lit(f"{r.label}:{r.pattern}({r.weight:+d})") for r in self.packs[k].scores))
        return F.transform(self.among(hits, k, "scores"), lambda x: F.get(names, x - a))


def packs_of(rows: DataFrame) -> list[RulePack]:
    """Packs from a table of terms: pack, place (order in the pack), layer, term, weight, label and unless; at most MOST_TERMS rows."""
    found = rows.select("pack", "place", "layer", "term", "weight", "label", "unless").limit(MOST_TERMS + 1).collect()
    if len(found) > MOST_TERMS:
        raise ValueError(f"at most {MOST_TERMS} terms")
    packs: dict[str, RulePack] = {}
    for r in sorted(found, key=lambda r: (r["pack"], r["place"], r["term"])):
        pack = packs.setdefault(r["pack"], RulePack(r["pack"]))
        term = r["term"]
        getattr(pack, r["layer"]).append(Rule(term, r["weight"] or 0, r["label"] or "", r["unless"] or "") if r["layer"] == "scores" else term)
    return list(packs.values())


#: Columns that the gate adds, and the struct with the normal text and its hits that it needs meanwhile.
FOUND, BOUND = ("layer", "rule", "points", "verdict"), "__gate_text"
HITS = f"{BOUND}.hits"


def bound(df: DataFrame, text: str, dictionary: Dictionary, added: tuple[str, ...] = FOUND) -> DataFrame:
    """Adds a struct of the normal text, its hits, whether two postcodes or a phone number are in it; columns that the gate would hide are refused."""
    clash = sorted({*added, BOUND} & set(df.columns))
    if clash:
        raise ValueError(f"columns of these names would be hidden: {', '.join(clash)}")
    ship(df.sparkSession)

    def facts(low: Column) -> Column:
        # Most texts have no three digits in a row and never meet the larger patterns.
        digits = low.rlike("[0-9]{3}")
        return F.struct(low.alias("low"), F.when(digits, F.size(postcodes(low)) >= 2).otherwise(False).alias("codes"), F.when(digits, first_phone(low).isNotNull()).otherwise(False).alias("phone"))

    # A lambda binds the normal text once, and what stands below the automaton is worked out once.
    out = df.withColumn(BOUND, F.transform(F.array(normal(F.col(text))), facts)[0])
    return out.withColumn(BOUND, F.struct(f"{BOUND}.low", f"{BOUND}.codes", f"{BOUND}.phone", dictionary.hits(F.col(f"{BOUND}.low")).alias("hits")))


def score(dictionary: Dictionary, k: int) -> Column:
    """Points of a pack: its terms, 4 for two postcodes, and its weight for a phone number."""
    hits, pack = F.col(HITS), dictionary.packs[k]
    total = dictionary.points(hits, k) + F.when(F.col(f"{BOUND}.codes"), 4).otherwise(0)
    return (total + F.when(F.col(f"{BOUND}.phone"), pack.phone).otherwise(0) if pack.phone else total).cast("int")


def direction(dictionary: Dictionary) -> Column:
    """demand or offer, by any pack's words; unclear where both or neither speak.  A question mark is demand."""
    hits = F.col(HITS)
    wants, offers = dictionary.any_of(hits, "demand") | F.contains(F.col(f"{BOUND}.low"), F.lit("?")), dictionary.any_of(hits, "offer")
    return F.when(wants & ~offers, "demand").when(offers & ~wants, "offer").otherwise("unclear")


def judged(dictionary: Dictionary, k: int, text: Column, threshold: int, params: Params = DEFAULT) -> Column:
    """A struct of layer, rule, points and verdict of one pack, from the columns that ``bound`` adds."""
    hits = F.col(HITS)
    first = F.struct(*(dictionary.first(hits, k, layer).alias(c) for c, layer in zip("ear", ("extinguish", "accept", "reject"))), score(dictionary, k).alias("points"), (F.length(F.trim(text)) < params.min_length).alias("short"))

    def verdict(x: Column) -> Column:
        layer = F.when(x["e"].isNotNull(), "extinguish").when(x["a"].isNotNull(), "accept").when(x["r"].isNotNull(), "reject").when(x["short"], "short").otherwise("score")
        passes = F.when(x["e"].isNotNull(), False).when(x["a"].isNotNull(), True).when(x["r"].isNotNull() | x["short"], False).otherwise(x["points"] >= threshold)
        return F.struct(layer.alias("layer"), F.coalesce(x["e"], x["a"], x["r"]).alias("rule"), x["points"].alias("points"), passes.alias("verdict"))

    return F.transform(F.array(first), verdict)[0]


def evaluate(df: DataFrame, pack: RulePack = SAMPLE, *, text: str = "text", threshold: int = DEFAULT.gate_threshold, params: Params = DEFAULT) -> DataFrame:
    """Adds layer, rule, points and verdict; the caller's columns all stay, and clashing names are refused."""
    dictionary = Dictionary([pack])
    out = bound(df, text, dictionary).withColumn("__gate", judged(dictionary, 0, F.col(text), threshold, params))
    return out.select(*(out[c] for c in df.columns), "__gate.*")


def _ranked(own: Column, match: Column, order: int) -> Column:
    """A pack's verdict behind what it is compared by."""

    def with_rank(x: Column) -> Column:
        rank = [x["verdict"].cast("int").alias("ok"), x["rule"].isNotNull().cast("int").alias("named"), F.when(x["verdict"], x["points"]).otherwise(-x["points"]).alias("p"), match.alias("match"), F.lit(-order).alias("order")]
        return F.struct(*rank, *(x[c].alias(c) for c in FOUND))

    return F.transform(F.array(own), with_rank)[0]


def _best(dictionary: Dictionary, text: Column, threshold: int, lang: Column | None, params: Params) -> Column:
    matches = [F.coalesce(lang == pack.name, F.lit(False)).cast("int") if lang is not None else F.lit(0) for pack in dictionary.packs]
    return F.array_max(F.array(*(_ranked(judged(dictionary, k, text, threshold, params), match, k) for k, match in enumerate(matches))))


def resolved(df: DataFrame, packs: list[RulePack], *, text: str = "text", threshold: int = DEFAULT.gate_threshold, lang: str | None = None, params: Params = DEFAULT) -> DataFrame:
    """Best verdict over several packs: passes before rejects, named rules first, then points, then the text's own language; the earlier pack on ties."""
    dictionary = Dictionary(packs)
    out = bound(df, text, dictionary).withColumn("__gate", _best(dictionary, F.col(text), threshold, F.col(lang) if lang else None, params))
    return out.select(*(out[c] for c in df.columns), *(f"__gate.{c}" for c in FOUND))


def orchestrated(df: DataFrame, packs: list[RulePack], *, text: str = "text", threshold: int = DEFAULT.gate_threshold, lang: str | None = None, shadow: bool = False, params: Params = DEFAULT) -> DataFrame:
    """Adds layer, rule, points, verdict, direction and passes.

    An offer, by any pack's words, ends it before the layers; then any pack's
    extinguishing rule, the first in order; then the best verdict of all packs.
    In shadow mode everything passes and the verdict stays as it is.
    """
    dictionary = Dictionary(packs)
    out = bound(df, text, dictionary, (*FOUND, "direction", "passes"))
    stop = F.coalesce(*(dictionary.first(F.col(HITS), k, "extinguish") for k in range(len(packs))))
    out = out.withColumn("__gate", F.struct(direction(dictionary).alias("direction"), stop.alias("stop"), _best(dictionary, F.col(text), threshold, F.col(lang) if lang else None, params).alias("best")))
    offer, stopped = F.col("__gate.direction") == "offer", F.col("__gate.stop").isNotNull()
    best = F.col("__gate.best")
    verdict = ~offer & ~stopped & best["verdict"]
    return out.select(
        *(out[c] for c in df.columns), F.when(offer, "offer").when(stopped, "extinguish").otherwise(best["layer"]).alias("layer"), F.when(offer, None).otherwise(F.coalesce(F.col("__gate.stop"), best["rule"])).alias("rule"),
        best["points"].alias("points"), verdict.alias("verdict"), F.col("__gate.direction").alias("direction"), (verdict | F.lit(shadow)).alias("passes"),
    )


def pack_of(name: str, words: dict[str, dict[str, int]], *, brands: list[str] = (), brand_weight: int = 3, **layers: list[str]) -> RulePack:
    """A language's pack from its words by category with weights; brands, the same in every language, score too."""
    scores = [Rule(w, n, category) for category, own in words.items() for w, n in own.items()]
    return RulePack(name, scores=scores + [Rule(b, brand_weight, "BRAND") for b in brands], **layers)


#: Packs for the synthetic corpus's languages; brands are names that occur in all of them.
PACKS = [
    pack_of("en", {"PLACE": {"the": 1, "of": 1}, "ACTION": {"that": 2, "with": 2}, "BRAKE": {"trash": -4}}, brands=["river", "market"], extinguish=["all rights reserved"], accept=["the apache license"], reject=["idiot", "moron"], demand=["is it", "need"], offer=["we offer", "for sale"]),
    pack_of("de", {"PLACE": {"der": 2, "die": 1}, "ACTION": {"und": 3, "nicht": 2}, "BRAKE": {"ohne": -2}}, brands=["river", "market"], extinguish=["alle rechte"], accept=["im auftrag"], reject=["dumm"], demand=["suche", "brauche"], offer=["wir bieten", "biete"]),
    pack_of("fr", {"PLACE": {"dans": 2, "les": 1}, "ACTION": {"pour": 3, "une": 2}, "BRAKE": {"sans": -2}}, brands=["river", "market"], extinguish=["tous droits"], accept=["licence libre"], reject=["idiote"], demand=["cherche"], offer=["je propose", "offre"]),
    pack_of("es", {"PLACE": {"del": 2, "los": 1}, "ACTION": {"para": 3, "una": 2}, "BRAKE": {"sin": -2}}, brands=["river", "market"], extinguish=["todos los derechos"], accept=["licencia libre"], reject=["tonto"], demand=["busco"], offer=["ofrezco"]),
]
