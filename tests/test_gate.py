"""The automaton against regular expressions, and the towing dictionaries on texts of our own."""

import random
import re

import pytest

from leadloom.functions.text import normal
from leadloom.operators import gate, towing

REQUESTS = [
    "Szukam pilnie lawety z Opola do Nysy, auto nie odpala",
    "Kto przewiezie auto z Lipska? Skoda Octavia po stłuczce, kontakt na priv",
    "Potrzebna laweta na A2, bus stoi na poboczu",
    "Transport samochodu z Niemiec do Polski, ktoś jedzie? Audi na kołach",
    "Zepsuł się silnik w Passacie, stoimy na parkingu przy autostradzie, kto pomoże?",
    "Jest do odholowania Ford Transit, niesprawny, dzisiaj",
    "Motocykl po wypadku, trzeba ściągnąć spod warsztatu do domu",
    "Kupiłem auto na Copart, szukam przewozu z portu",
    "Ile kosztuje przewóz auta 46-020 do 30-001? Pilne",
    "Auto z Holandii do Krakowa, BMW, tel 601 202 303",
    "Suche Abschleppdienst von Essen nach Polen, Golf springt nicht an",
    "Wer kann mein Auto abholen? Panne auf der Autobahn",
    "Brauche dringend Autotransport, Opel Astra, Motorschaden",
    "Transporter liegen geblieben auf dem Parkplatz, heute noch nach Bremen bringen",
    "Überführung eines Anhängers aus Holland nach Deutschland, bitte melden",
    "PKW nicht fahrbereit, muss aus der Werkstatt geholt werden, Abholung sofort",
    "Hledám odtah z Plzně do Polska, auto nestartuje",
    "Hľadám prepravu auta z Nemecka na Slovensko",
    "Kdo odveze auto z parkoviště? Škoda po nehodě",
    "Porucha na dálnici, dodávka stojí na krajnici, nutně",
    "Potrebujem súrne odtiahnuť motorku, dialnica D1",
    "Převoz karavanu z Holandska, kdo jede?",
]
OTHERS = [
    "Szukam pracy jako kierowca, prawo jazdy B",
    "Wygraj bon w naszym konkursie!",
    "Już nieaktualne, dzięki wszystkim",
    "Sprzedam kanapę, stan dobry",
    "Oferuję lawetę, wolna laweta cały tydzień, auto i bus",
    "Wszystkiego najlepszego dla całej grupy",
    "ok",
    "Kto poleci dobrego dentystę w Opolu",
    "Wir bieten Transport in ganz Europa, Autos und Anhänger",
    "Suche Wohnung in Essen, zwei Zimmer",
    "Hat sich erledigt, vielen Dank",
    "Schönes Wochenende euch allen in der Gruppe",
    "Stellenangebot: Buchhalter in Bremen",
    "Hledám práci ve skladu, Plzeň",
    "Prodám byt po rekonstrukci",
    "Nabízím odtah nonstop, volná odtahovka",
    "Už vyřízeno, díky všem",
    "Krásný večer všem ve skupině",
]


def test_requests_pass_and_others_mostly_do_not(spark):
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(REQUESTS + OTHERS)], "id long, text string").repartition(2)
    found = {r["id"]: r for r in gate.orchestrated(rows, towing.PACKS).collect()}
    lost = [(REQUESTS[k], found[k]["layer"], found[k]["points"]) for k in range(len(REQUESTS)) if not found[k]["verdict"]]
    assert lost == []
    turned_down = [k for k in found if not found[k]["verdict"]]
    assert len(turned_down) >= 0.25 * len(found)
    assert sum(k >= len(REQUESTS) for k in turned_down) >= len(OTHERS) - 1
    assert {found[k]["layer"] for k in turned_down} == {"offer", "extinguish", "reject", "short", "score"}


def test_packs_have_some_hundred_terms_and_signs_that_fit():
    for pack in towing.PACKS:
        terms = [*pack.extinguish, *pack.accept, *pack.reject, *(r.pattern for r in pack.scores), *pack.demand, *pack.offer]
        assert len(terms) >= 200
        assert all(re.compile(gate.compiled(t)) for t in terms)
        assert all((r.weight < 0) == (r.label in ("BRAKE", "ASIDE")) for r in pack.scores)


def made(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("ab1") for _ in range(rng.randrange(1, 4)))
    term = lambda: rng.choice([word(), f"{word()} {word()}", f"{word()}*", f"{word()}=", f"{word()}.{word()}"])
    packs = [gate.RulePack(f"p{k}", extinguish=[term() + "x"], accept=[term() + "y"], reject=[term() + "z"], scores=[gate.Rule(term(), rng.choice([1, 2, -3]), rng.choice("LMN")) for _ in range(30)] + [gate.Rule(term(), -2, "O", rng.choice("LX")) for _ in range(3)], demand=[term()], offer=[term()]) for k in range(3)]
    texts = ["".join(rng.choice(["a", "b", "1", " ", "=", ".", "ax", "by", "1z"]) for _ in range(rng.randrange(0, 40))) for _ in range(150)]
    return packs, texts


@pytest.mark.parametrize("seed", range(3))
def test_automaton_equals_regular_expressions(spark, seed):
    packs, texts = made(seed)
    dictionary = gate.Dictionary(packs)
    rows = gate.bound(spark.createDataFrame([(k, t) for k, t in enumerate([*texts, None])], "id long, text string"), "text", dictionary)
    outs = [dictionary.points(rows[gate.HITS], k).alias(f"points{k}") for k in range(3)] + [dictionary.first(rows[gate.HITS], k, "accept").alias(f"first{k}") for k in range(3)]
    for r in rows.select("id", f"{gate.BOUND}.low", gate.HITS, *outs).collect():
        hit = lambda t: bool(re.search(gate.compiled(t), r["low"] or ""))
        assert r["hits"] == [k for k, t in enumerate(dictionary.terms) if hit(t)]
        for k, pack in enumerate(packs):
            labels = {x.label for x in pack.scores if hit(x.pattern)}
            assert r[f"points{k}"] == sum(x.weight for x in pack.scores if hit(x.pattern) and not (x.unless and x.unless in labels))
            assert r[f"first{k}"] == next((t for t in pack.accept if hit(t)), None)


def test_packs_from_a_table(spark):
    rows = [("de", 2, "scores", "auto", 3, "VEHICLE", None), ("de", 1, "accept", "suche", None, None, None), ("pl", 1, "scores", "auto", 2, None, "X")]
    table = spark.createDataFrame(rows, "pack string, place int, layer string, term string, weight int, label string, unless string")
    assert gate.packs_of(table) == [gate.RulePack("de", accept=["suche"], scores=[gate.Rule("auto", 3, "VEHICLE")]), gate.RulePack("pl", scores=[gate.Rule("auto", 2, "", "X")])]


def test_size_is_checked():
    with pytest.raises(ValueError):
        gate.Dictionary([gate.RulePack("x", accept=["a"] * (gate.MOST_TERMS + 1))])
    for term in ("", "*", "a" * 300):
        with pytest.raises(ValueError):
            gate.Dictionary([gate.RulePack("x", accept=[term])])


def test_a_brake_is_off_beside_its_label(spark):
    rows = spark.createDataFrame([(1, "ile kosztuje cos tam innego"), (2, "ile kosztuje holowanie auta")], "id long, text string")
    found = {r["id"]: r["points"] for r in gate.evaluate(rows, towing.POLISH).collect()}
    assert found == {1: -4, 2: 6}


def test_normal_text_is_what_terms_are_written_in(spark):
    texts = spark.createDataFrame([(t,) for t in REQUESTS], "text string")
    assert all(re.fullmatch(r"[ -~]*", r[0]) for r in texts.select(normal(texts["text"])).collect())
