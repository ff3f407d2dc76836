"""The geocoder against one that goes through dictionaries question by question."""

import random

import pytest

from leadloom.functions import places
from leadloom.operators import geocoder

GAZETTEER = "at long, country string, code string, name string, region string, lat double, lng double, population long"
ASKED = "id long, code string, town string, text string, other string"
EXONYMS = {"abroad": "home city"}


def norm(name):
    table = str.maketrans(*places.letters())
    low = (name or "").lower().translate(table)
    return " ".join("".join(" " if c in "-–—./()" else c for c in low).split())


def bare(code):
    return "".join(c for c in code or "" if c not in " \t\n.-").upper()


def soft(rows, countries):
    return [r for r in rows if r["country"] in countries] or rows


def named(text):
    words = norm(text).split()
    return {c for c, stems in places.COUNTRY_NAMES.items() if any(w.startswith(stems) for w in words)}


def shaped(code):
    kinds = "".join("9" if c.isdigit() else "A" if c.isalpha() else c for c in (code or "").strip())
    return {"99-999": {"PL"}, "999 99": {"CZ", "SK"}, "9999 AA": {"NL"}}.get(kinds, set())


def sequential(q, gazetteer):
    codes, names = {}, {}
    for r in gazetteer:
        if r["code"]:
            codes.setdefault(bare(r["code"]), []).append(r)
        if r["name"]:
            names.setdefault(norm(r["name"]), []).append(r)
    wanted, hits = norm(q["town"]), codes.get(bare(q["code"]))
    if hits:
        left = hits
        same = [r for r in hits if wanted and norm(r["name"]) == wanted]
        for countries in (shaped(q["code"]), {r["country"] for r in same}, named(q["text"])):
            if len({r["country"] for r in left}) > 1:
                left = soft(left, countries)
        best = next((r for r in left if wanted and norm(r["name"]) == wanted), None) or next((r for r in left if r["country"] == "PL"), left[0])
        n = len({r["country"] for r in left})
        return ("unsure" if n > 1 else "code", best["country"], None, best["lat"], best["lng"], n)
    name, how = EXONYMS.get(wanted, wanted), "town"
    if name not in names:
        longer = [x for x in names if x.startswith(name) and 1 <= len(x) - len(name) <= 3] if len(name) >= 5 else []
        if len(longer) != 1:
            return ("none", None, None, None, None, 0)
        name, how = longer[0], "inflected"
    rows = names[name]
    counted = lambda r: sum(1 for x in rows if x["code"] and (x["country"], x["region"]) == (r["country"], r["region"]))
    found = [dict(r, codes=counted(r), population=r["population"] or 0) for r in rows if not r["code"]]
    if not found:
        seen = {}
        for r in rows:
            seen.setdefault((r["country"], r["region"]), []).append(r)
        mean = lambda g, c: sum(r[c] for r in g) / len(g)
        found = [dict(g[0], lat=mean(g, "lat"), lng=mean(g, "lng"), population=0, codes=len(g)) for g in seen.values()]
    from_codes = set()
    for code, country in places.codes_in(q["text"]):
        from_codes |= {country} if country != "?" else {r["country"] for r in codes.get(bare(code), [])}
    for countries in (from_codes, named(q["text"])):
        found = soft(found, countries)
    top = sorted(found, key=lambda r: -r["population"])
    best = top[0]
    if len(found) > 1:
        if best["population"] == 0:
            best = max(found, key=lambda r: r["codes"])
        elif best["population"] < 3 * max(1, top[1]["population"]):
            return ("none", None, None, None, None, len(found))
    return (how if how == "inflected" else "town" if len(found) == 1 else "unsure", best["country"], best["region"], best["lat"], best["lng"], len(found))


def made(seed):
    rng = random.Random(seed)
    names = ["Kozienka", "Koziebrod", "Home City", "Alpen", "Alpenau", "Łąki", "Laki", "Nowa Wies", "Beroun", "Berounka", "Xyz", None]
    codes = ["66-449", "664 49", "66449", "1010", "10-10", "1010 AB", "370 01", "37001", "05-820"]
    gaz = [
        dict(at=k, country=rng.choice(["PL", "DE", "CZ", "SK", "AT", "NL"]), code=rng.choice([*codes, None, None, ""]), name=rng.choice(names), region=rng.choice(["n", "s", ""]),
             lat=rng.randrange(90) / 2, lng=rng.randrange(90) / 2, population=rng.choice([None, 0, 5, 100, 1000, 400]))
        for k in range(rng.choice([6, 30, 60]))
    ]
    towns = [*names, "kozien", "kozienk", "kozie", "berou", "beroun", "ABROAD", "alpe", "alpena", "nowa", "(home) city", "", "nope"]
    texts = [None, "", "z Niemiec", "do Czech i Slowacji", "kod 1010 here", "load 664 49 there", "05-820 Piastow, Austria", "z 66449 Holandia"]
    asked = [dict(id=k % 190, code=rng.choice([*codes, "99999", None, None, "", " "]), town=rng.choice(towns), text=rng.choice(texts), other="x") for k in range(200)]
    return gaz, asked


@pytest.mark.parametrize("seed", range(4))
def test_equals_question_by_question(spark, seed):
    gaz, asked = made(seed)
    fields = [f.split()[0] for f in GAZETTEER.split(", ")]
    table = spark.createDataFrame([tuple(r[c] for c in fields) for r in gaz], GAZETTEER).repartition(3)
    rows = spark.createDataFrame([tuple(q.values()) for q in asked], ASKED).repartition(3)
    found = geocoder.geocoded(rows, table, exonyms=EXONYMS).collect()
    rounded = lambda x: None if x is None else round(x, 9)
    got = sorted(((r["id"], r["how"], r["country"], r["region"], rounded(r["lat"]), rounded(r["lng"]), r["candidates"]) for r in found), key=str)
    want = [(q["id"], *sequential(q, gaz)) for q in asked]
    assert got == sorted(((i, h, c, g, rounded(a), rounded(b), n) for i, h, c, g, a, b, n in want), key=str)


def test_all_answers_occur():
    kinds = set()
    for seed in range(4):
        gaz, asked = made(seed)
        kinds |= {sequential(q, gaz)[0] for q in asked}
    assert kinds == {"code", "town", "unsure", "inflected", "none"}


def test_labels_and_empty_tables(spark):
    table = spark.createDataFrame([(0, "PL", "66-449", "Skwir", "w", 1.0, 2.0, None), (1, "CZ", "664 49", "Osto", "m", 3.0, 4.0, None), (2, "DE", None, "Lahn", "r", 5.0, 6.0, 90), (3, "AT", None, "Lahn", "", 7.0, 8.0, 5)], GAZETTEER)
    rows = spark.createDataFrame([(1, "66449", None, None, ""), (2, None, "Lahn", None, ""), (3, None, "lahn", "z Niemiec", ""), (4, "664 49", "", None, "")], ASKED)
    assert {r["id"]: r["place"] for r in geocoder.geocoded(rows, table).collect()} == {1: "Skwir 66-449 (PL) or CZ", 2: "Lahn, r (DE) one of 2", 3: "Lahn, r (DE)", 4: "Osto 664 49 (CZ)"}
    assert [r["how"] for r in geocoder.geocoded(rows, table.limit(0)).collect()] == ["none"] * 4
    assert geocoder.geocoded(rows.limit(0), table).collect() == []
