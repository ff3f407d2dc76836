"""Dictionaries for requests to tow and carry vehicles, in Polish, German and Czech with Slovak.

Phrases are made by rule from verbs and the things that are asked for, so a pack has
some hundred terms; `stem*` stands for every ending.  Normal texts have no accents.
"""

from __future__ import annotations

from itertools import product

from .gate import Rule, RulePack

#: Makes of vehicles and kinds of auctions, the same in every language.
MAKES = "audi bmw citroen dacia fiat ford honda hyundai iveco jeep kia mazda mercedes nissan opel peugeot renault seat skoda suzuki tesla toyota volvo vw volkswagen ducato sprinter transit crafter octavia passat golf astra".split()
SOURCES = "copart iaai autobid licyta* aukcj* auktion* aukc*".split()


def _phrases(*parts: str) -> list[str]:
    """Every combination of the parts' words, in order; words of a part are divided by `|`, an empty one is left out."""
    return [" ".join(x for x in words if x) for words in product(*(p.split("|") for p in parts))]


def _pack(name: str, *, asks: list[str], stops: list[str], rejects: list[str], scores: dict[str, tuple[int, str]], brakes: dict[str, tuple[int, str]], demand: list[str], offer: list[str]) -> RulePack:
    rules = [Rule(term, weight, label) for label, (weight, terms) in scores.items() for term in terms.split("|")]
    rules += [Rule(x, 3, "VEHICLE") for x in MAKES] + [Rule(x, 2, "SOURCE") for x in SOURCES]
    rules += [Rule(term, weight, "BRAKE", unless) for unless, (weight, terms) in brakes.items() for term in terms.split("|")]
    return RulePack(name, extinguish=stops, accept=asks, reject=rejects, scores=rules, demand=demand, offer=offer, phone=1)


POLISH = _pack(
    "pl",
    asks=_phrases("szukam|poszukuje|potrzebuje|potrzebna|potrzebny|pilnie szukam", "|pilnie", "lawety|laweta|pomocy drogowej|holowania|transportu auta|transport auta|autolawety") + _phrases("kto|ktos", "przewiezie|odholuje|sciagnie|przetransportuje", "auto|samochod|busa|motocykl"),
    stops=_phrases("juz", "nieaktualne|zalatwione|znalazlem|odwiezione") + ["dzieki za pomoc", "temat zamkniety", "zlecenie oddane", "zamykam temat"],
    rejects=_phrases("szukam|oddam|kupie", "pracy|mieszkania|pokoju|felg|opon") + _phrases("dam|wynajme|przyjme", "prace|mieszkanie|kierowce|biuro") + ["memy", "konkurs", "wygraj", "regulamin grupy", "administrator grupy", "zyczenia urodzinowe"],
    scores={
        "ACTION": (3, "laweta|lawety|lawete|holow*|odholow*|przewiez*|przewoz*|przetranspor*|sciagn*|zabrac auto|odbior auta|transport"),
        "VEHICLE": (3, "auto|auta|samochod*|osobowk*|bus|busa|motocykl*|przyczep*|ciagnik*|quad*"),
        "STATE": (2, "nie odpala|nie jedzie|niesprawn*|uszkodzon*|po wypadku|po stluczce|rozbit*|zepsu*|awari*|zlapalem gume|silnik padl|skrzynia padla"),
        "PLACE": (2, "autostrad*|na trasie|parking*|pobocz*|granic*|stacj*|warsztat*|pod domem|w rowie"),
        "ROUTE": (3, "z niemiec|do polski|z holandii|z belgii|z czech|do niemiec|z anglii|na trasie do"),
        "URGENT": (3, "pilne|pilnie|na juz|natychmiast|dzisiaj|dzis|jak najszybciej"),
        "CONTACT": (1, "telefon|tel|dzwoncie|prosze o kontakt|priv|pw"),
        "ASIDE": (-3, "tak z ciekawosci|teoretycznie|zartuje|pytam dla kolegi"),
    },
    brakes={"ACTION": (-4, "ile kosztuje|jaka cena|ile bierzecie"), "URGENT": (-2, "wczoraj|w zeszlym tygodniu|miesiac temu")},
    demand=["szukam", "potrzebuje", "potrzebny", "potrzebna", "poszukuje", "kto przewiezie", "kto odholuje", "czy ktos", "prosze o", "zlece"],
    offer=["oferuje", "oferujemy", "swiadcze uslugi", "polecam sie", "wolna laweta", "wolne miejsce na lawecie", "zapraszam do wspolpracy", "uslugi transportowe", "wracam pusty"],
)
GERMAN = _pack(
    "de",
    asks=_phrases("suche|brauche|benotige|gesucht", "|dringend|einen|eine", "abschleppdienst|abschleppwagen|abschlepper|autotransport|pannenhilfe|autotransporter") + _phrases("wer kann", "mein auto|meinen wagen|mein motorrad", "abschleppen|transportieren|abholen"),
    stops=_phrases("hat sich", "erledigt|gefunden") + ["schon erledigt", "danke an alle", "bereits vergeben", "auftrag vergeben"],
    rejects=_phrases("suche|biete|vermiete", "wohnung|zimmer|job|felgen|reifen") + ["gewinnspiel", "gruppenregeln", "fahrer gesucht", "alles gute zum geburtstag", "stellenangebot"],
    scores={
        "ACTION": (3, "abschlepp*|transport|transportieren|uberfuhr*|abholen|abholung|verladen|bergung"),
        "VEHICLE": (3, "auto|autos|wagen|pkw|transporter|motorrad*|anhanger*|wohnmobil*|traktor*"),
        "STATE": (2, "springt nicht an|fahrt nicht|defekt*|kaputt|unfall*|panne|motorschaden|getriebeschaden|liegen geblieben|nicht fahrbereit"),
        "PLACE": (2, "autobahn*|raststatte*|parkplatz*|standstreifen|grenze|tankstelle*|werkstatt*"),
        "ROUTE": (3, "nach polen|aus polen|von polen|nach osterreich|aus holland|nach tschechien|nach deutschland"),
        "URGENT": (3, "dringend|sofort|heute noch|schnellstmoglich|so schnell wie moglich"),
        "CONTACT": (1, "telefon|tel|anrufen|pn|bitte melden|whatsapp"),
        "ASIDE": (-3, "nur aus neugier|rein theoretisch|nur so gefragt"),
    },
    brakes={"ACTION": (-4, "was kostet|wie teuer|welcher preis"), "URGENT": (-2, "gestern|letzte woche|vor einem monat")},
    demand=["suche", "brauche", "benotige", "gesucht", "wer kann", "hat jemand"],
    offer=["wir bieten", "biete an", "freie kapazitat", "unsere leistungen", "noch platz frei", "gunstig anzubieten", "leerfahrt"],
)
CZECH_SLOVAK = _pack(
    "cs",
    asks=_phrases("hledam|hladam|potrebuji|potrebujem|shanim|zhanam", "|nutne|surne", "odtah|odtahovku|odtahovu sluzbu|prepravu auta|autotransport") + _phrases("kdo|kto", "odveze|odvezie|odtahne|pretahne", "auto|dodavku|motorku"),
    stops=_phrases("uz", "vyrizeno|vybavene|neaktualni|neaktualne") + ["diky vsem", "dakujem vsetkym", "zakazka zadana"],
    rejects=_phrases("hledam|hladam|prodam|predam", "praci|pracu|byt|podnajem|pneumatiky|disky") + ["soutez", "sutaz", "pravidla skupiny", "vsechno nejlepsi"],
    scores={
        "ACTION": (3, "odtah*|preprav*|prevoz|prevez*|odvez*|nalozit|pretah*|vytah*"),
        "VEHICLE": (3, "auto|auta|osobak*|dodavk*|motork*|vozidl*|prives*|karavan*|traktor*"),
        "STATE": (2, "nestartuje|nejede|nejde nastartovat|pokazen*|nabouran*|havarovan*|po nehode|porucha|nepojizdn*|nepojazdn*"),
        "PLACE": (2, "dalnic*|dialnic*|parkovist*|parkovisk*|krajnic*|benzink*|hranic*|servis*"),
        "ROUTE": (3, "do polska|z polska|z nemecka|do nemecka|z holandska|na slovensko|do cech"),
        "URGENT": (3, "nutne|surne|ihned|hned|dnes|co nejdrive|co najskor"),
        "CONTACT": (1, "telefon|tel|volejte|volajte|zavolat|sms"),
        "ASIDE": (-3, "jen ze zvedavosti|len zo zvedavosti|ciste teoreticky"),
    },
    brakes={"ACTION": (-4, "kolik stoji|kolko stoji|jaka je cena"), "URGENT": (-2, "vcera|minuly tyden|minuly tyzden")},
    demand=["hledam", "hladam", "potrebuji", "potrebujem", "shanim", "zhanam", "kdo odveze", "kto odvezie"],
    offer=["nabizim", "ponukam", "nabizime", "ponukame", "volna odtahovka", "volne misto", "jedu prazdny", "nase sluzby"],
)
PACKS = [POLISH, GERMAN, CZECH_SLOVAK]
