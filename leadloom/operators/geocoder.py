"""Postcodes and names of places to points, with what is known of how sure a point is.

The gazetteer becomes two tables with one row a key: places by code and places by
name, each holding its candidates in the order of the gazetteer.  A question meets
one row of each by equal keys, and evidence (the code's shape, the name beside it,
codes and countries in the text) narrows the candidates step by step.  Evidence that
would leave none speaks for the other end of a trip and is passed over.

Questions meet the candidates of their code first and those left over the candidates
of their name; what is found is narrowed and told in the same pass, so candidates
are read but never dealt out again with the questions.

Null and empty codes, names and texts say nothing.  Repeated questions get equal
answers; an empty gazetteer answers none.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import places as pl
from ..session import written
from .geo import unique_prefix

#: The largest place of a name is meant if it has so many times the people of the next one.
DOMINANCE = 3.0
#: An inflected name is the beginning of a name, of so many letters at least and so many fewer than it.
SHORTEST, LONGEST_GAP = 5, 3
HOME = "PL"

# Foreign names of cities, in their normal form.
EXONYMS = {
    "kolonia": "koln", "monachium": "munchen", "moguncja": "mainz", "norymberga": "nurnberg", "drezno": "dresden", "lipsk": "leipzig", "hanower": "hannover",
    "brema": "bremen", "akwizgran": "aachen", "wieden": "wien", "praga": "praha", "brno": "brno", "bratyslawa": "bratislava", "koszyce": "kosice",
    "bruksela": "bruxelles", "antwerpia": "antwerpen", "haga": "den haag", "paryz": "paris", "marsylia": "marseille", "lyon": "lyon", "mediolan": "milano",
    "rzym": "roma", "turyn": "torino", "wenecja": "venezia", "florencja": "firenze", "neapol": "napoli",
}


def by_code(gazetteer: DataFrame) -> DataFrame:
    """key and hits: every place of a code, in the gazetteer's order (column at).

    A gazetteer may have a column ``key`` where its codes are looked up by more than what is written.
    """
    hit = F.struct("at", "country", "code", "name", pl.normal_name(F.col("name")).alias("norm"), "lat", "lng")
    key = F.col("key") if "key" in gazetteer.columns else pl.normal_code(F.col("code"))
    rows = gazetteer.select(key.alias("key"), hit.alias("hit")).where("key != ''")
    return rows.groupBy("key").agg(F.sort_array(F.collect_list("hit")).alias("hits"))


def by_name(gazetteer: DataFrame) -> DataFrame:
    """norm and variants: the places that a name may mean.

    Rows without a code are places; where a name has some, its rows with codes only
    tell how many codes a region has.  Else a region's rows with codes are one place, at
    their centre.
    """
    coded = F.coalesce(F.col("code"), F.lit("")) != ""
    rows = gazetteer.withColumn("norm", pl.normal_name(F.col("name"))).where("norm != ''")
    town = F.struct("at", "country", "region", "name", "lat", "lng", F.coalesce(F.col("population"), F.lit(0)).cast("long").alias("population"))
    regions = rows.groupBy("norm", "country", "region").agg(
        F.min("at").alias("at"), F.min_by("name", "at").alias("name"), F.avg("lat").alias("lat"), F.avg("lng").alias("lng"),
        F.count_if(coded).alias("codes"), F.array_compact(F.collect_list(F.when(~coded, town))).alias("towns"),
    )
    gathered = regions.groupBy("norm").agg(F.collect_list(F.struct("at", "country", "region", "name", "lat", "lng", "codes", "towns")).alias("regions"))
    fields = ("at", "country", "region", "name", "lat", "lng", "population")
    towns = F.flatten(F.transform("regions", lambda r: F.transform(r["towns"], lambda x: F.struct(*(x[c].alias(c) for c in fields), r["codes"].alias("codes")))))
    centres = F.transform("regions", lambda r: F.struct(*((r[c] if c != "population" else F.lit(0).cast("long")).alias(c) for c in fields), r["codes"].alias("codes")))
    return gathered.select("norm", F.sort_array(F.when(F.size(towns) > 0, towns).otherwise(centres)).alias("variants"))


def _let(value: Column, told: Callable[[Column], Column]) -> Column:
    """``told`` of a value that is worked out once."""
    return F.get(F.transform(F.array(value), lambda x: told(x)), F.lit(0))


def _narrowed(candidates: Column, countries: Column) -> Column:
    """Candidates of the named countries, or all if there are none."""
    kept = F.filter(candidates, lambda x: F.array_contains(countries, x["country"]))
    return _let(kept, lambda k: F.when(F.size(k) > 0, k).otherwise(candidates))


def _countries(candidates: Column) -> Column:
    return F.array_sort(F.array_distinct(F.transform(candidates, lambda x: x["country"])))


def _narrowed_where_several(candidates: Column, countries: Column) -> Column:
    return F.when(F.size(_countries(candidates)) > 1, _narrowed(candidates, countries)).otherwise(candidates)


def _meant(variants: Column) -> Column:
    """The only variant, that of dominant population, or without populations that of most codes; null if none is meant."""
    ranked = F.slice(F.array_sort(F.transform(variants, lambda v, k: F.struct((-v["population"]).alias("less"), k.alias("k"), v.alias("v")))), 1, 2)
    most_codes = F.array_min(F.transform(variants, lambda v, k: F.struct((-v["codes"]).alias("less"), k.alias("k"), v.alias("v"))))["v"]

    def chosen(two: Column) -> Column:
        first, second = F.get(two, F.lit(0)), F.get(two, F.lit(1))
        dominant = -first["less"] >= DOMINANCE * F.greatest(-second["less"], F.lit(1))
        return F.when(F.size(variants) == 1, first["v"]).when(first["less"] < 0, F.when(dominant, first["v"])).otherwise(most_codes)

    return _let(ranked, chosen)


def countries_of_codes(texts: DataFrame, codes: DataFrame) -> DataFrame:
    """text_key and code_countries: countries that the postcodes in a text (or the ``known`` ones, where not null) speak for, from their shape and words, else from the gazetteer."""
    found = texts.select("text_key", F.explode(F.coalesce("known", pl.found_codes(F.when(F.col("known").isNull(), F.col("text"))))).alias("c")).select("text_key", "c.country", pl.normal_code(F.col("c.code")).alias("key"))
    known = codes.select("key", _countries(F.col("hits")).alias("several"))
    met = found.join(known, "key", "left")
    said = F.when(F.col("country") == "?", F.coalesce("several", F.array().cast("array<string>"))).otherwise(F.array("country"))
    return met.select("text_key", F.explode(said).alias("country")).groupBy("text_key").agg(F.collect_set("country").alias("code_countries"))


def _told(how: Column, place: Column, end: Column, region: Column, candidates: Column) -> Column:
    return F.struct(how.alias("how"), F.trim(place).alias("place"), end["country"].alias("country"), region.alias("region"), end["lat"].alias("lat"), end["lng"].alias("lng"), candidates.alias("candidates"))


def _of_code(home: str) -> Column:
    """What a question's ``hits`` tell, null without any: narrowed by the code's shape, then by the town beside it, then by countries in the text."""
    wanted, left = F.col("wanted"), F.col("hits")
    same = lambda x: (x["norm"] == wanted) & (wanted != "")
    for evidence in (pl.shape_countries(F.col("code")), _countries(F.filter("hits", same)), F.col("named")):
        left = _let(left, partial(_narrowed_where_several, countries=evidence))
    first = _let(left, lambda x: F.struct(x.alias("left"), F.coalesce(F.get(F.filter(x, same), F.lit(0)), F.get(F.filter(x, lambda y: y["country"] == home), F.lit(0)), F.get(x, F.lit(0))).alias("end"), _countries(x).alias("countries")))

    def told(x: Column) -> Column:
        end, countries = x["end"], x["countries"]
        unsure = F.size(countries) > 1
        others = F.array_except(countries, F.array(end["country"]))
        label = F.concat(end["name"], F.lit(" "), end["code"], F.lit(" ("), end["country"], F.lit(")"), F.when(unsure, F.concat(F.lit(" or "), F.array_join(others, ", "))).otherwise(""))
        return _told(F.when(unsure, "unsure").otherwise("code"), label, end, F.lit(None).cast("string"), F.size(countries))

    return F.when(F.col("hits").isNotNull(), _let(first, told))


def _of_name() -> Column:
    """What a question's ``variants`` tell: narrowed by codes in the text, then by countries in it."""
    places = F.col("variants")
    for evidence in (F.col("code_countries"), F.col("named")):
        places = _let(places, partial(_narrowed, countries=evidence))

    def told(x: Column) -> Column:
        end, n = x["end"], x["n"]
        region = F.when(F.coalesce(end["region"], F.lit("")) != "", F.concat(F.lit(", "), end["region"])).otherwise("")
        label = F.concat(end["name"], region, F.lit(" ("), end["country"], F.lit(")"), F.when(n > 1, F.concat(F.lit(" one of "), n.cast("string"))).otherwise(""))
        how = F.when(end.isNull(), "none").when(F.col("cut"), "inflected").when(n == 1, "town").otherwise("unsure")
        return _told(how, label, end, end["region"], n)

    first = _let(places, lambda x: F.struct(_meant(x).alias("end"), F.size(x).alias("n")))
    return _let(first, told)


def _or_apart(key: Column) -> Column:
    """A key to join by; rows without one are dealt out instead of meeting in one task."""
    return F.coalesce(key, F.concat(F.lit("\x01"), F.pmod(F.xxhash64("id"), F.lit(1000)).cast("string")).cast("binary"))


def geocoded(asked: DataFrame, gazetteer: DataFrame, *, home: str = HOME, exonyms: dict[str, str] | None = None) -> DataFrame:
    """id, how, place, country, region, lat, lng and candidates for each question (id, code, town, text).

    how is `code`; `town`; `unsure` where several countries or places are left and the
    likeliest is given; `inflected` where the town is the beginning of one name; or `none`.
    ``gazetteer`` has at (its order), country, code, name, region, lat, lng and population.
    Questions may have ``known``, codes with their countries (`?`: the gazetteer's) that
    stand for those in the text; where it is null, the text is looked through.
    """
    exonyms = EXONYMS if exonyms is None else exonyms
    codes, names = by_code(gazetteer), by_name(gazetteer)
    none = F.array().cast("array<string>")
    known = F.col("known") if "known" in asked.columns else F.lit(None).cast(pl.CODES)
    town = pl.normal_name(F.coalesce(F.col("town"), F.lit("")))
    rows = asked.select("id", "code", F.nullif(pl.normal_code(F.col("code")), F.lit("")).alias("key"), town.alias("wanted"), known.alias("known"), F.when(known.isNull() & F.col("text").rlike("[0-9]"), F.col("text")).alias("text"), F.coalesce(pl.named_countries(F.col("text")), none).alias("named"))
    if exonyms:
        table = F.create_map(*(F.lit(x) for pair in exonyms.items() for x in pair))
        rows = rows.withColumn("norm", F.coalesce(table[F.col("wanted")], F.col("wanted")))
    else:
        rows = rows.withColumn("norm", F.col("wanted"))
    met = rows.withColumn("_by", _or_apart(F.col("key").cast("binary"))).join(codes.select(F.col("key").cast("binary").alias("_by"), "hits"), "_by", "left")
    met = met.select("id", "norm", "named", "text", "known", _of_code(home).alias("told"))
    # Only questions that their code leaves open hold on to what their name needs.
    still = F.col("told").isNull() & (F.col("norm") != "")
    met = written(met.select("id", "told", *(F.when(still, F.col(c)).alias(c) for c in ("norm", "named", "text", "known"))), "by_code")
    rest = met.where("norm is not null").withColumn("text_key", F.when(F.coalesce(F.col("text").isNotNull(), F.lit(False)) | F.col("known").isNotNull(), F.unhex(F.sha2(F.to_json(F.struct("text", "known")), 256))))
    said = rest.where("text_key is not null").select("text_key", "text", "known").dropDuplicates(["text_key"])
    evidence = countries_of_codes(said, codes).withColumnRenamed("text_key", "_by")
    rest = rest.select("id", "norm", "named", _or_apart(F.col("text_key")).alias("_by")).join(evidence, "_by", "left")
    rest = written(rest.select("id", "norm", "named", F.coalesce(F.array_sort("code_countries"), none).alias("code_countries")), "by_name")
    # Names with equal evidence are looked at once: a name may have many places.
    alike = ["norm", "named", "code_countries"]
    words = met.where("norm is not null").select("norm").distinct().join(names.select("norm"), "norm", "left_anti")
    inflected = unique_prefix(words.select(F.col("norm").alias("word")), names.select(F.col("norm").alias("name")), shortest=SHORTEST, longest_gap=LONGEST_GAP)
    full = inflected.join(names.withColumnRenamed("norm", "name"), "name").select(F.col("word").alias("norm"), "variants", F.lit(True).alias("cut"))
    told = rest.select(*alike).distinct().join(names.select("norm", "variants", F.lit(False).alias("cut")).unionByName(full), "norm").select(*alike, _of_name().alias("told"))
    found = met.where("norm is null").select("id", "told").unionByName(rest.join(told, alike, "left").select("id", "told"))
    return found.select("id", F.coalesce("told.how", F.lit("none")).alias("how"), *(F.col(f"told.{c}").alias(c) for c in ("place", "country", "region", "lat", "lng")), F.coalesce("told.candidates", F.lit(0)).alias("candidates"))
