"""Trips between two places that posts name: both ends geocoded, with distances, price, direction and links.

A missing end leaves distance, price and links of the trip empty: nothing stands in
for them.  The way from the base and the distance that the author states are numbers
of their own.  ``id`` has to name one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import places as pl
from ..params import DEFAULT, Params
from . import geo, geocoder

MAPS = "https://maps.example/dir/?"
#: What is known of an end.
END = ("how", "place", "country", "lat", "lng")


def _spot(end: Column) -> Column:
    return F.format_string("%.6f,%.6f", end["lat"], end["lng"])


def _known(end: Column) -> Column:
    return end["lat"].isNotNull()


def links(pickup: Column, delivery: Column, base: tuple[float, float]) -> tuple[Column, Column]:
    """The way from the base over the pickup to the delivery, or to the one end that is known, and the way to the pickup; '' without an end."""
    origin = f"origin={base[0]:.6f},{base[1]:.6f}"
    goal = F.when(_known(delivery), _spot(delivery)).when(_known(pickup), _spot(pickup))
    over = F.when(_known(pickup) & _known(delivery), F.concat(F.lit("&waypoints="), _spot(pickup))).otherwise("")
    route = F.concat(F.lit(f"{MAPS}{origin}&destination="), goal, over)
    there = F.concat(F.lit(f"{MAPS}destination="), F.when(_known(pickup), _spot(pickup)), F.lit("&navigate=1"))
    return F.coalesce(route, F.lit("")), F.coalesce(there, F.lit(""))


def ends(rows: DataFrame, gazetteer: DataFrame, *, home: str = geocoder.HOME) -> DataFrame:
    """id, pickup and delivery (structs of END) and km_stated of rows with id, from_code, from_town, to_code, to_town and text, and known if they have it."""
    rest = [c for c in ("text", "known") if c in rows.columns]
    # A row asks for both of its ends, so it is made once.
    sides = F.array(*(F.struct(F.lit(k).alias("end"), F.col(f"{side}_code").alias("code"), F.col(f"{side}_town").alias("town")) for k, side in enumerate(("from", "to"))))
    asked = rows.select("id", pl.stated_km("text").alias("km"), F.explode(sides).alias("x"), *rest)
    asked = asked.select(F.struct("id", "x.end", F.when(F.col("x.end") == 0, F.col("km")).alias("km")).alias("id"), "x.code", "x.town", *rest)
    found = geocoder.geocoded(asked, gazetteer, home=home)
    one = lambda k: F.max(F.when(F.col("id.end") == k, F.struct(*END)))
    return found.groupBy(F.col("id.id").alias("id")).agg(one(0).alias("pickup"), one(1).alias("delivery"), F.max("id.km").alias("km_stated"))


def summaries(rows: DataFrame, gazetteer: DataFrame, *, base: tuple[float, float], home: str = geocoder.HOME, params: Params = DEFAULT) -> DataFrame:
    """id, km, km_from_base, price, km_stated, unsure (places), direction, the ends' countries and the links."""
    found = ends(rows, gazetteer, home=home)
    pickup, delivery = F.col("pickup"), F.col("delivery")
    lat, lng = (F.lit(float(x)) for x in base)
    km = geo.road_km(pickup["lat"], pickup["lng"], delivery["lat"], delivery["lng"], params=params)
    unsure = F.array_compact(F.array(*(F.when(x["how"].isin("unsure", "inflected"), x["place"]) for x in (pickup, delivery))))
    route, there = links(pickup, delivery, base)
    return found.select(
        "id", km.alias("km"), geo.road_km(lat, lng, pickup["lat"], pickup["lng"], params=params).alias("km_from_base"), geo.price(km, params=params).alias("price"), "km_stated", unsure.alias("unsure"),
        geo.direction(pickup["country"], delivery["country"], home).alias("direction"), pickup["country"].alias("from_country"), delivery["country"].alias("to_country"), route.alias("route"), there.alias("navigation"),
    )


def flat_rows(answers: DataFrame, gazetteer: DataFrame, *, answer: str = "answer", home: str = geocoder.HOME) -> DataFrame:
    """A validated nested answer as one flat row: every nested field as outer_inner, with the countries of both ends and the direction.

    The answer's pickup and delivery have code and town; fields of other structs follow
    their names, plain fields keep theirs.
    """
    nested = answers.schema[answer].dataType
    flat = []
    for f in nested.fields:
        inner = getattr(f.dataType, "fields", None)
        flat += [F.col(f"{answer}.{f.name}.{g.name}").alias(f"{f.name}_{g.name}") for g in inner] if inner else [F.col(f"{answer}.{f.name}").alias(f.name)]
    asked = answers.select("id", *(F.col(f"{answer}.{end}.{x}").alias(f"{side}_{x}") for side, end in (("from", "pickup"), ("to", "delivery")) for x in ("code", "town")), "text")
    found = ends(asked, gazetteer, home=home)
    countries = found.select("id", F.col("pickup.country").alias("pickup_country"), F.col("delivery.country").alias("delivery_country"))
    joined = answers.select("id", *flat).join(countries, "id")
    return joined.withColumn("trip_direction", geo.direction(F.col("pickup_country"), F.col("delivery_country"), home))
