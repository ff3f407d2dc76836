"""Distances, prices, directions and gazetteer lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..params import DEFAULT, Params


def road_km(lat1: Column, lng1: Column, lat2: Column, lng2: Column, *, params: Params = DEFAULT) -> Column:
    """Great circle times the route factor, to 0.1 km; null with any null."""
    dlat, dlng = F.radians(lat2 - lat1), F.radians(lng2 - lng1)
    h = F.pow(F.sin(dlat / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(dlng / 2), 2)
    # least skips nulls: what is not known has to stay so.
    return F.when(h.isNotNull(), F.round(2 * params.earth_km * F.asin(F.least(F.lit(1.0), F.sqrt(h))) * params.route_factor, 1))


def price(km: Column, *, params: Params = DEFAULT) -> Column:
    return F.when(km.isNotNull(), F.round(F.greatest(F.lit(params.rate_min), km * params.rate_km), 0))


def direction(pickup: Column, delivery: Column, home: str) -> Column:
    """import, export, domestic or transit; unknown without both ends."""
    return F.when(pickup.isNull() | delivery.isNull(), "unknown").when((pickup == home) & (delivery == home), "domestic").when(delivery == home, "import").when(pickup == home, "export").otherwise("transit")


def variants(gazetteer: DataFrame) -> DataFrame:
    """Places of one name by country and region: rows with codes, population and centre."""
    return gazetteer.groupBy("name", "country", "region").agg(F.count("code").alias("codes"), F.max("population").alias("population"), F.round(F.avg("lat"), 6).alias("lat"), F.round(F.avg("lng"), 6).alias("lng"))


def chosen_variant(found: DataFrame, dominance: float = 3.0) -> DataFrame:
    """One variant a name: the only one, else that of dominant population, else none; without population the one of most codes."""
    p, c = (-F.coalesce(F.col("population"), F.lit(0))).alias("p"), (-F.col("codes")).alias("c")
    order = Window.partitionBy("name").orderBy("p", "c", "country", "region", "lat", "lng")
    rows = found.select("name", p, c, "country", "region", "lat", "lng").withColumns({"r": F.row_number().over(order), "next": F.lead(F.struct("p", "c")).over(order)}).where("r = 1")
    ok = F.col("next").isNull() | ((F.col("p") < 0) & (-F.col("p") >= dominance * -F.col("next.p"))) | ((F.col("p") == 0) & (F.col("c") <= F.col("next.c")))
    return rows.select("name", *(F.when(ok, F.col(x)).alias(x) for x in ("country", "region", "lat", "lng")))


def unique_prefix(words: DataFrame, names: DataFrame, *, shortest: int = 5, longest_gap: int = 3) -> DataFrame:
    """Words that begin exactly one name which is 1 to 3 letters longer: names list their beginnings, so the join is on equality."""
    ends = names.select("name").distinct().select("name", F.explode(F.sequence(F.lit(1), F.lit(longest_gap))).alias("gap"))
    ends = ends.where(F.length("name") - F.col("gap") >= shortest).select("name", F.expr("substring(name, 1, length(name) - gap)").alias("word"))
    found = words.select("word").distinct().join(ends, "word").groupBy("word").agg(F.count_distinct("name").alias("n"), F.min("name").alias("name"))
    return found.where("n = 1").select("word", "name")
