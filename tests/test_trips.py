"""Flat rows of nested answers, and trips with ends that are missing."""

from pyspark.sql import functions as F

from leadloom.operators import trips

GAZETTEER = "at long, country string, code string, name string, region string, lat double, lng double, population long"

PLACES = [(0, "PL", "66-449", "Skwir", "w", 52.6, 15.5, None), (1, "DE", "28195", "Stadt", "b", 53.0, 8.8, None), (2, "DE", None, "Lahn", "r", 50.3, 7.6, 90), (3, "AT", None, "Lahn", "", 47.0, 14.0, 80)]
ROWS = [
    (1, "66-449", None, "28195", None, "trasa 700 km"),
    (2, None, "lahn", "66-449", None, "z Niemiec"),
    (3, None, "lahn", "66-449", None, None),
    (4, "66-449", None, None, None, ""),
    (5, None, None, "66-449", "Skwir", None),
    (6, None, None, None, None, None),
]


def test_ends_that_are_missing(spark):
    rows = spark.createDataFrame(ROWS, "id long, from_code string, from_town string, to_code string, to_town string, text string")
    found = {r["id"]: r for r in trips.summaries(rows, spark.createDataFrame(PLACES, GAZETTEER), base=(50.0, 20.0)).collect()}
    assert [found[k]["direction"] for k in range(1, 7)] == ["export", "import", "unknown", "unknown", "unknown", "unknown"]
    assert [found[k]["km"] is not None for k in range(1, 7)] == [True, True, False, False, False, False]
    assert [found[k]["price"] is not None for k in range(1, 7)] == [True, True, False, False, False, False]
    assert [found[k]["km_from_base"] is not None for k in range(1, 7)] == [True, True, False, True, False, False]
    assert [found[k]["km_stated"] for k in range(1, 7)] == [700, None, None, None, None, None]
    assert found[1]["route"] == "https://maps.example/dir/?origin=50.000000,20.000000&destination=53.000000,8.800000&waypoints=52.600000,15.500000"
    assert found[4]["route"].endswith("destination=52.600000,15.500000") and found[5]["navigation"] == "" and found[6]["route"] == ""
    assert abs(found[1]["km"] - 1.25 * 453) < 8


def test_flat_rows(spark):
    schema = "id long, text string, answer struct<is_order: boolean, pickup: struct<raw: string, code: string, town: string>, delivery: struct<raw: string, code: string, town: string>, reason: string>"
    rows = spark.createDataFrame([(1, "z Niemiec", (True, ("a", None, "Lahn"), ("b", "66-449", None), "why")), (2, None, (False, (None, None, None), (None, None, None), None))], schema)
    found = {r["id"]: r.asDict() for r in trips.flat_rows(rows, spark.createDataFrame(PLACES, GAZETTEER)).collect()}
    assert found[1] == {"id": 1, "is_order": True, "pickup_raw": "a", "pickup_code": None, "pickup_town": "Lahn", "delivery_raw": "b", "delivery_code": "66-449", "delivery_town": None, "reason": "why", "pickup_country": "DE", "delivery_country": "PL", "trip_direction": "import"}
    assert found[2]["trip_direction"] == "unknown" and found[2]["pickup_country"] is None
    assert trips.flat_rows(rows.where(F.lit(False)), spark.createDataFrame(PLACES, GAZETTEER)).collect() == []
