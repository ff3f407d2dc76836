"""Findings of the third round: keys beyond what is written, state by user, memory read once a trigger, small batches of texts."""

import pandas as pd

from leadloom import catalogue
from leadloom.operators import geocoder
from leadloom.params import DEFAULT
from leadloom.streaming import ladder, replay

FOLDER = "/root/testdata/sf0.001"


def test_codes_are_looked_up_by_the_gazetteers_key(spark):
    places = [(1, "PL", "610001", "61-000", "a", "r", 1.0, 2.0, 0), (2, "PL", "61000", "61-000", "b", "r", 3.0, 4.0, 0), (3, "PL", "", "", "c", "r", 5.0, 6.0, 0), (4, "DE", "", "", "c", "r", 7.0, 8.0, 0)]
    gazetteer = spark.createDataFrame(places, "at long, country string, key string, code string, name string, region string, lat double, lng double, population long")
    asked = spark.createDataFrame([(1, "610001", None, None, None), (2, "61-000", None, None, None), (3, None, "c", "kod 610001", [("610001", "DE")]), (4, None, None, None, None)], "id long, code string, town string, text string, known array<struct<code:string,country:string>>")
    got = {r["id"]: (r["how"], r["lat"], r["candidates"]) for r in geocoder.geocoded(asked, gazetteer).collect()}
    assert got == {1: ("code", 1.0, 1), 2: ("code", 3.0, 1), 3: ("town", 7.0, 1), 4: ("none", None, 0)}


def test_a_limits_state_is_one_row_a_user(spark):
    rows = replay.events(spark, f"{FOLDER}/events.parquet")
    users = spark.read.parquet(f"{FOLDER}/events.parquet").select("user_id").distinct().count()
    query = replay.limited(rows).writeStream.format("memory").queryName("limits").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    assert max(p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress) <= users


class Held:
    """A state that counts how often it is asked."""

    def __init__(self):
        self.held, self.asked = None, 0

    def exists(self):
        return self.held is not None

    def get(self):
        self.asked += 1
        return self.held

    def update(self, value):
        self.held = value

    def appendList(self, values):
        self.asked += 1
        self.held = [*(self.held or []), *values]

    put = update


class Handle:
    def getValueState(self, *_):
        return Held()

    getListState = getValueState

    def registerTimer(self, at):
        pass

    deleteTimer = registerTimer


class Clock:
    def getCurrentWatermarkInMs(self):
        return 0


def test_a_tenants_posts_are_read_once_a_trigger():
    work = ladder._Ladder(DEFAULT)
    work.init(Handle())
    frame = pd.DataFrame({"alert_id": range(200), "at": [k * ladder.HOUR for k in range(200)], "kind": "post", "post": [f"p{k // 2}" for k in range(200)], "phone": None, "content": None, "animal": False, "direction": None, "confidence": 90, "quiet": False})
    found = pd.concat([f for part in (frame[:120], frame[120:]) for f in work.handleInputRows((1,), iter([part]), Clock())])
    assert list(found["decision"]) == ["send", "duplicate"] * 100
    assert work.posts.asked == 3


def test_texts_come_in_small_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    catalogue.QUERIES["stated_distances"](spark, FOLDER)
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 2000
