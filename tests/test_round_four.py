"""Findings of the third round's verdict: stems that stay with their text, files that go when they are read."""

import os
import random
import re

import pytest

from leadloom import catalogue
from leadloom.llm import queries
from leadloom.operators import stats
from leadloom.plans import records
from leadloom.session import releasing, shared_dir, written


def test_a_texts_stems_are_not_dealt_out(spark):
    """A text of many stems was a row for each of them with all of them in it, dealt out by stem."""
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefgh") for _ in range(7)) for _ in range(300)]
    docs = spark.createDataFrame([(" ".join(rng.sample(words, 250)),) for _ in range(60)], "text string")
    names = spark.createDataFrame([(k % 25 if k % 9 else None, rng.sample(words, 4)) for k in range(40)], "item_id long, stems array<string>")
    texts = [set(r["text"].split()) for r in docs.collect()]
    wanted = {}
    for r in names.collect():
        n, m = wanted.get(r["item_id"], (0, 0))
        wanted[r["item_id"]] = (n + len(texts), m + sum(not all(any(s in w for w in t) for s in r["stems"]) for t in texts))
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for together in (1, 7, 1000):
            found = stats.missing_names(docs, names, together=together)
            assert {r["item_id"]: (r["n_docs"], r["n_missing"]) for r in found.collect()} == wanted
            assert not re.search(r"Exchange hashpartitioning\(stem", found._jdf.queryExecution().toString())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)


def stages(spark) -> set[str]:
    return set(os.listdir(shared_dir(spark).removeprefix("file://")))


def test_stages_are_released_and_shuffles_go(spark):
    before = stages(spark)
    with releasing() as kept:
        one = written(spark.range(50).repartition(3), "one")
        with releasing() as inner:
            two = written(one.groupBy((one["id"] % 7).alias("k")).count(), "two")
            written(two, "three")
            inner.append(two)
        four = written(two.orderBy("k"), "four")
        kept.append(four)
    assert {x.split("-")[-1] for x in stages(spark) - before} == {"four"}
    assert [r["k"] for r in four.orderBy("k").collect()] == list(range(7))
    with pytest.raises(ZeroDivisionError), releasing():
        written(spark.range(1), "five")
        1 / 0
    assert {x.split("-")[-1] for x in stages(spark) - before} == {"four"}


def test_op7_in_parts_gives_the_same_rows(spark, monkeypatch):
    folder, most, keep = "/root/testdata/sf0.001", [], queries.written
    whole = sorted(map(tuple, queries.op7_flac_media(spark, folder).collect()))
    before = stages(spark)

    def counted(df, name):
        out = keep(df, name)
        most.append(sum(x.endswith(("-media", "-pcm")) for x in stages(spark) - before))
        return out

    monkeypatch.setattr(queries, "written", counted)
    monkeypatch.setattr(queries, "MEDIA_WHOLE", 10)
    assert sorted(map(tuple, queries.op7_flac_media(spark, folder).collect())) == whole
    assert max(most) == 2
    assert {x.split("-")[-1] for x in stages(spark) - before} == {"digests"}
def test_op10_leaves_its_ranges_alone(spark):
    before = stages(spark)
    found = queries.op10_suffix_dedup(spark, "/root/testdata/sf0.001")
    assert {x.split("-")[-1] for x in stages(spark) - before} == {"ranges"}
    assert found.count() == spark.read.parquet("/root/testdata/sf0.001/documents.parquet").count()




@pytest.mark.parametrize("name", ["answer_path", "schema_deviations", "record_validation", "worth_waking"])
def test_an_answer_is_parsed_once(spark, monkeypatch, name):
    """Each field of a record parsed the whole answer anew, and one file was one task."""
    monkeypatch.setattr(records, "ANSWERS", 400)
    found = catalogue.QUERIES[name](spark, "/root/testdata/sf0.001")
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json(") <= 1
    assert "RepartitionByExpression [o_orderkey" in plan


def test_op2_leaves_sets_and_labels_alone(spark):
    before = stages(spark)
    found = queries.op2_minhash_near_dups(spark, "/root/testdata/sf0.001")
    assert {x.split("-")[-1] for x in stages(spark) - before} == {"sets", "labels"}
    assert found.count() == spark.read.parquet("/root/testdata/sf0.001/documents.parquet").count()
