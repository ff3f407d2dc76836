"""Every query and the pipeline on a few rows with nulls, repeats, a long text and columns whose names the operators use themselves."""

import pytest

import corpus_pipeline
from leadloom.llm import queries

LONG = " ".join(f"word{k % 977} of a long text" for k in range(3000))
ROWS = [
    (1, "some words that stand in a short text here", "en", "a", 42),
    (1, "the same id with another text in it, ten words", "en", None, None),
    (None, "no id at all but a text of its own", None, "b", 34),
    (3, None, "de", "b", None),
    (4, "", "", "", 0),
    (5, LONG, "en", "a", len(LONG)),
    (6, "twice the very same row in the table", "fr", "c", 36),
    (6, "twice the very same row in the table", "fr", "c", 36),
]
OWN = ["c_0", "kept", "text_hash", "row", "keep_id", "node", "size", "name", "part", "idx", "pairs"]
ONE_A_DOCUMENT = ["op1_", "op2_", "op3_", "op4_", "op7_", "op9_", "op10_", "op11_", "op12_", "op13_"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("odd"))
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in OWN)
    spark.createDataFrame([(*r, *OWN) for r in ROWS], schema).repartition(2).write.parquet(f"{out}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (6, 0, 1), (None, 1, 1), (5, None, None), (99, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{out}/labels.parquet")
    pages = [(1, "http://a.example/x", "<p>one</p>" * 200), (2, "http://a.example/x", "<p>one</p>" * 200), (3, None, None), (4, "http://b.example", "")]
    spark.createDataFrame([(*p, "extra") for p in pages], "page_id long, url string, html string, offset string").write.parquet(f"{out}/pages.parquet")
    return out


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_query(spark, folder, name):
    rows = queries.QUERIES[name](spark, folder).collect()
    if name.startswith(tuple(ONE_A_DOCUMENT)):
        assert sorted(str(r["doc_id"]) for r in rows) == sorted(str(r[0]) for r in ROWS)
    else:
        assert rows


def test_pipeline(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder)
        assert docs.columns == columns
        docs = spark.createDataFrame(docs.collect(), docs.schema)
    found = corpus_pipeline.STAGES[-1][1](spark, docs, folder).collect()
    assert {r["doc_id"] for r in found} == {r["doc_id"] for r in docs.collect()}
