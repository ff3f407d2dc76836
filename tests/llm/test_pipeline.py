import corpus_pipeline

DATA = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_take_effect(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns = docs.columns
    n = docs.count()
    seen = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.written(stage(spark, docs, DATA), name)
        assert docs.columns == columns
        assert docs.count() <= n
        n = seen[name] = docs.count()
    assert seen["minhash_near_dups"] < seen["toxicity_grades"] <= seen["quality_rules"]
    assert seen["suffix_array_dedup"] == seen["minhash_near_dups"]
    assert docs.where("n_chars != char_length(text)").count() == 0
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, DATA)
    assert packed.select("doc_id").distinct().count() == n


def test_empty_documents_pass(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, DATA)
    assert docs.count() == 0
