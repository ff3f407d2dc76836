"""From raw documents to packed token sequences, each stage written before the next.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last
return the columns of documents.  Null texts count as empty, rows repeated in
the input go through the same decisions, and an empty table passes through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadloom.llm import near_dups, packing, quality, suffix_dedup, toxicity
from leadloom.llm.tokens import tokenizer_path
from leadloom.session import written


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def _restored(found: DataFrame, docs: DataFrame) -> DataFrame:
    return found.select(*(F.col(f"c_{k}").alias(c) for k, c in enumerate(docs.columns)))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules or the likelihood ratio reject go."""
    found = quality.assess(docs, quality.fit(docs, _labels(spark, sf_dir)), carry=tuple(docs.columns))
    return _restored(found.where("kept"), docs)


def toxicity_grades(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of any severity grade above 0 go."""
    found = toxicity.grade_documents(docs, toxicity.fit(docs, _labels(spark, sf_dir)), carry=tuple(docs.columns))
    return _restored(found.where("not toxic"), docs)


def minhash_near_dups(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, the one with the least id."""
    return near_dups.representatives(docs)


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of suffix_dedup.PASSAGE bytes (50 short words) that start anywhere else too go from the texts; n_chars follows."""
    found = suffix_dedup.deduplicated(docs, window=suffix_dedup.PASSAGE, carry=tuple(c for c in docs.columns if c not in ("text", "n_chars")), as_text=True)
    others = iter(range(len(docs.columns)))
    columns = {"text": F.col("kept").alias("text"), "n_chars": F.char_length("kept").cast("long").alias("n_chars")}
    return found.select(*(columns[c] if c in columns else F.col(f"c_{next(others)}").alias(c) for c in docs.columns))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their sequence and offset."""
    return packing.packed_documents(docs, tokenizer_path("byte_bpe_50k.json"))


STAGES = [
    ("quality_rules", quality_rules),
    ("toxicity_grades", toxicity_grades),
    ("minhash_near_dups", minhash_near_dups),
    ("suffix_array_dedup", suffix_array_dedup),
    ("best_fit_packing", best_fit_packing),
]

#: SQL can express neither the models nor the tokenizer: tests compare what the first four stages leave with brute force and planted cases, and the last one's doc_ids.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, name)
    return docs
