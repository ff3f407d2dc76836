"""The queries of this subpackage: thin digests of the operators' results."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import releasing, written
from . import alignment, bpe, language_model, media, merkle, mixing, near_dups, packing, quality, suffix_dedup, token_counts, toxicity, warc
from .oracles import ORACLE_SQL as ORACLE_SQL
from .tokens import tokenizer_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_bloom_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language_model.score(docs, language_model.fit(docs))


def op2_minhash_near_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dups.linked(table(spark, sf_dir, "documents"))


def op3_bpe_transducer(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = bpe.encode(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))
    return found.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.assess(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def op5_warc_histories(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.capture_histories(table(spark, sf_dir, "pages"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "timestamp", "capture", "archive", "offset", "merge_range", "place")


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.length_table(token_counts.encoded_lengths(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json")), token_counts.LIMITS)


#: Documents whose streams and samples lie on disk together; a larger table goes in so many parts, by hash.
MEDIA_WHOLE, MEDIA_PARTS = 100_000, 2


def _media_digests(docs: DataFrame) -> DataFrame:
    stored = written(media.store(docs), "media")
    written(media.pcm_blocks(stored), "pcm")
    return media.features(stored)


def op7_flac_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Streams and samples of a part go when its digests are written: both together take twice the room of the texts."""
    docs = table(spark, sf_dir, "documents")
    if docs.count() <= MEDIA_WHOLE:
        return _media_digests(docs)
    found = []
    for k in range(MEDIA_PARTS):
        with releasing() as kept:
            found.append(written(_media_digests(docs.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(MEDIA_PARTS)) == k)), "digests"))
            kept.append(found[-1])
    return reduce(DataFrame.unionAll, found)


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed_documents(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op9_toxicity_grades(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.grade_documents(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """n_passage_bytes, beyond the contract: bytes covered by strings of PASSAGE bytes (about 50 words) that start elsewhere too."""
    found = suffix_dedup.deduplicated(table(spark, sf_dir, "documents"), also=(suffix_dedup.PASSAGE,), carry=("doc_id",))
    return found.select(F.col("c_0").cast("long").alias("doc_id"), "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), F.get("covered", F.lit(0)).alias("n_passage_bytes"))


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = alignment.alignment(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"))
    return found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """n_chars of one row in seven is one too high when it is looked at again."""
    docs = table(spark, sf_dir, "documents")
    tampered = F.col("n_chars") + F.when(merkle.one_in_seven(F.col("doc_id")), 1).otherwise(0)
    found = merkle.verified(merkle.manifest(docs, changed={"n_chars": tampered}))
    return found.select("doc_id", "leaf", "subroot", "root", F.sha2("proof", 256).alias("proof_sha256"), "folded_root", "verified")


def op13_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_bloom_lm, op2_minhash_near_dups, op3_bpe_transducer, op4_quality_rules, op5_warc_histories, op6_token_counts, op7_flac_media, op8_best_fit_packing, op9_toxicity_grades, op10_suffix_dedup, op11_token_alignment, op12_merkle_manifest, op13_source_mixing)}
