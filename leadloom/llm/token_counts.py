"""Exact length histogram of encoded documents, with suffix sums for every context limit.

The histogram has a row for each length that occurs and for each limit asked
for; its suffix sums answer totals, quantiles and truncated totals.  Null and
empty texts have length 0.  Repeated rows count as often as they occur.  An
empty table gives rows for the limits alone.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import ship, written
from .tokens import encoder, text_blocks

#: Context limits that the query answers whether or not a document has this length.
LIMITS = (512, 1024, 2048, 4096, 8192, 16384, 32768, 65536, 131072)
#: Lengths are summed in blocks of this width, then the blocks: no window spans all lengths.
BLOCK = 1024


def encoded_lengths(docs: DataFrame, tokenizer: str, *, text: str = "text") -> DataFrame:
    """n_tokens and n, the documents of this length: a written table with a row for each length that occurs."""
    ship(docs.sparkSession)

    def count(batches):
        ids_of = encoder(tokenizer)
        for _, offsets, data in text_blocks(batches):
            _, bounds = ids_of.encode(data, offsets)
            length, n = np.unique(np.diff(bounds), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(length), pa.array(n.astype(np.int64))], ["n_tokens", "n"])

    counts = docs.select(docs[text].cast("string").alias("text")).mapInArrow(count, "n_tokens long, n long")
    return written(counts.groupBy("n_tokens").agg(F.sum("n").alias("n")), "lengths")


def length_table(lengths: DataFrame, limits: tuple[int, ...] = ()) -> DataFrame:
    """Histogram with suffix sums, one row a length or limit taken as a context limit.

    n_documents and tokens have this length; documents_longer and tokens_longer
    lie beyond it; truncated_total is what all documents keep under the limit;
    quantile is the share of documents that fit.
    """
    if limits:
        asked = lengths.sparkSession.createDataFrame([(x, 0) for x in limits], "n_tokens long, n long")
        lengths = lengths.select("n_tokens", "n").unionAll(asked)
    histogram = lengths.groupBy("n_tokens").agg(F.sum("n").alias("n_documents")).withColumn("block", F.floor(F.col("n_tokens") / BLOCK))
    behind = Window.orderBy(F.col("block").desc()).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    blocks = (
        histogram.groupBy("block")
        .agg(F.sum("n_documents").alias("d"), F.sum(F.col("n_documents") * F.col("n_tokens")).alias("t"))
        .select("block", F.coalesce(F.sum("d").over(behind), F.lit(0)).alias("d_behind"), F.coalesce(F.sum("t").over(behind), F.lit(0)).alias("t_behind"), F.sum("d").over(whole).alias("d_all"), F.sum("t").over(whole).alias("t_all"))
    )
    inside = Window.partitionBy("block").orderBy(F.col("n_tokens").desc()).rowsBetween(Window.unboundedPreceding, -1)
    longer = F.coalesce(F.sum("n_documents").over(inside), F.lit(0)) + F.col("d_behind")
    tokens_longer = F.coalesce(F.sum(F.col("n_documents") * F.col("n_tokens")).over(inside), F.lit(0)) + F.col("t_behind")
    return (
        histogram.join(blocks, "block")
        .select("n_tokens", "n_documents", (F.col("n_documents") * F.col("n_tokens")).alias("tokens"), longer.alias("documents_longer"), tokens_longer.alias("tokens_longer"), "d_all", "t_all")
        .select(
            "n_tokens",
            "n_documents",
            "tokens",
            "documents_longer",
            "tokens_longer",
            (F.col("t_all") - F.col("tokens_longer") + F.col("documents_longer") * F.col("n_tokens")).alias("truncated_total"),
            (1 - F.try_divide("documents_longer", "d_all")).alias("quantile"),
        )
    )


def totals_at(lengths: DataFrame, limits: tuple[int, ...]) -> DataFrame:
    """context, truncated_total and documents_over for each of ``limits``, exact below, between and beyond the lengths too."""
    found = length_table(lengths, limits).where(F.col("n_tokens").isin(*limits))
    return found.select(F.col("n_tokens").alias("context"), "truncated_total", F.col("documents_longer").alias("documents_over"))
