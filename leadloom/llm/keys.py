"""Row keys of documents that hold under null and repeated ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Stands for a null id inside joins; it sorts after every other id.
NO_ID = 2**63 - 1


def keyed(docs: DataFrame, *, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Columns k_id, k_text and text: the id (null: NO_ID) and a hash of the text name a row.

    Rows equal in both are copies of one document; each still gives a result row.
    """
    body = F.coalesce(docs[text].cast("string"), F.lit(""))
    return docs.select(F.coalesce(docs[key].cast("long"), F.lit(NO_ID)).alias("k_id"), F.xxhash64(body).alias("k_text"), body.alias("text"))


def original_id(column: str = "k_id") -> Column:
    return F.when(F.col(column) != NO_ID, F.col(column))
