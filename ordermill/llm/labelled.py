"""The fold rule and the bounded training sample that both classifiers use."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def held_out(doc_id: Column) -> Column:
    """True where crc32 of the id as text is divisible by 5; a null id counts as ''."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def training_sample(documents: DataFrame, labels: DataFrame, label: str, rows: int) -> DataFrame:
    """Texts and labels (0.0 or 1.0) of up to ``rows`` labelled documents outside the held-out fold.

    Of the ids that ``documents`` holds, those with the smallest hashes are taken, so that the
    sample is the same in every run. It is bounded, hence may be broadcast; only texts of the sample are
    shuffled. Null labels are left out; of several labels of an id the largest counts, of several texts
    the first in byte order.
    """
    outside = F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))
    known = labels.where(F.col(label).isNotNull() & outside)
    known = known.groupBy(F.col("doc_id").alias("_id")).agg(F.max(F.col(label).cast("double")).alias("label"))
    held = documents.where(outside).select(F.col("doc_id").alias("_id")).distinct()
    chosen = known.join(held, "_id").orderBy(F.xxhash64("_id"), "_id").limit(rows)
    texts = documents.select("doc_id", "text")
    sample = texts.join(F.broadcast(chosen), texts.doc_id == chosen._id)
    return sample.groupBy("_id").agg(F.min("text").alias("text"), F.first("label").alias("label")).select("text", "label")
