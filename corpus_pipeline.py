"""A training corpus from ``documents``: five stages, each over all that the one before kept.

Columns of ``documents`` other than doc_id and text go through the first four stages as they are, whatever their names, nulls
included. Null and empty texts have the quality of a text without words, and are neither toxic, alike nor contaminated. Rows that
repeat a doc_id and its text are one document for the near duplicates, of which one row stays; all other stages judge
each row for itself. Texts of any length are judged whole. Without labels of both classes no document goes for its
quality or toxicity; without test items none for contamination. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ordermill.llm import decontaminate, jaccard, packing, quality, toxicity
from ordermill.llm.stored import stored

# Documents below this quality, and those at or above this toxicity, go.
LEAST_QUALITY = 0.3
MOST_TOXIC = 0.5


def _given(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = quality.fit(docs, _given(spark, sf_dir, "labels"))
    return docs.where(quality.score(model, F.col("text")) >= LEAST_QUALITY)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.fit(docs, _given(spark, sf_dir, "labels"))
    return docs.where(toxicity.score(model, F.col("text")) < MOST_TOXIC)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.drop_near_duplicates(docs, width=5, percent=80)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_contaminated(docs, _given(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("quality classifier", keep_quality),
    ("toxicity", drop_toxic),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("benchmark decontamination", drop_contaminated),
    ("best-fit packing", pack),
]

# The classifiers are trained, so SQL cannot express their stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of all documents that pass every stage."""
    docs = _given(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        docs = stored(stage(spark, docs, sf_dir), f"stage-{number}")
    return docs
