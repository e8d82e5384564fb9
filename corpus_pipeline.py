"""A corpus from raw documents: toxic texts out, near copies out, repeated passages out, personal
data masked, then packed into training windows.

Each stage reads what the one before it wrote. All but the last return the columns of their input.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from attempt_grid.llm.common import split_by_keys, written
from attempt_grid.llm.near_copies import near_copy_components
from attempt_grid.llm.packing import pack
from attempt_grid.llm.pii import mask_personal_data, train_field
from attempt_grid.llm.substring_dedup import without_repeated_passages
from attempt_grid.llm.toxicity import fit_toxicity, without_toxic


def _characters(docs: DataFrame) -> Column:
    """n_chars of a changed text; a null text keeps its number."""
    return F.coalesce(F.length("text"), "n_chars").cast(docs.schema["n_chars"].dataType)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score reaches 0.5 go."""
    return without_toxic(docs, fit_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest doc_id stays, in one row.

    Near copies share 0.8 or more of their five-word shingles. Documents without a doc_id cannot be told apart from their copies and stay.
    """
    groups = written(near_copy_components(docs))
    copies = groups.filter("doc_id <> component_id").select("doc_id").distinct()
    repeated = groups.filter("doc_id IS NOT NULL").groupBy("doc_id").count().filter("count > 1").select("doc_id")
    # only these documents and few others are shuffled
    some, others = split_by_keys(docs, "doc_id", copies.unionAll(repeated))
    gone, again = (ids.select(F.col("doc_id").alias("_id")) for ids in (copies, repeated))
    some = some.join(gone, F.col("doc_id") == F.col("_id"), "left_anti")
    once = some.join(again, F.col("doc_id") == F.col("_id"), "left_anti")
    twice = some.join(again, F.col("doc_id") == F.col("_id"), "left_semi").dropDuplicates(["doc_id", "text"])
    return others.unionByName(once).unionByName(twice)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of passages that occurred earlier go; other documents keep their text as it is."""
    cut = without_repeated_passages(docs)
    return cut.withColumn("n_chars", _characters(docs))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is masked by its kind."""
    masked = mask_personal_data(docs, train_field(docs))
    return masked.withColumn("n_chars", _characters(docs))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of windows of 2048 tokens, each with every source's share."""
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("substring_dedup", repeated_passages),
    ("personal_data", personal_data),
    ("packing", packing),
]

# The stages are trained models, hashes and a tokenizer: no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir))
    return docs
