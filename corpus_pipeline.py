"""A corpus for language-model training: toxic documents go, repeated passages go, of near duplicates one stays, then packing."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from codeloom.llm.common import new_path
from codeloom.llm.jaccard_join import keep_one_per_component
from codeloom.llm.packing import pack
from codeloom.llm.passages import remove_repeated_passages
from codeloom.llm.toxicity import drop_toxic


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that aren't predicted to be toxic; learnt from the labels of rows that aren't held out."""
    return drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without later occurrences of passages of over 50 words, or of three lines or more.

    Rows that lose all their words leave here: what they held stays in earlier places. The next stage would keep them,
    as empty texts have no near duplicates. Rows that had no words before stay.
    """
    return remove_repeated_passages(docs, drop_emptied=True)


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of documents whose five-word shingles have a similarity of 0.8 or more; rows without words all stay."""
    return keep_one_per_component(docs, width=5, percent=80)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences of 4096 tokens."""
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"), window=4096, end=2)


STAGES = [("toxicity", without_toxic), ("line_dedup", without_repeated_lines), ("near_duplicates", without_near_duplicates), ("packing", packed)]

#: SQL can't express the first stage's model. Tests hold the stages apart against brute force or known texts; of the whole run only ids and places are checked.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; each one's result is a table in the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = new_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
