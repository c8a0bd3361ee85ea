"""Training-data pipeline over ``documents``: quality rules, near-dedup, secret scans, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes it as Parquet in the shared folder and
reads it again as the next stage's docs. All but the last return the columns of documents. A null or an empty text fails
the quality rules; an empty table passes through every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import stage, table, without
from tessera.llm.mixing import mixture
from tessera.llm.neardup import near_duplicates
from tessera.llm.packing import pack, public_tokenizer
from tessera.llm.quality import quality_filter
from tessera.llm.secrets import redact

#: Token shares that mixing comes down to, relative to the clean domain.
MIX = {"low": 0.005, "toxic": 0.005, "clean": 0.99}
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the n-gram ratio."""
    return quality_filter(docs.select(COLUMNS), table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity 0.8), the one with the smallest id."""
    gone = stage(near_duplicates(docs, shingle=5, percent=80).where("not kept").select("doc_id"), "copies")
    return without(docs.select(COLUMNS), "doc_id", gone)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with found secrets masked."""
    return redact(docs.select(COLUMNS)).withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn by their mixing rates; those of the favoured domain stay."""
    return mixture(docs.select(COLUMNS), table(spark, sf_dir, "labels"), MIX).select(COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents, packed into sequences of 4096 tokens."""
    return pack(docs, public_tokenizer())


STAGES = [("quality rules", quality), ("near-dedup", near_dedup), ("secret scans", secrets), ("mixing", mixing), ("packing", packing)]

#: SQL does not express signatures, classifiers and tokenisers; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, function in STAGES:
        docs = stage(function(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return docs
