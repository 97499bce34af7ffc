"""Corpus pipeline over ``documents``: five stages, each written as Parquet and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskloom.llm import decontaminate, jaccard, pieces, substring, toxicity
from maskloom.llm.store import saved


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that the multiple-instance model scores 0.7 or more; labels come from ``labels``."""
    return toxicity.reject(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), threshold=0.7)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near duplicates (five-word shingles, Jaccard 0.8) only the smallest doc_id stays."""
    groups = jaccard.near_duplicates(docs, shingle=5, num=80, den=100)
    return decontaminate.without(docs, groups.where("doc_id <> component_id").select("doc_id"))


def remove_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of 50-word passages that start in a document of smaller doc_id too are removed; every row stays."""
    kept = substring.remove_repeats(docs, window=50, carry=True)
    column = {
        "doc_id": F.col("doc_id").cast(docs.schema["doc_id"].dataType),
        "text": F.col("kept"),
        "n_chars": F.char_length("kept").cast("long"),
    }
    return kept.select(*[column.get(c, F.col(f"rest.`{c}`")).alias(c) for c in docs.columns])


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold 0.8 or more of a benchmark item's five-word shingles."""
    leaks = decontaminate.find_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return decontaminate.without(docs, leaks.select("doc_id"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every text that is left, and whether decoding gives the text back."""
    return pieces.encode_texts(docs)


STAGES = [
    ("toxicity", reject_toxic),
    ("near_duplicates", keep_one_of_each_group),
    ("substring_dedup", remove_repeated_passages),
    ("decontamination", decontaminated),
    ("sentencepiece", encoded),
]

#: Neither trained scores nor piece ids can be said in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
