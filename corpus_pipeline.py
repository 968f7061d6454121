"""A text corpus made ready for training, in stages that each read what the one before kept.

Quality rules turn documents down, near-duplicate groups keep one document, repeated
paragraphs go, documents that hold benchmark items go, and what is left is encoded.

Defined results: a null or empty text fails the length rule, so it does not reach the second stage;
rows without an id are compared with nothing and stay; repeated rows of one id stay or go
together; an empty table gives an empty result; extra columns of documents, whatever their names,
come out of all stages but the last as they went in (n_chars follows the text where that is cut).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bindframe.llm import bpe_transducer, decontaminate, near_dedup, quality_rules, substring_dedup
from bindframe.llm._common import stash
from bindframe.llm.queries import VOCABULARY


def reject_by_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules or their host's rates turn down go."""
    return quality_rules.keep_good(docs)


def keep_one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five-word shingles, similarity 0.8) the smallest id stays."""
    return near_dedup.keep_one(docs)


def remove_repeated_paragraphs(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Paragraphs and passages of 50 words or more that repeat an earlier one are cut out of the texts."""
    kept = substring_dedup.remove_repeats(docs)
    return kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else kept


def remove_benchmark_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item within its edit budget go."""
    return decontaminate.remove_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids and decoded text of each document that is left."""
    return bpe_transducer.encode(docs, VOCABULARY)


STAGES = [
    ("quality_rules", reject_by_rules),
    ("near_dedup", keep_one_of_near_duplicates),
    ("substring_dedup", remove_repeated_paragraphs),
    ("decontamination", remove_benchmark_documents),
    ("bpe", encode_texts),
]

#: SQL can neither sketch and branch nor merge by rank; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written to the shared folder and read again as the next one's input."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stash(docs)
    return docs
