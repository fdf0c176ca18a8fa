"""The corpus pipeline: five stages, each written and read again as the next one's documents.

1. quality rules: documents that the boosted trees or the base rules reject go;
2. n-gram Jaccard join: of each group of near duplicates the first document stays
   (five-word shingles, similarity 0.8 or more);
3. substring dedup: words of passages that an earlier document has are taken out;
4. benchmark decontamination: documents that share a window with the benchmark go;
5. BPE encoding and decoding: the ids of every document that is left.

The first four return the columns of documents.  Null texts are rejected by the
first stage; empty tables stay empty; other columns are carried along.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from palimpsest.llm import bpe, decontamination, jaccard_join, quality, substring_dedup
from palimpsest.llm.queries import table, tokenizer_path
from palimpsest.llm.staging import staged
from palimpsest.shipping import ship

SHINGLE_WORDS, SIMILARITY_PERCENT = 5, 80


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.good_documents(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.representatives(docs, SHINGLE_WORDS, SIMILARITY_PERCENT)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return substring_dedup.cleaned(docs)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.round_trip(docs, tokenizer_path())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality_rules),
    ("near duplicates", near_duplicates),
    ("repeated passages", repeated_passages),
    ("benchmark passages", benchmark_passages),
    ("tokens", tokens),
]

#: The verdict of the trees and the ids of the tokenizer are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each but the last written to the shared folder and reread."""
    ship(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
