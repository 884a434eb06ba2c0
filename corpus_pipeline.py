"""The corpus pipeline: documents to packed sequences in five stages.

Each stage reads what the stage before wrote. ``run`` writes the stages' results as Parquet in the session's shared folder;
``STAGES`` can also be driven from outside.

Every stage takes nulls in any column: a null text counts as empty where it is scored or packed, stays null where rows are kept, and
links to nothing; rows with a null id are kept by all stages. Rows that repeat stay together or go together. Columns may have any
names and all are kept, but for the last stage, which returns pieces. An empty table gives an empty result.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldtrace.llm import ngram_join, packing, quality, substring, toxicity
from fieldtrace.llm.common import read_table, write_shared

#: Words that the packing stage's encoder keeps.
CACHE_WORDS = 300_000


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts that the quality classifier rejects go."""
    return quality.keep_good(docs, read_table(spark, sf_dir, "labels"))


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts that are scored toxic go."""
    return toxicity.keep_civil(docs, read_table(spark, sf_dir, "labels"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One text of each group of near copies (five-word shingles, similarity 0.8) stays."""
    return ngram_join.keep_first(docs, words=5, percent=80)


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sentences under repeated spans go from the texts; n_chars follows."""
    return substring.remove_repeats(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences with their token ids. A smaller word cache than the operator's: workers hold memory of earlier stages too."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), cache_words=CACHE_WORDS)


STAGES = [
    ("quality classifier", quality_stage),
    ("toxicity", toxicity_stage),
    ("n-gram Jaccard join", near_duplicate_stage),
    ("substring dedup", substring_stage),
    ("packing", packing_stage),
]

#: The stages hold fitted models and a tokenizer, which SQL can't express; tests compare them with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = write_shared(docs, f"stage-{k}")
    return docs
