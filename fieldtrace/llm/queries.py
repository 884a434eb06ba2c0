"""Queries of this subpackage, one for each operator, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import alignment, bpe, clustering, decontaminate, fingerprints, html, ngram_join, packing, quality, rules, substring, token_counts, toxicity
from .common import read_table, shared_path


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), with_ids=False)


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract_pages(read_table(spark, sf_dir, "pages"))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return quality.score_quality(docs, quality.fit_quality(docs, read_table(spark, sf_dir, "labels")))


def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(read_table(spark, sf_dir, "documents"), words=4, percent=85)


def op5_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.apply_rules(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cache of its own for each call, so every distinct text is encoded."""
    return token_counts.count_tokens(read_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), shared_path(spark, "token-counts"))


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_documents(read_table(spark, sf_dir, "documents"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.remove_repeats(read_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return toxicity.score_toxicity(docs, toxicity.fit_toxicity(docs, read_table(spark, sf_dir, "labels")))


def op11_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op12_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.cluster_vectors(read_table(spark, sf_dir, "embeddings"))


def op13_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align_documents(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def longest_benchmark_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each benchmark item's longest verbatim match of at least ten words, and where it is."""
    return decontaminate.longest_matches(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def token_counts_from_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts through a cache that holds another tokenizer's counts of all texts and this one's of those in English."""
    docs, path, cache = read_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), shared_path(spark, "token-counts")
    token_counts.count_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"), cache)
    token_counts.count_tokens(docs.where("lang = 'en'"), path, cache)
    return token_counts.count_tokens(docs, path, cache)


def near_duplicate_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signature bands joined, Jaccard verified: the class of every text of fingerprints alike."""
    return fingerprints.near_duplicate_classes(read_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (
    op1_packing, op2_html_extraction, op3_quality_classifier, op4_ngram_jaccard_join, op5_bpe_round_trip,
    op6_quality_rules, op7_token_counts, op8_fingerprints, op9_substring_dedup, op10_toxicity,
    op11_decontamination, op12_centroid_clustering, op13_tokenizer_alignment,
    longest_benchmark_matches, token_counts_from_cache, near_duplicate_classes,
)}

ORACLE_SQL: dict[str, str] = {
    "op4_ngram_jaccard_join": ngram_join.oracle(words=4, percent=85),
    "op6_quality_rules": rules.oracle(),
    "op11_decontamination": decontaminate.oracle(),
    "op12_centroid_clustering": clustering.oracle(),
}
