"""Cleaning of a document table in five stages.

quality rules, n-gram Jaccard join, substring dedup, secret scan, packing. Each stage takes (spark, docs, sf_dir);
run() writes what a stage returns to the shared folder and reads it again as the next one's documents.
"""

from __future__ import annotations

from quillon.llm import jaccard_join, packing, quality_rules, secret_scan, substring_dedup
from quillon.llm._store import cut, documents
from quillon.llm.catalog import tokenizer_file


def quality(spark, docs, sf_dir):
    """Failed lines go, and documents that fail the rules."""
    return quality_rules.clean(docs)


def near_duplicates(spark, docs, sf_dir):
    """One document of each group of near copies stays, the one with the smallest id."""
    return jaccard_join.stage(docs)


def repeats(spark, docs, sf_dir):
    """Passages of 50 words that a document with a smaller id has too are removed."""
    return substring_dedup.stage(docs)


def secrets(spark, docs, sf_dir):
    """Secrets are masked."""
    return secret_scan.stage(docs)


def pack(spark, docs, sf_dir):
    """Pieces of tokenised documents with their sequences."""
    return packing.pack(docs, tokenizer_file("word_bpe_49k.json"))


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("repeats", repeats), ("secrets", secrets), ("packing", pack)]
ORACLE_SQL = None  # no stage but the first has an SQL form


def run(spark, sf_dir):
    docs = documents(spark, sf_dir)
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = cut(docs, name)
    return docs
