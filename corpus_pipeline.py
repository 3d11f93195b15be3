"""The corpus pipeline: quality, repeated lines, near copies, benchmark leaks, token ids.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame. ``run`` writes the result of a stage below
``spark.checkpoint.dir`` and reads it again as the next one's ``docs``. All stages but the last return the columns of
``documents``. A null text is empty to every stage; repeated rows and rows without an id go through like any other; an
empty table gives an empty result; columns beyond those of ``documents`` are carried by all stages but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokengraph.llm import line_chunks, neighbour_quality, templates, trie_join, word_table_bpe
from tokengraph.llm.common import cut, table
from tokengraph.llm.queries import tokenizer_file


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the neighbours' vote does not reject."""
    return neighbour_quality.accepted(docs, table(spark, sf_dir, "labels"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the multi-line chunks that an earlier document or place has; every document stays."""
    return line_chunks.deduplicated(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by a Jaccard similarity of 0.8 or more over five-word shingles."""
    return trie_join.one_of_each(docs, size=5, percent=80)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a template window of a benchmark item."""
    return templates.clean(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, ids, n_tokens``: byte-level BPE ids of what is left."""
    made = word_table_bpe.encode(docs, tokenizer_file("byte_bpe_50k.json"))
    return made.select("doc_id", "ids", F.size("ids").cast("long").alias("n_tokens"))


STAGES = [("quality_classifier", quality), ("line_dedup", lines), ("ngram_jaccard_join", near_copies), ("benchmark_decontamination", decontaminate), ("bpe_encoding", encode)]

ORACLE_SQL: str | None = None
"""Neighbour votes, rolling hashes and merges have no SQL; tests compare ``run`` with a brute-force version."""


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir))
    return docs
