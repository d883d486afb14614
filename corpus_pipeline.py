"""The corpus pipeline: language ID, line dedup, near-duplicate join, benchmark
decontamination and packing, each a stage over all documents the one before kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last
return the columns of documents.  run() writes each stage's result as Parquet in the
folder all machines share and reads it again as the next one's documents.  Each stage
sets batches for Python workers to 4 MB at most, so what a task holds does not follow the
length of its documents.

Cases: rows without text are rejected by the first stage; an empty table passes
through as one; extra columns stay until packing.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from folioscope.llm import _core, decontaminate, language_id, line_dedup, pack, shingle_join


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a language: no text, no letter in it, or a score below the network's least."""
    _core.small_batches(spark)
    net = language_id.fit(docs)
    return language_id.keep_known(docs, net, least=net.least if net else 0.0)


def new_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops repeated content-defined chunks of lines, the rest of repeated runs up to their edges,
    repeated long lines, and documents of which nothing is left."""
    _core.small_batches(spark)
    return line_dedup.remove(docs, runs=True)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of least id of each group of near duplicates."""
    _core.small_batches(spark)
    return shingle_join.keep_first(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts benchmark passages from the texts, and drops documents of which nothing is left."""
    _core.small_batches(spark)
    return decontaminate.remove(docs, _core.read_table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 2048 ids."""
    _core.small_batches(spark)
    return pack.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("language_id", known_language),
    ("line_dedup", new_lines),
    ("shingle_join", one_of_each),
    ("decontaminate", without_benchmark),
    ("pack", packed),
]

#: Training, the choice of first occurrences and packing have no SQL form; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = _core.read_table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = _core.materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if before is not None:
            _core.discard(before)  # what the stage before left has been read
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
