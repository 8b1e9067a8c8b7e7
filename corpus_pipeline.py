"""A corpus from raw documents: five stages, each over all that the one before has kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read back as the docs of
the next. All but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from terrain_spark.llm import bpe, decontaminate, line_dedup, near_dup, quality
from terrain_spark.llm.common import documents, stored


def choose_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects what importance resampling leaves out.

    Null and empty texts are neutral; rows with the same doc_id and text go or stay together, ties are decided by doc_id; columns of any name keep their
    values.
    """
    return quality.accept(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies stays, that with the lowest id; texts without words and rows without an id all stay.

    Columns of any name keep their values.
    """
    return near_dup.distinct(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines and sentences are cut out of all but the first document; the first is that with the lowest id, rows without one come last.

    Null and empty texts stay as they are; repeated rows lose what the first of them keeps; columns of any name keep their values.
    """
    return line_dedup.dedup(docs).select(*docs.columns)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go; null and empty texts hold none; repeated rows go or stay together; columns of any name keep their values."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text (little-endian unsigned 32-bit) and their number.

    Python processes go on to other stages with what they keep, so they keep less than for this stage alone.
    """
    return bpe.encode_documents(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, cache=CACHE)


#: Chunks, and pieces of chunks, that a Python process keeps with their ids.
CACHE = 200_000

STAGES = [
    ("quality", choose_quality),
    ("near_dup", drop_near_copies),
    ("line_dedup", cut_repeats),
    ("decontaminate", drop_leaks),
    ("byte_bpe", encode),
]

#: Sketches, models and tilings have no SQL form; the tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline_{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
