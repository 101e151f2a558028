"""Corpus pipeline: quality rules, exact dedup, near duplicates, mixture, pieces.

Each stage is ``(spark, docs, sf_dir) -> DataFrame``; its result is written as
Parquet to the shared folder and read back as the next stage's ``docs``.
"""

from __future__ import annotations

import os
import sys

from pyspark.sql import DataFrame, SparkSession

_HERE = os.path.dirname(os.path.abspath(__file__))
if _HERE not in sys.path:
    sys.path.insert(0, _HERE)

from tidecast.llm import exact_dedup, jaccard_join, mixture, piece_codec, quality_rules  # noqa: E402
from tidecast.llm.common import arrow_rows, shared_table, table  # noqa: E402

ARROW_ROWS = 1000  # documents that a Python task of the last stage receives at once


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble rejects go."""
    return quality_rules.keep_good(docs, table(spark, sf_dir, "labels"))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the smallest doc_id stays."""
    return exact_dedup.drop_copies(docs)


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by shingle similarity 0.75 or more the one with the smallest doc_id stays."""
    return jaccard_join.one_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mixture takes it."""
    return mixture.mixed_documents(docs)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, token_ids and round_trip of every document in the mix."""
    with arrow_rows(spark, ARROW_ROWS):
        return shared_table(piece_codec.encode(docs), "stage-encoded")


STAGES = [
    ("quality", keep_quality),
    ("exact_dedup", drop_exact_copies),
    ("near_copies", one_of_near_copies),
    ("mix_sources", mix_sources),
    ("encode_pieces", encode_pieces),
]

ORACLE_SQL = None  # the trained stages have no SQL form


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = shared_table(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
