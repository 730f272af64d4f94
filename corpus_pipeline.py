"""Corpus pipeline: language ID, near copies, benchmark decontamination, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vigilspark.llm.common import table, written
from vigilspark.llm.decontaminate import drop_contaminated
from vigilspark.llm.language import keep_identified
from vigilspark.llm.near_copies import keep_firsts
from vigilspark.llm.packing import pack_documents
from vigilspark.llm.tokens import tokenizer_path


def pack_kept(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Last stage: the pieces of all rows in sequences of at most 1024 tokens; a null text is empty, repeated rows are packed each, an empty table has no pieces."""
    return pack_documents(docs, tokenizer_path("byte_bpe_50k.json"), end_id=0, word_ends=False)


STAGES = [
    ("language_id", keep_identified),
    ("near_copies", keep_firsts),
    ("decontaminate", drop_contaminated),
    ("pack", pack_kept),
]
#: SQL expresses neither the centroids, nor the latent search, nor the packing: tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage; every stage is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
