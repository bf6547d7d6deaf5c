"""From raw documents to token ids: five stages, each written as a table that the next one reads.

A stage that is lost with its executors is run again from the table before it.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from proofmill.llm.bpe import encode_documents
from proofmill.llm.common import durable, read
from proofmill.llm.decontaminate import drop_leaking
from proofmill.llm.neardup import drop_near_duplicates
from proofmill.llm.rules import keep_good
from proofmill.llm.suffixes import cut_repeats


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or a risk-controlled cutoff reject go.

    Null and empty texts go; repeated rows stay or go together; a null doc_id has no label; a score that ties with a cutoff stays;
    an empty table, or one without labels, is fine; all columns come back, whatever their names.
    """
    return keep_good(docs, read(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, similarity 0.8) the document of the least doc_id stays.

    Null and empty texts are copies of nothing and stay; a null doc_id comes last; rows that repeat a doc_id and text stay or go
    together; an empty table stays empty; all columns come back, whatever their names.
    """
    return drop_near_duplicates(docs, words=5, num=80, den=100)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Text under strings of 100 bytes that also start earlier goes; the document stays, with what is left.

    Null texts stay null, empty and short ones as they are; a null doc_id comes first; rows that repeat a doc_id and text are one
    document and end alike; an empty table stays empty; n_chars follows the text, all other columns come back.
    """
    return cut_repeats(docs, length=100)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents into which a benchmark item leaks go.

    Null and empty texts and items match nothing; repeated rows stay or go together; an empty table or benchmark is fine; all columns come back.
    """
    return drop_leaking(docs, read(spark, sf_dir, "benchmark"))


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of what is left, with digests of the ids and of their decoding.

    Null and empty texts have no ids; repeated rows give repeated results; null doc_ids pass through; other columns are left out.
    """
    return encode_documents(docs, public_tokenizers.path("word_bpe_49k.json"), outputs=("ids", "digests"))


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("suffix_dedup", suffix_dedup),
    ("decontamination", decontamination),
    ("bpe", bpe),
]

#: SQL can express the first stage alone; tests hold the others against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = durable(docs)
    return docs
