"""A corpus made ready for training: five stages, each on all that the one before it kept.

Defined cases, as the stages' own modules state them: texts that are null, empty or under 50 words go with the first stage; rows that
repeat a doc_id are judged one by one, count as one document for lines and near copies, and are packed one by one; rows with a
null doc_id are never near copies; an empty table gives no rows; further columns are carried untouched up to the packing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidewell.llm.common import table, written
from tidewell.llm.line_dedup import dedup_lines
from tidewell.llm.minhash_dedup import drop_near_duplicates
from tidewell.llm.packing import pack
from tidewell.llm.quality_rules import reject_documents
from tidewell.llm.substring_dedup import drop_repeats

#: The scoring and packing stages have no counterpart in SQL; the tests hold the pipeline against brute force.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go."""
    return reject_documents(docs, table(spark, sf_dir, "labels"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that many documents share stay in one."""
    return dedup_lines(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays (five-word shingles, similarity of at least 0.8)."""
    return drop_near_duplicates(docs)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words inside repeated passages go."""
    return drop_repeats(docs)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, packed into sequences: one row per piece."""
    import public_tokenizers

    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality rules", quality),
    ("line dedup", lines),
    ("minhash near-dedup", near_duplicates),
    ("substring dedup", passages),
    ("best-fit packing", sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
