"""The corpus pipeline: five stages over ``documents``, each by one corpus operator.

``run`` applies ``STAGES`` in order.  Each stage works on all rows that its predecessor
kept, and is written to the folder that all executors share before the next one reads.

All stages take any table with ``doc_id``, ``text`` and ``lang``.  All but the last return
its columns as they are, also those whose names the operators use inside.  An empty table
stays empty through every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from driftloom.llm import decontam, langid, neardup, packing, pii
from driftloom.llm.common import stored, table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose words are mostly of one language stay.

    Null and empty texts, and those without letters, go: nothing tells their language.  A
    null ``lang`` isn't learned from.  Rows that repeat stay or go together.
    """
    return langid.keep_identified(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class stays, that of the smallest ``doc_id``.

    Null and empty texts are one class.  Of rows that repeat one stays; unlike texts that
    share a ``doc_id`` are unlike documents; a null ``doc_id`` comes last.
    """
    return neardup.keep_one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a leak of ``benchmark`` stay.

    Null and empty texts have none.  Rows that repeat stay or go together.
    """
    return decontam.keep_clean(docs, table(spark, sf_dir, "benchmark", "item_id", "text"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents stay; personal data in their texts is replaced by its kind.

    Null texts stay null, empty ones empty; rows that repeat all stay, alike.
    """
    return pii.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' tokens in sequences of 1024: one row per piece.

    Null and empty texts are the end id alone; rows that repeat, also a ``doc_id``, are
    packed each for itself; a null ``doc_id`` stays null.
    """
    return packing.pack(docs)


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("packing", pack),
]

#: Learned models, near duplicates and tokens are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
