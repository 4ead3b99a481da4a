"""Corpus pipeline: from raw documents to packed training sequences.

``STAGES`` lists ``(name, function)``; a function takes ``(spark, docs,
sf_dir)`` and returns the rows its stage keeps, in the columns of documents
(the last one: the packed pieces). Each result is written as Parquet and read
again as the next stage's ``docs``, so a lost executor costs at most a part of
one stage. A stage's intermediate tables go when the next stage begins, so its
result must be written by then.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cartograph.llm import mixing, packing, pii, quality, simhash
from cartograph.llm.common import Scratch
from cartograph.llm.queries import table, vocabulary
from cartograph.session import apply_session_rules


_LAST: dict[str, Scratch] = {}


def begin(spark: SparkSession, name: str) -> Scratch:
    """Intermediate tables for a stage. Those of the stage before are deleted:
    its result has been written when the next stage begins."""
    apply_session_rules(spark)
    app = spark.sparkContext.applicationId
    if app in _LAST:
        _LAST.pop(app).close()
    _LAST[app] = Scratch(spark, name)
    return _LAST[app]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the adaptive quality rules reject."""
    return quality.passing(docs, scratch=begin(spark, "quality"))


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each near-duplicate class."""
    return simhash.keep_first(docs, scratch=begin(spark, "simhash"))


def pii_redaction(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by markers."""
    begin(spark, "pii")
    return pii.redact(docs)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the weighted mix of the sources takes it."""
    return mixing.mixed(docs, scratch=begin(spark, "mixing"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of the encoded documents in sequences of at most 2048 tokens."""
    return packing.pack(docs, vocabulary("word_bpe_49k.json"), scratch=begin(spark, "packing")).pieces


STAGES = [("quality_rules", quality_rules), ("simhash_dedup", simhash_dedup), ("pii_redaction", pii_redaction),
          ("source_mixing", source_mixing), ("best_fit_packing", best_fit_packing)]

#: Near-duplicate classes, redaction and token ids are no SQL; tests/llm holds
#: each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, applied to ``documents``."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = scratch.save(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
