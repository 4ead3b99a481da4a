"""Registered queries of the corpus operators. Each applies its operator with
production parameters to a whole table and derives the digest columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartograph.llm import (attention, audit, embeddings, infill, licenses, mixing, neighbours, packing, pii, quality, simhash, urls, wavelet)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str) -> str:
    """Path of a public tokenizer's file (same on every machine)."""
    import public_tokenizers
    return public_tokenizers.path(name)


def op1_embedding_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate links and components of all vectors."""
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document by multiple-instance learning."""
    return attention.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate class of every document."""
    got = simhash.groups(table(spark, sf_dir, "documents"))
    return got.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of the adaptive quality rules for every document."""
    return quality.rules(table(spark, sf_dir, "documents"))


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Position, size and checksum of every document, read from token shards."""
    return wavelet.round_trip(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the weighted mix takes from every document."""
    return mixing.mix(table(spark, sf_dir, "documents"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License templates found in every document."""
    return licenses.scan(table(spark, sf_dir, "documents"), texts_by_name=licenses.common_texts())


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, rule and verdict of every page's address."""
    return urls.judge(table(spark, sf_dir, "pages"), urls.train(urls.labelled_table(spark), group_col="word"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of personal data in every document."""
    return pii.scan(table(spark, sf_dir, "documents"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place of every piece of every document in the packed sequences."""
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json")).pieces.select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op11_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 nearest vectors of every hundredth vector."""
    return neighbours.nearest(table(spark, sf_dir, "embeddings"))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cuts of every document, digests of the reordered and the restored text."""
    got = infill.transform(table(spark, sf_dir, "documents"))
    return got.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
                      F.sha2(infill.restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every step of every order of five filters, per source."""
    return audit.filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {f.__name__: f for f in (op1_embedding_links, op2_quality_classifier, op3_simhash, op4_quality_rules, op5_token_files,
                                   op6_mixing, op7_license_scan, op8_url_filter, op9_pii, op10_packing, op11_nearest_neighbours,
                                   op12_fill_in_middle, op13_filter_audit)}

ORACLES = {
    "op1_embedding_links": embeddings.oracle(),
    "op4_quality_rules": quality.oracle(),
    "op6_mixing": mixing.oracle(),
    "op7_license_scan": licenses.oracle(texts_by_name=licenses.common_texts()),
    "op12_fill_in_middle": infill.oracle(),
    "op13_filter_audit": audit.oracle(),
}
