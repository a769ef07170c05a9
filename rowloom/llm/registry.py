"""Queries of the training-data operators: each applies its operator to its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowloom.llm import audit, balltree, decontaminate, jaccard, langid, media, mincut, mixing, pii, secrets, sharding, tokens, urlfilter
from rowloom.session import spread

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(name: str, oracle: str | None = None):
    def add(f):
        QUERIES[name] = f
        if oracle is not None:
            ORACLES[name] = oracle
        return f

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


@_query("op1_pii")
def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pii_digest(pii.pii_spans(_table(spark, sf_dir, "documents")))


@_query("op9_token_counts")
def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = tokens.token_table(_table(spark, sf_dir, "documents"))
    return counted.select(F.col("id").alias("doc_id"), "n_bytes", "n_tokens", (F.col("n_tokens") > 512).alias("over_limit"))


@_query("op2_language_id")
def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", langid.held_out())
    model = langid.train(docs.where(~F.col("held_out")))
    return langid.predict(docs, model, keep=("held_out",)).drop("has_letters")


def media_digest(features: DataFrame) -> DataFrame:
    """The contract's columns from stored media and its features."""
    shape = F.concat_ws("x", "width", "height", "channels")
    return features.select(
        F.col("id").alias("doc_id"), "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32",
        F.length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"),
        F.concat_ws(":", shape, "dhash", F.sha2("tile", 256)).alias("feature"),
    )


@_query("op3_media")
def op3_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_digest(media.media_features(media.text_to_media(_table(spark, sf_dir, "documents"))))


@_query("op5_decontamination", decontaminate.ORACLE)
def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate.decontamination_digest(decontaminate.find_benchmark(docs, _table(spark, sf_dir, "benchmark")))


@_query("op6_mixing", mixing.ORACLE)
def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mixing.mix(docs).select("doc_id", "size", "source_size", "target", "taken")


@_query("op10_sharding", sharding.ORACLE)
def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(_table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


@_query("op4_jaccard_join", jaccard.ORACLE)
def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(_table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


@_query("op7_html_extraction")
def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mincut.main_text(_table(spark, sf_dir, "pages"), keep=("page_id", "url")).select("page_id", "url", "text", "n_chars")


@_query("op8_url_filter", urlfilter.ORACLE)
def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.filter_urls(_table(spark, sf_dir, "pages").select("page_id", "url")).drop("url")


@_query("op12_filter_audit", audit.ORACLE)
def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.interactions(audit.failure_counts(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")))


@_query("op13_centroid_clustering", balltree.oracle())
def op13_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return balltree.with_inertia(*balltree.cluster(_table(spark, sf_dir, "embeddings"))).withColumnRenamed("id", "vec_id")


@_query("op11_secret_scan", secrets.oracle())
def op11_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return secrets.secret_digest(secrets.secret_spans(docs, secrets.train(secrets.labelled_samples(docs))))
