"""The queries of this subpackage; oracle_sql has those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import language_id, license_scan, mixing, ngram_join, packing, quality_classifier, quality_rules, sharding, toxicity, webp
from .common import held, keep, table


def seen_labels(spark: SparkSession, sf_dir: str, label: str) -> DataFrame:
    """Labels of the rows that may be learnt from."""
    return table(spark, sf_dir, "labels").filter(~held("doc_id", 3, 1) & F.col(label).isNotNull()).select("doc_id", label)


def op1_webp_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, name = webp.digests(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", *[F.col(f"{name}.{f.name}").alias(f.name) for f in webp.SCHEMA])


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.op2(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts are read once; fitting and scoring work on the few statistics of each."""
    docs, stats = quality_classifier.described(table(spark, sf_dir, "documents").select("doc_id", "text"))
    docs = keep(docs.select("doc_id", stats))
    model = quality_classifier.fit(docs.join(seen_labels(spark, sf_dir, "quality"), "doc_id"), stats)
    out, name = quality_classifier.score(docs, model, stats)
    return out.select("doc_id", held("doc_id", 3, 1).alias("held_out"), F.col(name).alias("score")).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language_id.fit(docs.filter(~held("doc_id", 5, 0)))
    out, name = language_id.predict(docs.select("doc_id", "text"), model)
    return out.select("doc_id", held("doc_id", 5, 0).alias("held_out"), f"{name}.lang_pred", f"{name}.score", f"{name}.ambiguous")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.op6(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.op7(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out, name = toxicity.score(docs, toxicity.fit(docs, seen_labels(spark, sf_dir, "toxic")))
    return out.select("doc_id", held("doc_id", 3, 1).alias("held_out"), F.col(name).alias("score")).withColumn("predicted", (F.col("score") >= 0.7).cast("int"))


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.op9(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.op10(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for k, v in globals().items() if k.startswith("op") and callable(v)}


def oracle_sql() -> dict[str, str]:
    return {"op4_license_scan": license_scan.sql()}
