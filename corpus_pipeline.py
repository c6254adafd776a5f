"""The corpus pipeline: documents through five stages, each written as Parquet and read again by the next.

quality rules -> language ID -> n-gram Jaccard join -> mixing -> packing. Each stage calls its operator on all rows that
the stage before kept; all but the last return the columns of documents.

Cases, for every stage: an empty table gives an empty result; columns beside those of documents pass through; rows with
equal ids are judged one by one, but are one document for the join, which keeps one of them; rows without an id are
documents each. Null and empty texts fail the quality rules; given to later stages, they have no language and go there,
link with nothing in the join, are never taken by the mix, and pack as the one end token.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.llm import common, language_id, mixing, ngram_join, packing, quality_rules


@common.stage
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weakly supervised quality rules reject go."""
    common.ready(spark)
    return quality_rules.keep_quality(docs)


@common.stage
def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language, or with an ambiguous one, go. The classifiers learn from this stage's labelled rows."""
    common.ready(spark)
    return language_id.known_language(docs, F.lit(True))


@common.stage
def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents, the one with the least id stays. Near copies are those of the corpus rule: five words,
    similarity 0.8 or more (the query op9 has a contract of its own: four words, 0.85)."""
    common.ready(spark)
    return ngram_join.distinct_documents(docs, shingle=5, percent=80)


@common.stage
def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; those that it does not take go."""
    common.ready(spark)
    return mixing.mix(docs)


@common.stage
def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the mix in sequences. A document taken twice has its pieces twice."""
    common.ready(spark)
    return packing.op6(docs.select("doc_id", "text"))


STAGES = [("quality_rules", quality), ("language_id", language), ("ngram_join", near_copies), ("mixing", mixed), ("packing", packed)]

#: No stage of trained or sampled decisions can be said in SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other, each result written and read again."""
    docs = common.table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, common.keep(docs) if k else docs, sf_dir)
    return docs
