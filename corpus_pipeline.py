"""A corpus pipeline: documents of good quality, one of each group of near copies, without repeated passages and benchmark texts, mixed to target weights."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linelake.llm.common import scratch, staged, table
from linelake.llm.decontaminate import decontaminate
from linelake.llm.mixing import mixture
from linelake.llm.ngram_join import one_of_each
from linelake.llm.quality import keep_quality
from linelake.llm.substrings import remove_repeats

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, fitted on all labelled ones, accepts.

    Null and empty texts are scored like others; repeated rows stay or go together. In this and all stages but the last: rows are those of ``docs``,
    with the columns of documents only; without documents there are none.
    """
    return keep_quality(docs, table(spark, sf_dir, "labels")).select(*COLUMNS)


def unlike(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group of near copies. Rows without id or without words stay, and repeated rows with their id."""
    return one_of_each(docs).select(*COLUMNS)


def unrepeated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the sentences of repeated spans; those of which nothing is left go. Null and empty texts stay as they are; n_chars follows
    the text where it was cut. Repeated rows are cut alike."""
    cut = remove_repeats(docs).where("n_removed = 0 or trim(text) != ''")
    return cut.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def unleaked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of the benchmark: each row stays or goes by its own text. Null and empty texts stay."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark")).select(*COLUMNS)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts drawn to the target weights: the columns of ``mixture``. Null and empty texts have no tokens and are not drawn; repeated rows are each drawn."""
    return mixture(docs)


STAGES = [("quality", good), ("near duplicates", unlike), ("repeated passages", unrepeated), ("benchmark", unleaked), ("mixing", mixed)]

#: A discriminant's fit and a tree's budgets aren't expressed in SQL; tests/llm hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. Each stage's result is written; what a stage staged on its way goes then."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        with scratch(spark):
            docs = staged(stage(spark, docs, sf_dir), name.replace(" ", "-"), kept=True)
    return docs
