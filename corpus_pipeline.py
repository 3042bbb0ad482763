"""A corpus pipeline: documents through toxicity, quality rules, near-duplicates and packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and reread as the next one's docs. All but the
last return rows of ``documents`` with its columns.

Defined results, which hold for every stage: an empty table gives an empty one; columns besides doc_id, text and lang are passed on and may
have any name; texts of any length are read whole. Labels may be missing: nothing is toxic then, and quality is learned from all rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from courtflux.llm import common, packing, quality, simhash, toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the factorization machine predicts to be toxic (a score of 0.5 is).

    Null and empty texts have the score of the labels alone; repeated rows go or stay together. A null id matches no label.
    """
    return toxicity.drop_toxic(docs, common.table(spark, sf_dir, "labels"))


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the counts or the perplexity bands reject; one on a band's edge stays.

    Null and empty texts have under ten words, so they go. A null lang counts as the empty one. Repeated rows go or stay together.
    """
    return quality.keep_good(docs, common.table(spark, sf_dir, "labels"))


def keep_one(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: that with the smallest id, of rows that share it one.

    Null texts count as empty ones, which are near-duplicates of each other. A group without ids keeps one row too.
    """
    return simhash.keep_one(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the sequences that the documents are packed into.

    Null and empty texts are an end token. Equal places on the curve are ordered by id (nulls first), then by tokens; repeated rows are packed
    as often as they stand there.
    """
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("quality", keep_good),
    ("near_duplicates", keep_one),
    ("packing", pack),
]

#: Learned scores, perplexity, XXH64 and a tokenizer go beyond SQL; the tests compare with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = common.written(stage(spark, docs, sf_dir))
    return docs
