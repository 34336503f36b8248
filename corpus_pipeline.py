"""The corpus pipeline: documents through quality rules, near-duplicate removal, removal of repeated passages, mixing of
sources and packing. Every stage takes what the one before kept; all but the last return the columns of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from textveil.llm import jaccard_join, mixing, packing, quality, substring_dedup
from textveil.llm.common import table, written
from textveil.llm.queries import vocabulary


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return quality.kept_documents(docs, quality.trusted_ids(table(spark, sf_dir, "labels")))


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest id stays. Runs of five words, a similarity of 0.8."""
    return jaccard_join.one_of_each(docs, n=5, percent=80)


def substring_removal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that an earlier document holds are cut out."""
    return substring_dedup.without_repeats(docs, chars_col="n_chars")


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document at least once; those of sources that are to weigh more, more often."""
    return mixing.mixed_documents(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of every piece of every document in a sequence."""
    return packing.pack(docs, *vocabulary())


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", ngram_jaccard_join),
    ("substring dedup", substring_removal),
    ("mixing sources", source_mixing),
    ("best-fit packing", best_fit_packing),
]

#: Neither compact windows nor a tokenizer are within SQL's reach; tests/llm/test_near_duplicates.py has a brute-force version (test_pipeline).
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again. Rows that share an id, or have none, are told apart by their
    texts in the first three stages; an empty table gives an empty table."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)


def queries() -> dict:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
