"""The corpus pipeline: quality, deduplication, decontamination and tokens for `documents`.

Every stage takes (spark, docs, sf_dir), works on all rows that its predecessor kept and returns a DataFrame; all but the last
return the columns of documents. `run` writes each stage's rows as Parquet in the shared folder, reads them back for the next, and
deletes them when the next stage has written its own.

Defined results, for every stage: null ids, languages and sources are values like any other; extra columns of any name are kept (all but
the last stage) or ignored (the last); an empty table gives no rows. What null and empty texts, repeated rows and ties give is said
for each stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from verilume.llm import bpe, decontaminate, language_model, minhash, quality_rules
from verilume.llm.common import drop, materialize, table
from verilume.llm.queries import tokenizer_path

#: Documents that share this percentage of their five-word shingles are near duplicates (the query op6_minhash has 85).
DUPLICATE_PERCENT = 80


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose perplexity is within their language's threshold. Null and empty texts and languages without trusted text stay; equal rows
    are judged alike; a perplexity equal to the threshold stays."""
    return language_model.reject(docs, table(spark, sf_dir, "labels"))


def quality_outliers(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that break no limit and are no outliers. Null, empty and short texts go; equal rows are judged alike; a distance equal to the
    cut-off stays."""
    return quality_rules.reject(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates, that with the smallest id (a null id only if there is no other; of repeated rows one). Rows
    without words all stay; a similarity of exactly DUPLICATE_PERCENT links."""
    return minhash.deduplicate(docs, percent=DUPLICATE_PERCENT)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that no benchmark item contaminates. Null and empty texts stay; repeated rows go or stay together."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and digests of ids and decoded text of each row. Null and empty texts have no tokens; repeated rows repeat."""
    return bpe.digests(docs, tokenizer_path())


STAGES = [
    ("quality classifier", quality_classifier),
    ("quality rules", quality_outliers),
    ("near duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("tokens", tokens),
]

#: Perplexities, determinants and BPE are beyond SQL; tests/llm hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        drop(*before)
        before = [docs]
    return docs
