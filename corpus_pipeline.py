"""A training corpus from raw documents: five stages, each an operator of docmill.llm at work on what the stage before kept.

Every stage but the last returns the columns of `documents`; the last adds what the mix took.

Defined cases, for every stage: an empty table gives an empty one; further columns are left out, so
their names can't clash; texts of any length are read whole.  What each does with nulls, ties and
repeated rows stands in its docstring.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docmill.llm import decontaminate, mixing, ngram_join, pii, quality
from docmill.llm.shared import written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the current policy.  Null and empty texts have too few words and go; repeated rows are judged alike; null ids, languages and sources don't matter."""
    book = quality.ledger(docs, prefix="__q_")
    return book.where(quality.passes(quality.CURRENT, "__q_")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked documents, the one with the smallest id, a null id last; repeated rows leave one.

    Texts that are null or without a word link with nothing and stay; of several texts under the smallest id one stays.
    """
    return ngram_join.one_of_each(docs.select(*COLUMNS))


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a word inside a benchmark window.  Null texts have no words and stay; repeated rows are judged alike; null items have no window."""
    found = decontaminate.matched(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.where("NOT contaminated").select(*COLUMNS)


def pii_surrogates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced; n_chars follows a changed text, and stays as it is, null too, where the text does.

    Null texts stay null; repeated rows get equal surrogates; where entities overlap the kind listed first takes its text.
    """
    changed = pii.replaced(docs.select(*COLUMNS))
    n_chars = F.when(F.col("n_entities") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return changed.withColumn("n_chars", n_chars).select(*COLUMNS)


def mixing_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, with how often (`copies`) and their size in words.

    A null source is one of its own, ranked last; null texts have size 0, and may be taken as such; rows of one id share its draw.
    """
    mix = mixing.mixed(docs.select(*COLUMNS))
    return mix.where(F.col(mixing.P + "copies") > 0).select(*COLUMNS, F.col(mixing.P + "size").alias("size"), F.col(mixing.P + "copies").alias("copies"))


STAGES = [
    ("quality_rules", quality_rules),
    ("ngram_jaccard", near_duplicates),
    ("benchmark_decontamination", benchmark_decontamination),
    ("pii", pii_surrogates),
    ("mixing", mixing_to_weights),
]

#: Surrogates are keyed permutations, which SQL can't express; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs, _ = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
