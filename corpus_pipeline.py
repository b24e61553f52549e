"""Corpus pipeline: quality, near duplicates, benchmark, secrets, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet
and read again as the next one's ``docs``; all but the last return the columns of ``documents``. Whole texts go
through Python workers in every stage, which stay alive from stage to stage: batches are bounded by bytes.
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import common, decontaminate, jaccard_join, packing, ranking, secrets
from tessera.sources.tables import table


def _small_batches(stage):
    """The stage with batches to Python workers bounded (``common.bound_batches``)."""

    @wraps(stage)
    def bounded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        common.bound_batches(spark)
        return stage(spark, docs, sf_dir)

    return bounded


@_small_batches
def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ranking model (fitted on the labelled training fold of ``documents``) rejects go."""
    model = ranking.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return ranking.keep_good(docs, model)


@_small_batches
def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five words, similarity 0.8) the smallest doc_id stays."""
    return jaccard_join.keep_one(docs, width=5, percent=80)


@_small_batches
def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark window go."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


@_small_batches
def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced in the text; every document stays."""
    return secrets.redact_secrets(docs)


@_small_batches
def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of what is left, packed into training sequences."""
    return packing.pack(packing.pieces(docs))


STAGES = [
    ("quality_classifier", quality_classifier),
    ("ngram_jaccard_join", ngram_jaccard_join),
    ("benchmark_decontamination", benchmark_decontamination),
    ("secret_scans", secret_scans),
    ("best_fit_packing", best_fit_packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; every stage's result is a table in the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


#: Ranking weights, bitmaps and packing order are not expressible in SQL; tests hold run() against
#: a brute-force version instead.
ORACLE_SQL = None
