"""Report aggregates over change rows and tasks (AGG-4..8, AGG-13, JOIN-6, JOIN-9, WIN-2)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dense_index

COMPLEXITIES = ("SIMPLE", "MODERATE", "COMPLEX")


def complexity_matrix(changes: DataFrame, file_col: str = "filename") -> DataFrame:
    """AGG-4: per file, number of changes of each complexity (fixed values, no pivot job)."""
    aggs = [F.count_if(F.col("complexity") == c).alias(f"n_{c.lower()}") for c in COMPLEXITIES]
    return changes.groupBy(file_col).agg(*aggs, F.count(F.lit(1)).alias("n_total"))


def lines_by_complexity(tasks: DataFrame) -> DataFrame:
    """AGG-5: sum(int(numberOfLines)) per complexity; non-numeric text fails like the original."""
    return tasks.groupBy("complexity").agg(F.sum(F.col("numberOfLines").cast("int")).alias("lines"))


def tasks_by_effort(tasks: DataFrame, order_col: str, ranks: dict, other_rank: int = 4) -> DataFrame:
    """AGG-6 / WIN-2: stable sort by effort rank (unknown efforts last), position inside each
    effort group in original order, and the global sorted position. Both positions come from
    ``dense_index`` so a dominant effort value is spread over many tasks."""
    rank = None
    for k, v in ranks.items():
        rank = F.when(F.col("effort") == k, F.lit(v)) if rank is None else rank.when(F.col("effort") == k, F.lit(v))
    t = tasks.withColumn("effort_rank", rank.otherwise(F.lit(other_rank)))
    t = dense_index(t, [order_col], ["effort"], index_col="group_pos")
    return dense_index(t, ["effort_rank", order_col], index_col="sorted_pos")


def app_totals(files: DataFrame, impacted: DataFrame) -> DataFrame:
    """AGG-7: lines of code (nulls ignored), files, impacted files."""
    f = files.join(impacted.distinct().withColumn("_imp", F.lit(1)), "filename", "left")
    return f.agg(F.sum("line_count").alias("lines_of_code"), F.count(F.lit(1)).alias("n_files"),
                 F.count("_imp").alias("n_impacted"))


def impact_split(files: DataFrame, impacted: DataFrame) -> DataFrame:
    """AGG-8: modified vs unchanged files and lines."""
    f = files.join(impacted.distinct().withColumn("_imp", F.lit(1)), "filename", "left")
    imp = F.col("_imp").isNotNull()
    return f.agg(F.count_if(imp).alias("modified_files"), F.count_if(~imp).alias("unchanged_files"),
                 F.coalesce(F.sum(F.when(imp, F.col("line_count"))), F.lit(0)).alias("modified_lines"),
                 F.coalesce(F.sum(F.when(~imp, F.col("line_count"))), F.lit(0)).alias("unchanged_lines"))


def task_changes(tasks: DataFrame, changes: DataFrame, key: str, measure: str, total: str) -> DataFrame:
    """JOIN-6: explode task indexes, join the indexed changes, re-nest in index order.

    Every task stays: one without any change (or without indexes) has zero changes and a total of 0.
    """
    ex = tasks.select(key, F.posexplode_outer("indexes").alias("_p", "idx"))
    j = ex.join(changes.withColumn("_there", F.lit(1)), [key, "idx"], "left")
    hit = F.when(F.col("_there") == 1, F.struct("_p", "idx"))
    return j.groupBy(key).agg(
        F.count("_there").alias("n_changes"),
        F.array_join(F.transform(F.array_sort(F.collect_list(hit)), lambda x: x["idx"].cast("string")), ",").alias("line_numbers"),
        F.round(F.coalesce(F.sum(measure), F.lit(0.0)), 6).alias(total))


def affected_changes(changes: DataFrame, affected: DataFrame, file_col: str = "filename") -> DataFrame:
    """JOIN-9: semi join with the affected files, counted by file and complexity."""
    j = changes.join(affected, file_col, "left_semi")
    return j.groupBy(file_col, "complexity").agg(F.count(F.lit(1)).alias("n"))
