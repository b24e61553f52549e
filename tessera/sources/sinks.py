"""SNK-1..SNK-5: change-set JSON, evaluation CSV, metric record, embedded corpus, report tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHANGE_COLUMNS = ["code_sample", "complexity", "description", "end_line", "filename", "notes",
                  "start_line", "suggested_change", "warnings"]

# Column order of the evaluation CSV (the two score columns get distinct names).
EVAL_COLUMNS = ["functionality", "source_code", "mysql_schema", "spanner_schema", "gt_code", "gen_code",
                "code_similarity", "gt_desc", "gen_desc", "description_similarity"]


def write_change_set(changes: DataFrame, path: str, mode: str = "overwrite") -> None:
    """SNK-1: one JSON line per file holding its changes, keys sorted, in the answer's order
    (``pos``, where the frame has it; else by line)."""
    cols = [c for c in CHANGE_COLUMNS if c in changes.columns]
    nested = changes.groupBy("filename").agg(
        F.array_sort(F.collect_list(F.struct(F.col("pos" if "pos" in changes.columns else "start_line").alias("_k"), F.struct(*cols).alias("c"))))
        .alias("_c"))
    out = nested.select("filename", F.transform("_c", lambda x: x["c"]).alias("changes"))
    out.write.mode(mode).json(path)


def write_evaluation_csv(rows: DataFrame, path: str, mode: str = "overwrite") -> None:
    """SNK-2: ten columns with a header, one file per partition; quotes inside a value are doubled."""
    rows.select(*EVAL_COLUMNS).write.mode(mode).option("header", "true").option("escape", '"').csv(path)


def metric_record(accuracy: DataFrame, col: str = "accuracy") -> DataFrame:
    """SNK-3: ``[{name, unit, value}]`` with value = accuracy x 100."""
    return accuracy.select(F.lit("Overall Eval Result").alias("name"),
                           F.lit("Accuracy (percent)").alias("unit"),
                           (F.col(col) * 100.0).cast("double").alias("value"))


def write_embedded(corpus: DataFrame, path: str, mode: str = "overwrite") -> None:
    """SNK-4: embedded corpus ordered by id (range-partitioned sort, parquet)."""
    corpus.orderBy("id").write.mode(mode).parquet(path)


def write_report_tables(tables: dict, path: str, mode: str = "overwrite") -> None:
    """SNK-5: one parquet table per report section under ``path``."""
    for name, df in tables.items():
        df.write.mode(mode).parquet(f"{path.rstrip('/')}/{name}")
