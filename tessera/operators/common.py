"""Shared helpers: size-checked broadcast and dense positional indexes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Largest side we broadcast after counting it; beyond it the join shuffles (AQE may still
# turn it into a broadcast at run time from measured sizes). Callers with wide rows pass a
# smaller bound: narrow rows (token, id, two numbers) x 1M is about 50 MB.
DEFAULT_BROADCAST_ROWS = 1_000_000


def bounded_broadcast(df: DataFrame, max_rows: int = DEFAULT_BROADCAST_ROWS) -> tuple[DataFrame, int]:
    """Broadcast ``df`` only when a count proves it small; return the frame and its size."""
    n = df.count()
    return (F.broadcast(df) if n <= max_rows else df), n


def dense_index(df: DataFrame, order_cols, group_cols=(), index_col: str = "idx",
                num_partitions: int | None = None) -> DataFrame:
    """COL-10: 0-based dense position over a total order, optionally restarting per group.

    Works like ``zipWithIndex`` without leaving the DataFrame API: range-partition on the
    (group, order) keys, number rows inside each partition, then add per-(partition, group)
    offsets computed from a tiny count table. No window over the whole table, so one hot
    group is spread over many partitions instead of landing in one task. ``order_cols``
    must be unique within a group so that re-executed tasks number rows identically.
    """
    from ..session import cut_lineage

    keys = [*group_cols, *order_cols]
    spark = df.sparkSession
    n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    # Range bounds are sampled per execution, so the numbered rows are materialised once
    # (reliable checkpoint) and both the count table and the final join read that copy.
    s = cut_lineage(df.repartitionByRange(n, *keys).sortWithinPartitions(*keys)
                    .withColumn("_pid", F.spark_partition_id())
                    .withColumn("_mid", F.monotonically_increasing_id()))
    stats = s.groupBy("_pid", *group_cols).agg(F.min("_mid").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*group_cols).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    stats = stats.withColumn("_off", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    # null groups are groups too, so the offsets meet the rows null-safely; ungrouped, the table has
    # one row per partition and is broadcast, else its size follows the groups and the join decides
    names = {c: f"_g{i}" for i, c in enumerate(group_cols)}
    stats = stats.select(F.col("_pid").alias("_p"), *[F.col(c).alias(g) for c, g in names.items()], "_first", "_off")
    on = s["_pid"] == stats["_p"]
    for c, g in names.items():
        on = on & s[c].eqNullSafe(stats[g])
    out = s.join(stats if group_cols else F.broadcast(stats), on).drop("_p", *names.values())
    out = out.withColumn(index_col, F.col("_mid") - F.col("_first") + F.col("_off")).drop("_pid", "_mid", "_first", "_off")
    out._checkpoint = s._checkpoint  # ``release`` deletes the numbered copy
    return out


def batch_number(index_col, size: int):
    """COL-11: fixed-size batch of a 0-based index."""
    return F.floor(F.col(index_col) / F.lit(size)).cast("bigint")
