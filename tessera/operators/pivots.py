"""Exact range join of unit vectors (JOIN-5, stands in for VEC-7): pivots prune, equi-joins on blocks pair.

All pairs of a query vector and a corpus vector with cosine >= ``t`` are found, none is lost:

1. A few corpus vectors, far from each other, are the pivots. Every vector gets its angle to each pivot; the
   nearest one names its cell.
2. Each side is sorted by (cell, angle to the cell's pivot) over range partitions and cut into blocks of at most
   ``block_rows`` neighbours. A block is described by the smallest and largest angle to each pivot.
3. Angles are a metric. Two blocks can only hold a pair within the angle arccos(t) if, for every pivot, their angle
   ranges come within it. Blocks meet in an equi-join on the cell, each query block in every cell; what fails any
   pivot's bound is dropped. These tables have one row per block.
4. Rows of the blocks left meet by block id (cogroup), the query side of a corpus block in groups of at most
   ``group_rows`` rows, so neither a dense region nor a frequent vector makes a large group. Each group is one
   matrix product; only passing pairs leave it.

Pivots come from at most ``SAMPLE`` corpus vectors (those of least hash). They decide how much is pruned, never the
result. Without any structure in the data nothing can be pruned by distances alone, and every block pair is multiplied: still
no nested loop, no broadcast and bounded groups.

Vectors that are null, empty, hold a null, or have length zero have no direction and pair with nothing. All others must have
as many dimensions as the pivots; another number raises.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..session import cut_lineage, ship

PIVOTS = 8
SAMPLE = 2048
BLOCK_ROWS = 2048
GROUP_ROWS = 4096
#: angles of nearly parallel vectors are known to about the root of the rounding error
SLACK = 1e-6


def _unit_rows(df: DataFrame, vec: str, keys: list[str]) -> DataFrame:
    """Rows with a direction: keys and ``_u``, the unit vector."""
    full = df.select(*keys, V.as_double(vec).alias("_v")).where("size(_v) > 0 and not exists(_v, x -> x is null)")
    return V.with_unit(full, "_v", "_u").where("exists(_u, x -> x <> 0)").select(*keys, "_u")


def choose_pivots(corpus: DataFrame, vec: str, n: int) -> np.ndarray:
    """``n`` (or fewer) unit vectors of a bounded sample, each the farthest from those before."""
    rows = corpus.select(vec).orderBy(F.xxhash64(vec)).limit(SAMPLE).toArrow().column(0).combine_chunks()
    if not len(rows):
        return np.empty((0, 0))
    sample = np.unique(matrix(rows, len(rows[0])), axis=0)
    chosen, nearest = [0], sample @ sample[0]
    while len(chosen) < min(n, len(sample)):
        chosen.append(int(nearest.argmin()))
        nearest = np.maximum(nearest, sample @ sample[chosen[-1]])
    return sample[chosen]


def matrix(column, dims: int) -> np.ndarray:
    """Rows of a list column as a matrix."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if not all(n == dims for n in set(flat.value_lengths().to_pylist())):
        raise ValueError(f"a vector has not {dims} dimensions")
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), dims)


def _blocks(rows: DataFrame, keys: list[str], pivots: np.ndarray, block_rows: int) -> DataFrame:
    """keys, _u, cell, block, a0..: rows with their angles, sorted and cut into blocks; materialised once."""
    p, dims = pivots.shape
    angles = [f"a{k}" for k in range(p)]

    def scan(batches):
        for b in batches:
            a = np.arccos(np.clip(matrix(b.column("_u"), dims) @ pivots.T, -1, 1)) if b.num_rows else np.empty((0, p))
            cell = a.argmin(1).astype(np.int32) if len(a) else np.empty(0, np.int32)
            ring = a[np.arange(len(a)), cell]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell), pa.array(ring), *(pa.array(np.ascontiguousarray(a[:, k])) for k in range(p))],
                                             names=[*b.schema.names, "cell", "ring", *angles])

    schema = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes) + ", cell int, ring double, " + ", ".join(f"{a} double" for a in angles)
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sort = ["cell", "ring", F.xxhash64(*keys)]
    place = F.monotonically_increasing_id()
    local = place.bitwiseAND(F.lit((1 << 33) - 1))
    block = F.shiftleft(F.spark_partition_id().cast("long"), 44) + F.shiftleft(F.floor(local / block_rows).cast("long"), 16) + F.col("cell")
    dealt = rows.mapInArrow(scan, schema).repartitionByRange(n, *sort).sortWithinPartitions(*sort)
    return cut_lineage(dealt.withColumn("block", block).drop("ring"))


def _bounds(blocks: DataFrame, p: int, prefix: str) -> DataFrame:
    """One row per block: its cell, rows, and the angle range to each pivot."""
    ranges = [f(f"a{k}").alias(f"{prefix}{e}{k}") for k in range(p) for f, e in ((F.min, "lo"), (F.max, "hi"))]
    return (blocks.groupBy("block").agg(F.first("cell").alias(f"{prefix}cell"), F.count(F.lit(1)).alias(f"{prefix}n"), *ranges)
            .withColumnRenamed("block", f"{prefix}block"))


def block_pairs(queries: DataFrame, corpus: DataFrame, p: int, reach: float) -> DataFrame:
    """(qblock, qn, cblock, cn) of the blocks that may hold a pair within the angle ``reach``."""
    q, c = _bounds(queries, p, "q"), _bounds(corpus, p, "c")

    def near(k):
        return (F.col(f"qlo{k}") - F.col(f"chi{k}") <= reach) & (F.col(f"clo{k}") - F.col(f"qhi{k}") <= reach)

    def all_of(conditions):
        out = F.lit(True)
        for x in conditions:
            out = out & x
        return out

    met = q.withColumn("cell", F.explode(F.sequence(F.lit(0), F.lit(p - 1))))
    return (met.join(c, met["cell"] == c["ccell"]).where(all_of(near(k) for k in range(p)))
            .select("qblock", "qn", "cblock", "cn"))


def range_join(queries: DataFrame, corpus: DataFrame, *, qkeys: list[str], q_vec: str, cid: str, c_vec: str, t: float, n_pivots: int = PIVOTS,
               block_rows: int = BLOCK_ROWS, group_rows: int = GROUP_ROWS) -> tuple[DataFrame, DataFrame | None]:
    """All (qkeys..., cid, s) with cosine s >= t, and the block pairs that were multiplied (None without a corpus)."""
    spark = corpus.sparkSession
    ship(spark)
    q, c = _unit_rows(queries, q_vec, qkeys), _unit_rows(corpus, c_vec, [cid])
    kinds, ckind = [(k, dict(q.dtypes)[k]) for k in qkeys], dict(c.dtypes)[cid]
    schema = ", ".join(f"`{k}` {v}" for k, v in kinds) + f", `{cid}` {ckind}, s double"
    pivots = choose_pivots(c, "_u", n_pivots)
    if not len(pivots):
        return spark.createDataFrame([], schema), None
    p, dims = pivots.shape
    qb, cb = _blocks(q, qkeys, pivots, block_rows), _blocks(c, [cid], pivots, block_rows)
    pairs = cut_lineage(block_pairs(qb, cb, p, math.acos(max(-1.0, min(1.0, t))) + SLACK))
    # the query blocks of a corpus block, in groups of bounded rows
    before = Window.partitionBy("cblock").orderBy("qblock").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    grouped = pairs.withColumn("grp", F.floor((F.sum("qn").over(before) - F.col("qn")) / group_rows)).select("qblock", "cblock", "grp")
    left = qb.select(*qkeys, "_u", "block").join(grouped, F.col("block") == F.col("qblock")).select(*qkeys, "_u", F.col("cblock").alias("lblock"), F.col("grp").alias("lgrp"))
    right = cb.select(cid, "_u", "block").join(grouped.select("cblock", "grp").distinct(), F.col("block") == F.col("cblock")).select(cid, "_u", F.col("cblock").alias("rblock"), F.col("grp").alias("rgrp"))

    def product(a: pa.Table, b: pa.Table) -> pa.Table:
        at_a, at_b, found = [], [], []
        if a.num_rows and b.num_rows:
            x, y = matrix(a.column("_u"), dims), matrix(b.column("_u"), dims)
            for k in range(0, len(x), 512):
                s = x[k:k + 512] @ y.T
                i, j = np.nonzero(s >= t)
                at_a.append(i + k)
                at_b.append(j)
                found.append(s[i, j])
        i, j, s = (np.concatenate(v) if v else np.empty(0, d) for v, d in ((at_a, np.int64), (at_b, np.int64), (found, np.float64)))
        return pa.table([*(a.column(k).take(pa.array(i)) for k in qkeys), b.column(cid).take(pa.array(j)), pa.array(s)], names=[*qkeys, cid, "s"])

    return left.groupBy("lblock", "lgrp").cogroup(right.groupBy("rblock", "rgrp")).applyInArrow(product, schema), pairs


def multiplied_share(pairs: DataFrame, n_queries: int, n_corpus: int) -> float:
    """Share of all vector pairs that the bounds left to be multiplied."""
    return (pairs.agg(F.sum(F.col("qn") * F.col("cn"))).first()[0] or 0) / max(1, n_queries * n_corpus)
