"""Thresholded top-k similarity search for many queries at once (VEC-4, VEC-6, JOIN-5,
AGG-3, WIN-1).

A query is a set of fragments; its similarity to a corpus record is the best similarity
over its fragments; records below ``1 - distance`` are dropped (equal is kept); the best
``k`` per query win, ties broken by the larger record id.

Sparse (term-count cosine) search runs over an inverted index with block maxima (``postings``).
Dense search is an exact range join: pivots bound angles between blocks of vectors, and only
block pairs that can reach the threshold meet, by block id (``pivots``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import pivots, postings
from .common import DEFAULT_BROADCAST_ROWS

def top_k(scored: DataFrame, qid: str, cid: str, k: int, sim: str = "similarity") -> DataFrame:
    """WIN-1: best ``k`` per query by similarity desc, record id desc; adds ``rank`` (1-based)."""
    w = Window.partitionBy(qid).orderBy(F.col(sim).desc(), F.col(cid).desc())
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def sparse_search(queries: DataFrame, corpus: DataFrame, *, qid: str, fid: str, q_text: str,
                  cid: str, c_text: str, distance: float = 0.25, k: int = 10,
                  max_broadcast_rows: int = DEFAULT_BROADCAST_ROWS, block_records: int = postings.BLOCK_RECORDS) -> DataFrame:
    """VEC-4 with VEC-6: ``queries(qid, fid, q_text)`` one row per fragment, ``corpus(cid, c_text)``.

    Returns (qid, cid, similarity, rank). Fragments are scored against an inverted index whose
    block maxima skip the records that cannot reach the threshold (``postings``).
    """
    index = postings.build_index(corpus, cid, c_text, block_records, max_broadcast_rows)
    frag = postings.search(queries, index, qid=qid, fid=fid, text=q_text, t=1.0 - distance)
    best = frag.groupBy(qid, cid).agg(F.max("s").alias("similarity"))
    return top_k(best, qid, cid, k)


def dense_search(queries: DataFrame, corpus: DataFrame, *, qid: str, fid: str, q_vec: str,
                 cid: str, c_vec: str, distance: float = 0.25, k: int = 10, n_pivots: int = pivots.PIVOTS,
                 block_rows: int = pivots.BLOCK_ROWS, group_rows: int = pivots.GROUP_ROWS) -> DataFrame:
    """VEC-4 over dense vectors (JOIN-5 range join by pivots, AGG-3 max over fragments, WIN-1).

    A fragment below the threshold cannot make its query's best similarity pass, so the range
    join applies the threshold before the max; only passing pairs are shuffled. Vectors without a
    direction (null, empty, zero) match nothing.
    """
    frag, _ = pivots.range_join(queries, corpus, qkeys=[qid, fid], q_vec=q_vec, cid=cid, c_vec=c_vec, t=1.0 - distance,
                                n_pivots=n_pivots, block_rows=block_rows, group_rows=group_rows)
    best = frag.groupBy(qid, cid).agg(F.max("s").alias("similarity"))
    return top_k(best, qid, cid, k)


def attach_records(hits: DataFrame, corpus: DataFrame, cid: str, cols) -> DataFrame:
    """Ordered search result: distance = 1 - similarity plus the record's columns."""
    return (hits.join(corpus.select(cid, *cols), cid)
            .withColumn("distance", F.lit(1.0) - F.col("similarity")))
