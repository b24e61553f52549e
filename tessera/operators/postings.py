"""Inverted index with block maxima (VEC-6): exact thresholded term-count cosine.

Build. Every record's term vector is counted inside its row. Records are sorted by their heaviest token and cut
into blocks of at most ``BLOCK_RECORDS``; the index holds the postings (token, block, record, count) and, per token and
block, the largest normalised weight.

Search. A fragment is one row; its terms are counted inside it, so nothing is shuffled before the first
aggregate, and a document with any share of all fragments is spread by (query, fragment) like all others.

1. Bound: the terms meet the maxima; the sum of own weight times block maximum bounds the similarity to every
   record of the block from above. Blocks below the threshold are skipped.
2. Score: fragments that are left meet the postings of their blocks; the similarity is ``dot / sqrt(|q|^2 |c|^2)`` over integer
   counts, so identical vectors give exactly 1.0 and the inclusive threshold holds.

An index of at most ``max_broadcast_rows`` postings is broadcast as arrays and both steps run in one scan of the fragments,
without a shuffle; the bound is left out where blocks hold few common tokens (fewer than half of the postings saved). A larger
index is written bucketed by token, and the steps are joins whose index side stays in its buckets.

Fragments and records without a token match nothing; pairs that share no token are not looked at.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import bucketed, cut_lineage, ship
from .common import DEFAULT_BROADCAST_ROWS

# Word pattern of the term vectors (applied to lower-cased text): a letter of any script, then letters and digits.
TOKEN_PATTERN = r"\p{L}[\p{L}\p{N}]*"
BLOCK_RECORDS = 16
#: relative error that sums of weights may carry
SLACK = 1e-9


def tokens(text) -> Column:
    t = F.col(text) if isinstance(text, str) else text
    return F.regexp_extract_all(F.lower(t), F.lit(TOKEN_PATTERN), F.lit(0))


def term_vectors(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """keys, ``terms`` (array of token, n) and ``ss`` (squared norm), counted inside the row; without a token, no terms.

    Sorted tokens change where a term ends; its count is the distance from the end before.
    """
    words = df.select(*keys, F.sort_array(F.coalesce(tokens(text), F.array().cast("array<string>"))).alias("_t"))
    ends = words.select(*keys, "_t", F.filter(F.sequence(F.lit(1), F.greatest(F.size("_t"), F.lit(1))),
                                              lambda i: ~F.get("_t", i - 1).eqNullSafe(F.get("_t", i))).alias("_e"))
    terms = F.transform("_e", lambda i, k: F.struct(F.get("_t", i - 1).alias("token"),
                                                    (i - F.coalesce(F.get("_e", k - 1), F.lit(0))).cast("double").alias("n")))
    return ends.select(*keys, terms.alias("terms")).select(
        *keys, "terms", F.aggregate("terms", F.lit(0.0), lambda a, x: a + x["n"] * x["n"]).alias("ss"))


def _terms(vec: DataFrame, *keep: str) -> DataFrame:
    """One row per term. The outer form keeps the optimizer from testing ``size(terms) > 0`` below the
    projections that build them, where every nested array would be built again for each of its elements."""
    return (vec.select(*keep, F.explode_outer("terms").alias("_x")).where("_x is not null")
            .select(*keep, "_x.token", "_x.n"))


@dataclass
class Index:
    """``postings(token, block, cid, m, css)`` and ``maxima(token, block, w)``; ``small``: proven to fit a broadcast."""

    postings: DataFrame
    maxima: DataFrame
    cid: str
    small: bool


def build_index(corpus: DataFrame, cid: str, text: str, block_records: int = BLOCK_RECORDS, max_broadcast_rows: int = DEFAULT_BROADCAST_ROWS) -> Index:
    n = int(corpus.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    vec = term_vectors(corpus, [cid], text)
    heaviest = F.aggregate("terms", F.struct(F.lit(0.0).alias("n"), F.lit("").alias("token")),
                           lambda a, x: F.when(x["n"] > a["n"], F.struct(x["n"].alias("n"), x["token"].alias("token"))).otherwise(a))["token"]
    local = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    block = F.shiftleft(F.spark_partition_id().cast("long"), 33) + F.floor(local / block_records)
    placed = cut_lineage(vec.withColumn("_h", heaviest).repartitionByRange(n, "_h", cid).sortWithinPartitions("_h", cid)
                         .select(cid, "terms", "ss", block.alias("block")))
    postings = _terms(placed, "block", cid, "ss").select("token", "block", cid, F.col("n").alias("m"), F.col("ss").alias("css"))
    small = postings.limit(max_broadcast_rows + 1).count() <= max_broadcast_rows
    if not small:
        postings = bucketed(postings, ["token"], n)
    maxima = postings.groupBy("token", "block").agg(F.max(F.col("m") / F.sqrt("css")).alias("w"))
    return Index(postings, maxima if small else bucketed(maxima, ["token"], n), cid, small)


def search(queries: DataFrame, index: Index, *, qid: str, fid: str, text: str, t: float) -> DataFrame:
    """(qid, fid, cid, s): every fragment and record of the index with cosine s >= t > 0."""
    return (_scan if index.small else _joined)(queries, index, [qid, fid], text, t)


def _joined(queries: DataFrame, index: Index, key: list[str], text: str, t: float) -> DataFrame:
    """Against the stored index: joins on the token, whose index side stays in its buckets."""
    cid = index.cid
    vec = term_vectors(queries, key, text)
    bound = F.sum(F.col("n") * F.col("w")) / F.sqrt(F.first("ss"))
    blocks = (_terms(vec, *key, "ss").join(index.maxima, "token").groupBy(*key, "block").agg(bound.alias("_b"))
              .where(F.col("_b") >= t * (1 - SLACK)).select(*key, "block"))
    dots = (_terms(vec.join(blocks, key), *key, "ss", "block").join(index.postings, ["token", "block"]).groupBy(*key, cid)
            .agg(F.sum(F.col("n") * F.col("m")).alias("dot"), F.first("ss").alias("qss"), F.first("css").alias("css")))
    return dots.select(*key, cid, (F.col("dot") / F.sqrt(F.col("qss") * F.col("css"))).alias("s")).where(F.col("s") >= t)


class Arrays:
    """A small index as arrays: postings and maxima by token, records and blocks by number."""

    def __init__(self, rows: pa.Table):
        token = rows.column("token").combine_chunks().dictionary_encode()
        self.vocabulary = token.dictionary
        tid = token.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        record = rows.column("cid").combine_chunks().dictionary_encode()
        self.cids = record.dictionary
        rid = record.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        m, css = (rows.column(c).to_numpy() for c in ("m", "css"))
        names, bid = np.unique(rows.column("block").to_numpy(), return_inverse=True)
        n_tokens, self.n_records, self.n_blocks = len(self.vocabulary), len(self.cids), len(names)
        self.css, self.block = np.ones(self.n_records), np.zeros(self.n_records, np.int64)
        self.css[rid], self.block[rid] = css, bid
        order = np.argsort(tid, kind="stable")
        self.first = np.searchsorted(tid[order], np.arange(n_tokens + 1))
        self.record, self.m = rid[order], m[order]
        pair, at = np.unique(tid * self.n_blocks + bid, return_inverse=True)
        self.w = np.zeros(len(pair))
        np.maximum.at(self.w, at, m / np.sqrt(css))
        self.max_block = pair % max(1, self.n_blocks)
        self.max_first = np.searchsorted(pair // max(1, self.n_blocks), np.arange(n_tokens + 1))
        #: blocks bound anything only where their records share tokens
        self.bounds = 2 * len(pair) < len(tid)


def _gather(first: np.ndarray, token: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every given token its entries: (position among the given, entry)."""
    n = first[token + 1] - first[token]
    own = np.repeat(np.arange(len(token)), n)
    return own, np.arange(len(own)) - np.repeat(np.cumsum(n) - n, n) + first[token][own]


def _sums(key: np.ndarray, value: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys that occur and their sums."""
    if size <= 1 << 22:
        total, seen = np.bincount(key, value, size), np.bincount(key, minlength=size)
        return (at := np.flatnonzero(seen)), total[at]
    names, at = np.unique(key, return_inverse=True)
    return names, np.bincount(at, value, len(names))


def score(words: pa.Array, index: Arrays, t: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, record, similarity) of what passes, for rows of words."""
    n_rows = len(words)
    row = np.repeat(np.arange(n_rows), words.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
    coded = words.flatten().dictionary_encode()
    size = max(1, len(coded.dictionary))
    term, n = np.unique(row * size + coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), return_counts=True)
    row, n = term // size, n.astype(np.float64)
    ss = np.bincount(row, n * n, n_rows)
    known = pc.index_in(coded.dictionary, value_set=index.vocabulary).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
    token = known[term % size] if len(known) else np.empty(0, np.int64)
    row, n, token = row[token >= 0], n[token >= 0], token[token >= 0]
    live = None
    if index.bounds:
        own, at = _gather(index.max_first, token)
        pair, bound = _sums(row[own] * index.n_blocks + index.max_block[at], n[own] * index.w[at], n_rows * index.n_blocks)
        live = np.zeros(n_rows * index.n_blocks, bool)
        live[pair[bound >= t * (1 - SLACK) * np.sqrt(ss[pair // index.n_blocks])]] = True
        some = np.zeros(n_rows, bool)
        some[np.flatnonzero(live) // index.n_blocks] = True
        row, n, token = row[some[row]], n[some[row]], token[some[row]]
    own, at = _gather(index.first, token)
    r, c = row[own], index.record[at]
    value = n[own] * index.m[at]
    if live is not None:
        keep = live[r * index.n_blocks + index.block[c]]
        r, c, value = r[keep], c[keep], value[keep]
    pair, dot = _sums(r * index.n_records + c, value, n_rows * index.n_records)
    r, c = pair // max(1, index.n_records), pair % max(1, index.n_records)
    s = dot / np.sqrt(ss[r] * index.css[c])
    return r[s >= t], c[s >= t], s[s >= t]


def _scan(queries: DataFrame, index: Index, key: list[str], text: str, t: float) -> DataFrame:
    """Against a small index, broadcast as arrays: one scan of the fragments, nothing is shuffled."""
    spark = queries.sparkSession
    ship(spark)
    cid = index.cid
    rows = index.postings.select("token", "block", F.col(cid).alias("cid"), "m", "css").toArrow()
    shared = spark.sparkContext.broadcast(Arrays(rows))
    base = queries.select(*key, F.coalesce(tokens(text), F.array().cast("array<string>")).alias("_t"))
    kinds = [*((k, dict(base.dtypes)[k]) for k in key), (cid, dict(index.postings.dtypes)[cid])]

    def scan(batches):
        for whole in batches:
            for b in (whole.slice(k, 1024) for k in range(0, whole.num_rows, 1024)):
                r, c, s = score(b.column("_t"), shared.value, t)
                yield pa.RecordBatch.from_arrays([*(b.column(k).take(pa.array(r)) for k in key), shared.value.cids.take(pa.array(c)), pa.array(s)],
                                                 names=[*key, cid, "s"])

    return base.mapInArrow(scan, ", ".join(f"`{k}` {v}" for k, v in kinds) + ", s double")
