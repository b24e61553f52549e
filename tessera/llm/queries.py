"""Queries of the training-data operators: (spark, sf_dir) -> DataFrame over the driver tables."""

from __future__ import annotations

import zlib

from pyspark.sql import functions as F

from ..sources.tables import table
from . import common as C
from . import covering_simhash, decontaminate, jaccard_join, lattice, packing, periodic_runs, prefix_trie, ranking, rules, secrets, substring_dedup, training_order, warc

QUERIES = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_lattice_score(spark, sf_dir):
    """Subword lattice likelihood of every document."""
    return lattice.score(table(spark, sf_dir, "documents"))


@query
def op2_decontamination(spark, sf_dir):
    """Benchmark windows found in every document."""
    return decontaminate.report(decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


@query
def op3_jaccard_join(spark, sf_dir):
    """Components of documents by shingle sets of three words at a similarity of 0.9."""
    return jaccard_join.jaccard_join(table(spark, sf_dir, "documents"), width=3, percent=90).drop("class")


@query
def op4_training_order(spark, sf_dir):
    """Global slot and place of every sequence; each slot read back from its shard."""
    rows, folder, _ = training_order.materialise(table(spark, sf_dir, "documents"))
    return training_order.read_back(rows, folder).drop("file")


@query
def op5_substring_dedup(spark, sf_dir):
    """Words removed as repeats of windows of twenty words."""
    return substring_dedup.substring_dedup(table(spark, sf_dir, "documents"))


@query
def op6_warc(spark, sf_dir):
    """Pages written as WARC archives and read back."""
    path = C.scratch(spark, "warc")
    warc.write_pages(table(spark, sf_dir, "pages"), path)
    return warc.page_report(spark, path)


@query
def op7_secret_scan(spark, sf_dir):
    """Pattern and entropy spans of every document."""
    return secrets.scan_secrets(table(spark, sf_dir, "documents"))


@query
def op8_best_fit_packing(spark, sf_dir):
    """Pieces of all documents in sequences of at most 1024 tokens."""
    return packing.pack(packing.pieces(table(spark, sf_dir, "documents")))


@query
def op9_quality_rules(spark, sf_dir):
    """Rule measurements and the current policy's verdict."""
    book = rules.apply_policy(rules.ledger(table(spark, sf_dir, "documents")))
    base = F.col("failed").bitwiseAND(F.lit(rules.POLICIES["v1"])) != 0
    return book.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), "kept", "failed")


@query
def op10_quality_ranking(spark, sf_dir):
    """Quality score of every document."""
    docs = table(spark, sf_dir, "documents")
    return ranking.classify(docs, ranking.train(docs, table(spark, sf_dir, "labels")))


@query
def op11_prefix_trie(spark, sf_dir):
    """Prefix trie of the rebuilt conversations with the rollup of its leaves and savings."""
    return prefix_trie.prefix_trie(table(spark, sf_dir, "conversations"))


def _repeated(doc_id, words):
    """The contract's input: every tenth document (by checksum) repeats a stretch of its words to its end."""
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    n = len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + k % p] for k in range(n - a)]


@query
def op12_periodic_runs(spark, sf_dir):
    """Periodic runs of words of every document, as the contract rewrites it."""
    return periodic_runs.periodic_runs(table(spark, sf_dir, "documents"), _repeated)


@query
def op13_covering_simhash(spark, sf_dir):
    """Components of documents whose SimHash fingerprints differ in at most two bits."""
    return covering_simhash.near_duplicates(table(spark, sf_dir, "documents"))


ORACLE = {}
