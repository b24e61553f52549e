"""Benchmark decontamination by a broadcast set of normalised test n-grams.

Words are the runs of ASCII letters and digits (A-Z lowered) and non-ASCII characters. Every
``width`` consecutive words of a benchmark item are a window; an item of fewer words is one
window as a whole. A worker holds a bitmap of window hashes (first probe), the sorted hashes and the items' words
(verification), built once per block and worker process; a task slides over the document's words, verifies
every hash hit on the words themselves and marks the words covered.

The set is broadcast in blocks of at most ``max_block_bytes`` of benchmark text. One block is
the usual case; more are read, broadcast and scanned one after the other and their marks merged per (doc_id, text), with the
number of its rows, so driver and broadcast hold two blocks at most, whatever the benchmark's size.

Defined cases: null text has no words; empty texts and empty tables give rows with zero hits
(no documents: no rows); the words of items with a null id are hit and count as contamination, only the list of
items has no entry for them; repeated ids count once; items with a null text have no words; each input row gives one row, however many blocks the benchmark needs; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections import defaultdict
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

WIDTH = 10
MAX_BLOCK_BYTES = 16 << 20

_LOWER = bytes(range(256)).lower()
_TABLE = bytes(c if c >= 0x80 or chr(c).isalnum() else 0x20 for c in _LOWER)
_SPAN = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(_TABLE).split() if text else []


class WindowSet:
    """Windows of a block of items: sorted 64-bit hashes, where each distinct window stands, and its items.

    About 30 bytes a window beside the words. ``words`` are verified, so equal hashes of different windows do no harm.
    """

    def __init__(self, items: list[tuple[str | None, bytes]], width: int):
        self.ids = sorted({i for i, _ in items if i is not None})
        place = {i: k for k, i in enumerate(self.ids)}
        self.texts: list[list[bytes]] = [words_of(t) for _, t in items]
        owner = np.array([-1 if i is None else place[i] for i, _ in items], np.int64)
        by_width: dict[int, list[int]] = defaultdict(list)
        for k, w in enumerate(self.texts):
            if w:
                by_width[min(width, len(w))].append(k)
        self.widths = []
        for n, rows in sorted(by_width.items()):
            h = [C.rolling(C.word_hashes(self.texts[k]), n) for k in rows]
            item = np.repeat(rows, [len(x) for x in h])
            pos = np.concatenate([np.arange(len(x)) for x in h])
            h = np.concatenate(h)
            order = np.argsort(h, kind="stable")
            h, item, pos = h[order], item[order], pos[order]
            head = np.ones(len(h), bool)  # the first of each distinct window
            at = 0
            for k in (np.flatnonzero(h[1:] == h[:-1]) + 1).tolist():
                at = k - 1 if head[k - 1] else at
                head[k] = not self._same(n, (item[at], pos[at]), (item[k], pos[k]))
            first = np.flatnonzero(head)
            bits = max(16, int(len(first)).bit_length() + 6)
            seen = np.zeros(1 << bits, bool)
            seen[(h[first] >> np.uint64(64 - bits)).astype(np.int64)] = True
            self.widths.append((n, np.uint64(64 - bits), seen, h[first], item[first], pos[first], np.append(first, len(h)), owner[item]))

    def _same(self, n, one, two) -> bool:
        (a, i), (b, j) = one, two
        return self.texts[a][i:i + n] == self.texts[b][j:j + n]

    def scan(self, words: list[bytes]) -> tuple[np.ndarray, set[int]]:
        """Hit flags per word, and the items with a window in ``words`` (those with an id)."""
        hit, items = np.zeros(len(words), bool), set()
        hashes = C.word_hashes(words) if self.widths else None
        for n, shift, seen, h, item, pos, edges, owner in self.widths:
            rolled = C.rolling(hashes, n)
            likely = np.flatnonzero(seen[(rolled >> shift).astype(np.int64)])
            found = np.searchsorted(h, rolled[likely])
            for p, k in zip(likely.tolist(), found.tolist(), strict=True):
                while k < len(h) and h[k] == rolled[p]:
                    if words[p:p + n] == self.texts[item[k]][pos[k]:pos[k] + n]:
                        hit[p:p + n] = True
                        items.update(owner[edges[k]:edges[k + 1]].tolist())
                    k += 1
        items.discard(-1)
        return hit, items


_BUILT: list = [None, None]


def _windows(shared, width: int) -> WindowSet:
    """The window set of a broadcast block, built once per worker process (the last one is kept)."""
    key = (shared.value[0], width)
    if _BUILT[0] != key:
        _BUILT[:] = [key, WindowSet(shared.value[1], width)]
    return _BUILT[1]


def _blocks(bench: DataFrame, item_col: str, text_col: str, max_bytes: int):
    """Broadcast items in blocks of bounded bytes, streamed (a text above the bound is a block alone)."""
    spark = bench.sparkSession
    rows = (bench.select(bench[item_col].cast("string").alias("i"), bench[text_col].cast("binary").alias("t"))
            .where("t is not null"))
    block, size = [], 0
    for r in rows.toLocalIterator():
        if block and size + len(r["t"]) > max_bytes:
            yield spark.sparkContext.broadcast((uuid.uuid4().hex, block))
            block, size = [], 0
        block.append((r["i"], bytes(r["t"])))
        size += len(r["t"])
    yield spark.sparkContext.broadcast((uuid.uuid4().hex, block))


def _one_or_more(blocks):
    """The first block, and the rest as an iterator that reads on when it is used (None: there is no other)."""
    first, second = next(blocks), next(blocks, None)
    return first, None if second is None else chain([second], blocks)


def contamination(docs: DataFrame, bench: DataFrame, width: int = WIDTH, item_col: str = "item_id",
                  max_block_bytes: int = MAX_BLOCK_BYTES) -> DataFrame:
    """Per document: doc_id, n_words, hit_words (positions), items (sorted ids), plus text hash."""
    spark = docs.sparkSession
    C.ship(spark)
    base = C.texts(docs).withColumn("text_hash", F.xxhash64("text"))
    schema = f"doc_id {dict(base.dtypes)['doc_id']}, text_hash long, n_words long, hit_words array<int>, items array<string>"

    def scan_block(shared):
        def scan(batches):
            windows = _windows(shared, width)
            for b in batches:
                n, hits, items = [], [], []
                for t in b.column(1).to_pylist():
                    w = words_of(t)
                    hit, found = windows.scan(w)
                    n.append(len(w))
                    hits.append(np.flatnonzero(hit).astype(np.int32))
                    items.append(sorted(windows.ids[k] for k in found))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), b.column(2), pa.array(n, pa.int64()), pa.array(hits, pa.list_(pa.int32())),
                     pa.array(items, pa.list_(pa.string()))],
                    names=["doc_id", "text_hash", "n_words", "hit_words", "items"])

        return base.mapInArrow(scan, schema)

    first, rest = _one_or_more(_blocks(bench, item_col, "text", max_block_bytes))
    if rest is None:
        return scan_block(first)
    out = C.stored(scan_block(first), "contamination").withColumn("copies", F.lit(1))
    first.unpersist()
    for shared in rest:  # one block at a time is broadcast
        out = out.unionByName(C.stored(scan_block(shared).where(F.size("hit_words") > 0), "contamination").withColumn("copies", F.lit(0)))
        shared.unpersist()
    merged = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_set(c)))).alias(c)
    return (out.groupBy("doc_id", "text_hash").agg(F.max("n_words").alias("n_words"), merged("hit_words"), merged("items"), F.sum("copies").alias("copies"))
            .withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).drop("copies", "copy"))


def report(found: DataFrame) -> DataFrame:
    """Digest columns of ``contamination``."""
    return found.select(
        "doc_id", "n_words", F.size("hit_words").cast("long").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("hit_words") > 0).alias("contaminated"))


def cut_spans(text: str, hit: set[int]) -> str:
    """``text`` without the marked words; what stands between two marked words goes with them."""
    out, at, last = [], 0, None
    for k, m in enumerate(_SPAN.finditer(text)):
        if k in hit:
            if last != k - 1:
                out.append(text[at:m.start()])
            at, last = m.end(), k
    return "".join(out) + text[at:]


def decontaminate(docs: DataFrame, bench: DataFrame, mode: str = "documents", width: int = WIDTH,
                  item_col: str = "item_id", max_block_bytes: int = MAX_BLOCK_BYTES) -> DataFrame:
    """``docs`` without contaminated documents, or (mode="spans") without the words hit.

    All columns of ``docs`` are kept. Documents are judged inside the scan, without a shuffle:
    one pass a block. Spans of several blocks are judged on the input, so their merged marks
    meet the documents again on (doc_id, text hash).
    """
    if mode not in ("documents", "spans"):
        raise ValueError(mode)
    spark = docs.sparkSession
    C.ship(spark)
    at = docs.columns.index("text")
    first, rest = _one_or_more(_blocks(bench, item_col, "text", max_block_bytes))

    def judged(frame, shared):
        def scan(batches):
            windows = _windows(shared, width)
            for b in batches:
                hits = [windows.scan(words_of(t))[0] for t in b.column(at).cast(pa.binary()).to_pylist()]
                if mode == "documents":
                    yield b.filter(pa.array([not h.any() for h in hits], pa.bool_()))
                else:
                    yield cut(b, [np.flatnonzero(h).tolist() for h in hits])

        return frame.mapInArrow(scan, docs.schema)

    def cut(b, hits):
        texts = [cut_spans(t, set(h)) if h else t for t, h in zip(b.column(at).to_pylist(), hits, strict=True)]
        return b.set_column(at, b.schema.field(at), pa.array(texts, b.schema.field(at).type))

    if rest is None:
        return judged(docs, first)
    if mode == "documents":
        docs = C.stored(judged(docs, first), "decontaminated")
        first.unpersist()
        for shared in rest:  # one block at a time is broadcast
            kept = C.stored(judged(docs, shared), "decontaminated")
            shared.unpersist()
            C.discard(docs)
            docs = kept
        return docs
    found = (contamination(docs, bench, width, item_col, max_block_bytes).where(F.size("hit_words") > 0)
             .select(F.col("doc_id").alias("_k"), F.col("text_hash").alias("_h"), F.col("hit_words").alias("_w")).dropDuplicates(["_k", "_h"]))
    on = docs["doc_id"].eqNullSafe(found["_k"]) & (F.xxhash64(docs["text"].cast("binary")) == found["_h"])
    last = len(docs.columns)

    def scan_found(batches):
        for b in batches:
            hits = [h or [] for h in b.column(last).to_pylist()]
            yield cut(pa.RecordBatch.from_arrays(b.columns[:last], schema=pa.schema([b.schema.field(k) for k in range(last)])), hits)

    return docs.join(found, on, "left").select(*(docs[c] for c in docs.columns), found["_w"]).mapInArrow(scan_found, docs.schema)


def brute_force(docs, items, width=WIDTH):
    """Reference result for tests: every window of every item looked for everywhere."""
    pat = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    norm = lambda t: pat.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    out = []
    for doc_id, text in docs:
        w, hit, ids = norm(text), set(), set()
        for item, it in items:
            v = norm(it)
            n = min(width, len(v))
            for k in range(len(v) - n + 1 if n else 0):
                for p in range(len(w) - n + 1):
                    if w[p:p + n] == v[k:k + n]:
                        hit.update(range(p, p + n))
                        ids.update(() if item is None else (str(item),))
        digest = hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()
        out.append((doc_id, len(w), len(hit), len(ids), digest, bool(hit)))
    return out
