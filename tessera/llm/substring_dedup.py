"""Exact substring dedup by fixed-block anchors.

A window is ``WINDOW`` consecutive words. A word goes when a window that covers it has the
same words as a window that starts earlier (smaller doc_id, or earlier in the same document).

1. Anchors. Every document's non-overlapping blocks of ``BLOCK`` words (starting at multiples of ``BLOCK``)
   are the reference; any window of ``2 * BLOCK - 1`` or more words holds a whole block. Every
   rolling window of ``BLOCK`` words probes them: a block is *hit* when its words occur anywhere else.
   A task sends, by hash bucket, one packed array for its blocks (hash and place) and one for all
   other probes (distinct hashes, no place); repeats inside a task are settled there. A
   probe costs about 3 bytes in the shuffle instead of a row.
2. Extension. A repeat of at least ``WINDOW`` words covers a hit block, so only windows that hold
   one can repeat. Documents with hits are read again; of each candidate window the task
   sends hash and place of its first occurrence, later ones in the same task are settled there.
   The bucket's earliest place stays, all others repeat it and go back packed by document. Runs of repeated windows are the
   maximal exact repeats; the union of their windows is removed.

Hot passages: after settling inside the task a window found in a third of all documents is one entry
per task. Buckets grow in number with the corpus, so each stays bounded; nothing is broadcast.
Bucket and entry hashes are 48 bits for anchors (false hits only add candidates) and 64 bits
for windows; at 10^11 candidate windows in all some hundreds of false repeats are expected.

Defined cases: null or empty texts have no words and keep the empty string's hash; rows that repeat
(doc_id, text) are one document and give one row; different texts under one doc_id are ordered by their hash; a
null doc_id comes before all others; doc_id must be an integer; extra columns are ignored; empty
tables give no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

WINDOW = 20
BLOCK = 10
CHUNK_WORDS = 1_500_000
BUCKET_WORDS = 4_000_000
_NO_ID = -(1 << 63)


def _planes(a: np.ndarray) -> bytes:
    """Bytes of an integer array plane by plane: sorted values then compress well."""
    return np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.dtype.itemsize).T).tobytes()


def _unplanes(b: bytes, dtype) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(size, -1).T).view(dtype).reshape(-1)


class Chunk:
    """Words of several documents in a row: hashes, document bounds and keys."""

    def __init__(self):
        self.parts, self.keys, self.size = [], [], 0

    def add(self, key: tuple[int, int], text: bytes | None) -> None:
        h = C.word_hashes(text.split()) if text else np.empty(0, np.uint64)
        self.parts.append(h)
        self.keys.append(key)
        self.size += len(h)

    def rolled(self, width: int):
        """Hash, document number and position of every window inside one document."""
        n = np.array([len(p) for p in self.parts], np.int64)
        count = np.maximum(n - width + 1, 0)
        h = [C.rolling(p, width) for p in self.parts]
        doc = np.repeat(np.arange(len(n), dtype=np.int32), count)
        pos = (np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)).astype(np.int32)
        return (np.concatenate(h) if h else np.empty(0, np.uint64)), doc, pos


def _chunks(batches):
    """Documents (id, text hash, text, more...) in chunks of bounded words; yields (chunk, extra values)."""
    chunk, extra = Chunk(), []
    for b in batches:
        for i, k, t, *more in zip(*(c.to_pylist() for c in b.columns), strict=True):
            chunk.add((i, k), t)
            extra.append(more)
            if chunk.size >= CHUNK_WORDS:
                yield chunk, extra
                chunk, extra = Chunk(), []
    if chunk.keys:
        yield chunk, extra


def _first_places(h, doc, pos, keys):
    """Order by (hash, place); marks the first entry of each hash. Places: (doc_id, text hash, pos)."""
    rank = np.empty(len(keys), np.int64)
    distinct = {k: r for r, k in enumerate(sorted(set(keys)))}
    rank[:] = [distinct[k] for k in keys]
    order = np.lexsort((pos, rank[doc], h))
    hs, rs, ps = h[order], rank[doc][order], pos[order]
    first = np.ones(len(hs), bool)
    first[1:] = hs[1:] != hs[:-1]
    lead = np.maximum.accumulate(np.where(first, np.arange(len(hs)), 0))
    same = (rs == rs[lead]) & (ps == ps[lead])  # the same place again: a repeated row
    return order, first, same


def _bucketed(h: np.ndarray, buckets: int) -> np.ndarray:
    return ((h >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)


def _by_bucket(b: np.ndarray):
    order = np.argsort(b, kind="stable")
    edges = np.flatnonzero(np.diff(b[order])) + 1
    return [g for g in np.split(order, edges) if len(g)]


_PACKED = pa.schema([("bucket", pa.int32()), ("kind", pa.int8()), ("hashes", pa.binary()), ("docs", pa.binary()),
                     ("place", pa.binary()), ("keys", pa.binary())])


def _row(bucket, kind, hashes=b"", docs=b"", place=b"", keys=b""):
    return pa.RecordBatch.from_arrays([pa.array([v], t.type) for v, t in zip((bucket, kind, hashes, docs, place, keys), _PACKED, strict=True)],
                                      schema=_PACKED)


def _key_table(keys, used):
    """Keys of the documents used, as bytes, and the new numbers of the documents."""
    which, number = np.unique(used, return_inverse=True)
    return np.array([keys[k] for k in which.tolist()], np.int64).reshape(-1, 2).tobytes(), number.astype(np.uint32)


_SETTLED, _PLACED, _PRESENT = 0, 1, 2


def _spread(chunk, doc, pos, buckets):
    """Settled places travel through the same shuffle, dealt by document."""
    keys = np.array(chunk.keys, np.int64).reshape(-1, 2)
    yield from _pack_places(keys[doc, 0], keys[doc, 1], pos, buckets)


def _send_anchors(buckets: int):
    def scan(batches):
        for chunk, _ in _chunks(batches):
            h, doc, pos = chunk.rolled(BLOCK)
            if not len(h):
                continue
            block = pos % BLOCK == 0
            order, first, same = _first_places(h, doc, pos, chunk.keys)
            group = np.cumsum(first) - 1
            other = np.bincount(group, weights=~same) > 0  # the hash is at two places in this task
            repeated = np.empty(len(h), bool)
            repeated[order] = other[group]
            settled = np.flatnonzero(block & repeated)
            if len(settled):
                yield from _spread(chunk, doc[settled], pos[settled], buckets)
            placed = np.flatnonzero(block & ~repeated)
            placed = placed[np.argsort(h[placed].astype(np.uint32), kind="stable")]
            for g in _by_bucket(_bucketed(h[placed], buckets)):
                at = placed[g]
                keys, number = _key_table(chunk.keys, doc[at])
                yield _row(int(_bucketed(h[at[:1]], buckets)[0]), _PLACED, _planes(h[at].astype(np.uint32)),
                           _planes(number), _planes(pos[at].astype(np.uint32)), keys)
            there = np.ones(len(h), bool)
            there[placed] = False
            rest = h[there]
            low, b = rest.astype(np.uint32), _bucketed(rest, buckets)
            both = np.unique((b.astype(np.uint64) << np.uint64(32)) | low)
            b = (both >> np.uint64(32)).astype(np.int64)
            for g in _by_bucket(b):
                yield _row(int(b[g[0]]), _PRESENT, _planes(both[g].astype(np.uint32)))

    return scan


def _unpack(docs, place, keys):
    table = np.frombuffer(keys, np.int64).reshape(-1, 2)
    number, pos = _unplanes(docs, np.uint32), _unplanes(place, np.uint32)
    return table[number, 0], table[number, 1], pos.astype(np.int64)


_BACK = "bucket int, kind byte, hashes binary, docs binary, place binary, keys binary"


def _own_bucket(doc, key, buckets):
    """Bucket of a document (for the way back to it)."""
    return (xor_mix(doc.astype(np.uint64), key.astype(np.uint64)) % np.uint64(buckets)).astype(np.int64)


def xor_mix(a, b):
    x = (a * C.WORD_MULTIPLIER) ^ b
    x ^= x >> np.uint64(32)
    return x * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(8)


def _pack_places(doc, key, pos, buckets):
    """Places as packed rows, one for each document bucket."""
    own = _own_bucket(doc, key, buckets)
    order = np.lexsort((pos, key, doc, own))
    doc, key, pos, own = doc[order], key[order], pos[order], own[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (key[1:] != key[:-1])
    number = np.cumsum(new) - 1
    edges = [0, *(np.flatnonzero(np.diff(own)) + 1).tolist(), len(own)]
    for a, z in zip(edges, edges[1:], strict=False):
        if z > a:
            k = np.flatnonzero(new[a:z]) + a
            table = np.stack([doc[k], key[k]], axis=1).astype(np.int64)
            yield _row(int(own[a]), _SETTLED, b"", _planes((number[a:z] - number[a]).astype(np.uint32)),
                       _planes(pos[a:z].astype(np.uint32)), table.tobytes())


def _buckets_of(batches, resolve, buckets):
    """Collect a partition's packed rows by bucket, pass settled ones on, resolve the rest."""
    held: dict[int, list] = {}
    for b in batches:
        for r in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if r[1] == _SETTLED:
                yield _row(*r)
            else:
                held.setdefault(r[0], []).append(r[1:])
    for bucket in sorted(held):
        out = resolve(held.pop(bucket))
        if out is not None and len(out[0]):
            yield from _pack_places(*out, buckets)


def _gather(batches):
    """One row per document: its distinct places, sorted and packed."""
    parts = [_unpack(*r[3:]) for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True)]
    if not parts:
        return
    doc, key, pos = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.lexsort((pos, key, doc))
    doc, key, pos = doc[order], key[order], pos[order].astype(np.uint32)
    edges = (np.flatnonzero((np.diff(doc) != 0) | (np.diff(key) != 0)) + 1).tolist()
    for a, z in zip([0, *edges[9_999::10_000]], [*edges[9_999::10_000], len(doc)], strict=True):
        inner = [e for e in edges[np.searchsorted(edges, a, "right"):np.searchsorted(edges, z)]] if edges else []
        at = [a, *inner]
        yield pa.RecordBatch.from_arrays(
            [pa.array(doc[at]), pa.array(key[at]), pa.array([np.unique(pos[x:y]).tobytes() for x, y in zip(at, [*inner, z], strict=True)], pa.binary())],
            names=["pid", "ph", "places"])


def _meet_anchors(buckets: int):
    def resolve(rows):
        blocks = [r for r in rows if r[0] == _PLACED]
        if not blocks:
            return None
        h = np.concatenate([_unplanes(r[1], np.uint32) for r in blocks])
        doc, key, pos = (np.concatenate(x) for x in zip(*(_unpack(*r[2:]) for r in blocks), strict=True))
        kinds, number, times = np.unique(h, return_inverse=True, return_counts=True)
        hit = times > 1  # two blocks with one hash; a repeated row may count twice, which only adds a candidate
        for r in rows:
            if r[0] == _PRESENT:
                probe = _unplanes(r[1], np.uint32)
                at = np.minimum(np.searchsorted(kinds, probe), len(kinds) - 1)
                hit[at[kinds[at] == probe]] = True
        keep = hit[number]
        return doc[keep], key[keep], pos[keep]

    return lambda batches: _buckets_of(batches, resolve, buckets)


def _send_windows(buckets: int):
    def scan(batches):
        for chunk, extra in _chunks(batches):
            h, doc, pos = chunk.rolled(WINDOW)
            if not len(h):
                continue
            start = np.zeros(len(chunk.keys) + 1, np.int64)  # place of each document's first window
            np.cumsum([max(0, len(p) - WINDOW + 1) for p in chunk.parts], out=start[1:])
            edge = np.zeros(len(h) + 1, np.int64)
            for d, (hits,) in enumerate(extra):
                if hits is None or start[d] == start[d + 1]:
                    continue
                at = np.frombuffer(hits, np.uint32).astype(np.int64)
                a = np.maximum(at + BLOCK - WINDOW, 0)  # windows that hold the block
                z = np.minimum(at + 1, start[d + 1] - start[d])
                ok = z > a
                np.add.at(edge, a[ok] + start[d], 1)
                np.add.at(edge, z[ok] + start[d], -1)
            able = np.flatnonzero(np.cumsum(edge[:-1]) > 0)
            if not len(able):
                continue
            h, doc, pos = h[able], doc[able], pos[able]
            order, first, same = _first_places(h, doc, pos, chunk.keys)
            settled = order[~same]
            if len(settled):
                yield from _spread(chunk, doc[settled], pos[settled], buckets)
            placed = np.sort(order[first])  # in the order of places: the place planes compress
            for g in _by_bucket(_bucketed(h[placed], buckets)):
                at = placed[g]
                keys, number = _key_table(chunk.keys, doc[at])
                yield _row(int(_bucketed(h[at[:1]], buckets)[0]), _PLACED, _planes(h[at]), _planes(number),
                           _planes(pos[at].astype(np.uint32)), keys)

    return scan


def _meet_windows(buckets: int):
    def resolve(rows):
        h = np.concatenate([_unplanes(r[1], np.uint64) for r in rows])
        doc, key, pos = (np.concatenate(x) for x in zip(*(_unpack(*r[2:]) for r in rows), strict=True))
        order = np.lexsort((pos, key, doc, h))
        h, doc, key, pos = h[order], doc[order], key[order], pos[order]
        first = np.ones(len(h), bool)
        first[1:] = h[1:] != h[:-1]
        lead = np.maximum.accumulate(np.where(first, np.arange(len(h)), 0))
        later = (doc != doc[lead]) | (key != key[lead]) | (pos != pos[lead])
        return doc[later], key[later], pos[later]

    return lambda batches: _buckets_of(batches, resolve, buckets)


def _met(packed: DataFrame, meet, buckets: int) -> DataFrame:
    """Deal by hash bucket, resolve, deal back by document bucket: (pid, ph, places), a row a document."""
    back = packed.repartitionById(buckets, "bucket").mapInArrow(meet(buckets), _BACK)
    return back.repartitionById(buckets, "bucket").mapInArrow(_gather, "pid long, ph long, places binary")


def kept_words(words: list[bytes], starts: np.ndarray, window: int = WINDOW) -> list[bytes]:
    """Words outside all windows that begin at ``starts``."""
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, np.minimum(starts + window, len(words)), -1)
    gone = np.cumsum(edge[:-1]) > 0
    return [w for w, g in zip(words, gone.tolist(), strict=True) if not g]


def substring_dedup(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """Per document: doc_id, n_words, n_removed, kept_sha256 (and the kept text)."""
    spark = docs.sparkSession
    C.ship(spark)
    kind = dict(docs.dtypes)["doc_id"]
    base = C.texts(docs).select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)).alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
    # white space is counted without reading words: an upper estimate of the words sizes the buckets
    total = base.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(C.partitions(spark), int(total // 6 // BUCKET_WORDS))
    hits = C.stored(_met(base.mapInArrow(_send_anchors(buckets), _BACK), _meet_anchors, buckets), "anchors")
    dealt = base.repartition(C.partitions(spark), "doc_id", "text_hash")  # one exchange of the texts for both joins
    able = dealt.join(hits, (dealt["doc_id"] == hits["pid"]) & (dealt["text_hash"] == hits["ph"])) \
        .select("doc_id", "text_hash", "text", "places")
    gone = _met(able.mapInArrow(_send_windows(buckets), _BACK), _meet_windows, buckets)
    joined = dealt.join(gone, (dealt["doc_id"] == gone["pid"]) & (dealt["text_hash"] == gone["ph"]), "left") \
        .select("doc_id", "text_hash", "text", "places")

    def finish(batches):
        for b in batches:
            n, removed, digest, text = [], [], [], []
            for t, places in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                words = t.split() if t else []
                kept = words
                if places:
                    kept = kept_words(words, np.frombuffer(places, np.uint32).astype(np.int64))
                out = b" ".join(kept)
                n.append(len(words))
                removed.append(len(words) - len(kept))
                digest.append(hashlib.sha256(out).hexdigest())
                text.append(out)
            cols = [b.column(0), b.column(1), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(digest, pa.string())]
            names = ["doc_id", "text_hash", "n_words", "n_removed", "kept_sha256"]
            if with_text:
                cols.append(pa.array([x.decode("utf-8", "replace") for x in text], pa.string()))
                names.append("kept_text")
            yield pa.RecordBatch.from_arrays(cols, names=names)

    out = joined.mapInArrow(finish, "doc_id long, text_hash long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * with_text)
    return (out.dropDuplicates(["doc_id", "text_hash"]).drop("text_hash")
            .withColumn("doc_id", F.when(F.col("doc_id") != _NO_ID, F.col("doc_id")).cast(kind)))


def brute_force(docs):
    """Reference result for tests."""
    rows = sorted(set(docs), key=lambda r: (r[0] is not None, r[0] or 0))
    seen, out = set(), []
    for doc_id, text in rows:
        w = text.encode().split() if text else []
        gone = set()
        for p in range(len(w) - WINDOW + 1):
            k = tuple(w[p:p + WINDOW])
            if k in seen:
                gone.update(range(p, p + WINDOW))
            seen.add(k)
        kept = [x for i, x in enumerate(w) if i not in gone]
        out.append((doc_id, len(w), len(gone), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return out
