"""N-gram Jaccard join: size-banded tiles, hashed bitmap signatures, exact intersection.

A document's set is its distinct word shingles (the whole sequence where it has fewer words). Two
documents link when ``100 * |A and B| >= percent * |A or B|``.

1. One scan gives each row its set's identity (hash of the sorted shingle array). Equal sets
   are one *class*, represented by the smallest doc_id: copies are never paired.
2. Tiles. Linked sizes differ by a factor of at most 100/percent, so sizes are cut into bands of
   that ratio and tile t holds bands t-1 and t. Linked sets of tile t differ in at most
   ``k = floor((100-percent)/(100+percent) * 2 * largest size)`` shingles. The shingle space is hashed
   into ``k + 1 + e`` cells: at least ``1 + e`` cells of two linked sets are equal, so a set
   with at most ``e`` empty cells needs only its filled cells as keys, any other adds its
   empty ones; ``e`` is set per tile so that this is rare. Every linked pair shares a key (tile,
   cell, hash of the cell's shingles): the candidates are complete, and a shared passage alone
   rarely makes one, because a cell's shingles come from all over the text.
3. Each key's members are streamed in order; each is paired with the first one only (a star). A key of two members is
   decided by that; of keys with the same members one goes on.
4. Bitmaps. Every set has a parity bitmap of about two bits per shingle (the tile-independent size is a
   power of two). ``popcount(a xor b)`` never exceeds the symmetric difference, which bounds the
   overlap from above: pairs that cannot reach the threshold stop here. Where widths differ the wider
   bitmap is folded.
5. What is left is decided on the sorted shingle arrays, for which the texts of these pairs alone are read again.
6. Components of the links found. Keys whose members are still in several components go on:
   their members are dealt into blocks, each pair of blocks is one task-sized tile, and
   all pairs of different components in it are bounded by their bitmaps at once (numpy). Of each
   two components the closest pair is verified first; only where it was not the only one left and
   the components are still apart are all left verified. So no link between components is lost.
7. Links of each class. Every link lies within a component, so each component's classes are dealt into
   blocks and each pair of blocks is one tile, where the overlaps of all its pairs are counted
   exactly (``overlaps``). A tile gives one count a class, never the pairs.

Shingles are 64-bit hashes and classes 64-bit hashes of them; at a billion distinct sets the
expected number of colliding classes is 0.03.

Defined cases: null or empty texts and texts without words have the empty set and link with nothing
(their own component); repeated rows give one output row each; doc_id must be an integer and not null for a
link to count, rows with a null doc_id stand alone; extra columns are ignored; empty tables give no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

BLOCK = 1024
#: a block of the link count holds at most LINK_BLOCK classes and, apart from a single larger set, about LINK_SHINGLES shingles
LINK_BLOCK = 512
LINK_SHINGLES = 1 << 20
#: a key of at most so many classes is one row; of a larger one at most HELD rows are held while it is read
PACKED, HELD = 64, 4096
#: (document, class) pairs that are broadcast at most (about 100 bytes each as a hash table)
ID_ROWS = 500_000
_CELL_SEED = np.uint64(0xD6E8FEB86659FD93)


def _unique(h: np.ndarray) -> np.ndarray:
    """Sorted distinct values (cheaper than np.unique for many short arrays)."""
    h.sort()
    keep = np.empty(len(h), bool)
    keep[:1] = True
    np.not_equal(h[1:], h[:-1], out=keep[1:])
    return h[keep]


def shingles(text: bytes | None, width: int) -> np.ndarray:
    """Sorted distinct 64-bit shingle hashes of a text."""
    words = text.lower().split() if text else []
    return _unique(C.rolling(C.word_hashes(words), min(width, len(words)))) if words else np.empty(0, np.uint64)


def class_of(s: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63)


class Bands:
    """Size bands, tiles and cell counts for a similarity of ``percent``."""

    def __init__(self, percent: int):
        if not 50 <= percent <= 100:
            raise ValueError("percent must be within 50 and 100")
        self.percent = percent
        self.ends: list[int] = []  # largest size of each band
        self._grow(64)

    def _grow(self, size: int) -> None:
        while not self.ends or self.ends[-1] < size:
            low = self.ends[-1] + 1 if self.ends else 1
            self.ends.append(low * 100 // self.percent)

    def band(self, size: int) -> int:
        self._grow(size)
        return int(np.searchsorted(self.ends, size))

    def cells(self, tile: int) -> tuple[int, int]:
        """Cells of a tile, and how many of them may be empty before the empty ones become keys."""
        while len(self.ends) <= tile:
            self._grow(self.ends[-1] + 1)
        k = (100 - self.percent) * 2 * self.ends[tile] // (100 + self.percent)
        if not k:
            return 1, 0
        least = self.ends[tile - 2] + 1 if tile > 1 else 1
        usual = (k + 1) * math.exp(-least / (k + 1))
        e = math.ceil(usual + 6 * math.sqrt(usual) + 2)
        return k + 1 + e, e

    def keys(self, s: np.ndarray) -> np.ndarray:
        """Keys of a set in its two tiles (its own band's and the next larger one's)."""
        mixed = s * _CELL_SEED
        mixed ^= mixed >> np.uint64(31)
        own, out = self.band(len(s)), []
        for tile in (own, own + 1):
            m, e = self.cells(tile)
            cell = (mixed % np.uint64(m)).astype(np.int64)
            total = np.zeros(m, np.uint64)
            np.add.at(total, cell, mixed * C.WORD_MULTIPLIER ^ (s >> np.uint64(7)))
            filled = np.bincount(cell, minlength=m) > 0
            use = np.flatnonzero(filled) if m - filled.sum() <= e else np.arange(m)
            k = total[use] + use.astype(np.uint64) * np.uint64(0xA0761D6478BD642F) + np.uint64((tile + 1) * 0xE7037ED1A0B428DB % (1 << 64))
            k ^= k >> np.uint64(32)
            k *= C.WORD_MULTIPLIER
            out.append(k ^ (k >> np.uint64(29)))
        return np.concatenate(out)


def bitmap(s: np.ndarray) -> np.ndarray:
    """Parity bitmap: bit = number of shingles hashed to it, modulo 2; 64-bit words."""
    bits = max(64, 1 << int(2 * len(s) - 1).bit_length())
    odd = np.bincount(((s * C.WORD_MULTIPLIER) >> np.uint64(64 - bits.bit_length() + 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.uint64)


def fold(b: np.ndarray, words: int) -> np.ndarray:
    """A bitmap of the last axis' words brought down to ``words`` by xor of neighbours (same hash prefix)."""
    while b.shape[-1] > words:
        b = _halve(b.reshape(*b.shape[:-1], -1, 2))
    return b


def _halve(pair: np.ndarray) -> np.ndarray:
    """Two neighbouring 64-bit words of bits (2i, 2i+1) -> one word of bit i = xor of the two."""
    bits = np.unpackbits(pair.view(np.uint8).reshape(*pair.shape[:-1], 16), axis=-1)
    odd = bits[..., 0::2] ^ bits[..., 1::2]
    return np.packbits(odd, axis=-1).view(np.uint64)[..., 0]


def may_link(xor_bits, a, b, percent: int):
    """Upper bound of the overlap from the bit count, against the threshold."""
    most = np.minimum((a + b - xor_bits) // 2, np.minimum(a, b))
    return 100 * most >= percent * (a + b - most)


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def overlaps(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of every set of ``a`` with every set of ``b``.

    Shingles of many sets go through a product of 0/1 matrices (float32 counts are exact below 2^24 a
    chunk), the others through a list of their sets in ``b``.
    """
    out = np.zeros((len(a), len(b)), np.int64)
    names, at = np.unique(np.concatenate([*a, *b]), return_inverse=True)
    split = sum(map(len, a))
    row_a, row_b = (np.repeat(np.arange(len(x)), [len(v) for v in x]) for x in (a, b))
    id_a, id_b = at[:split], at[split:]
    in_a, in_b = np.bincount(id_a, minlength=len(names)), np.bincount(id_b, minlength=len(names))
    dense = np.flatnonzero(in_a * in_b > len(a) + len(b))
    place = np.full(len(names), -1)
    place[dense] = np.arange(len(dense))
    for start in range(0, len(dense), 4096):
        sides = []
        for rows, ids, n in ((row_a, id_a, len(a)), (row_b, id_b, len(b))):
            p = place[ids] - start
            k = (p >= 0) & (p < 4096) & (place[ids] >= 0)
            m = np.zeros((n, min(4096, len(dense) - start)), np.float32)
            m[rows[k], p[k]] = 1
            sides.append(m)
        out += (sides[0] @ sides[1].T).astype(np.int64)
    k = (place[id_b] < 0) & (in_a[id_b] > 0)
    order = np.argsort(id_b[k], kind="stable")
    rows, first = row_b[k][order], np.searchsorted(id_b[k][order], np.arange(len(names) + 1))
    k = (place[id_a] < 0) & (in_b[id_a] > 0)
    ids, mine = id_a[k], row_a[k]
    for s in range(0, len(ids), 1 << 16):  # every shingle of a here meets its sets in b
        i, m = ids[s:s + (1 << 16)], mine[s:s + (1 << 16)]
        n = first[i + 1] - first[i]
        other = rows[np.repeat(first[i] - np.cumsum(n) + n, n) + np.arange(n.sum())]
        out += np.bincount(np.repeat(m, n) * len(b) + other, minlength=out.size).reshape(out.shape)
    return out


def _classes(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, text_hash, n_shingles, class (null for the empty set or a null id), bits (its bitmap); one scan."""

    def scan(batches):
        for b in batches:
            n, c, m = [], [], []
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                s = shingles(t, width)
                own = len(s) > 0 and i is not None
                n.append(len(s))
                c.append(class_of(s) if own else None)
                m.append(bitmap(s).tobytes() if own else None)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(n, pa.int64()), pa.array(c, pa.int64()), pa.array(m, pa.binary())],
                                             names=["doc_id", "text_hash", "n_shingles", "class", "bits"])

    base = C.texts(docs).withColumn("text_hash", F.xxhash64("text"))
    return base.mapInArrow(scan, f"doc_id {dict(base.dtypes)['doc_id']}, text_hash long, n_shingles long, class long, bits binary")


def _keys(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """(key, class) rows; a class is emitted once per task."""

    def scan(batches):
        bands, seen = Bands(percent), set()
        for b in batches:
            ks, cs, size = [], [], 0
            for t in b.column(0).to_pylist():
                s = shingles(t, width)
                c = class_of(s) if len(s) else None
                if c is None or c in seen:
                    continue
                seen.add(c)
                k = bands.keys(s)
                ks.append(k)
                cs.append(np.full(len(k), c, np.int64))
                size += len(k)
                if size > 200_000:
                    yield out(ks, cs)
                    ks, cs, size = [], [], 0
            if ks:
                yield out(ks, cs)

    def out(ks, cs):
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(ks).view(np.int64)), pa.array(np.concatenate(cs))],
                                          names=["key", "class"])

    return C.texts(docs).where("doc_id is not null").select("text").mapInArrow(scan, "key long, class long")


def _stars(keys: DataFrame) -> DataFrame:
    """What keys with two or more classes give, streamed in key order with bounded memory:

    * (a, b): each member with the key's first one;
    * (key, classes): the members of a key of 3 to ``PACKED`` of them, one row a key;
    * (key, a): the members of larger keys, a row each.
    """
    dealt = keys.repartition(C.partitions(keys.sparkSession), "key").sortWithinPartitions("key", "class")
    none = np.empty(0, np.int64)

    def scan(batches):
        key, cls, large = none, none, None  # rows of the last key, which may go on; (key, first) of a larger one
        for batch in batches:
            k, c = (x.to_numpy(zero_copy_only=False) for x in batch.columns)
            key, cls = np.concatenate([key, k]), np.concatenate([cls, c])
            if not len(key):
                continue
            fresh = np.ones(len(key), bool)
            fresh[1:] = (key[1:] != key[:-1]) | (cls[1:] != cls[:-1])
            key, cls = key[fresh], cls[fresh]
            if large is not None:
                own = key == large[0]
                yield flat(large, cls[own])
                if own.all():
                    key, cls = none, none
                    continue
                key, cls, large = key[~own], cls[~own], None
            cut = int(np.searchsorted(key, key[-1])) if (key[:-1] <= key[1:]).all() else int(np.flatnonzero(key != key[-1])[-1]) + 1
            yield complete(key[:cut], cls[:cut])
            key, cls = key[cut:], cls[cut:]
            if len(key) > HELD:
                large = (int(key[0]), int(cls[0]))
                yield flat(large, cls)
                key, cls = none, none
        if len(key):
            yield complete(key, cls)

    def complete(key, cls):
        if not len(key):
            return out(none, none, none, none, [0], none)
        heads = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        size = np.diff(np.append(heads, len(key)))
        first, n = np.repeat(cls[heads], size), np.repeat(size, size)
        other = np.ones(len(key), bool)
        other[heads] = False
        pair = np.unique(np.stack([np.minimum(cls, first), np.maximum(cls, first)])[:, other], axis=1)
        packed, big = (n > 2) & (n <= PACKED), n > PACKED
        kept = size[(size > 2) & (size <= PACKED)]
        return out(pair[0], pair[1], key[big], cls[big], np.append(0, np.cumsum(kept)), cls[packed], key[heads][(size > 2) & (size <= PACKED)])

    def flat(large, cls):
        first = np.full(len(cls), large[1])
        rest = cls != first
        return out(np.minimum(cls, first)[rest], np.maximum(cls, first)[rest], np.full(len(cls), large[0]), cls, [0], none)

    def out(a, b, key, cls, offsets, classes, names=none):
        kinds = (len(a), len(key), len(names))
        lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(classes, pa.int64()))
        empty = lambda n, t=pa.int64(): pa.nulls(n, t)
        cols = [pa.concat_arrays([empty(kinds[0]), pa.array(key, pa.int64()), pa.array(names, pa.int64())]),
                pa.concat_arrays([pa.array(a, pa.int64()), pa.array(cls, pa.int64()), empty(kinds[2])]),
                pa.concat_arrays([pa.array(b, pa.int64()), empty(kinds[1] + kinds[2])]),
                pa.concat_arrays([empty(kinds[0] + kinds[1], lists.type), lists])]
        return pa.RecordBatch.from_arrays(cols, names=["key", "a", "b", "classes"])

    return dealt.mapInArrow(scan, "key long, a long, b long, classes array<long>")


def _arrays(docs: DataFrame, ids: DataFrame, width: int) -> DataFrame:
    """class, n, hashes of the documents in ``ids(doc_id, class)``: their texts are read again. Repeated rows repeat.

    Only where more than ``ID_ROWS`` documents are asked for at once, texts are shuffled to meet them.
    """

    def scan(batches):
        for b in batches:
            for part in (b.slice(i, 512) for i in range(0, b.num_rows, 512)):
                c, n, a = [], [], []
                for t, want in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    s = shingles(t, width)
                    if len(s) and class_of(s) == want:
                        c.append(want)
                        n.append(len(s))
                        a.append(s.tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()), pa.array(n, pa.int64()), pa.array(a, pa.binary())], names=["class", "n", "hashes"])

    base, want = C.texts(docs), C.stored(ids.select(F.col("doc_id").alias("want_id"), "class"), "wanted")
    if want.count() <= ID_ROWS:
        want = F.broadcast(want)
    return base.join(want, base["doc_id"] == want["want_id"]).select("text", "class").mapInArrow(scan, "class long, n long, hashes binary")


def _met(pairs: DataFrame, sets: DataFrame, column: str) -> DataFrame:
    """a, b, class, n, value: two rows per pair of classes (repeats aside), side by side, with ``column`` of either class.

    Few pairs (counted) are broadcast, so that of the sets only what the pairs need is shuffled.
    """
    spark = pairs.sparkSession
    wanted = (pairs.select(F.col("a").alias("c"), "a", "b").unionByName(pairs.select(F.col("b").alias("c"), "a", "b")))
    if pairs.limit(C.BROADCAST_ROWS + 1).count() <= C.BROADCAST_ROWS:
        wanted = F.broadcast(wanted)
    have = sets.select("class", "n", F.col(column).alias("value"))
    return (have.join(wanted, have["class"] == wanted["c"]).select("a", "b", "class", "n", "value")
            .repartition(C.partitions(spark), "a", "b").sortWithinPartitions("a", "b", "class").select("a", "b", "class", "n", "value"))


def _decided(met: DataFrame, decide) -> DataFrame:
    """Pairs (a, b) for which ``decide(n of a, value of a, n of b, value of b)``; rows as ``_met`` gives them."""

    def scan(batches):
        left = last = None
        for batch in batches:
            a, b = [], []
            for x, y, c, n, v in C.rows_of(batch):
                if (x, y, c) == last:  # a repeated row
                    continue
                last = (x, y, c)
                if c == x:
                    left = (n, v)
                elif decide(*left, n, v):
                    a.append(x)
                    b.append(y)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return met.mapInArrow(scan, "a long, b long")


def _bounded(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose bitmaps allow a link."""

    def decide(na, x, nb, y):
        x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
        w = min(len(x), len(y))
        return bool(may_link(int(np.bitwise_count(fold(x, w) ^ fold(y, w)).sum()), na, nb, percent))

    return _decided(_met(pairs, sets, "bits"), decide)


def _exact(pairs: DataFrame, docs: DataFrame, ids: DataFrame, width: int, percent: int) -> DataFrame:
    """Pairs (a, b) that link, by intersection of their sorted arrays; ``ids(class, doc_id)`` says where a class's text is."""
    asked = pairs.select(F.col("a").alias("class")).unionByName(pairs.select(F.col("b").alias("class"))).distinct()
    arrays = _arrays(docs, ids.join(asked, "class"), width)
    return _decided(_met(pairs, arrays, "hashes"), lambda na, x, nb, y: linked(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), percent))


def _tiles(open_keys: DataFrame, sets: DataFrame, percent: int, block: int, every: bool) -> DataFrame:
    """(a, b, key, more): pairs of different components within a key whose bitmaps allow a link.

    ``open_keys``: key, class, component, members (of the key). A key's classes are dealt into
    ``ceil(members / block)`` blocks; each pair of blocks is one group of the stream. Of each two
    components a group gives the most promising pair, and ``more`` says that there are others;
    with ``every`` it gives all.
    """
    blocks = F.ceil(F.col("members") / F.lit(block)).cast("int")
    dealt = (open_keys.withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int"))
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
             .select("key", "class", "component", "own", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi")))
    small = sets.select(F.col("class").alias("c"), "n", "bits")
    rows = (dealt.join(small, dealt["class"] == small["c"]).select("key", "lo", "hi", "own", "class", "component", "n", "bits")
            .repartition(C.partitions(dealt.sparkSession), "key", "lo", "hi").sortWithinPartitions("key", "lo", "hi", "n", "class"))

    def scan(batches):
        held, last = [], None
        for b in batches:
            for r in C.rows_of(b):
                if r[:3] != last:
                    if len(held) > 1:
                        yield from compare(held)
                    held, last = [], r[:3]
                held.append(r)
        if len(held) > 1:
            yield from compare(held)

    def compare(held):
        key, lo, hi = held[0][:3]
        own = np.array([r[3] for r in held])
        cls, comp, n = (np.array([r[k] for r in held], np.int64) for k in (4, 5, 6))
        maps = [np.frombuffer(r[7], np.uint64) for r in held]
        w = min(map(len, maps))
        maps = np.array([fold(m, w) for m in maps])
        best: dict[tuple[int, int], list] = {}
        for i in range(1, len(held)):
            j = np.flatnonzero((comp[:i] != comp[i]) & ((own[:i] != own[i]) | (lo == hi)) & (100 * n[:i] >= percent * n[i]))
            if not len(j):
                continue
            apart = np.bitwise_count(maps[j] ^ maps[i]).sum(1).astype(np.int64)
            able = may_link(apart, n[j], n[i], percent)
            j, apart = j[able], apart[able]
            if every and len(j):
                yield out(np.minimum(cls[j], cls[i]), np.maximum(cls[j], cls[i]), key, False)
            elif len(j):
                order = np.lexsort((cls[j], apart, comp[j]))
                j, apart = j[order], apart[order]
                other, at, times = np.unique(comp[j], return_index=True, return_counts=True)
                for c, k, t in zip(other.tolist(), at.tolist(), times.tolist(), strict=True):
                    pair = (min(c, int(comp[i])), max(c, int(comp[i])))
                    found = (int(apart[k]), int(cls[j[k]]), int(cls[i]))
                    had = best.get(pair)
                    best[pair] = [min(found, had[0]) if had else found, (had[1] if had else 0) + t]
        if best:
            x, y = (np.array([v[0][k] for v in best.values()], np.int64) for k in (1, 2))
            yield out(np.minimum(x, y), np.maximum(x, y), key, [v[1] > 1 for v in best.values()])

    def out(a, b, key, more):
        more = [more] * len(a) if isinstance(more, bool) else more
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array([key] * len(a), pa.int64()), pa.array(more, pa.bool_())],
                                          names=["a", "b", "key", "more"])

    return rows.mapInArrow(scan, "a long, b long, key long, more boolean")


def _degrees(label: DataFrame, sets: DataFrame, percent: int, block: int) -> DataFrame:
    """class, n_links: the number of other classes that each class of ``label(class, component)`` links with.

    The two classes of a component of two link with each other; larger components are compared in tiles.
    """
    spark = label.sparkSession
    sized = label.join(sets.select(F.col("class").alias("c"), "n"), F.col("class") == F.col("c")).drop("c")
    blocks = F.ceil(F.greatest(F.col("members") / F.lit(block), F.col("total") / F.lit(LINK_SHINGLES))).cast("int")
    known = (sized.groupBy("component").agg(F.count(F.lit(1)).alias("members"), F.sum("n").alias("total"))
             .select(F.col("component").alias("k"), "members", F.least(blocks, F.col("members").cast("int")).alias("blocks")))
    rows = label.join(known, label["component"] == known["k"]).drop("k")
    dealt = (rows.where("members > 2").withColumn("own", F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int"))
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
             .select(F.col("class").alias("c"), "component", "own", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi")))
    full = sets.select("class", "hashes")
    tiles = (dealt.join(full, dealt["c"] == full["class"]).select("component", "lo", "hi", "own", "class", "hashes")
             .repartition(C.partitions(spark), "component", "lo", "hi").sortWithinPartitions("component", "lo", "hi", "class"))

    def scan(batches):
        held, last, cls, n = [], None, [], []

        def out():
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(cls)), pa.array(np.concatenate(n))], names=["class", "n_links"])

        for b in batches:
            for r in C.rows_of(b):
                if r[:3] != last:
                    if held:
                        compare(held, cls, n)
                    if sum(map(len, cls)) > 10_000:
                        yield out()
                        cls.clear()
                        n.clear()
                    held, last = [], r[:3]
                held.append(r)
        if held:
            compare(held, cls, n)
        if cls:
            yield out()

    def compare(held, cls, n):
        _, lo, hi = held[0][:3]
        left = [(r[4], np.frombuffer(r[5], np.uint64)) for r in held if r[3] == lo]
        right = left if lo == hi else [(r[4], np.frombuffer(r[5], np.uint64)) for r in held if r[3] == hi]
        if not left or not right:
            return
        a, b = [x for _, x in left], [x for _, x in right]
        both = overlaps(a, b)
        union = np.array([len(x) for x in a])[:, None] + np.array([len(x) for x in b])[None] - both
        links = 100 * both >= percent * union
        if lo == hi:
            np.fill_diagonal(links, False)
        for side, axis in ((left, 1),) if lo == hi else ((left, 1), (right, 0)):
            cls.append(np.array([c for c, _ in side], np.int64))
            n.append(links.sum(axis).astype(np.int64))

    counted = tiles.mapInArrow(scan, "class long, n_links long").groupBy("class").agg(F.sum("n_links").alias("n_links"))
    return counted.unionByName(rows.where("members = 2").select("class", F.lit(1).cast("long").alias("n_links")))


def _joined(docs: DataFrame, width: int, percent: int, block: int):
    """Rows (``_classes``), their classes' smallest doc_id, (class, component) of linked classes, and where classes with shared keys are.

    What later steps no longer read is deleted on the way.
    """
    C.ship(docs.sparkSession)
    rows = C.stored(_classes(docs, width), "classes")
    classes = rows.where("class is not null").groupBy("class").agg(F.min("doc_id").alias("doc_id"))
    stars = C.stored(_stars(_keys(docs, width, percent)), "keys")
    pairs = C.stored(stars.where("key is null").select("a", "b").distinct(), "pairs")
    ids = C.stored(classes.join(pairs.select(F.col("a").alias("class")).unionByName(pairs.select(F.col("b").alias("class"))).distinct(), "class"), "ids")
    known = F.broadcast(ids) if ids.count() <= ID_ROWS else ids
    sets = C.stored(rows.join(known, ["class", "doc_id"]).select("class", F.col("n_shingles").alias("n"), "bits").dropDuplicates(["class"]), "sets")
    able = C.stored(_bounded(pairs, sets, percent), "pairs")
    links = C.stored(_exact(able, docs, ids, width, percent), "links")
    C.discard(able, pairs)
    used = [links]
    label = C.components(links).withColumnRenamed("node", "class")

    def open_keys(members):
        """Keys that still hold several components."""
        known = members.join(label, "class", "left").select("key", "class", F.coalesce("component", "class").alias("component"))
        mixed = (known.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.count(F.lit(1)).alias("members"))
                 .where("x <> y").select(F.col("key").alias("k"), "members"))
        return known.join(mixed, known["key"] == mixed["k"]).drop("k")

    # of keys with the same members (by two hashes) one goes on; keys of two are decided by their pair
    packed = (stars.where("classes is not null").withColumn("same", F.xxhash64("classes")).withColumn("same2", F.xxhash64(F.lit(1), "classes"))
              .groupBy("same", "same2").agg(F.min_by("classes", "key").alias("classes"), F.min("key").alias("key")))
    members = C.stored(packed.select("key", F.explode("classes").alias("class"))
                       .unionByName(stars.where("key is not null and classes is null").select("key", F.col("a").alias("class"))), "members")
    used.append(members)
    for every in (False, True):
        found = C.stored(_tiles(open_keys(members), sets, percent, block, every), "tiles")
        late = C.stored(_exact(C.stored(found.select("a", "b").distinct(), "pairs"), docs, ids, width, percent), "links")
        used += [found, late]
        if late.limit(1).count():
            links = links.unionByName(late).distinct()
            label = C.components(links).withColumnRenamed("node", "class")
        again = found.where("more").select(F.col("key").alias("k")).distinct()
        if every or not again.limit(1).count():
            break
        members = members.join(again, members["key"] == again["k"]).drop("k")

    C.discard(stars, sets, *used)
    plain = rows.drop("bits")
    plain._stored = rows._stored
    return plain, classes, label, ids


def jaccard_join(docs: DataFrame, width: int = 5, percent: int = 80, block: int = BLOCK) -> DataFrame:
    """Per row: doc_id, n_shingles, class, component_id, n_links.

    ``component_id``: smallest doc_id reachable by links, itself included. ``n_links``: the number of other classes
    (different sets) that the row's class links with; copies of its own set are not counted.
    """
    rows, classes, label, ids = _joined(docs, width, percent, block)
    arrays = C.stored(_arrays(docs, ids.join(label.select("class"), "class"), width).dropDuplicates(["class"]), "arrays")
    degree = C.stored(_degrees(label, arrays, percent, min(block, LINK_BLOCK)), "degrees")
    C.discard(arrays, ids)
    small = (classes.join(label, "class").select("class", "component", "doc_id").groupBy("component").agg(F.min("doc_id").alias("least")))
    merged = label.join(small, "component").select("class", "least").join(degree, "class", "left")
    per_class = (classes.join(merged, "class", "left")
                 .select(F.col("class").alias("c"), F.coalesce("least", "doc_id").alias("root"), F.coalesce("n_links", F.lit(0)).alias("n_links")))
    return (rows.join(per_class, rows["class"] == per_class["c"], "left")
            .select(rows["doc_id"], "n_shingles", "class", F.coalesce("root", rows["doc_id"]).alias("component_id"),
                    F.coalesce("n_links", F.lit(0)).alias("n_links")))


def keep_one(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """``docs``, all columns kept, one row per group: one of the smallest doc_id (of its texts, the one of least hash).

    Rows are judged, not ids: a row is its doc_id and text (hash). Rows with the empty set or a null id stay.
    The rejected rows meet the documents in an anti-join; where the row to keep is repeated, its repeats
    are dropped (which of them stays is open, as far as their other columns differ).
    """
    rows, _, label, ids = _joined(docs, width, percent, BLOCK)
    C.discard(ids)
    kind = label.select(F.col("class").alias("c"), "component")
    found = (rows.where("class is not null").join(kind, F.col("class") == F.col("c"), "left")
             .select("doc_id", "text_hash", F.coalesce("component", "class").alias("component")))
    least = (found.groupBy("component").agg(F.min(F.struct("doc_id", "text_hash")).alias("least"), F.count(F.lit(1)).alias("n"))
             .where("n > 1").select(F.col("component").alias("k"), "least"))
    judged = C.stored(found.join(least, found["component"] == least["k"])
                      .groupBy(F.col("doc_id").alias("_i"), F.col("text_hash").alias("_h"))
                      .agg(F.first(F.struct("doc_id", "text_hash") == F.col("least")).alias("_keep"), F.count(F.lit(1)).alias("_n")), "judged")
    C.discard(rows)
    small = F.broadcast if judged.count() <= ID_ROWS else (lambda df: df)  # else the documents are shuffled
    gone, many = judged.where("not _keep"), judged.where("_keep and _n > 1")
    on = lambda side: (docs["doc_id"] == side["_i"]) & (F.xxhash64(docs["text"].cast("binary")) == side["_h"])
    if not many.limit(1).count():
        return docs.join(small(gone), on(gone), "left_anti")
    once = docs.join(small(many), on(many), "left_semi").dropDuplicates(["doc_id", "text"])
    rest = judged.where("not _keep or _n > 1")
    return docs.join(small(rest), on(rest), "left_anti").unionByName(once)
