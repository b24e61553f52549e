"""SimHash near duplicates by covering locality-sensitive hashing.

A document's fingerprint has a bit set where more than half of its word shingles' hashes (XXH64, seed 42,
repeats included) have it set. Two documents link when their fingerprints differ in at most ``radius`` bits.

Covering masks. Bit i carries a vector f(i) of radius + 1 bits, never zero; the table of a vector v (each but
zero) keeps the bits with an odd number of ones in ``f(i) & v``. The vectors of ``radius`` differing bits span at
most ``radius`` dimensions, so some v is orthogonal to all of them: its table keeps none of the differing bits
and the pair collides there. With radius 2 there are 7 tables of 36 or 37 bits, and no pair is lost.

1. One scan gives doc_id and fingerprint. Equal fingerprints are one *class* (partial aggregation), so copies never meet.
2. Every class goes into its table's buckets (table, kept bits). Buckets are counted first (partial counts).
3. Small buckets (at most ``crowd`` classes) are streamed sorted and compared by bit counts in numpy. A pair is
   judged only in the first table where it collides, and a bucket gives a spanning forest of its links, never the pairs.
4. Crowded buckets are split before any of their rows is shuffled: within a bucket all differing bits lie among the bits
   that the mask leaves out, so the same construction over these alone gives 7 tables again. After three levels at most
   six bits of 64 are left, so a bucket holds at most 64 classes, the least ``crowd``.
5. Components of the links, then the smallest doc_id of each. Classes of many rows meet the documents in a
   broadcast join of a proven size, all others in a shuffled one (``common.attach``).

Defined cases: null and empty texts and texts without words have the fingerprint 0 and link like any other; with fewer
words than a shingle the whole sequence is the one shingle; repeated rows give one output row each; rows with a null
doc_id link with nothing and have a null component; very long texts are hashed in chunks; extra columns are ignored; an
empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

WIDTH = 3
RADIUS = 2
BITS = 64
CROWD = 64
SEED = 42
_CHUNK = 1 << 16


def fingerprint(text: bytes | None, width: int = WIDTH) -> int:
    """Majority bits of the shingle hashes of a text."""
    words = text.lower().split() if text else []
    if not words:
        return 0
    n = min(width, len(words))
    m = len(words) - n + 1
    ones = np.zeros(BITS, np.int64)
    for at in range(0, m, _CHUNK):
        part = words[at:min(m, at + _CHUNK) + n - 1]
        h = np.fromiter((xxhash.xxh64_intdigest(b" ".join(s), SEED) for s in zip(*(part[k:] for k in range(n)))), "<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > m, bitorder="little").view("<u8")[0])


def masks(bits: list[int], radius: int = RADIUS) -> list[int]:
    """Covering masks over the given bit positions: of any ``radius`` of them, some mask keeps none."""
    top = 1 << (radius + 1)
    vector = {b: 1 + k % (top - 1) for k, b in enumerate(bits)}
    return [sum(1 << b for b in bits if (vector[b] & v).bit_count() & 1) for v in range(1, top)]


def left_out(mask: int) -> list[int]:
    return [b for b in range(BITS) if not mask >> b & 1]


def table_masks(level: int, radius: int = RADIUS) -> list[int]:
    """Masks of all tables of a level, by table number; each level's tables extend one of the level above.

    The children of table t are the tables ``t * k`` to ``t * k + k - 1`` of the next level (k tables a level).
    """
    found = masks(list(range(BITS)), radius)
    for _ in range(level):
        found = [m | more for m in found for more in masks(left_out(m), radius)]
    return found


def _signed(masks_: list[int]) -> list[int]:
    return [m - (1 << 64) if m >> 63 else m for m in masks_]


def _forest(fp: np.ndarray, heads: np.ndarray, table: np.ndarray, before: list[np.ndarray], radius: int):
    """Links (a, b) that connect what links within each bucket; ``heads`` marks the first row of each bucket.

    ``before[t]``: masks of the tables in which a pair that collides in table t may have met already.
    """
    ends = np.append(np.flatnonzero(heads)[1:], len(fp))
    own = np.cumsum(heads) - 1
    last = ends[own]  # end of each row's bucket
    found_a, found_b = [], []
    step, at = 1, np.arange(len(fp))
    while len(at := at[at + step < last[at]]):
        x = fp[at] ^ fp[at + step]
        near = at[np.bitwise_count(x) <= radius]
        found_a.append(near)
        found_b.append(near + step)
        step += 1
    a, b = (np.concatenate(v) if v else np.empty(0, np.int64) for v in (found_a, found_b))
    keep = np.ones(len(a), bool)
    x = fp[a] ^ fp[b]
    for t in np.unique(table[a]):
        mine = table[a] == t
        for m in before[t]:
            keep &= ~(mine & (x & m == 0))
    a, b = a[keep], b[keep]
    root = {}

    def find(i):
        while (p := root.get(i, i)) != i:
            root[i] = root.get(p, p)
            i = p
        return i

    out = []
    for i, j in zip(a.tolist(), b.tolist(), strict=True):
        p, q = find(i), find(j)
        if p != q:
            root[max(p, q)] = min(p, q)
            out.append((i, j))
    pairs = np.array(out, np.int64).reshape(-1, 2)
    return fp[pairs[:, 0]], fp[pairs[:, 1]]


def links(classes: DataFrame, radius: int = RADIUS, crowd: int = CROWD) -> DataFrame:
    """(a, b): fingerprints within ``radius`` bits, enough of them to connect whatever such links connect.

    ``classes``: distinct fingerprints in the column ``fp`` (long).
    """
    spark = classes.sparkSession
    crowd = max(64, crowd)
    fan = (1 << (radius + 1)) - 1
    rows, level, out = classes.select("fp").withColumn("above", F.lit(0)), 0, None
    while True:
        signed = _signed(table_masks(level, radius))
        kept = F.element_at(F.array(*[F.lit(m).cast("long") for m in signed]), F.col("table") + 1)
        dealt = (rows.withColumn("table", F.explode(F.sequence(F.col("above") * fan, F.col("above") * fan + fan - 1)))
                 .select("fp", "table", F.col("fp").bitwiseAND(kept).alias("key")))
        crowded = dealt.groupBy("table", "key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > crowd).drop("n")
        crowded = C.stored(crowded, "crowded")
        full = F.broadcast(crowded) if crowded.count() <= C.BROADCAST_ROWS else crowded
        calm = dealt.join(full, ["table", "key"], "left_anti")
        found = C.stored(_compare(calm, level, radius), "links")
        out = found if out is None else out.unionByName(found)
        if not crowded.limit(1).count():
            return out
        rows = C.stored(dealt.join(full, ["table", "key"]).select("fp", F.col("table").alias("above")), "crowd")
        level += 1


def _compare(calm: DataFrame, level: int, radius: int) -> DataFrame:
    """Links within buckets of bounded size, streamed."""
    fan = (1 << (radius + 1)) - 1
    here = np.array(table_masks(level, radius), np.uint64)
    # a pair meets first in the first colliding table among those that extend the same table above, on every level
    before = []
    for t in range(len(here)):
        earlier, at = [], t
        for up in range(level, -1, -1):
            level_masks = table_masks(up, radius)
            earlier += level_masks[at - at % fan:at]
            at //= fan
        before.append(np.array(earlier, np.uint64))
    dealt = calm.repartition(C.partitions(calm.sparkSession), "table", "key").sortWithinPartitions("table", "key", "fp")

    def scan(batches):
        held = None  # rows of the last bucket, which may go on in the next batch
        for b in batches:
            cols = [b.column(i).to_numpy(zero_copy_only=False) for i in range(3)]
            fp, table, key = cols if held is None else [np.concatenate(v) for v in zip(held, cols, strict=True)]
            if not len(fp):
                continue
            heads = np.empty(len(fp), bool)
            heads[0] = True
            heads[1:] = (table[1:] != table[:-1]) | (key[1:] != key[:-1])
            cut = int(np.flatnonzero(heads)[-1])
            yield out(fp[:cut], heads[:cut], table[:cut])
            held = [fp[cut:], table[cut:], key[cut:]]
        if held is not None:
            heads = np.zeros(len(held[0]), bool)
            heads[0] = True
            yield out(held[0], heads, held[1])

    def out(fp, heads, table):
        a, b = _forest(fp.view(np.uint64), heads, table, before, radius) if len(fp) else (fp, fp)
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    return dealt.select("fp", "table", "key").mapInArrow(scan, "a long, b long")


def near_duplicates(docs: DataFrame, width: int = WIDTH, radius: int = RADIUS, crowd: int = CROWD) -> DataFrame:
    """Per row: doc_id, fingerprint (hexadecimal), component_id (smallest doc_id reachable by links)."""
    C.ship(docs.sparkSession)
    base = C.texts(docs)

    def scan(batches):
        for b in batches:
            fp = np.array([fingerprint(t, width) for t in b.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64))], names=["doc_id", "fp"])

    rows = C.stored(base.mapInArrow(scan, f"doc_id {dict(base.dtypes)['doc_id']}, fp long"), "fingerprints")
    classes = C.stored(rows.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")), "classes")
    label = C.components(links(classes, radius, crowd))
    linked = classes.join(label, classes["fp"] == label["node"])
    root = linked.groupBy("component").agg(F.min("least").alias("root"))
    known = (classes.join(linked.join(root, "component").select(F.col("node"), "root"), F.col("fp") == F.col("node"), "left")
             .select("fp", F.coalesce("root", "least").alias("root"), "n"))
    found = C.attach(rows, C.stored(known, "roots"), ["fp"], "n")
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
                        F.when(F.col("doc_id").isNotNull(), F.col("root")).alias("component_id"))
