"""Best-fit packing by the sum-of-squares rule.

A document's token ids plus the end id are cut into pieces (only documents above the capacity;
the first piece takes the remainder). A piece goes where the sum over residual gaps of the squared
number of open bins becomes smallest: placing length s into a bin of gap g changes that sum by
2*(N[g-s] - N[g]) + 2, or, where the bin gets full, by 1 - 2*N[g]; a new bin changes it by
2*N[c-s] + 1. Ties take the smallest gap. Pieces come longest first.

Scale: pieces are dealt by hash into groups of bounded size, each packed by itself (only
lengths and keys are shuffled, never ids). Bins that stay open with a gap above ``slack`` are
not closed: the pieces of these bins go to a second round with fewer groups, so the waste of many groups does
not add up. ``sequence_id`` = round, group and bin.

Ids come through tiktoken with the same vocabulary's ranks (equal to the ``tokenizers``
ids, tested), which is several times as fast; the literal of the special token gives its one id, as there.

Defined cases: null texts count as empty, an empty text is the end id alone; repeated rows are packed each; extra
columns are ignored; empty tables give no rows.
"""

from __future__ import annotations

import base64
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

CAPACITY = 1024
END_ID = 2
GROUP_ROWS = 50_000
SLACK = 16
# The vocabulary's only special token.
SPECIAL, SPECIAL_ID = "<|endoftext|>", 50256
#: two characters side by side that are white space by any common definition
_RUN = r"[\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]{2}"
_RUN_BRANCH = r"|\s+(?!\S)"


@lru_cache(maxsize=2)
def _encoder(ranks_path: str, pattern: str):
    import tiktoken

    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def tokenizer_files() -> tuple[str, str]:
    """Ranks file and split pattern of the public byte-level vocabulary."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def encode_all(texts: pa.Array, ranks_path: str, pattern: str):
    """Ids of each text (UTF-8 bytes; null: none) as a list, one after the other.

    The pattern's look-ahead branch matters only where white-space characters stand side by side; texts
    without such a place go through the pattern without it, which its regex engine runs faster.
    """
    strings = [t.decode("utf-8", "replace") if t else "" for t in texts.to_pylist()]
    whole, plain = _encoder(ranks_path, pattern), _encoder(ranks_path, pattern.replace(_RUN_BRANCH, ""))
    for t, run in zip(strings, pc.match_substring_regex(pa.array(strings, pa.string()), _RUN).to_pylist(), strict=True):
        encode_part = (whole if run else plain).encode_ordinary
        if SPECIAL not in t:
            yield encode_part(t) if t else []
            continue
        ids: list[int] = []
        for k, part in enumerate(t.split(SPECIAL)):  # the vocabulary's special token stands for its literal
            ids += ([SPECIAL_ID] if k else []) + (whole.encode_ordinary(part) if part else [])
        yield ids


def encode(text: str, ranks_path: str, pattern: str) -> bytes:
    """Ids of one text as little-endian uint32 bytes."""
    return np.array(next(encode_all(pa.array([text.encode()]), ranks_path, pattern)), "<u4").tobytes()


def pieces(docs: DataFrame, capacity: int = CAPACITY, end_id: int = END_ID, files: tuple[str, str] | None = None,
           with_ids: bool = False) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32 (and ids)."""
    C.ship(docs.sparkSession)
    path, pattern = files or tokenizer_files()
    base = C.texts(docs)
    kind = dict(base.dtypes)["doc_id"]
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids

    def cut(batches):
        for b in batches:
            at, cols = [], [[] for _ in range(5)]
            for row, found in enumerate(encode_all(b.column(1), path, pattern)):
                ids = np.array([*found, end_id], "<u4").tobytes()
                n = len(ids) // 4
                edges = list(range(n % capacity or capacity, n, capacity))
                for k, (a, z) in enumerate(zip([0, *edges], [*edges, n], strict=True)):
                    at.append(row)
                    part = ids[4 * a:4 * z]
                    for c, v in zip(cols, (k, a, z - a, zlib.crc32(part), part), strict=True):
                        c.append(v)
            arrays = [b.column(0).take(pa.array(at, pa.int64())), pa.array(cols[0], pa.int32()),
                      *(pa.array(c, pa.int64()) for c in cols[1:4])]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                arrays.append(pa.array(cols[4], pa.binary()))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    return base.mapInArrow(cut, schema)


def sum_of_squares(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of each length (in the given order), and the gap left in each bin."""
    count = np.zeros(capacity + 1, np.int64)  # open bins by gap
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    place, offset, gaps = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64), []
    for i, s in enumerate(lengths.tolist()):
        best, at = 2 * int(count[capacity - s]) + 1 if s < capacity else 0, -1
        if s < capacity:
            change = 2 * (count[:capacity - s] - count[s:capacity]) + 2
            change[0] = 1 - 2 * count[s]  # the bin gets full: its gap is no longer counted
            change[count[s:capacity] == 0] = 1 << 40
            k = int(change.argmin())
            if change[k] <= best:
                at = k + s
        if at < 0:
            gaps.append(capacity)
            b, at = len(gaps) - 1, capacity
        else:
            b = stacks[at].pop()
            count[at] -= 1
        place[i], offset[i] = b, capacity - gaps[b]
        gaps[b] -= s
        if gaps[b]:
            stacks[gaps[b]].append(b)
            count[gaps[b]] += 1
    return place, offset, np.array(gaps, np.int64)


def _round(rows: DataFrame, groups: int, number: int, capacity: int, slack: int) -> DataFrame:
    """One round: deal by hash, sort each group longest first, pack; ``open`` marks unfilled bins."""
    keyed = rows.withColumn("grp", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(groups)).cast("int"))
    keyed = (keyed.repartitionById(groups, "grp")
             .sortWithinPartitions("grp", F.desc("length"), "doc_id", "piece", "ids_crc32"))
    schema = ", ".join(f"{n} {t}" for n, t in rows.dtypes) + ", sequence_id long, offset long, open boolean"
    width = len(rows.columns)

    def pack(batches):
        held, last = [], None
        for b in batches:
            grp = b.column(width).to_numpy(zero_copy_only=False)
            edges = [0, *(np.flatnonzero(np.diff(grp)) + 1).tolist(), len(grp)]
            for a, z in zip(edges, edges[1:], strict=False):
                if z == a:
                    continue
                if held and grp[a] != last:
                    yield done(held, last)
                    held = []
                held.append(b.slice(a, z - a))
                last = int(grp[a])
        if held:
            yield done(held, last)

    def done(held, grp):
        t = pa.Table.from_batches(held).combine_chunks()
        place, offset, gaps = sum_of_squares(t.column("length").to_numpy(), capacity)
        cols = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in t.columns[:width]]
        ids = (np.int64(number) << 56) + (np.int64(grp) << 32) + place
        return pa.RecordBatch.from_arrays([*cols, pa.array(ids), pa.array(offset), pa.array(gaps[place] > slack)],
                                          names=[*t.column_names[:width], "sequence_id", "offset", "open"])

    return keyed.mapInArrow(pack, schema)


def pack(parts: DataFrame, capacity: int = CAPACITY, group_rows: int = GROUP_ROWS, slack: int = SLACK) -> DataFrame:
    """``parts`` (from ``pieces``, without ids) with sequence_id and offset."""
    spark = parts.sparkSession
    C.ship(spark)
    parts = C.stored(parts, "pieces")
    count = parts.count()
    groups = max(1, -(-count // group_rows), min(C.partitions(spark), count // 2_000))
    first = C.stored(_round(parts, groups, 0, capacity, slack), "packed")
    rest = first.where("open").drop("sequence_id", "offset", "open")
    again = _round(rest, max(1, -(-rest.count() // group_rows)), 1, capacity, slack)
    return first.where("not open").drop("open").unionByName(again.drop("open"))
