"""Training-order materialisation: a keyed Feistel permutation places every sequence.

The token stream of each scan partition (documents in order, each with its end id) is cut into sequences
of ``seq_len`` ids; the last one of a partition is filled with the end id. Sequences get
consecutive numbers 0..n-1 from the partitions' counts. The slot of sequence x is a keyed balanced Feistel
permutation of the smallest even power-of-two domain that holds n, walked along its cycle until the value
is below n: a bijection on 0..n-1, computed by each task alone, without any shuffle or sort of
keys, and different for each key (epoch).

Sequences are then range-partitioned by slot; a shard holds ``shard_slots`` consecutive slots, each
``seq_len`` ids of fixed width (stride), so slot s lives in shard ``s // shard_slots`` at byte
``(s % shard_slots) * stride``: training reads shards front to back and resumes at any slot by
arithmetic. A reducer writes a contiguous range of shards, one after the other; there are at most ``REDUCERS`` times as many
reducers as shuffle partitions, however many shards. A shard is written under a name of its attempt
and gets its own name, which follows from its number, once it is complete; repeated attempts write the same
bytes, and what lost ones leave behind goes at the end.

The numbering needs the same ids in the same partitions in both passes: each pass takes a checksum of a partition's ids in
their order, and a partition that differs raises.

Defined cases: null texts count as empty, an empty text is the end id alone; an empty table gives no shards;
repeated rows are written each; extra columns are ignored.
"""

from __future__ import annotations

import json
import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from .packing import END_ID, encode_all, tokenizer_files
from .warc import open_fs

SEQ_LEN = 1024
SHARD_SLOTS = 4096
KEY = 0x5EED
_ROUNDS = 4
REDUCERS = 8


_ATTEMPTS = "_attempts"


def shard_name(shard: int) -> str:
    return f"shard-{shard:08d}.bin"


class Feistel:
    """Keyed permutation of 0..n-1 on int64 arrays."""

    def __init__(self, n: int, key: int = KEY):
        self.n = n
        self.half = max(1, -(-max(1, (n - 1).bit_length()) // 2))
        self.mask = np.uint64((1 << self.half) - 1)
        self.keys = [np.uint64(int.from_bytes(__import__("hashlib").sha256(f"{key}:{r}".encode()).digest()[:8], "big")) for r in range(_ROUNDS)]

    def _mix(self, x, k):
        x = (x + k) * np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xD6E8FEB86659FD93)
        return (x ^ (x >> np.uint64(29))) & self.mask

    def _step(self, x, keys, back=False):
        h = np.uint64(self.half)
        left, right = x >> h, x & self.mask
        for k in keys:
            if back:
                left, right = right ^ self._mix(left, k), left
            else:
                left, right = right, left ^ self._mix(right, k)
        return (left << h) | right

    def _walk(self, x, keys, back):
        x = np.asarray(x, np.uint64).copy()
        todo = np.arange(len(x))
        while len(todo):  # cycle-walking: the domain is at most four times n, so few steps are expected
            x[todo] = self._step(x[todo], keys, back)
            todo = todo[x[todo] >= np.uint64(self.n)]
        return x.astype(np.int64)

    def slots(self, x):
        return self._walk(x, self.keys, False)

    def sequences(self, slot):
        return self._walk(slot, self.keys[::-1], True)


def _streams(base: DataFrame, files, end_id: int):
    """Function over a partition's batches: yields (doc_id, its ids with the end id) per document."""
    path, pattern = files

    def run(batches):
        for b in batches:
            for i, ids in zip(b.column(0).to_pylist(), encode_all(b.column(1), path, pattern), strict=True):
                ids.append(end_id)
                yield i, ids

    return run


def materialise(docs: DataFrame, path: str | None = None, seq_len: int = SEQ_LEN, shard_slots: int = SHARD_SLOTS, key: int = KEY,
                end_id: int = END_ID, files: tuple[str, str] | None = None) -> tuple[DataFrame, str, int]:
    """Write the shards; returns (one row per sequence, folder, number of sequences).

    Rows: sequence, slot, shard, byte_offset, first_doc, n_ids (without filling), ids_crc32 (of the slot's bytes).
    """
    spark = docs.sparkSession
    C.ship(spark)
    base = C.texts(docs)
    kind = dict(base.dtypes)["doc_id"]
    stream = _streams(base, files or tokenizer_files(), end_id)
    folder = path or C.scratch(spark, "shards")

    def count(batches):
        n = crc = 0
        for _, ids in stream(batches):
            n, crc = n + len(ids), zlib.crc32(np.array(ids, "<u4").tobytes(), crc)
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([n], pa.int64()), pa.array([crc], pa.int64())], names=["p", "n", "crc"])

    said = {r["p"]: (r["n"], r["crc"]) for r in base.mapInArrow(count, "p int, n long, crc long").collect()}  # two numbers per partition
    counts = {p: n for p, (n, _) in said.items()}
    first, total = {}, 0
    for p in sorted(counts):
        first[p] = total
        total += -(-counts[p] // seq_len)
    shared = spark.sparkContext.broadcast((said, first))
    width = np.dtype("<u2")  # ids below 65,536 take two bytes; wider ones raise

    def cut(batches):
        p = TaskContext.get().partitionId()
        known, start = shared.value
        place = Feistel(total, key)
        held, owner, done, seen, crc = b"", None, 0, 0, 0
        rows = []

        def flush(rows):
            seq = np.array([r[0] for r in rows], np.int64)
            return pa.RecordBatch.from_arrays(
                [pa.array(seq), pa.array(place.slots(seq)), pa.array([r[1] for r in rows]).cast(arrow), pa.array([r[2] for r in rows], pa.int64()),
                 pa.array([r[3] for r in rows], pa.binary())], names=["sequence", "slot", "first_doc", "n_ids", "ids"])

        size = 4 * seq_len
        for i, ids in stream(batches):
            seen += len(ids)
            if not held:
                owner = i
            part = np.array(ids, "<u4").tobytes()
            held, crc, at = held + part, zlib.crc32(part, crc), 0
            while len(held) - at >= size:
                rows.append((start[p] + done, owner, seq_len, narrow(held[at:at + size])))
                done, at, owner = done + 1, at + size, i
            held = held[at:]
            if len(rows) >= 1024:
                yield flush(rows)
                rows = []
        if (seen, crc) != known.get(p, (0, 0)):
            raise RuntimeError(f"partition {p} held other ids before ({known.get(p)}) than now ({seen, crc}): the input changed between the passes")
        if held:
            n = len(held) // 4
            rows.append((start[p] + done, owner, n, narrow(held + np.array([end_id], "<u4").tobytes() * (seq_len - n))))
        if rows:
            yield flush(rows)

    def narrow(ids: bytes) -> bytes:
        a = np.frombuffer(ids, "<u4")
        if a.max() > 0xFFFF:
            raise ValueError("ids above 65,535 need a wider stride")
        return a.astype(width).tobytes()

    arrow = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind]
    cut_schema = f"sequence long, slot long, first_doc {kind}, n_ids long, ids binary"
    shards = max(1, -(-total // shard_slots))
    stride = seq_len * width.itemsize
    reducers = min(shards, REDUCERS * C.partitions(spark))
    # Ranges of whole shards, and slots come in order within them.
    placed = (base.mapInArrow(cut, cut_schema).withColumn("shard", F.floor(F.col("slot") / shard_slots).cast("int"))
              .withColumn("reducer", F.floor(F.col("shard").cast("long") * reducers / shards).cast("int"))
              .repartitionById(reducers, "reducer").drop("reducer").sortWithinPartitions("slot"))

    def write(batches):
        fs, root = open_fs(folder)
        fs.create_dir(f"{root}/{_ATTEMPTS}", recursive=True)
        out = shard = name = attempt = None

        def seal():
            out.close()
            if fs.get_file_info(f"{root}/{name}").type != pafs.FileType.NotFound:  # of an earlier attempt, the same bytes
                fs.delete_file(f"{root}/{name}")
            fs.move(attempt, f"{root}/{name}")

        for b in batches:
            names = [None] * b.num_rows
            crc = []
            for k, (s, slot, ids) in enumerate(zip(b.column(5).to_pylist(), b.column(1).to_pylist(), b.column(4).to_pylist(), strict=True)):
                if s != shard:
                    if out is not None:
                        seal()
                    shard, name, attempt = s, shard_name(s), f"{root}/{_ATTEMPTS}/{uuid.uuid4().hex}"
                    out, expect = fs.open_output_stream(attempt, compression=None), s * shard_slots
                if slot != expect:
                    raise RuntimeError(f"slot {slot} where {expect} was due")
                expect += 1
                out.write(ids)
                names[k] = name
                crc.append(zlib.crc32(ids))
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(5), b.column(2), b.column(3), pa.array(crc, pa.int64()), pa.array(names, pa.string())],
                                                 names=["sequence", "slot", "shard", "first_doc", "n_ids", "ids_crc32", "file"])
        if out is not None:
            seal()

    rows = C.stored(placed.mapInArrow(write, f"sequence long, slot long, shard int, first_doc {kind}, n_ids long, ids_crc32 long, file string"), "slots")
    rows = rows.withColumn("byte_offset", F.col("slot") % shard_slots * stride)
    fs, root = open_fs(folder)
    fs.create_dir(f"{root}/{_ATTEMPTS}", recursive=True)
    fs.delete_dir(f"{root}/{_ATTEMPTS}")
    with fs.open_output_stream(f"{root}/_SHARDS.json", compression=None) as f:
        f.write(json.dumps({"n": total, "seq_len": seq_len, "stride": stride, "shard_slots": shard_slots, "key": key, "dtype": "<u2"}).encode())
    return rows, folder, total


class Shards:
    """Sequential, resumable reading of a folder of shards."""

    def __init__(self, folder: str):
        self.fs, self.root = open_fs(folder)
        with self.fs.open_input_stream(f"{self.root}/_SHARDS.json") as f:
            self.about = json.loads(f.read())

    def read(self, slot: int = 0, count: int | None = None):
        """(slot, ids) from ``slot`` on; one open file and one stride in memory at a time."""
        a, last = self.about, self.about["n"] if count is None else min(self.about["n"], slot + count)
        while slot < last:
            shard, at = divmod(slot, a["shard_slots"])
            with self.fs.open_input_file(f"{self.root}/{shard_name(shard)}") as f:
                f.seek(at * a["stride"])
                for s in range(slot, min(last, (shard + 1) * a["shard_slots"])):
                    yield s, np.frombuffer(f.read(a["stride"]), a["dtype"])
            slot = (shard + 1) * a["shard_slots"]


def read_back(rows: DataFrame, folder: str) -> DataFrame:
    """``rows`` with ``stored_crc32``: every slot read again from its shard, shard by shard."""

    def check(batches):
        fs, root = open_fs(folder)
        f = name = None
        for b in batches:
            crc = []
            for file, at, size in zip(*(b.column(b.schema.get_field_index(c)).to_pylist() for c in ("file", "byte_offset", "stride")), strict=True):
                if file != name:
                    if f is not None:
                        f.close()
                    f, name = fs.open_input_file(f"{root}/{file}"), file
                f.seek(at)
                crc.append(zlib.crc32(f.read(size)))
            yield b.append_column("stored_crc32", pa.array(crc, pa.int64()))
        if f is not None:
            f.close()

    about = Shards(folder).about
    wide = rows.withColumn("stride", F.lit(about["stride"]))
    return wide.mapInArrow(check, ", ".join(f"{n} {t}" for n, t in wide.dtypes) + ", stored_crc32 long").drop("stride")
