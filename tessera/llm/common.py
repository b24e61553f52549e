"""Helpers shared by the training-data operators: words, rolling hashes, shared folder, components.

Text is handled as UTF-8 bytes: ``bytes.split()`` splits exactly on 0x20 and 0x09-0x0D, the
separators of the word pattern ``[^\\x20\\x09-\\x0D]+``, and ``bytes.lower()`` lowers A-Z alone.
"""

from __future__ import annotations

import os
import uuid
import zipfile

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_dir

#: rows of two or three numbers that are broadcast at most
BROADCAST_ROWS = 200_000
#: bytes of a batch that goes to a Python worker
BATCH_BYTES = 4 << 20
#: ``attach`` treats keys that hold more than this share of all rows as hot: at most 10,000 keys
HOT_SHARE = 10_000

WORD_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once per context (they need not have it installed).

    The archive is made in the driver's own temporary folder; Spark's file service carries it.
    """
    sc = spark.sparkContext
    if getattr(sc, "_tessera_shipped", False):
        return
    import tempfile

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    if os.path.isdir(root):  # already inside an archive: nothing to ship
        name = os.path.join(tempfile.mkdtemp(prefix="tessera-"), "tessera_pkg.zip")
        with zipfile.ZipFile(name, "w") as z:
            for d, _, files in os.walk(root):
                for f in sorted(files):
                    if f.endswith(".py"):
                        full = os.path.join(d, f)
                        z.write(full, os.path.relpath(full, os.path.dirname(root)))
        sc.addPyFile(name)
    sc._tessera_shipped = True


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder below the shared checkpoint folder; unique, so reruns never meet."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored = path
    return out


def discard(*frames: DataFrame) -> None:
    """Delete tables of ``stored`` that no frame still to be run reads."""
    for df in frames:
        path = getattr(df, "_stored", None)
        if path:
            sc = df.sparkSession.sparkContext
            p = sc._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)


def bound_batches(spark: SparkSession) -> None:
    """Batches to Python workers hold about ``BATCH_BYTES`` at most, unless the session has a bound of its own.

    Spark's default is 64 MB a batch: an executor holds it in Arrow's buffers and the worker once more, as Python objects and as
    result, in every task at once. Narrow rows still come 10,000 at a time. Frames are run later by their caller, so the setting stays.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, str(BATCH_BYTES))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def texts(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Key and text alone (extra columns of any name stay out); the text as UTF-8 bytes."""
    return docs.select(docs[key].alias("doc_id"), docs[text].cast("binary").alias("text"))


def held_out(key, modulus: int, remainder: int):
    """crc32 of the key as text falls on ``remainder``; a null key never does."""
    return F.coalesce(F.crc32(key.cast("string")) % modulus == remainder, F.lit(False))


def rows_of(batch: pa.RecordBatch) -> list[tuple]:
    return list(zip(*(c.to_pylist() for c in batch.columns), strict=True))


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def rolling(h: np.ndarray, width: int) -> np.ndarray:
    """64-bit hash of every ``width`` consecutive entries of ``h``."""
    m = len(h) - width + 1
    if m <= 0:
        return np.empty(0, np.uint64)
    out = h[:m].copy()
    for j in range(1, width):
        out *= WORD_MULTIPLIER
        out += h[j:j + m]
    out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    out ^= out >> np.uint64(32)
    return out


def components(links: DataFrame, name: str = "components") -> DataFrame:
    """Connected components of ``links(a, b)``: (node, component), component = smallest node.

    Min-label propagation with pointer jumping; every round is written to the shared folder.
    Labels only travel as (node, label) rows, reduced by partial ``min`` before each shuffle; a
    hub is a hot key of a plain equi-join, which adaptive execution splits.
    """
    both = stored(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
                  .where("a <> b").distinct(), f"{name}-edges")
    n = both.count()
    # few links (counted): their labels are broadcast and kept in few files, so that a round is a few tasks
    few, tasks = n <= BROADCAST_ROWS, max(1, n // 50_000)
    side = F.broadcast if few else (lambda df: df)
    keep = (lambda df: stored(df.coalesce(tasks), f"{name}-labels")) if few else (lambda df: stored(df, f"{name}-labels"))
    if few:
        wide, both = both, stored(both.coalesce(tasks), f"{name}-edges")
        discard(wide)
    label = keep(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("label")))
    last = label
    while True:
        near = both.join(side(label), both["b"] == label["node"]).groupBy("a").agg(F.min("label").alias("m"))
        hooked = (near.join(side(label), label["node"] == near["a"])
                  .select("node", F.col("label").alias("old"), F.least("label", "m").alias("label")))
        up = label.select(F.col("node").alias("p"), F.col("label").alias("pl"))
        nxt = keep(hooked.join(side(up), hooked["label"] == up["p"], "left")
                   .select("node", "old", F.least("label", F.coalesce("pl", "label")).alias("label")))
        discard(last)
        last, label = nxt, nxt.select("node", "label")
        if not nxt.where("label <> old").limit(1).count():
            discard(both)
            return label.withColumnRenamed("label", "component")


def attach(rows: DataFrame, side: DataFrame, keys: list[str], n: str) -> DataFrame:
    """``rows`` left-joined with ``side``, which has one row per key and the number of its ``rows`` in ``n``.

    Keys that hold more than 1 / HOT_SHARE of all rows, at most HOT_SHARE of them, are broadcast; the
    rows of all other keys are shuffled. So no key, however frequent, gathers in one task.
    """
    total = side.agg(F.sum(n)).first()[0] or 0
    hot = F.col(n) * HOT_SHARE > total
    few, rest = side.where(hot).drop(n), side.where(~hot).drop(n)
    if side.count() <= HOT_SHARE:  # all of them are few
        return rows.join(F.broadcast(side.drop(n)), keys, "left")
    met = rows.join(F.broadcast(few.withColumn("_hot", F.lit(True))), keys, "left")
    cold = met.where("_hot is null").select(*rows.columns).join(rest, keys, "left")
    return met.where("_hot").select(*cold.columns).unionByName(cold)
