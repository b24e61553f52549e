"""SRC-1..SRC-4: corpus scans with directory pruning, suffix listing, text decoding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship
from . import tree

# Directory-name prefixes pruned by the node scan and by the edge scan.
NODE_PRUNE_PREFIXES = (".", "test", "target", "build")
EDGE_PRUNE_PREFIXES = (".", "test")
SOURCE_SUFFIXES = (".java", ".xml")


def _any_prefix(c: Column, prefixes) -> Column:
    out = F.lit(False)
    for p in prefixes:
        out = out | c.startswith(p)
    return out


def pruned(relpath, prefixes) -> Column:
    """True when a directory segment of ``relpath`` (never the file name) starts with a prefix."""
    p = F.col(relpath) if isinstance(relpath, str) else relpath
    segs = F.split(p, "/")
    dirs = F.slice(segs, 1, F.greatest(F.size(segs) - 1, F.lit(0)))
    return F.exists(dirs, lambda d: _any_prefix(d, prefixes))


def has_suffix(relpath, suffixes) -> Column:
    p = F.col(relpath) if isinstance(relpath, str) else relpath
    out = F.lit(False)
    for s in suffixes:
        out = out | p.endswith(s)
    return out


def scan_corpus(spark: SparkSession, root: str, suffixes=SOURCE_SUFFIXES,
                prune_prefixes=NODE_PRUNE_PREFIXES, with_content: bool = True) -> DataFrame:
    """SRC-1: recursive listing of ``root`` -> (path, relpath, length, content?, text?).

    The walk prunes folders before it descends, so nothing in them is listed or opened (``tree``), and an
    unreadable file gives a row with null content. With ``with_content=False`` (SRC-2) no file is opened. Undecodable
    bytes give a null ``text`` (SRC-3). Stores that only Spark's readers open are listed by those instead: there
    pruned folders are dropped by path after the listing.
    """
    if not tree.opens(root):
        return _scan_listed(spark, root, suffixes, prune_prefixes, with_content)
    ship(spark)
    spark.dataSource.register(tree.TreeSource)
    df = (spark.read.format("source_tree").option("path", root).option("suffixes", ",".join(suffixes)).option("prune", ",".join(prune_prefixes))
          .option("content", str(with_content).lower()).load())
    return df if with_content else df.select("path", "relpath", "length")


def _scan_listed(spark: SparkSession, root: str, suffixes, prune_prefixes, with_content: bool) -> DataFrame:
    """The same rows through Spark's own listing."""
    root = root.rstrip("/")
    df = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if suffixes and not any(set(s) & set("*?[]{},\\") for s in suffixes):
        df = df.option("pathGlobFilter", "*{" + ",".join(suffixes) + "}")
    df = df.load(root)
    # path comes back as a URI; the relative path is everything after the root folder
    rel = F.substring_index(F.col("path"), root.split(":", 1)[-1] + "/", -1)
    df = df.withColumn("relpath", rel)
    df = df.where(has_suffix("relpath", suffixes) & ~pruned("relpath", prune_prefixes))
    if not with_content:
        return df.select("path", "relpath", "length")
    return df.select("path", "relpath", "length", "content",
                     F.when(F.is_valid_utf8("content"), F.decode("content", "UTF-8")).alias("text"))


def read_side_text(spark: SparkSession, path: str) -> DataFrame:
    """SRC-4: whole text of one file as a one-row frame; a missing file gives ``''``."""
    try:
        df = spark.read.format("binaryFile").load(path)
        text = F.when(F.is_valid_utf8("content"), F.decode("content", "UTF-8"))
        return df.agg(F.coalesce(F.max(text), F.lit("")).alias("text"))
    except Exception:  # noqa: BLE001 - missing path is a normal case
        return spark.range(1).select(F.lit("").alias("text"))
