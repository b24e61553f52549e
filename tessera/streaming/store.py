"""Copy-on-write bucket store of an embedded corpus (VEC-5).

Records lie in hash buckets by id, vectors in hash buckets by the hash of their string. A version is a manifest:
which folder holds each bucket, and the last epoch applied of every stream. A batch reads and rewrites only the buckets
that its ids and its new strings fall into; the manifest is written under a temporary name and renamed, which commits
data and epoch at once. A batch that fails leaves the version before as it was, a replayed epoch changes nothing.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.embed import apply_embed, text_key, unembedded_strings
from ..session import cut_lineage, release
from ..sources.loaders import EMBEDDED_SCHEMA

BUCKETS = 256
VECTORS = "key string, vec array<float>"


class BucketStore:
    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS):
        self.spark, self.root = spark, root.rstrip("/")
        self.jvm = spark.sparkContext._jvm
        self.fs = self._path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self.version, self.manifest = self._latest(buckets)

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def _latest(self, buckets: int) -> tuple[int, dict]:
        """Number and content of the newest manifest (its bucket count holds for the store's life)."""
        empty = {"buckets": buckets, "records": {}, "vectors": {}, "epochs": {}}
        if not self.fs.exists(self._path("manifest")):
            return -1, empty
        names = sorted(s.getPath().getName() for s in self.fs.listStatus(self._path("manifest")) if s.getPath().getName().startswith("v-"))
        if not names:
            return -1, empty
        text = self.spark.read.text(f"{self.root}/manifest/{names[-1]}", wholetext=True).first()[0]
        return int(names[-1][2:11]), json.loads(text)

    def applied(self, stream: str, epoch: int) -> bool:
        return self.manifest["epochs"].get(stream, -1) >= epoch

    def bucket(self, c) -> Column:
        return F.pmod(F.xxhash64(c), F.lit(self.manifest["buckets"])).cast("int")

    def read(self, kind: str, touched: set[int] | None = None) -> DataFrame:
        """Rows of a table (``records`` or ``vectors``), of the given buckets alone where these are named."""
        schema = EMBEDDED_SCHEMA if kind == "records" else VECTORS
        folders = sorted(f for b, f in self.manifest[kind].items() if touched is None or int(b) in touched)
        return self.spark.read.schema(schema).parquet(*(f"{self.root}/{f}" for f in folders)) if folders else self.spark.createDataFrame([], schema)

    def _touched(self, df: DataFrame, c: str) -> set[int]:
        return {r[0] for r in df.select(self.bucket(c)).distinct().toLocalIterator()}  # at most one number per bucket

    def _write(self, kind: str, df: DataFrame, key: str, touched: set[int]) -> dict[str, str]:
        name = f"{kind}/{uuid.uuid4().hex}"
        n = max(1, min(len(touched), int(self.spark.conf.get("spark.sql.shuffle.partitions"))))
        df.withColumn("b", self.bucket(key)).repartition(n, "b").write.partitionBy("b").parquet(f"{self.root}/{name}")
        return {str(b): f"{name}/b={b}" for b in touched if self.fs.exists(self._path(f"{name}/b={b}"))}

    def upsert(self, examples: DataFrame, stream: str, epoch: int, embed=None) -> None:
        """Apply a batch of examples(id, example, rewrite); of repeated ids the greatest (example, rewrite) wins."""
        if self.applied(stream, epoch):
            return
        cols = ["example", "rewrite"]
        new = cut_lineage(examples.select("id", *[F.col(c).cast("string").alias(c) for c in cols]).where("id is not null")
                          .groupBy("id").agg(F.max(F.struct(*cols)).alias("r")).select("id", "r.*"))
        strings = None
        for c in cols:
            s = new.select(text_key(c).alias("key"))
            strings = s if strings is None else strings.unionByName(s)
        asked = self._touched(strings.where("key is not null"), "key")
        known = self.read("vectors", asked)
        fresh = cut_lineage(apply_embed(unembedded_strings(new, known), "text", embed, "vec").select("key", "vec"))
        grown = self._touched(fresh, "key")
        vectors = self._write("vectors", self.read("vectors", grown).unionByName(fresh), "key", grown) if grown else {}
        found = known.unionByName(fresh)
        done = new
        for c in cols:
            side = found.select(F.col("key").alias(f"k_{c}"), F.col("vec").alias(f"{c}_embedding"))
            done = done.join(side, text_key(c) == F.col(f"k_{c}"), "left").drop(f"k_{c}")
        ids = self._touched(new, "id")
        kept = self.read("records", ids).join(new.select("id"), "id", "left_anti")
        names = [f.split()[0] for f in EMBEDDED_SCHEMA.split(", ")]
        records = self._write("records", kept.select(*names).unionByName(done.select(*names)), "id", ids) if ids else {}
        self._commit({**self.manifest, "records": {**self.manifest["records"], **records}, "vectors": {**self.manifest["vectors"], **vectors},
                      "epochs": {**self.manifest["epochs"], stream: epoch}})
        release(new, fresh)

    def _commit(self, manifest: dict) -> None:
        self.fs.mkdirs(self._path("manifest"))
        temp, name = self._path(f"manifest/.{uuid.uuid4().hex}"), self._path(f"manifest/v-{self.version + 1:09d}.json")
        out = self.fs.create(temp, True)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        if not self.fs.rename(temp, name):
            raise RuntimeError(f"version {self.version + 1} was written by another job")
        self.version, self.manifest = self.version + 1, manifest
