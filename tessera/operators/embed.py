"""Batch text embedding (VEC-1), pooled token embedding (VEC-3, AGG-12) and the
incremental embedded-corpus refresh (VEC-5 with SET-1, SET-2, JOIN-2..4).

``embed_fn`` is the extension point for a real model: a function from a list of strings
to a list of vectors, called once per Arrow batch inside ``mapInPandas``. Without one,
a letter profile (``functions.vectors.with_letter_profile``) is used, or the hashed
term vector below when a Python batch function is wanted.
"""

from __future__ import annotations

import hashlib
import re
from typing import Callable, Iterable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import vectors as V
from ..session import cut_lineage, ship

EmbedFn = Callable[[list], list]

# words of UTF-8 bytes: ASCII letters and digits, and every byte of other characters
_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


def hashed_term_vectors(texts: list, dims: int = 256) -> list:
    """Default batch ``embed_fn``: signed feature hashing of words (A-Z lower-cased), L2-normalised.

    A word's MD5 names its bucket (first 32 bits modulo ``dims``) and its sign (top bit of the next
    byte), so the vectors can be recomputed in SQL. Words are hashed once per batch; a null or
    empty text gives the zero vector.
    """
    codes: dict = {}
    out = []
    for t in texts:
        words = _WORD.findall((t or "").encode("utf-8").lower())
        for w in words:
            if w not in codes:
                h = hashlib.md5(w, usedforsecurity=False).digest()
                codes[w] = 2 * (int.from_bytes(h[:4], "big") % dims) + (h[4] >> 7)
        c = np.bincount(np.fromiter((codes[w] for w in words), np.int64, len(words)), minlength=2 * dims)
        v = (c[0::2] - c[1::2]).astype(np.float64)
        n = np.sqrt((v * v).sum())
        out.append((v / n if n > 0 else v).astype(np.float32))
    return out


def embed_texts(df: DataFrame, text: str, embed_fn: EmbedFn | None = None,
                out: str = "embedding") -> DataFrame:
    """VEC-1: add ``out array<float>`` computed batch-wise; an empty input yields no call."""
    ship(df.sparkSession)
    fn = embed_fn or hashed_term_vectors
    schema = T.StructType(df.schema.fields + [T.StructField(out, T.ArrayType(T.FloatType()))])
    cols = df.columns

    def run(batches: Iterable):
        for pdf in batches:
            if len(pdf) == 0:
                continue
            vecs = fn(pdf[text].tolist())
            pdf = pdf[cols].copy()
            pdf[out] = [np.asarray(v, dtype=np.float32) for v in vecs]
            yield pdf

    return df.mapInPandas(run, schema)


def mean_pool(df: DataFrame, keys, vec: str, out: str = "pooled") -> DataFrame:
    """AGG-12: per-dimension mean of the vectors of each key, re-assembled in dimension order.

    Dimensions are exploded so the mean is a plain partial/final ``avg``; a hot key is
    pre-aggregated map side and never collected whole.
    """
    keys = list(keys)
    ex = df.select(*keys, F.posexplode(V.as_double(vec)).alias("_d", "_v"))
    per = ex.groupBy(*keys, "_d").agg(F.avg("_v").alias("_m"))
    return (per.groupBy(*keys)
            .agg(F.array_sort(F.collect_list(F.struct("_d", "_m"))).alias("_a"))
            .select(*keys, F.transform("_a", lambda x: x["_m"]).alias(out)))


def text_key(c) -> Column:
    """Vectors are stored under the SHA-256 of their string."""
    return F.sha2(F.col(c) if isinstance(c, str) else c, 256)


def apply_embed(df: DataFrame, text: str, embed, out: str) -> DataFrame:
    if embed is None:
        return V.with_letter_profile(df, text, out)
    return embed_texts(df, text, embed, out)


def unembedded_strings(examples: DataFrame, stored_vectors: DataFrame,
                       string_cols=("example", "rewrite")) -> DataFrame:
    """SET-1 + JOIN-2: distinct strings of the corpus that have no stored vector.

    ``stored_vectors(key, ...)`` is keyed by ``text_key``; returns (key, text).
    """
    strings = None
    for c in string_cols:
        s = examples.select(F.col(c).cast("string").alias("text")).where(F.col("text").isNotNull())
        strings = s if strings is None else strings.unionByName(s)
    # de-duplicate on the 64-character hash, not on whole texts
    strings = strings.withColumn("key", text_key("text")).dropDuplicates(["key"])
    return strings.join(stored_vectors.select("key"), "key", "left_anti")


def refresh_corpus(examples: DataFrame, stored: DataFrame | None, embed=None,
                   id_col: str = "id") -> DataFrame:
    """VEC-5: bring an embedded corpus up to date with new examples.

    examples(id, example, rewrite); stored(id, example, rewrite, example_embedding,
    rewrite_embedding) from the previous run (``None`` when there is none). Only strings
    without a stored vector are embedded; vectors are looked up by string, so a string
    already embedded under another id is reused. Records are upserted by id (new values
    win, stored-only records stay). Output is ordered by id.
    """
    cols = ["example", "rewrite"]
    # one row per id, whatever the batch repeats: the greatest (example, rewrite) wins
    ex = (examples.select(id_col, *[F.col(c).cast("string").alias(c) for c in cols])
          .groupBy(id_col).agg(F.max(F.struct(*cols)).alias("_r")).select(id_col, "_r.*"))
    if stored is None:
        spark = examples.sparkSession
        stored = spark.createDataFrame([], f"{id_col} bigint, example string, rewrite string, "
                                           "example_embedding array<float>, rewrite_embedding array<float>")
    st = stored.select(id_col, *[F.col(c).cast("string").alias(c) for c in cols],
                       "example_embedding", "rewrite_embedding")
    # stored vectors by string, materialised once: read by the anti join and the lookup
    known = cut_lineage(
        st.select(F.col("example").alias("text"), F.col("example_embedding").alias("vec"))
        .unionByName(st.select(F.col("rewrite").alias("text"), F.col("rewrite_embedding").alias("vec")))
        .where(F.col("vec").isNotNull() & F.col("text").isNotNull())
        .withColumn("key", text_key("text"))
        .groupBy("key").agg(F.min("vec").alias("vec")))
    missing = unembedded_strings(ex, known)
    # model output is materialised once, so both lookups below reuse it (one call per string)
    fresh = cut_lineage(apply_embed(missing, "text", embed, "vec").select("key", "vec"))
    vectors = known.unionByName(fresh)
    merged = ex.alias("n").join(st.alias("o"), id_col, "full_outer").select(
        id_col,
        *[F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}")).alias(c) for c in cols],
        F.col("o.example_embedding").alias("_oe"), F.col("o.rewrite_embedding").alias("_or"))
    ve = vectors.select(F.col("key").alias("_ke"), F.col("vec").alias("_ve"))
    vr = vectors.select(F.col("key").alias("_kr"), F.col("vec").alias("_vr"))
    out = (merged.withColumn("_ke", text_key("example")).withColumn("_kr", text_key("rewrite"))
           .join(ve, "_ke", "left").join(vr, "_kr", "left"))
    return out.select(id_col, *cols,
                      F.coalesce("_ve", "_oe").alias("example_embedding"),
                      F.coalesce("_vr", "_or").alias("rewrite_embedding")).orderBy(id_col)
