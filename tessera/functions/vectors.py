"""Vector column functions on ``array<float|double>`` (higher-order functions, no UDFs)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..session import ship


def _c(c):
    return F.col(c) if isinstance(c, str) else c


def as_double(v) -> Column:
    return _c(v).cast("array<double>")


def dot(a, b) -> Column:
    """Sum of element-wise products; arrays of unequal length are cut to the shorter."""
    prods = F.zip_with(as_double(a), as_double(b), lambda x, y: x * y)
    return F.aggregate(F.filter(prods, lambda p: p.isNotNull()), F.lit(0.0), lambda acc, x: acc + x)


def norm(v) -> Column:
    return F.sqrt(F.aggregate(as_double(v), F.lit(0.0), lambda acc, x: acc + x * x))


def normalise(v) -> Column:
    """Unit vector (a zero vector stays zero)."""
    n = norm(v)
    return F.transform(as_double(v), lambda x: F.when(n > 0, x / n).otherwise(F.lit(0.0)))


def with_unit(df, vec: str, out: str):
    """Add ``out`` = ``vec`` normalised, computing the norm once per row (not per element)."""
    tmp = f"_{out}_norm"
    return (df.withColumn(tmp, norm(vec))
            .withColumn(out, F.transform(as_double(vec), lambda x: F.when(F.col(tmp) > 0, x / F.col(tmp))
                                         .otherwise(F.lit(0.0))))
            .drop(tmp))


def cosine(a, b) -> Column:
    """VEC-2: cosine similarity of two vectors."""
    return dot(a, b) / (norm(a) * norm(b))


def abs_vector(v) -> Column:
    return F.transform(as_double(v), lambda x: F.abs(x))


def scale(v, s) -> Column:
    return F.transform(as_double(v), lambda x: x * s)


def add(a, b) -> Column:
    return F.zip_with(as_double(a), as_double(b), lambda x, y: x + y)


# The alphabet of the SQL-expressible default embedding.
LETTERS = "abcdefghijklmnopqrstuvwxyz"


def _count_letters(texts: pd.Series) -> pd.Series:
    """One pass per text: byte histogram, then a-z plus A-Z (ASCII bytes never occur inside
    multi-byte UTF-8 sequences, so byte counts are character counts)."""
    out = []
    for t in texts:
        b = np.bincount(np.frombuffer((t or "").encode("utf-8"), dtype=np.uint8), minlength=256)
        out.append((b[97:123] + b[65:91]).astype(np.float64))
    return pd.Series(out)


_COUNT_UDF = []


def _count_udf():
    if not _COUNT_UDF:  # created lazily: pandas_udf needs an active session
        _COUNT_UDF.append(F.pandas_udf(_count_letters, "array<double>"))
    return _COUNT_UDF[0]


def letter_counts(text) -> Column:
    """Per-letter counts (either case) as ``array<double>``.

    Built-in string functions need one pass per letter and case (52 passes over every
    text); the Arrow-batched helper does one pass per text.
    """
    return _count_udf()(_c(text))


def with_letter_profile(df, text: str, out: str, as_float: bool = True):
    """Default embedding: letter counts (one Arrow-batched pass), L2-normalised on the JVM side
    (norm computed once per row).

    Deterministic and exactly reproducible in SQL, so the refresh job can be checked
    against an oracle; a real model plugs in through ``embed_fn`` instead.
    """
    ship(df.sparkSession)
    tmp = f"_{out}_counts"
    df = with_unit(df.withColumn(tmp, letter_counts(text)), tmp, out).drop(tmp)
    return df.withColumn(out, F.col(out).cast("array<float>")) if as_float else df
