"""Quality rules as a bitmask ledger.

``ledger`` evaluates every rule once per document in a single scan: it stores the
measurements and one failure bit per rule. A policy is a versioned bit mask; ``apply_policy``
keeps a document when no failed bit is in the mask, so changing policy reads the ledger and never the
texts. ``ablations`` counts, by bitwise aggregation over the ledger, what each rule drops and
what would be kept without it.

Rules (bit: name: fails when): see ``RULES``; all compare integers, so there are no rounding ties.
Defined cases: null and empty texts have zero words, fail ``few_words`` and are dropped; every input row gives
one row; extra columns are ignored.
"""

from __future__ import annotations

from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

REPEAT_WINDOW = 5
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_chars", "n_adjacent")
#: (name, measurements -> failed); the position is the bit
RULES = (
    ("few_words", lambda m: m["n_words"] < 10),
    ("repeated_windows", lambda m: 100 * m["n_repeat_words"] > 20 * m["n_words"]),
    ("short_words", lambda m: m["word_chars"] < 2 * m["n_words"]),
    ("long_words", lambda m: m["word_chars"] > 14 * m["n_words"]),
    ("symbols", lambda m: 10 * m["n_symbols"] > m["n_words"]),
    ("duplicate_lines", lambda m: 100 * m["n_dup_lines"] > 60 * m["n_lines"]),
    ("upper_case", lambda m: 100 * m["n_upper"] > 40 * m["word_chars"]),
    ("repeated_words", lambda m: 100 * m["n_adjacent"] > 30 * m["n_words"]),
)
BIT = {name: 1 << k for k, (name, _) in enumerate(RULES)}
#: versioned policies: a document is kept when (failed & mask) = 0
POLICIES = {
    "v1": BIT["few_words"] | BIT["repeated_windows"],
    "v2": sum(BIT.values()),
}
CURRENT = "v2"

_SYMBOLS = b"#*$%&|<>"
_NOT_SYMBOL = bytes(set(range(256)) - set(_SYMBOLS))
_NOT_UPPER = bytes(set(range(256)) - set(range(0x41, 0x5B)))
_CONTINUATION = bytes(range(0x80, 0xC0))


def repeated_words(words: list[bytes], width: int = REPEAT_WINDOW) -> int:
    """Words inside windows of ``width`` words that occur twice or more, first ones included."""
    n = len(words)
    if n <= width:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n)
    m, key = n - width + 1, ids[:n - width + 1]
    for j in range(1, width):  # dense numbers of ever longer prefixes: exact, no hash collisions
        _, key = np.unique(key * (len(number) + 1) + ids[j:j + m], return_inverse=True)
    again = np.bincount(key)[key] > 1
    edge = np.zeros(n + 1, np.int64)
    edge[:m] += again
    edge[width:width + m] -= again
    return int((np.cumsum(edge[:n]) > 0).sum())


def measure(text: bytes | None) -> tuple[int, ...]:
    text = text or b""
    words = text.split()
    glued = b"".join(words)
    lines = [x for x in text.split(b"\n") if x.split(None, 1)]
    return (len(words), len(glued.translate(None, _CONTINUATION)), len(text.translate(None, _NOT_SYMBOL)),
            len(lines) - len(set(lines)), repeated_words(words), len(lines), len(glued.translate(None, _NOT_UPPER)),
            len(text.translate(None, _CONTINUATION)), sum(map(eq, words, words[1:])))


def ledger(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, the measurements, and ``failed``: bit k set when rule k fails."""
    C.ship(docs.sparkSession)
    base = C.texts(docs)
    schema = f"doc_id {dict(base.dtypes)['doc_id']}, " + ", ".join(f"{m} long" for m in MEASURES) + ", failed long"

    def scan(batches):
        for b in batches:
            rows = np.array([measure(t) for t in b.column(1).to_pylist()], np.int64).reshape(-1, len(MEASURES))
            m = dict(zip(MEASURES, rows.T, strict=True))
            failed = np.zeros(len(rows), np.int64)
            for k, (_, rule) in enumerate(RULES):
                failed |= rule(m).astype(np.int64) << k
            yield pa.RecordBatch.from_arrays([b.column(0), *map(pa.array, m.values()), pa.array(failed)],
                                             names=["doc_id", *MEASURES, "failed"])

    return base.mapInArrow(scan, schema)


def apply_policy(book: DataFrame, version: str = CURRENT) -> DataFrame:
    """The ledger with ``kept`` under a policy: a bitwise test, no text is read."""
    return book.withColumn("kept", F.col("failed").bitwiseAND(F.lit(POLICIES[version])) == 0)


def ablations(book: DataFrame, version: str = CURRENT) -> DataFrame:
    """One row per rule of the policy: failed, failed_alone, and kept documents without the rule.

    One aggregation over the ledger; its partial results are one row per task.
    """
    mask = POLICIES[version]
    held = F.col("failed").bitwiseAND(F.lit(mask))
    used = [(n, b) for n, b in BIT.items() if b & mask]
    sums = [F.count_if(held == 0).alias("kept")]
    for name, bit in used:
        sums += [F.count_if(held.bitwiseAND(F.lit(bit)) != 0).alias(f"any_{name}"),
                 F.count_if(held == bit).alias(f"alone_{name}")]
    rows = F.explode(F.array(*[F.struct(
        F.lit(name).alias("rule"), F.col(f"any_{name}").alias("failed"), F.col(f"alone_{name}").alias("failed_alone"),
        (F.col("kept") + F.col(f"alone_{name}")).alias("kept_without")) for name, _ in used]))
    return book.agg(*sums).select(rows.alias("r")).select("r.*")
