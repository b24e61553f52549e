"""Quality classifier by Bradley-Terry pairwise ranking.

Preference pairs (a document labelled good beats one labelled bad) are drawn from all labelled
training rows; the logistic loss on the feature difference of each pair,
log(1 + exp(-w.(x_good - x_bad))), is minimised by Adam. A document's ranking score is w.x.
The threshold is the quantile of all training scores at their share of bad labels; the
reported score is the logistic function of the distance to it, so 0.5 is the threshold.

The fit runs where the rows are: every labelled training row is dealt by the hash of its id to one of
rows / ``BLOCK_ROWS`` blocks, each block is fitted in a task, and the weights are the mean of the blocks'
weights by their rows (parameter averaging). Of a label so rare that blocks could miss it every row goes to several
blocks. Ranks, quantile and spread of the scores are exact, over every training row. Only labels and texts are read:
language, source and id are no features.

Defined cases: null and empty texts have the zero text's features and get a score; null labels are
no labels; repeated ids in the labels take the larger label, and every document of such an id is a row; without both labels every score is 0.5; every
input row gives one row; extra columns are ignored.
"""

from __future__ import annotations

import decimal
import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.common import dense_index
from ..session import release
from . import common as C

#: labelled rows fitted in one task
BLOCK_ROWS = 8_000
#: rows of either label that a block is to have; rows of a rarer one go to several blocks
RARE_ROWS = 64
#: texts or vectors that a worker turns into a float matrix at once
PART_ROWS = 256
WORD_BUCKETS = 512
PAIRS_PER_STEP = 2_048
STEPS = 300
FOLD = (3, 1)

_SYMBOLS = bytes(set(range(256)) - set(b"#*$%&|<>"))
_WIDTH = 256 + 14 + WORD_BUCKETS


def features(text: bytes | None) -> np.ndarray:
    """Byte shares (square roots), shape statistics and hashed words of one whole text."""
    text = text or b""
    x = np.zeros(_WIDTH, np.float32)
    words = text.split()
    n, size = len(words), len(text)
    if not size:
        x[256] = 1.0
        return x
    share = np.bincount(np.frombuffer(text, np.uint8), minlength=256) / size
    x[:256] = np.sqrt(share)
    lines = [v for v in text.split(b"\n") if v.strip()]
    kinds = set(words)
    x[257:270] = (
        np.log1p(n) / 10, min(1.0, 10 / (n + 1)), len(kinds) / (n + 1),
        sum(map(len, words)) / (n + 1) / 10, len(text.translate(None, _SYMBOLS)) / (n + 1),
        (len(lines) - len(set(lines))) / (len(lines) + 1), n / (len(lines) + 1) / 50,
        float(share[0x41:0x5B].sum()), float(share[0x30:0x3A].sum()), float(share[0x80:].sum()),
        min(2.0, len(zlib.compress(text, 1)) / size), text.count(b" | ") / (n + 1), text.count(b"!!") / (n + 1))
    low = text.lower().split()
    bucket = np.fromiter(map(xxhash.xxh32_intdigest, low), np.uint32, n) % WORD_BUCKETS
    x[270:] = np.sqrt(np.bincount(bucket, minlength=WORD_BUCKETS) / max(n, 1))
    return x


def fit(good: np.ndarray, bad: np.ndarray, steps: int = STEPS, pairs: int = PAIRS_PER_STEP,
        rate: float = 0.02, decay: float = 1e-4, seed: int = 7, counts: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
    """Weights that minimise the pairwise logistic loss over drawn (good, bad) pairs; ``counts``: how often each row occurs."""
    ends = [np.cumsum(c) for c in counts] if counts else [np.arange(1, len(x) + 1) for x in (good, bad)]

    def draw(x, end):
        rows = x[np.searchsorted(end, rng.integers(end[-1], size=pairs), side="right")]
        return rows.astype(np.promote_types(rows.dtype, np.float32), copy=False)  # half precision is for keeping, not for sums

    rng = np.random.default_rng(seed)
    w, m, v = (np.zeros(good.shape[1]) for _ in range(3))
    total = np.zeros_like(w)
    for t in range(1, steps + 1):
        d = (draw(good, ends[0]) - draw(bad, ends[1])).astype(np.float64, copy=False)
        d /= (1 + np.exp(np.clip(d @ w, -30, 30)))[:, None]
        g = -d.mean(0) + decay * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - rate * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.999 ** t)) + 1e-8)
        total += w * (t > steps // 2)
    return total / (steps - steps // 2)


class Ranker:
    """Fitted weights with the threshold; ``scale`` is the spread of the training scores."""

    def __init__(self, weights, threshold: float, scale: float):
        self.weights, self.threshold, self.scale = weights, threshold, scale

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip((x @ self.weights - self.threshold) * self.scale, -30, 30)))


def _vectors(batches):
    """Features of the texts of (k, y, text)."""
    for b in batches:
        for part in (b.slice(i, PART_ROWS) for i in range(0, b.num_rows, PART_ROWS)):
            x = [np.minimum(features(t), 6e4).astype(np.float16).tobytes() for t in part.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(x, pa.binary())], names=["k", "y", "x"])


def _halves(x) -> np.ndarray:
    """A column of vectors as one matrix, in half precision as they are stored; no second copy of the column on the way."""
    out = np.empty((len(x), _WIDTH), np.float16)
    for i in range(0, len(x), PART_ROWS):
        part = x.slice(i, PART_ROWS).to_pylist()
        out[i:i + len(part)] = np.frombuffer(b"".join(part), np.float16).reshape(-1, _WIDTH)
    return out


def _raw_scores(x, w: np.ndarray) -> np.ndarray:
    """Products of a column of vectors with the weights, a part at a time."""
    out = np.empty(len(x))
    for i in range(0, len(x), PART_ROWS):
        out[i:i + PART_ROWS] = _halves(x.slice(i, PART_ROWS)).astype(np.float32) @ w
    return out


def _fit_block(table: pa.Table) -> pa.Table:
    """Weights of one block, times its rows, as fixed-point numbers: their sum is the same in any order."""
    x, y, n = _halves(table.column("x")), table.column("y").to_numpy(), table.column("n").to_numpy()
    order = np.lexsort(x.view(np.uint16).T[::-1])  # rows in an order of their own, not the shuffle's; no feature is negative, so bits order as values
    good, bad = order[y[order] > 0], order[y[order] <= 0]
    if not len(good) or not len(bad):
        return pa.table({"i": pa.array([], pa.int32()), "v": pa.array([], pa.decimal128(38, 0))})
    sides = [x[good], x[bad]]
    del x
    w = fit(*sides, seed=7 + int(table.column("block")[0].as_py()), counts=(n[good], n[bad]))
    fixed = [decimal.Decimal(round(v * (1 << 40)) * int(n.sum())) for v in [*w.tolist(), 1.0]]
    return pa.table({"i": pa.array(range(len(fixed)), pa.int32()), "v": pa.array(fixed, pa.decimal128(38, 0))})


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", block_rows: int = BLOCK_ROWS,
          fold: tuple[int, int] | None = FOLD) -> Ranker:
    """Fit on every labelled row outside the held-out fold, in blocks of about ``block_rows`` rows."""
    C.ship(docs.sparkSession)
    known = labels.select(labels["doc_id"].alias("k"), labels[label].cast("int").alias("y")).where("k is not null and y is not null")
    if fold:
        known = known.where(~C.held_out(F.col("k"), *fold))
    known = known.groupBy("k").agg(F.max("y").alias("y"))
    if known.count() <= C.BROADCAST_ROWS:
        known = F.broadcast(known)
    base = C.texts(docs).where("doc_id is not null")
    if fold:
        base = base.where(~C.held_out(F.col("doc_id"), *fold))
    rows = C.stored(base.join(known, base["doc_id"] == known["k"]).select("k", "y", "text")
                    .mapInArrow(_vectors, f"k {dict(known.dtypes)['k']}, y int, x binary"), "ranking-rows")
    try:
        n, n_bad = rows.agg(F.count(F.lit(1)), F.count_if(F.col("y") <= 0)).first()
        if not n_bad or n_bad == n:
            return Ranker(np.zeros(_WIDTH), 0.0, 1.0)
        w = _weights(rows, n, n_bad, block_rows)
        return Ranker(w, *_threshold(rows, w, n, n_bad))
    finally:
        C.discard(rows)


def _weights(rows: DataFrame, n: int, n_bad: int, block_rows: int) -> np.ndarray:
    """Mean of the weights fitted on the blocks of ``rows(k, y, x)``, by the blocks' rows."""
    blocks = -(-n // block_rows)
    times = [min(blocks, -(-RARE_ROWS * blocks // m)) for m in (n - n_bad, n_bad)]  # blocks that a good and a bad row goes to
    copies = F.when(F.col("y") > 0, times[0]).otherwise(times[1])
    home = F.pmod(F.xxhash64("k"), F.lit(blocks))
    dealt = rows.select("y", "x", home.alias("home"), F.explode(F.sequence(F.lit(0), copies - 1)).alias("j"))
    # rows that repeat are one row with a count, so an id of very many rows fills no block
    dealt = dealt.select(F.pmod(F.col("home") + F.col("j"), F.lit(blocks)).alias("block"), "y", "x").groupBy("block", "y", "x").agg(F.count(F.lit(1)).alias("n"))
    sums = dealt.groupBy("block").applyInArrow(_fit_block, "i int, v decimal(38,0)").groupBy("i").agg(F.sum("v").alias("v")).collect()
    total = np.zeros(_WIDTH + 1)
    for r in sums:
        total[r["i"]] = float(r["v"])
    return total[:-1] / total[-1]


def _threshold(rows: DataFrame, w: np.ndarray, n: int, n_bad: int) -> tuple[float, float]:
    """Threshold and scale from the scores of all rows: the quantile at the share of bad ones, in the middle of the
    widest gap within two percent of that rank. Scores are ranked by Spark; the driver sees one gap."""

    def scan(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(_raw_scores(b.column(0), w), pa.float64())], names=["s"])

    s = C.stored(rows.select("x").mapInArrow(scan, "s double"), "ranking-scores")
    spread = s.agg(F.stddev_pop("s")).first()[0]
    slack = max(1, n // 50)
    a, b = max(1, n_bad - slack), min(n - 1, n_bad + slack)
    ranked = dense_index(s, ["s"])
    near = ranked.where(F.col("idx").between(a - 1, b))
    up = near.select((F.col("idx") - 1).alias("idx"), F.col("s").alias("t"))
    gap = near.join(up, "idx").agg(F.max(F.struct((F.col("t") - F.col("s")).alias("gap"), (-F.col("idx")).alias("first"), "s", "t")).alias("m")).first()["m"]
    release(ranked)
    C.discard(s)
    return (gap["s"] + gap["t"]) / 2, 4.0 / max(1e-6, float(spread))


def classify(docs: DataFrame, model: Ranker, fold: tuple[int, int] = FOLD) -> DataFrame:
    """Per row: doc_id, held_out, score, predicted."""
    base = C.texts(docs)
    base = base.withColumn("held_out", C.held_out(base["doc_id"], *fold))
    schema = f"doc_id {dict(base.dtypes)['doc_id']}, held_out boolean, score double, predicted int"

    def scan(batches):
        for b in batches:
            for part in (b.slice(i, PART_ROWS) for i in range(0, b.num_rows, PART_ROWS)):
                x = np.array([features(t) for t in part.column(1).to_pylist()]).reshape(-1, _WIDTH)
                s = model.scores(x)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(s), pa.array((s >= 0.5).astype(np.int32))],
                                                 names=["doc_id", "held_out", "score", "predicted"])

    return base.mapInArrow(scan, schema)


def keep_good(docs: DataFrame, model: Ranker) -> DataFrame:
    """``docs``, all columns kept, without the rows the model rejects; no shuffle."""
    at = docs.columns.index("text")

    def scan(batches):
        for b in batches:
            for part in (b.slice(i, PART_ROWS) for i in range(0, b.num_rows, PART_ROWS)):
                x = np.array([features(t) for t in part.column(at).cast(pa.binary()).to_pylist()]).reshape(-1, _WIDTH)
                yield part.filter(pa.array(model.scores(x) >= 0.5))

    return docs.mapInArrow(scan, docs.schema)
