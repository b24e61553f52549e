"""Language-model scoring by subword lattice likelihood.

The pieces and their scores come from an existing vocabulary file (the score gives each piece its starting
weight); the weights are re-estimated on the training words. A word's probability under the
lattice is the sum over *all* its segmentations into pieces, by a forward recursion in log
space over byte positions: a[j] = logsumexp over pieces ending at j of a[i] + log p(piece). Opening
pieces (with the word mark) and inner pieces have a distribution each; the inner one holds the end of the
word, so the lattice is a probability over all words. Single bytes are pieces: any word has a path.

Words seen in training also have an arc of their own through the whole word. With absolute discount D
(from the counts of counts), N training tokens and V distinct ones:

    P(word) = max(c - D, 0) / N + D * V / N * P_lattice(word)

which sums to one. Each class of the training documents (the values of the column ``classes``, their language; with more than
``n_classes`` of them the rarest share one) discounts its own counts in the same way and backs off to P. Within a
document words come in bursts, so its words follow the Dirichlet mixture around the class's P with
concentration ``alpha`` (a word seen k times in m words so far has (k + alpha * P) / (m + alpha)); the end token
comes with the class's own probability. The score is the log10 of the sum over the classes, weighted by
their share of training documents, and the classless model: a marginal over all paths and classes. A
scored document's own class is not read.

Scale: word counts are a partial aggregation and one shuffle. The lattice runs once per distinct
word, not per token. Weights are re-estimated by distributed expectation: each task sends the
expected counts of the pieces (bounded by the vocabulary). For scoring, the most frequent words
(at most ``HOT_WORDS``, a proven bound, found from the counts of counts) are broadcast and resolved inside
the scan; the others, none of them frequent, meet the word table in a shuffle join. No key of that
join is hot.

Defined cases: null and empty texts are the end token alone; rows that repeat (doc_id, text) give one row;
null ids are never held out; extra columns are ignored; empty tables give no rows; without any
training token all counts are zero (N = V = 0) and the lattice alone scores, with an end probability of a half;
null classes, and a table without the class column, train the classless model alone.
"""

from __future__ import annotations

import math
from collections import Counter
from itertools import compress, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

FOLD = (7, 2)
HOT_WORDS = 100_000
ROUNDS = 2
N_CLASSES = 8
ALPHA = 2_000.0
#: words of more bytes go through the lattice in segments of so many positions
LONG = 256
MARK = "▁"
#: the end token's name in the word table; holds a space, so no word equals it
END = " end"
_NEVER = -1e30


def read_vocabulary(path: str | None = None) -> tuple[list[bytes], np.ndarray, list[bytes], np.ndarray]:
    """Opening pieces, their scores, inner pieces, their scores, of a sentencepiece model file.

    Bytes are added to both. The file's scores are merge ranks (-0, -1, ...); a rank r stands for the
    Zipf weight 1 / (r + 1).
    """
    import sentencepiece

    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    m = sentencepiece.SentencePieceProcessor(model_file=path)
    opening, inner = {}, {}
    for i in range(m.vocab_size()):
        if m.is_control(i) or m.is_unknown(i) or m.is_byte(i):
            continue
        p = m.id_to_piece(i)
        side = opening if p.startswith(MARK) else inner
        p = p[1:] if p.startswith(MARK) else p
        if p and MARK not in p and p.encode().lower() == p.encode() and not p.isspace():
            side[p.encode()] = max(side.get(p.encode(), 0.0), 1.0 / (1.0 - m.get_score(i)))
    least = 1.0 / m.vocab_size()
    for side in (opening, inner):
        for c in range(256):
            side.setdefault(bytes([c]), least)
    pack = lambda d: (sorted(d), np.array([d[k] for k in sorted(d)]))
    return (*pack(opening), *pack(inner))


class Lattice:
    """Piece tables by length and their log weights; the last inner weight is the end of the word."""

    def __init__(self, opening: list[bytes], inner: list[bytes], log_open: np.ndarray, log_inner: np.ndarray):
        self.sides = []
        for pieces, logs in ((opening, log_open), (inner, log_inner)):
            tables = {}
            for n in sorted({len(p) for p in pieces}):
                at = np.array([i for i, p in enumerate(pieces) if len(p) == n])
                tables[n] = (self._codes(b"".join(pieces[i] for i in at), n), at)
            tables = {n: (c[np.argsort(c)], at[np.argsort(c)]) for n, (c, at) in tables.items()}
            self.sides.append((tables, logs))
        self.log_end = float(log_inner[-1])

    @staticmethod
    def _codes(data: bytes, n: int) -> np.ndarray:
        """One 64-bit number per ``n`` bytes (exact up to 8 bytes, hashed beyond)."""
        a = np.frombuffer(data, np.uint8).reshape(-1, n)
        return Lattice._fold(a)

    @staticmethod
    def _fold(a: np.ndarray) -> np.ndarray:
        out = np.zeros(len(a), np.uint64)
        odd = np.uint64(256 if a.shape[1] <= 8 else 0x9E3779B97F4A7C15)
        for j in range(a.shape[1]):
            out = out * odd + a[:, j]
        return out

    def arcs(self, block: np.ndarray):
        """(start, end, side, rows, piece numbers) of all pieces in words of one length (rows of bytes)."""
        width = block.shape[1]
        for i in range(width):
            side = 0 if i == 0 else 1
            for n, (codes, numbers) in self.sides[side][0].items():
                if i + n > width:
                    break
                c = self._fold(block[:, i:i + n])
                at = np.minimum(np.searchsorted(codes, c), len(codes) - 1)
                rows = np.flatnonzero(codes[at] == c)
                if len(rows):
                    yield i, i + n, side, rows, numbers[at[rows]]

    def forward(self, block: np.ndarray, arcs: list) -> np.ndarray:
        """Log-space forward values, (words, positions + 1)."""
        a = np.full((len(block), block.shape[1] + 1), _NEVER)
        a[:, 0] = 0.0
        for i, j, side, rows, numbers in arcs:  # arcs come by start, so a[:, i] is final
            a[rows, j] = np.logaddexp(a[rows, j], a[rows, i] + self.sides[side][1][numbers])
        return a

    def backward(self, block: np.ndarray, arcs: list) -> np.ndarray:
        b = np.full((len(block), block.shape[1] + 1), _NEVER)
        b[:, -1] = self.log_end
        for i, j, side, rows, numbers in reversed(arcs):
            b[rows, i] = np.logaddexp(b[rows, i], b[rows, j] + self.sides[side][1][numbers])
        return b

    def blocks(self, words: list[bytes]):
        """(indices, byte rows) of words of one length, at most 2^18 bytes a block."""
        by: dict[int, list[int]] = {}
        for k, w in enumerate(words):
            by.setdefault(len(w), []).append(k)
        for n, at in sorted(by.items()):
            step = max(1, (1 << 18) // max(n, 1))
            for s in range(0, len(at), step):
                part = at[s:s + step]
                yield np.array(part), np.frombuffer(b"".join(words[k] for k in part), np.uint8).reshape(len(part), n)

    def log_probability(self, words: list[bytes]) -> np.ndarray:
        """Natural log of the sum over all segmentations of each word."""
        out = np.empty(len(words))
        for at, block in self.blocks(words):
            if block.shape[1] <= LONG:
                out[at] = self.forward(block, list(self.arcs(block)))[:, -1] + self.log_end
            else:  # a very long word: the same recursion with a sliding frontier, constant memory per step
                a = {0: np.zeros(len(block))}
                width = block.shape[1]
                for i, j, side, rows, numbers in self.arcs(block):
                    for k in [k for k in a if k < i]:
                        del a[k]
                    to = a.setdefault(j, np.full(len(block), _NEVER))
                    to[rows] = np.logaddexp(to[rows], a[i][rows] + self.sides[side][1][numbers])
                out[at] = a[width] + self.log_end
        return out

    def expected(self, words: list[bytes], sizes: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
        """Expected piece counts (opening; inner with the end last) over words, each counted once."""
        total = (np.zeros(sizes[0]), np.zeros(sizes[1]))
        for w in words:
            if len(w) > LONG:
                self._expected_long(w, total)
        for _, block in self.blocks([w for w in words if len(w) <= LONG]):
            arcs = list(self.arcs(block))
            a, b = self.forward(block, arcs), self.backward(block, arcs)
            z = a[:, -1] + self.log_end
            for i, j, side, rows, numbers in arcs:
                p = np.exp(a[rows, i] + self.sides[side][1][numbers] + b[rows, j] - z[rows])
                total[side][:] += np.bincount(numbers, weights=p, minlength=sizes[side])
            total[1][-1] += len(block)
        return total


    def _long_arcs(self, data: np.ndarray, lo: int, hi: int) -> list[list[tuple[int, int, int]]]:
        """(end, side, piece number) of the pieces starting at each position of ``lo``..``hi`` in one word."""
        out = [[] for _ in range(hi - lo)]
        for side, a, b in ((0, lo, min(hi, 1)), (1, max(lo, 1), hi)):
            for n, (codes, numbers) in self.sides[side][0].items():
                last = min(b, len(data) - n + 1)
                if a >= last:
                    continue
                c = self._fold(np.lib.stride_tricks.sliding_window_view(data[a:last + n - 1], n))
                at = np.minimum(np.searchsorted(codes, c), len(codes) - 1)
                for k in np.flatnonzero(codes[at] == c).tolist():
                    out[a + k - lo].append((a + k + n, side, int(numbers[at[k]])))
        return out

    def _expected_long(self, word: bytes, total: tuple[np.ndarray, np.ndarray]) -> None:
        """Adds one word's expected counts to ``total``, in segments of ``LONG`` positions.

        Forward keeps the frontier at each segment's start (as many values as the longest piece has bytes);
        backward goes from the last segment to the first and repeats the forward values inside it. So arcs and
        values are held for one segment at a time.
        """
        data, width, logs = np.frombuffer(word, np.uint8), len(word), [g.tolist() for g in (self.sides[0][1], self.sides[1][1])]

        def add(x, y):
            x, y = (x, y) if x >= y else (y, x)
            return x + math.log1p(math.exp(y - x))

        def forward(a, arcs, lo):
            for i, here in enumerate(arcs, lo):
                at = a[i]
                for j, side, k in here:
                    v = at + logs[side][k]
                    a[j] = add(a[j], v) if j in a else v
            return a

        longest = max(n for tables, _ in self.sides for n in tables)
        starts, frontiers, a = range(0, width, LONG), [], {0: 0.0}
        for lo in starts:
            frontiers.append(a)
            hi = min(lo + LONG, width)
            a = {j: v for j, v in forward(dict(a), self._long_arcs(data, lo, hi), lo).items() if j >= hi}
        z, b = a[width] + self.log_end, {width: self.log_end}
        for lo, a in zip(reversed(starts), reversed(frontiers), strict=True):
            hi = min(lo + LONG, width)
            arcs = self._long_arcs(data, lo, hi)
            a = forward(dict(a), arcs, lo)
            sides, numbers, p = [], [], []
            for i in range(hi - 1, lo - 1, -1):
                value = None
                for j, side, k in arcs[i - lo]:
                    v = logs[side][k] + b[j]
                    value = v if value is None else add(value, v)
                    sides.append(side)
                    numbers.append(k)
                    p.append(math.exp(a[i] + v - z))
                b[i] = value
            sides, numbers, p = np.array(sides), np.array(numbers), np.array(p)
            for side in (0, 1):
                total[side][:] += np.bincount(numbers[sides == side], weights=p[sides == side], minlength=len(total[side]))
            b = {j: v for j, v in b.items() if j <= lo + longest}
        total[1][-1] += 1


class Model:
    """Vocabulary and log weights; ``fit`` re-estimates them on a frame of distinct words."""

    def __init__(self, path: str | None = None):
        self.opening, w_open, self.inner, w_inner = read_vocabulary(path)
        # half of the words' inner decisions end the word, to begin with
        self.logs = [np.log(w_open / w_open.sum()), np.log(np.append(w_inner / w_inner.sum() / 2, 0.5))]

    def lattice(self) -> Lattice:
        return Lattice(self.opening, self.inner, *self.logs)

    def fit(self, spark: SparkSession, words: DataFrame, rounds: int = ROUNDS, floor: float = 0.01) -> Model:
        """Expectation over all rows of ``words(word)``, maximisation on the driver (vocabulary-sized)."""
        sizes = tuple(map(len, self.logs))
        for _ in range(rounds):
            shared = spark.sparkContext.broadcast((self.opening, self.inner, self.logs))

            def expect(batches):
                opening, inner, logs = shared.value
                lattice, total = Lattice(opening, inner, *logs), (np.zeros(sizes[0]), np.zeros(sizes[1]))
                for b in batches:
                    for t, e in zip(total, lattice.expected(b.column(0).cast(pa.binary()).to_pylist(), sizes), strict=True):
                        t[:] += e
                for side, t in enumerate(total):
                    at = np.flatnonzero(t)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), side, np.int32)), pa.array(at.astype(np.int32)),
                                                      pa.array(t[at])], names=["side", "piece", "n"])

            got = (words.select("word").mapInArrow(expect, "side int, piece int, n double")
                   .groupBy("side", "piece").agg(F.sum("n").alias("n")).collect())
            counts = [np.zeros(n) for n in sizes]
            for r in got:
                counts[r["side"]][r["piece"]] = round(r["n"], 6)
            # every piece keeps a little of its former weight, so none vanishes
            mixed = [c + floor * max(1.0, c.sum()) * np.exp(g) for c, g in zip(counts, self.logs, strict=True)]
            self.logs = [np.log(m / m.sum()) for m in mixed]
            shared.unpersist()
        return self


def log_gamma(z: np.ndarray) -> np.ndarray:
    """ln Gamma(z) for z >= 1, by Stirling's series at z + 8."""
    y = z + 8.0
    series = (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y ** 3) + 1 / (1260 * y ** 5) - 1 / (1680 * y ** 7)
    return series - sum(np.log(z + k) for k in range(8))


def log_rising(x: np.ndarray, k: np.ndarray, direct: int = 8) -> np.ndarray:
    """ln of (x + 1) (x + 2) ... (x + k - 1) for every row of ``x`` and its k >= 1.

    Up to ``direct`` factors are multiplied and logged once (x < 1e30 keeps the product finite);
    the factors beyond are a difference of two ln Gamma.
    """
    product, at = np.ones_like(x), np.arange(len(k))
    for m in range(1, direct + 1):
        at = at[k[at] > m]
        if not len(at):
            break
        product[at] *= m + x[at]
    out = np.log(product)
    far = np.flatnonzero(k > direct + 1)
    if len(far):
        out[far] += log_gamma(k[far, None] + x[far]) - log_gamma(direct + 1 + x[far])
    return out


def _strings(words: list[bytes]) -> pa.Array:
    try:
        return pa.array(words, pa.binary()).cast(pa.string())
    except pa.ArrowInvalid:  # a text that is no UTF-8
        return pa.array([w.decode("utf-8", "replace") for w in words], pa.string())


def count_words(docs: DataFrame, classes: int = 0) -> DataFrame:
    """word, c (rows with ``train``), c_0.. (those of each class); the end token is a row named ``END``.

    ``docs``: doc_id, text (bytes), train, class (null or 0..classes-1). Tasks count in memory and
    send partial counts.
    """

    def scan(batches):
        for b in batches:
            seen: dict[tuple, Counter] = {}
            size = 0
            for t, train, kind in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                words = t.lower().split() if t else []
                part = seen.setdefault((bool(train), -1 if kind is None else kind), Counter())
                part.update(words)
                part[END.encode()] += 1
                size += len(words)
                if size > 2_000_000:
                    yield from out(seen)
                    seen, size = {}, 0
            yield from out(seen)

    def out(seen):
        for (train, kind), c in seen.items():
            n = pa.array(list(c.values()), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [_strings(list(c)), pa.array(np.full(len(c), kind, np.int32)),
                 n if train else pa.array(np.zeros(len(c), np.int64))], names=["word", "kind", "c"])

    each = [F.sum(F.when(F.col("kind") == j, F.col("c")).otherwise(0)).alias(f"c_{j}") for j in range(classes)]
    return (docs.select("text", "train", "class").mapInArrow(scan, "word string, kind int, c long")
            .groupBy("word").agg(F.sum("c").alias("c"), *each))


def _with_class(base: DataFrame, n_classes: int = N_CLASSES) -> tuple[DataFrame, int]:
    """``base`` with class, and the number of classes: every training value has a class of its own, or, where there are more
    than ``n_classes`` values, the most frequent ``n_classes - 1`` have one each and all others share the last."""
    top = (base.where(F.col("train") & F.col("value").isNotNull()).groupBy("value").agg(F.count(F.lit(1)).alias("n"))
           .orderBy(F.desc("n"), "value").limit(n_classes + 1).collect())
    more = len(top) > n_classes
    named = top[:n_classes - 1] if more else top
    place = F.when(F.col("value").isNotNull(), F.lit(n_classes - 1)) if more else F.lit(None).cast("int")
    for j, r in enumerate(named):
        place = F.when(F.col("value") == F.lit(r["value"]), F.lit(j)).otherwise(place)
    return base.withColumn("class", place), min(len(top), n_classes)


class Smoothed:
    """Absolute discounting of the counts, over all training words (last) and in each class."""

    def __init__(self, totals: list[tuple[int, int, int, int]], ends: list[int]):
        self.totals = totals
        self.discounts = [min(0.95, max(0.05, n1 / (n1 + 2 * n2))) if n1 else 0.5 for _, _, n1, n2 in totals]
        n, _, _, _ = totals[-1]
        whole = max(ends[-1] - self.discounts[-1], 0) / n if n else 0.5
        self.ends = [(max(c - d, 0) + d * v * whole) / n for c, d, (n, v, _, _) in zip(ends[:-1], self.discounts, totals, strict=False)]
        self.ends = np.array([*self.ends, whole]).clip(1e-12, 1 - 1e-12)
        weights = np.array([*ends[:-1], 1], float)
        self.log_weights = np.log(weights / weights.sum())

    def log_words(self, counts: list[np.ndarray], spelled: np.ndarray) -> list[np.ndarray]:
        """ln P(word | it is no end) in each class and overall; ``spelled``: ln of the lattice's probability."""

        def mixed(j, back):
            (n, v, _, _), d = self.totals[j], self.discounts[j]
            if not n:
                return back
            with np.errstate(divide="ignore"):
                return np.logaddexp(np.log(np.maximum(counts[j] - d, 0) / n), math.log(d * v / n) + back)

        whole = mixed(-1, spelled)
        every = [mixed(j, whole) for j in range(len(counts) - 1)] + [whole]
        return [p - math.log1p(-e) if self.totals[-1][0] else p for p, e in zip(every, self.ends, strict=True)]


def score(docs: DataFrame, fold: tuple[int, int] = FOLD, vocabulary: str | None = None, rounds: int = ROUNDS,
          hot_words: int = HOT_WORDS, classes: str | None = "lang", alpha: float = ALPHA, n_classes: int = N_CLASSES) -> DataFrame:
    """Per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark = docs.sparkSession
    C.ship(spark)
    kind = dict(docs.dtypes)["doc_id"]
    value = docs[classes].cast("string") if classes in docs.columns else F.lit(None).cast("string")
    base = docs.select(docs["doc_id"], docs["text"].cast("binary").alias("text"), value.alias("value"))
    base = base.withColumn("held_out", C.held_out(base["doc_id"], *fold)).withColumn("train", ~F.col("held_out"))
    base, n_classes = _with_class(base, n_classes)
    counts = C.stored(count_words(base, n_classes), "words")
    one = F.lit(1)
    cs = [*(f"c_{j}" for j in range(n_classes)), "c"]
    figures = [f for c in cs for f in (F.sum(c), F.count_if(F.col(c) > 0), F.count_if(F.col(c) == 1), F.count_if(F.col(c) == 2))]
    totals = [int(x or 0) for x in counts.agg(*figures).first()]
    totals = [tuple(totals[i:i + 4]) for i in range(0, len(totals), 4)]
    end = counts.where(F.col("word") == END).select(*cs).first()
    ends = [int(x) for x in end] if end else [0] * len(cs)
    n, v, _, _ = totals[-1]
    smooth = Smoothed(totals, ends)
    model = Model(vocabulary).fit(spark, counts.where((F.col("c") > 0) & (F.col("word") != END)), rounds)
    shared = spark.sparkContext.broadcast((model.opening, model.inner, model.logs))
    ps = [f"p_{j}" for j in range(len(cs))]

    def price(batches):
        lattice = Lattice(*shared.value[:2], *shared.value[2])
        for b in batches:
            got = [b.column(i).to_numpy(zero_copy_only=False) for i in range(1, 1 + len(cs))]
            logs = smooth.log_words(got, lattice.log_probability([w.encode() for w in b.column(0).to_pylist()]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(got[-1]), pa.array(np.log10((got[-1] + 1) / (n + v + 1))), *map(pa.array, logs)],
                                             names=["word", "c", "base", *ps])

    priced = C.stored(counts.where(F.col("word") != END).select("word", *cs)
                      .mapInArrow(price, "word string, c long, base double" + "".join(f", {p} double" for p in ps)), "priced")
    # the smallest count with at most hot_words words above it, from the counts of counts by eighth powers of two
    step = F.floor(8 * F.log2(F.greatest("c", one))).cast("int")
    above, least = 0, None
    for r in priced.groupBy(step.alias("s")).agg(F.count(one).alias("k"), F.min("c").alias("m")).orderBy(F.desc("s")).collect():
        if r["s"] == 0 or above + r["k"] > hot_words:
            break
        above, least = above + r["k"], r["m"]
    frequent = (F.col("c") >= least) if least else F.lit(False)
    hot = priced.where(frequent).toArrow()
    column = lambda c: hot.column(c).to_numpy()
    table = spark.sparkContext.broadcast(({w.encode(): i for i, w in enumerate(hot.column("word").to_pylist())}, column("c") > 0,
                                          column("base"), np.column_stack([column(p) for p in ps])))
    end_base, end_known = math.log10((ends[-1] + 1) / (n + v + 1)), int(ends[-1] > 0)
    log_alpha, sums = math.log(alpha), [f"s_{j}" for j in range(len(ps))]

    schema = (f"doc_id {kind}, text_hash long, word string, k long, held_out boolean, n_tokens long, n_known long, base_score double"
              + "".join(f", {x} double" for x in sums))
    names = [f.split()[0] for f in schema.split(", ")]

    def look(batches):
        place, known, base10, logs = table.value
        start, expected = log_gamma(np.array([alpha]))[0], alpha * np.exp(logs)

        def figures_of(held):
            """Own figures of some documents: places and counts of the frequent words, number of all words."""
            at, ks = (np.concatenate([h[i] for h in held]) for i in (0, 1))
            size = np.array([n for _, _, n in held], float)
            row = np.repeat(np.arange(len(held)), [len(h[0]) for h in held])
            add = lambda w: np.bincount(row, weights=w, minlength=len(held))
            logged, more = log_alpha + logs[at], np.flatnonzero(ks > 1)
            logged[more] += log_rising(expected[at[more]], ks[more])
            # the words' rising factorials over alpha's, and the end
            fixed = start - log_gamma(size + alpha)
            totals = [add(w) + fixed + size * math.log1p(-e) + math.log(e) for w, e in zip(logged.T, smooth.ends.tolist(), strict=True)]
            return zip((size + 1).astype(np.int64).tolist(), (add(ks * known[at]).astype(np.int64) + end_known).tolist(),
                       (add(ks * base10[at]) + end_base).tolist(), *(t.tolist() for t in totals), strict=True)

        for whole in batches:
            for b in (whole.slice(i, 256) for i in range(0, whole.num_rows, 256)):
                own, rare, owner, times, held = [], [], [], [], []
                for row, t in enumerate(b.column(1).to_pylist()):
                    words = Counter(t.lower().split() if t else ())
                    at = np.fromiter(map(place.get, words, repeat(-1)), np.int64, len(words))
                    ks = np.fromiter(words.values(), np.int64, len(words))
                    size, new = int(ks.sum()), at < 0
                    if new.any():
                        rare += compress(words, new.tolist())
                        times.append(ks[new])
                        owner.append(np.full(len(times[-1]), row))
                        at, ks = at[~new], ks[~new]
                    held.append((at, ks, size))
                    if sum(len(h[0]) for h in held) > 50_000 or row + 1 == b.num_rows:
                        own += figures_of(held)
                        held = []
                # the document's own row: its "word" holds a space and its hash, so it joins with nothing
                hashes = [f"{END} {h}" for h in b.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(hashes, pa.string()), pa.array([0] * len(own), pa.int64()), b.column(3),
                                                  *(pa.array(c, t) for c, t in zip(zip(*own, strict=True), types, strict=True))], names=names)
                if rare:
                    at = pa.array(np.concatenate(owner))
                    yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(2).take(at), _strings(rare), pa.array(np.concatenate(times)),
                                                      pa.nulls(len(rare), pa.bool_()), *(pa.nulls(len(rare), t) for t in types)], names=names)

    types = [pa.int64(), pa.int64(), *[pa.float64()] * (1 + len(sums))]
    parts = base.select("doc_id", "text", F.xxhash64("text").alias("text_hash"), "held_out").mapInArrow(look, schema)
    rare = priced.where(~frequent).select(F.col("word").alias("w"), "c", "base", *ps)
    each = parts.join(rare, parts["word"] == rare["w"], "left")
    copies = F.count_if(F.col("n_tokens").isNotNull())
    whole = lambda c: F.floor(F.sum(c) / copies).cast("long")
    k = F.col("k")

    def burst(p):
        """ln of the rising factorial of alpha * P over k occurrences."""
        x = F.lit(alpha) * F.exp(p)
        again = F.aggregate(F.sequence(F.lit(1).cast("long"), k - 1), F.lit(0.0), lambda s, m: s + F.log(m + x))
        return F.lit(log_alpha) + F.col(p) + F.when(k > 1, again).otherwise(0.0)

    got = each.groupBy("doc_id", "text_hash").agg(
        F.max("held_out").alias("held_out"), F.max("n_tokens").alias("n_tokens"),
        whole(F.coalesce("n_known", F.when(F.col("c") > 0, k), F.lit(0))).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.sum(F.coalesce("base_score", F.col("base") * k)) / copies).alias("base_score"),
        *((F.sum(F.when(F.col("n_tokens").isNotNull(), F.col(s)).otherwise(burst(p))) / copies).alias(s) for s, p in zip(sums, ps, strict=True)))
    weighted = [F.col(s) + F.lit(float(w)) for s, w in zip(sums, smooth.log_weights, strict=True)]
    top = F.array_max(F.array(*weighted))
    total = top + F.log(sum((F.exp(w - top) for w in weighted), F.lit(0.0)))
    return got.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", (total / math.log(10)).alias("score"))
