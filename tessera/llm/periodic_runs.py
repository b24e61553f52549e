"""Periodic runs of words by internal pattern matching.

A run is a stretch of words with smallest period q that no neighbouring word extends and whose length is at
least ``max(6, 4 q)``. All runs of every document are found, exactly, in one scan without a shuffle.

1. Stretches. Every word of a run occurs at least four times within it, so words that occur less often cut the
   document into stretches; each is counted again until nothing changes. Nothing else can hold a run.
2. The stretches of many documents are numbered (a word of another stretch is another number) and indexed
   together: prefix doubling gives the rank of every block of 2^k words, the suffix array, and the
   suffix-array interval of every dyadic block.
3. Internal pattern matching. A run with 2^k <= q < 2^(k+1) holds, in its first 2 q words, a block of 2^k
   words that starts at a multiple of 2^k; the block occurs again q words later. So each dyadic block s asks for its first
   three occurrences in the window [s + 2^k, s + 2^(k+1)): range successors in the block's suffix-array interval,
   answered by a wavelet tree over the suffix array.
4. Candidate periods. One or two occurrences: their distances from s. Three or more form an arithmetic
   progression whose difference d is the block's own period; the stretch of period d around s must end q words before the
   one around the progression does, which leaves one candidate (were both one stretch, q would not be the smallest period).
5. A candidate is extended both ways by the block ranks (longest common extension). Of equal stretches the smallest period stays.

Work per document is O(n log n); memory is about 250 bytes per word of the stretches indexed together (``FLUSH`` words,
or one longer document). Very long texts are one document in one task, never cut.

Defined cases: null, empty and white texts have no words and no runs (nulls, the hash of the empty string); ties of
the best run go to the smallest start, then period; repeated rows give one row each; a null doc_id is kept; extra
columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import common as C

LEAST = 6
POWER = 4
FLUSH = 1 << 17


def numbers(words: list[bytes]) -> np.ndarray:
    known: dict[bytes, int] = {}
    return np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))


def stretches(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions whose words occur ``POWER`` times or more in their stretch, and the number of each one's stretch."""
    at = np.flatnonzero(np.bincount(ids)[ids] >= POWER) if len(ids) else np.empty(0, np.int64)
    group = np.zeros(len(at), np.int64)
    while len(at):
        new = np.empty(len(at), bool)
        new[0] = True
        new[1:] = (np.diff(at) > 1) | (np.diff(group) > 0)
        group = np.cumsum(new) - 1
        long = np.bincount(group)[group] >= LEAST
        at, group = at[long], group[long]
        _, name, count = np.unique(group * (int(ids.max()) + 1) + ids[at], return_inverse=True, return_counts=True)
        often = count[name] >= POWER
        if often.all():
            break
        at, group = at[often], group[often]
    return at, group


class Wavelet:
    """Wavelet tree (matrix form) over a permutation: order statistics of its ranges."""

    def __init__(self, values: np.ndarray):
        self.bits = max(1, int(len(values) - 1).bit_length())
        self.ones, self.zeros = [], []
        for b in range(self.bits - 1, -1, -1):
            bit = (values >> b) & 1
            ones = np.zeros(len(values) + 1, np.int32)
            np.cumsum(bit, out=ones[1:])
            self.ones.append(ones)
            self.zeros.append(len(values) - int(ones[-1]))
            values = np.concatenate([values[bit == 0], values[bit == 1]])

    def less(self, lo: np.ndarray, hi: np.ndarray, v: np.ndarray) -> np.ndarray:
        """Number of values below ``v`` in [lo, hi)."""
        n = np.where(v >> self.bits > 0, hi - lo, 0)
        live = v >> self.bits == 0
        for level in range(self.bits):
            ones, zeros = self.ones[level], self.zeros[level]
            a, b = ones[lo].astype(np.int64), ones[hi].astype(np.int64)
            up = (v >> (self.bits - 1 - level)) & 1 == 1
            n += np.where(up & live, (hi - b) - (lo - a), 0)
            lo, hi = np.where(up, zeros + a, lo - a), np.where(up, zeros + b, hi - b)
        return n

    def smallest(self, lo: np.ndarray, hi: np.ndarray, k: np.ndarray) -> np.ndarray:
        """The value with ``k`` smaller ones in [lo, hi); k < hi - lo."""
        out = np.zeros(len(lo), np.int64)
        for level in range(self.bits):
            ones, zeros = self.ones[level], self.zeros[level]
            a, b = ones[lo].astype(np.int64), ones[hi].astype(np.int64)
            small = (hi - b) - (lo - a)
            up = k >= small
            k = np.where(up, k - small, k)
            lo, hi = np.where(up, zeros + a, lo - a), np.where(up, zeros + b, hi - b)
            out = out << 1 | up
        return out

    def successors(self, lo: np.ndarray, hi: np.ndarray, v: np.ndarray, n: int) -> list[np.ndarray]:
        """The ``n`` smallest values from ``v`` on in each range; where there are fewer, a value beyond all."""
        first, out = self.less(lo, hi, v), []
        for j in range(n):
            there = first + j < hi - lo
            out.append(np.where(there, self.smallest(lo, hi, np.where(there, first + j, 0)), np.int64(1) << 62))
        return out


class Blocks:
    """Ranks of all blocks of 2^k words, the suffix array, and the interval of every dyadic block."""

    def __init__(self, x: np.ndarray):
        n = len(x)
        self.n, self.ranks, self.queries = n, [], []
        key, k = x.astype(np.int64), 0
        while True:
            order = np.argsort(key)
            heads = np.empty(n, bool)
            heads[0] = True
            sorted_key = key[order]
            heads[1:] = sorted_key[1:] != sorted_key[:-1]
            first = np.flatnonzero(heads)
            size = np.diff(np.append(first, n))
            rank = np.empty(n, np.int32)
            rank[order] = np.repeat(first, size)
            self.ranks.append(rank)
            s = np.arange(0, n, 1 << k)
            lo = rank[s].astype(np.int64)
            count = size[np.searchsorted(first, lo)]
            few = count >= POWER - 1  # a block within a run occurs at least so often
            if few.any():
                self.queries.append((np.full(few.sum(), k, np.int64), s[few], lo[few], (lo + count)[few]))
            if size.max() < POWER - 1 or 2 << k > n:
                self.order = order
                return
            after = np.zeros(n, np.int64)
            after[:n - (1 << k)] = rank[1 << k:].astype(np.int64) + 1
            key, k = rank.astype(np.int64) * (n + 1) + after, k + 1

    def forward(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Words from a and from b on (a < b) that are equal."""
        n, k = np.zeros(len(a), np.int64), len(self.ranks) - 1
        while k >= 0:
            ok = b + n < self.n
            end = self.n - 1
            ok &= self.ranks[k][np.minimum(a + n, end)] == self.ranks[k][np.minimum(b + n, end)]
            n += ok.astype(np.int64) << k
            if k < len(self.ranks) - 1 or not ok.any():  # blocks of the largest size may follow one another
                k -= 1
        return n

    def backward(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Words before a and before b (a < b) that are equal."""
        n, k = np.zeros(len(a), np.int64), len(self.ranks) - 1
        while k >= 0:
            p = a - n - (1 << k)
            q = np.maximum(p, 0)
            ok = (p >= 0) & (self.ranks[k][q] == self.ranks[k][q + (b - a)])
            n += ok.astype(np.int64) << k
            if k < len(self.ranks) - 1 or not ok.any():
                k -= 1
        return n


def find_runs(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, period) of all runs of a sequence of numbers."""
    none = np.empty(0, np.int64)
    if len(x) < LEAST:
        return none, none, none
    index = Blocks(x)
    if not index.queries:
        return none, none, none
    k, s, lo, hi = (np.concatenate(c) for c in zip(*index.queries, strict=True))
    m = np.int64(1) << k
    one, two, three = Wavelet(index.order).successors(lo, hi, s + m, 3)
    far = s + 2 * m
    single = one < far
    pair = two < far
    many = three < far
    p = np.flatnonzero(many)
    d = two[p] - one[p]
    period = (one[p] + index.forward(one[p], one[p] + d)) - (s[p] + index.forward(s[p], s[p] + d))
    fit = (period >= m[p]) & (period < 2 * m[p])
    a, b = np.flatnonzero(single & ~many), np.flatnonzero(pair & ~many)
    at = np.concatenate([s[a], s[b], s[p][fit]])
    q = np.concatenate([one[a] - s[a], two[b] - s[b], period[fit]])
    inside = at + q < len(x)
    at, q = at[inside], q[inside]
    end = at + q + index.forward(at, at + q)
    start = at - index.backward(at, at + q)
    run = end - start >= np.maximum(LEAST, POWER * q)
    start, end, q = start[run], end[run], q[run]
    order = np.lexsort((q, end, start))
    start, end, q = start[order], end[order], q[order]
    least = np.ones(len(q), bool)
    least[1:] = (start[1:] != start[:-1]) | (end[1:] != end[:-1])
    return start[least], end[least], q[least]


def runs_together(parts: list[np.ndarray]) -> list[list[tuple[int, int, int]]]:
    """Runs (start, length, period) of each of several sequences, indexed together."""
    pos, name, owner, base = [], [], [], 0
    for i, ids in enumerate(parts):
        at, group = stretches(ids)
        if len(at):
            pos.append(at)
            owner.append(np.full(len(at), i, np.int64))
            _, number = np.unique(group * (int(ids.max()) + 1) + ids[at], return_inverse=True)
            name.append(number + base)
            base += int(number.max()) + 1
    out: list[list[tuple[int, int, int]]] = [[] for _ in parts]
    if pos:
        pos, owner = np.concatenate(pos), np.concatenate(owner)
        start, end, q = find_runs(np.concatenate(name))
        for i, a, n, p in zip(owner[start].tolist(), pos[start].tolist(), (end - start).tolist(), q.tolist(), strict=True):
            out[i].append((a, n, p))
        for found in out:
            found.sort(key=lambda r: (r[0], r[2]))
    return out


def report(words: list[bytes], runs: list[tuple[int, int, int]]) -> tuple:
    """n_runs, best run (start, length, period, exponent_milli) and the two digests; ``runs`` in order."""
    listed = hashlib.sha256("".join(f"{a},{n},{p}\n" for a, n, p in runs).encode()).hexdigest()
    if not runs:
        return (0, None, None, None, None, listed, hashlib.sha256(b" ".join(words)).hexdigest())
    gone = np.zeros(len(words) + 1, np.int64)
    for a, n, p in runs:
        gone[a + p] += 1
        gone[a + n] -= 1
    kept = [w for w, g in zip(words, np.cumsum(gone[:-1]).tolist(), strict=True) if not g]
    a, n, p = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]))
    return (len(runs), a, n, p, 1000 * n // p, listed, hashlib.sha256(b" ".join(kept)).hexdigest())


SCHEMA = "n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def periodic_runs(docs: DataFrame, rewrite: Callable[[object, list[bytes]], list[bytes]] | None = None, flush: int = FLUSH,
                  with_runs: bool = False) -> DataFrame:
    """Per row: doc_id and ``SCHEMA``; with ``with_runs`` also all runs (start, length, period).

    ``rewrite``: maps (doc_id, words) to the words to look at; without it, the text's own.
    """
    C.ship(docs.sparkSession)
    base = C.texts(docs)
    schema = f"doc_id {dict(base.dtypes)['doc_id']}, {SCHEMA}" + ", runs array<struct<start:long,length:long,period:long>>" * with_runs
    kinds = [pa.int64()] * 5 + [pa.string()] * 2
    if with_runs:
        kinds.append(pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])))
    names = [c.split()[0] for c in SCHEMA.split(", ")] + ["runs"] * with_runs

    def scan(batches):
        for b in batches:
            rows: list = [None] * b.num_rows
            held: list = []
            size = 0

            def settle():
                for (row, words, _), runs in zip(held, runs_together([h[2] for h in held]), strict=True):
                    rows[row] = report(words, runs) + ((runs,) if with_runs else ())
                held.clear()

            for row, (i, t) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)):
                words = t.split() if t else []
                if rewrite is not None:
                    words = rewrite(i, words)
                held.append((row, words, numbers(words)))
                size += len(words)
                if size >= flush:
                    settle()
                    size = 0
            settle()
            cols = list(zip(*rows, strict=True)) or [()] * len(kinds)
            if with_runs:
                cols[-1] = [[dict(zip(("start", "length", "period"), r, strict=True)) for r in v] for v in cols[-1]]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=["doc_id", *names])

    return base.mapInArrow(scan, schema)


def brute_force(words: list) -> list[tuple[int, int, int]]:
    """Runs for tests: every period, every stretch of equal words at that distance."""
    n, found = len(words), {}
    for q in range(1, n // POWER + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(LEAST, POWER * q):
                found.setdefault((i, j - i + q), q)
            i = j + 1
    return sorted(((a, n, q) for (a, n), q in found.items()), key=lambda r: (r[0], r[2]))
