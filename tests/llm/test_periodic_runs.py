import random
import zlib

import numpy as np
import pytest

from tessera.llm import periodic_runs as P
from tessera.llm.queries import QUERIES

from . import fixtures as X


def _runs(x):
    s, e, q = P.find_runs(np.array(x, np.int64))
    return sorted((a, b - a, p) for a, b, p in zip(s.tolist(), e.tolist(), q.tolist(), strict=True))


def _string(r):
    kind, n = r.randrange(5), r.randrange(1, 90)
    if kind == 0:
        return [r.randrange(r.randrange(1, 4)) for _ in range(n)]
    if kind == 1:  # powers, with noise
        base = [r.randrange(3) for _ in range(r.randrange(1, 9))]
        x = [r.randrange(3) for _ in range(r.randrange(5))] + base * r.randrange(2, 9) + base[:r.randrange(len(base) + 1)]
        for _ in range(r.randrange(3)):
            x[r.randrange(len(x))] = r.randrange(3)
        return x
    if kind == 2:  # powers of powers
        inner = [r.randrange(2)] * r.randrange(1, 6) + [2]
        return (inner * r.randrange(1, 6) + [r.randrange(4)]) * r.randrange(3, 7)
    if kind == 3:  # Fibonacci word
        a, b = [0], [0, 1]
        while len(b) < n:
            a, b = b, b + a
        return b[:n]
    return [0] * r.randrange(1, 30) + [1] + [0] * r.randrange(1, 30) + [1] + [0] * r.randrange(40)


def test_runs_match_brute_force():
    r = random.Random(1)
    for _ in range(4000):
        x = _string(r)
        assert _runs(x) == sorted(P.brute_force(x)), x


def test_sequences_indexed_together():
    r = random.Random(2)
    parts = [np.array(_string(r) + [50 + r.randrange(9) for _ in range(r.randrange(9))] + _string(r), np.int64) for _ in range(300)] + [np.empty(0, np.int64)]
    assert P.runs_together(parts) == [P.brute_force(p.tolist()) for p in parts]


def test_successors():
    r = np.random.default_rng(3)
    v = r.permutation(200)
    tree = P.Wavelet(v)
    lo = r.integers(0, 200, 500)
    hi = np.minimum(200, lo + r.integers(1, 80, 500))
    at = r.integers(0, 300, 500)
    got = tree.successors(lo, hi, at, 3)
    for i in range(500):
        want = sorted(x for x in v[lo[i]:hi[i]] if x >= at[i])[:3]
        assert [int(g[i]) for g in got if g[i] < 1 << 62] == want


def test_long_sequences():
    x = [7, 8] * 30_000 + [9] + list(range(20, 320)) * 12 + [1]
    assert _runs(x) == [(0, 60_000, 2), (60_001, 3600, 300)]


def _brute_rows(rows, rewrite):
    out = []
    for i, t in rows:
        words = rewrite(i, (t or "").encode().split())
        out.append((i, *P.report(words, P.brute_force(words))))
    return sorted(out, key=repr)


def contract(doc_id, words):
    """The rewritten words, straight from the statement."""
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    if doc_id is None or h % 10 or n == 0:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


@pytest.mark.parametrize("flush", [1 << 17, 1])
def test_edge_cases(spark, flush):
    rows = [(i, t) for i, t in X.edge_rows() if i != 17] + [(200 + k, " ".join(["x", "y"] * k + ["z"])) for k in range(5)]
    got = P.periodic_runs(X.frame(spark, rows), flush=flush)
    assert sorted(map(tuple, got.collect()), key=repr) == _brute_rows(rows, lambda i, w: w)
    assert any(r["n_runs"] for r in got.collect())


def test_runs_column_and_empty_table(spark):
    got = P.periodic_runs(X.frame(spark, [(1, "a b " * 5 + "c"), (2, None)]), with_runs=True).collect()
    assert sorted((r["doc_id"], [tuple(x) for x in r["runs"]]) for r in got) == [(1, [(0, 10, 2)]), (2, [])]
    assert P.periodic_runs(X.empty(spark)).count() == 0


def test_query_matches_brute_force(spark):
    docs = [(i, t) for i, t in X.documents(spark, "/root/testdata/sf0.001") if len((t or "").split()) < 3000]
    got = {tuple(r) for r in QUERIES["op12_periodic_runs"](spark, "/root/testdata/sf0.001").collect()}
    want = _brute_rows(docs, contract)
    assert set(want) <= got and sum(r[1] > 0 for r in want) > 10
