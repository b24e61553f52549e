import math
import zlib
from collections import Counter

import numpy as np
import pytest

from tessera.llm import lattice as L
from tessera.llm.queries import QUERIES

from . import fixtures as X


def segmentations(word, lattice, start=0):
    """Sum of products over all segmentations, by enumeration."""
    if start == len(word):
        return math.exp(lattice.log_end)
    total = 0.0
    for n in range(1, len(word) - start + 1):
        side = 0 if start == 0 else 1
        tables, logs = lattice.sides[side]
        if n not in tables:
            continue
        codes, numbers = tables[n]
        c = lattice._codes(word[start:start + n], n)[0]
        at = np.searchsorted(codes, c)
        if at < len(codes) and codes[at] == c:
            total += math.exp(logs[numbers[at]]) * segmentations(word, lattice, start + n)
    return total


def test_forward_recursion_sums_all_segmentations():
    lattice = L.Model().lattice()
    words = [b"information", b"the", b"\xc3\xa9t\xc3\xa9", b"x", b"\xff\xfe", b"information"]
    got = lattice.log_probability(words)
    for w, g in zip(words, got, strict=True):
        assert math.isclose(math.exp(g), segmentations(w, lattice), rel_tol=1e-9)


def test_long_words_use_the_same_recursion():
    lattice = L.Model().lattice()
    whole = lattice.log_probability([b"ab" * 128])[0]
    block = np.frombuffer(b"ab" * 128, np.uint8).reshape(1, -1)
    assert math.isclose(whole, lattice.forward(block, list(lattice.arcs(block)))[0, -1] + lattice.log_end, rel_tol=1e-12)
    long = lattice.log_probability([b"ab" * 3000])[0]
    assert math.isclose(long, whole * 6000 / 256, rel_tol=0.05)


@pytest.mark.parametrize("segment", [5, 256])
def test_long_words_count_in_training(monkeypatch, segment):
    lattice = L.Model().lattice()
    sizes = tuple(len(logs) for _, logs in lattice.sides)
    words = ["информация東京都".encode() * 14, b"information" * 60, b"x" * 257]
    monkeypatch.setattr(L, "LONG", 10_000)
    want = lattice.expected(words, sizes)
    monkeypatch.setattr(L, "LONG", segment)
    got = lattice.expected(words, sizes)
    assert got[1][-1] == 3 and sum(map(np.sum, got)) > 100
    for g, w in zip(got, want, strict=True):
        assert np.allclose(g, w, rtol=1e-9, atol=1e-12)


def test_piece_weights_sum_to_one_and_training_helps(spark):
    model = L.Model()
    words = spark.createDataFrame([(w,) for w in ("thing", "things", "bring", "singing", "king") * 5], "word string")
    before = model.lattice().log_probability([b"singing"])[0]
    model.fit(spark, words)
    assert all(math.isclose(np.exp(g).sum(), 1.0, rel_tol=1e-9) for g in model.logs)
    assert model.lattice().log_probability([b"singing"])[0] > before


def brute_base(rows):
    split = {(i, t): ((t or "").encode().lower().split() + [None]) for i, t in rows}
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    c = Counter()
    for i, t in rows:
        if not held(i):
            c.update(split[i, t])
    n, v = sum(c.values()), len(c)
    return {(i, t): (i, held(i), len(w), sum(c[x] > 0 for x in w), n, sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w))
            for (i, t), w in split.items()}


@pytest.mark.parametrize("hot", [0, 50, 100_000])
def test_base_columns_and_edge_cases(spark, hot):
    rows = X.edge_rows()
    got = L.score(X.frame(spark, rows), hot_words=hot, rounds=1).collect()
    want = sorted(brute_base(rows).values(), key=repr)
    assert len(got) == len(want)
    for g, w in zip(sorted(got, key=lambda r: repr((r[0], r[1], r[2], r[3], r[4]))), sorted(want, key=lambda r: repr(r[:5])), strict=True):
        assert tuple(g)[:5] == w[:5]
        assert math.isclose(g["base_score"], w[5], rel_tol=1e-9)
        assert math.isfinite(g["score"]) and g["score"] < 0


def test_query_base_and_held_out_fit(spark):
    got = {r["doc_id"]: r for r in QUERIES["op1_lattice_score"](spark, X.SF).collect()}
    rows = X.documents(spark)
    want = brute_base(rows)
    assert len(got) == len(rows)
    for key, w in want.items():
        g = got[key[0]]
        assert tuple(g)[:5] == w[:5] and math.isclose(g["base_score"], w[5], rel_tol=1e-9)
    # words in a shuffled alphabet are far less likely per token than the corpus' own words
    known = [r["score"] / r["n_tokens"] for r in got.values() if r["held_out"] and r["n_tokens"] > 50]
    assert -6 < float(np.mean(known)) < -2


def test_word_probabilities_sum_to_less_than_one(spark):
    """The words of a small corpus and the end token share one distribution."""
    rows = [(k, "a b c a") for k in range(9)]
    got = L.score(X.frame(spark, rows + [(100 + k, w) for k, w in enumerate(["a", "b", "c", "zz", "", "ab"])]), rounds=1)
    by = {r["doc_id"]: r["score"] for r in got.collect()}
    end = by[104]
    total = sum(10 ** (by[k] - end) for k in (100, 101, 102, 103, 105)) + 10 ** end
    assert 0.9 < total <= 1.0


def brute_score(rows, alpha, logp):
    """One class-marginal score per row, word after word, from the model's own piece weights."""
    held = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    counts = {None: Counter()}
    for i, t, kind in rows:
        if not held(i):
            for key in {None, kind}:
                counts.setdefault(key, Counter()).update([*t.lower().split(), " end"])
    out = {}

    def discounted(c, word, back):
        n1, n2 = (sum(v == k for v in c.values()) for k in (1, 2))
        d = min(0.95, max(0.05, n1 / (n1 + 2 * n2))) if n1 else 0.5
        n = sum(c.values())
        return max(c[word] - d, 0) / n + d * len(c) / n * back if word in c or back else 0.0

    ends = {key: None for key in counts}
    ends[None] = discounted(counts[None], " end", 0.0)
    for key in counts:
        if key is not None:
            ends[key] = discounted(counts[key], " end", ends[None])
    docs = {key: (c[" end"] if key is not None else 1) for key, c in counts.items()}
    for i, t, _ in rows:
        total = 0.0
        for key, c in counts.items():
            p, seen = docs[key] / sum(docs.values()), Counter()
            for m, w in enumerate(t.lower().split()):
                q = discounted(counts[None], w, math.exp(logp[w]))
                q = q if key is None else discounted(c, w, q)
                q /= 1 - ends[key]
                p *= (1 - ends[key]) * (seen[w] + alpha * q) / (m + alpha)
                seen[w] += 1
            total += p * ends[key]
        out[i] = math.log10(total)
    return out


@pytest.mark.parametrize("hot", [0, 100_000])
def test_score_is_the_sequential_mixture(spark, hot):
    rows = [(k, "the cat the dog" if k % 3 else "le chat le chien le", "en" if k % 3 else "fr") for k in range(20)]
    rows += [(50, "the the zebra zebra zebra cat", None), (51, "", "en"), (52, "le chat", "xx")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r["doc_id"]: r["score"] for r in L.score(docs, rounds=0, hot_words=hot, alpha=3.0).collect()}
    lattice = L.Model().lattice()
    words = sorted({w for _, t, _ in rows for w in t.split()})
    logp = dict(zip(words, lattice.log_probability([w.encode() for w in words]).tolist(), strict=True))
    want = brute_score(rows, 3.0, logp)
    assert got.keys() == want.keys()
    for k in want:
        assert math.isclose(got[k], want[k], rel_tol=1e-9), k


def test_log_gamma():
    z = [1.0, 1.5, 2.0, 10.25, 3000.0]
    assert np.allclose(L.log_gamma(np.array(z)), [math.lgamma(x) for x in z], rtol=1e-11, atol=1e-11)


def test_held_out_documents_beat_the_add_one_baseline(spark):
    got = [r for r in QUERIES["op1_lattice_score"](spark, "/root/testdata/sf0.1").collect() if r["held_out"]]
    assert sum(r["score"] for r in got) > sum(r["base_score"] for r in got)


def test_empty_and_untrained(spark):
    assert L.score(X.empty(spark)).count() == 0
    held = [i for i in range(50) if zlib.crc32(str(i).encode()) % 7 == 2]
    got = L.score(X.frame(spark, [(i, "some words") for i in held])).collect()
    assert all(r["train_tokens"] == 0 and r["n_known"] == 0 and r["base_score"] == 0 and math.isfinite(r["score"]) for r in got)


def test_every_value_has_a_class(spark):
    """With more values than classes the rarest share the last one; none trains the classless model alone."""
    from tessera.llm import lattice
    rows = [(f"l{k}", True) for k in range(11) for _ in range(20 - k)] + [(None, True), ("unseen", False)]
    base = spark.createDataFrame(rows, "value string, train boolean")
    for n, want in ((8, 8), (20, 11)):
        found, number = lattice._with_class(base, n)
        by = {r["value"]: r["class"] for r in found.distinct().collect()}
        assert number == want and by[None] is None
        assert [by[f"l{k}"] for k in range(11)] == [min(k, n - 1) for k in range(11)]
        assert by["unseen"] == (7 if n == 8 else None)
