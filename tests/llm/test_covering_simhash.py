import itertools
import random

import numpy as np
import pytest
import xxhash

from tessera.llm import covering_simhash as S
from tessera.llm.queries import QUERIES

from . import fixtures as X


def brute_fingerprint(text, width=3):
    words = (text or "").encode().lower().split()
    n = min(width, len(words))
    h = [xxhash.xxh64_intdigest(b" ".join(words[k:k + n]), 42) for k in range(len(words) - n + 1)] if words else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(values, radius=2):
    """Smallest id reachable; values: (id, fingerprint)."""
    fps = sorted({f for i, f in values if i is not None})
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    known, one = set(fps), [1 << b for b in range(64)]
    for f in fps:
        for k in range(1, radius + 1):
            for bits in itertools.combinations(one, k):
                g = f ^ sum(bits)
                if g in known:
                    root[find(g)] = find(f)
    least = {}
    for i, f in values:
        if i is not None:
            least[find(f)] = min(least.get(find(f), i), i)
    return sorted(((i, f"{f:016x}", None if i is None else least[find(f)]) for i, f in values), key=repr)


def _rows(df):
    return sorted(map(tuple, df.select("doc_id", "fingerprint", "component_id").collect()), key=repr)


@pytest.mark.parametrize("level", [0, 1, 2])
def test_every_pair_within_the_radius_collides(level):
    tables = S.table_masks(level)
    assert len(tables) == 7 ** (level + 1)
    for d in (1, 2):
        for bits in itertools.combinations(range(64), d):
            x = sum(1 << b for b in bits)
            assert any(x & m == 0 for m in tables)
    assert max(len(S.left_out(m)) for m in S.table_masks(2)) <= 6


def test_edge_cases_match_brute_force(spark):
    rows = X.edge_rows()
    want = components([(i, brute_fingerprint(t)) for i, t in rows])
    assert _rows(S.near_duplicates(X.frame(spark, rows))) == want


def test_long_texts_go_in_chunks(monkeypatch):
    text = " ".join(X.words(2000, 4)).encode()
    monkeypatch.setattr(S, "_CHUNK", 17)
    assert S.fingerprint(text) == brute_fingerprint(text.decode())


@pytest.mark.parametrize("crowd", [64, 5000])
def test_crowded_buckets_lose_no_link(spark, crowd):
    """Dense balls of fingerprints (hundreds share a bucket), chains, and random ones."""
    r = random.Random(9)
    fps = [r.getrandbits(64) for _ in range(300)]
    for _ in range(3):
        centre = r.getrandbits(64)
        fps += [centre ^ sum(1 << b for b in r.sample(range(64), r.randrange(0, 5))) for _ in range(900)]
        low = r.getrandbits(64) >> 12 << 12
        fps += [low | r.getrandbits(12) for _ in range(500)]
    chain = r.getrandbits(64)
    for b in range(0, 62, 2):
        chain ^= 3 << b
        fps.append(chain)
    fps = sorted(set(fps))
    signed = np.array(fps, np.uint64).view(np.int64).tolist()
    got = S.links(spark.createDataFrame([(f,) for f in signed], "fp long"), crowd=crowd).collect()
    pairs = [(a % (1 << 64), b % (1 << 64)) for a, b in got]
    assert all((a ^ b).bit_count() <= 2 for a, b in pairs)
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        root[find(a)] = find(b)
    want = {int(h, 16): c for _, h, c in components(list(enumerate(fps)))}
    groups = {}
    for k, f in enumerate(fps):
        groups.setdefault(find(f), set()).add(k)
    assert {f: min(groups[find(f)]) for f in fps} == want
    assert len(pairs) < 40 * len(fps)  # forests, not pairs


def test_query_matches_brute_force(spark):
    docs = X.documents(spark)
    assert _rows(QUERIES["op13_covering_simhash"](spark, X.SF)) == components([(i, brute_fingerprint(t)) for i, t in docs])


def test_empty_table(spark):
    assert S.near_duplicates(X.empty(spark)).count() == 0


def test_hot_keys_are_attached(spark, monkeypatch):
    monkeypatch.setattr(S.C, "HOT_SHARE", 4)
    rows = spark.createDataFrame([(k, k % 3 if k < 90 else k) for k in range(120)], "doc long, key long")
    side = rows.groupBy("key").count().selectExpr("key", "key * 10 as v", "count as n")
    got = S.C.attach(rows, side, ["key"], "n")
    assert sorted((r["doc"], r["key"], r["v"]) for r in got.collect()) == [(k, x, 10 * x) for k, x in ((k, k % 3 if k < 90 else k) for k in range(120))]
