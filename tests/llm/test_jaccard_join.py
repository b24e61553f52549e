import random

import numpy as np
import pytest

from tessera.llm import jaccard_join as J
from tessera.llm.queries import QUERIES

from . import fixtures as X


def brute(rows, width, percent):
    """Component of each row by comparing all pairs of sets."""
    sets = []
    for i, t in rows:
        w = (t or "").encode().lower().split()
        n = min(width, len(w))
        sets.append({tuple(w[k:k + n]) for k in range(len(w) - n + 1)} if w else set())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    order = sorted(range(len(rows)), key=lambda k: len(sets[k]))
    for x, p in enumerate(order):
        for q in order[x + 1:]:
            a, b = sets[p], sets[q]
            if 100 * len(a) < percent * len(b):
                break
            if not a or rows[p][0] is None or rows[q][0] is None:
                continue
            both = len(a & b)
            if 100 * both >= percent * (len(a) + len(b) - both):
                root[find(p)] = find(q)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(least.get(find(k), i), i)
    return sorted(((i, len(sets[k]), least.get(find(k)) if i is not None else None) for k, (i, _) in enumerate(rows)), key=repr)


def _rows(df):
    return sorted(map(tuple, df.select("doc_id", "n_shingles", "component_id").collect()), key=repr)


@pytest.mark.parametrize("width,percent,block", [(3, 90, 1024), (5, 80, 2)])
def test_edge_cases_match_brute_force(spark, monkeypatch, width, percent, block):
    if block == 2:  # keys of more than three members are large, and not held whole
        monkeypatch.setattr(J, "PACKED", 3)
        monkeypatch.setattr(J, "HELD", 5)
    rows = X.edge_rows()
    assert _rows(J.jaccard_join(X.frame(spark, rows), width, percent, block)) == brute(rows, width, percent)


@pytest.mark.parametrize("width,percent", [(3, 90), (5, 80)])
def test_links_near_the_threshold(spark, width, percent):
    """Families of edited texts of many sizes: pairs just above and just below the threshold."""
    r, rows = random.Random(5), []
    for family in range(30):
        base = X.words(r.randrange(1, 120), 1000 + family, 5000)
        for _ in range(6):
            c = list(base)
            for _ in range(r.randrange(0, 1 + len(c) // 15)):
                k = r.randrange(len(c))
                c[k:k + 1] = r.choice([[], [f"n{r.random()}"], [c[k], f"n{r.random()}"]])
                c = c or ["x"]
            rows.append((len(rows), " ".join(c)))
    want = brute(rows, width, percent)
    assert len({c for _, _, c in want}) < len(rows)
    assert _rows(J.jaccard_join(X.frame(spark, rows), width, percent)) == want


@pytest.mark.parametrize("packed,held", [(64, 4096), (3, 4), (4, 4)])
def test_keys_become_pairs_and_members(spark, monkeypatch, packed, held):
    """Every member meets its key's first one; members of three and more go on, whatever the batches."""
    monkeypatch.setattr(J, "PACKED", packed)
    monkeypatch.setattr(J, "HELD", held)
    r = random.Random(8)
    keys = {k: {r.randrange(-50, 50) for _ in range(r.choice([1, 1, 2, 2, 3, 4, 5, 9, 30]))} for k in range(-60, 60)}
    rows = [(k, c) for k, m in keys.items() for c in m for _ in range(r.choice([1, 1, 2]))]
    r.shuffle(rows)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = J._stars(spark.createDataFrame(rows, "key long, class long")).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    pairs = {(x["a"], x["b"]) for x in got if x["key"] is None}
    assert pairs == {(min(m), c) for m in keys.values() for c in m if c != min(m)}
    members = {(x["key"], c) for x in got if x["key"] is not None for c in (x["classes"] or [x["a"]])}
    assert members == {(k, c) for k, m in keys.items() if len(m) > 2 for c in m}


def test_query_matches_brute_force(spark):
    assert _rows(QUERIES["op3_jaccard_join"](spark, X.SF)) == brute(X.documents(spark), 3, 90)


def test_shared_template_without_links(spark):
    """Many texts that share most of their words but do not link, with linked pairs among them."""
    base = X.words(200, 77, 9000)
    rows = []
    for k in range(60):
        c = list(base)
        for j in range(0, 200, 9):
            c[(j + k) % 200] = f"own{k // 2}_{j}"
        rows.append((k, " ".join(c + [f"tail{k}"])))
    assert _rows(J.jaccard_join(X.frame(spark, rows), 3, 90, 16)) == brute(rows, 3, 90)


def test_bitmaps_bound_the_difference():
    r = np.random.default_rng(1)
    for n in (1, 5, 60, 700):
        a = np.unique(r.integers(0, 1 << 63, n).astype(np.uint64))
        b = np.unique(np.concatenate([a[: n // 2 + 1], r.integers(0, 1 << 63, 2 * n).astype(np.uint64)]))
        x, y = J.bitmap(a), J.bitmap(b)
        w = min(len(x), len(y))
        assert np.bitwise_count(J.fold(x, w) ^ J.fold(y, w)).sum() <= len(np.setxor1d(a, b))
        assert (J.bitmap(a) == J.fold(J.bitmap(a), len(x))).all()


def test_cells_suffice():
    """Every tile has more cells than linked sets of its sizes can differ in."""
    for percent in (80, 90):
        bands = J.Bands(percent)
        for n in range(1, 3000):
            t = bands.band(n)
            m, e = bands.cells(t)
            low = -(-percent * n // 100)  # smallest partner of n
            assert bands.band(low) >= t - 1
            assert m - e > (100 - percent) * 2 * n // (100 + percent)


def test_keep_one_and_empty(spark):
    docs = X.frame(spark, X.edge_rows())
    kept = J.keep_one(docs, 3, 90)
    assert kept.columns == docs.columns
    want = {i for i, _, c in brute(X.edge_rows(), 3, 90) if i == c and i is not None}
    assert {r["doc_id"] for r in kept.collect() if r["doc_id"] is not None} == want
    assert J.jaccard_join(X.empty(spark)).count() == 0
    assert J.keep_one(X.empty(spark)).count() == 0


def brute_links(rows, width, percent):
    """doc_id -> number of other sets that link with the row's set."""
    sets = []
    for i, t in rows:
        w = (t or "").encode().lower().split()
        n = min(width, len(w))
        sets.append(frozenset(tuple(w[k:k + n]) for k in range(len(w) - n + 1)) if w and i is not None else frozenset())
    known = {s for s in sets if s}
    links = {s: sum(a != s and 100 * len(a & s) >= percent * len(a | s) for a in known) for s in known}
    return sorted(((i, links.get(s, 0)) for (i, _), s in zip(rows, sets, strict=True)), key=repr)


def test_overlaps_match_intersections():
    r = np.random.default_rng(4)
    common = r.integers(0, 1 << 62, 50).astype(np.uint64)
    a, b = ([np.unique(np.concatenate([r.choice(common, 20), r.integers(0, 300, 30).astype(np.uint64)])) for _ in range(n)] for n in (40, 25))
    for x, y in ((a, b), (a, a), (a[:1], b[:1])):
        assert (J.overlaps(x, y) == [[len(np.intersect1d(p, q)) for q in y] for p in x]).all()


@pytest.mark.parametrize("block", [1024, 2])
def test_all_links_are_counted(spark, block):
    """A triangle of near copies, a family of many and a lone pair, with copies of some."""
    base = X.words(300, 21)
    rows = [(k, " ".join(base[:290] + [f"t{k}"])) for k in range(3)] + X.edge_rows()
    family = X.words(200, 22, 9000)
    rows += [(500 + k, " ".join([*family[:k % 9], f"u{k}", *family[k % 9:]])) for k in range(40)]
    rows += [(900, "alpha beta gamma delta " * 3 + "x"), (901, "alpha beta gamma delta " * 3 + "x"), (902, " ".join(X.words(90, 23)))]
    got = J.jaccard_join(X.frame(spark, rows), 3, 90, block).select("doc_id", "n_links").collect()
    want = brute_links(rows, 3, 90)
    assert sorted(map(tuple, got), key=repr) == want
    assert max(n for _, n in want) > 2


def test_keep_one_judges_rows(spark):
    near = X.words(100, 31)
    other = [*near[:50], "changed", *near[51:]]
    rows = [(1, " ".join(near)), (1, " ".join(near)), (2, " ".join(other)), (2, "a clean text of its own that stays here"),
            (3, "twice the same text in two rows of one id"), (3, "twice the same text in two rows of one id"),
            (4, "One Two three"), (4, "one two three"), (5, None), (5, None), (None, " ".join(near)), (None, " ".join(near)),
            (6, "first text of the least id here"), (6, "second text with nothing in common")]
    got = sorted((r["doc_id"], r["text"]) for r in J.keep_one(X.frame(spark, rows), 3, 80).collect() if r["doc_id"] not in (None, 4, 5))
    assert got == sorted([rows[0], rows[3], rows[4], rows[12], rows[13]])
    ids = [r["doc_id"] for r in J.keep_one(X.frame(spark, rows), 3, 80).collect()]
    assert ids.count(4) == 1 and ids.count(5) == 2 and ids.count(None) == 2
