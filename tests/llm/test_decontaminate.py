from tessera.llm import decontaminate as D
from tessera.llm.queries import QUERIES

from . import fixtures as X


X_ROLL = D.C.rolling


def _bench(spark, rows):
    return spark.createDataFrame([(*r, 7) for r in rows], "item_id long, text string, hits int")


ITEMS = [(1, " ".join(X.words(60, 2))), (2, "one two"), (2, "one two"), (10, "z z z z z z z z z z z"), (3, None), (4, ""), (None, "one")]


def _known():
    return [(None if i is None else str(i), t) for i, t in ITEMS]


def _rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_edge_cases_match_brute_force(spark):
    docs = X.edge_rows()
    got = D.report(D.contamination(X.frame(spark, docs), _bench(spark, ITEMS)))
    assert _rows(got) == sorted(D.brute_force(docs, _known()), key=repr)


def test_blocks_give_the_same_marks(spark):
    docs = sorted(set(X.edge_rows()), key=repr)
    got = D.report(D.contamination(X.frame(spark, docs), _bench(spark, ITEMS), max_block_bytes=5))
    assert _rows(got) == sorted(D.brute_force(docs, _known()), key=repr)


def test_repeated_rows_stay_whatever_the_blocks(spark):
    docs = X.edge_rows() + [(5, "one two"), (5, "one two"), (None, None), (None, "one two"), (None, "one two"), (1, None)]
    want = sorted(D.brute_force(docs, _known()), key=repr)
    for size in (D.MAX_BLOCK_BYTES, 5):
        assert _rows(D.report(D.contamination(X.frame(spark, docs), _bench(spark, ITEMS), max_block_bytes=size))) == want
        cut = D.decontaminate(X.frame(spark, docs), _bench(spark, ITEMS), mode="spans", max_block_bytes=size)
        assert cut.count() == len(docs)


def test_items_without_an_id_are_hit(spark):
    text = " ".join(X.words(10, 77))
    for size in (D.MAX_BLOCK_BYTES, 5):
        found = D.contamination(X.frame(spark, [(1, text), (2, "clean")]), _bench(spark, [(None, text), (7, "other words")]), max_block_bytes=size)
        assert sorted((r["doc_id"], r["n_hit"], r["n_items"], r["contaminated"]) for r in D.report(found).collect()) == [(1, 10, 0, True), (2, 0, 0, False)]


def test_equal_hashes_of_different_windows(monkeypatch):
    """With every hash equal, words alone decide."""
    monkeypatch.setattr(D.C, "rolling", lambda h, n: X_ROLL(h, n) * 0)
    items = [("a", b"x y z w"), ("b", b"p q r s"), ("c", b"x y z w"), (None, b"y z w v"), ("d", b"q r s t")]
    windows = D.WindowSet(items, 3)
    assert windows.scan(b"k x y z k".split())[1] == {windows.ids.index("a"), windows.ids.index("c")}
    hit, found = windows.scan(b"q r s t".split())
    assert hit.all() and {windows.ids[k] for k in found} == {"b", "d"}
    assert windows.scan(b"z w v".split())[0].all() and not windows.scan(b"z w v".split())[1]


def test_large_block_is_built_once_per_worker(spark):
    """16 MiB of items in one block, and in several."""
    base = [(k, " ".join(X.words(2000, k, 50_000))) for k in range(1200)]
    docs = [(k, base[k][1][3000:3400] if k % 2 else f"nothing of it {k}") for k in range(40)]
    bench = spark.createDataFrame([(*r, 7) for r in base], "item_id long, text string, hits int")
    for size in (D.MAX_BLOCK_BYTES, 6 << 20):
        got = D.report(D.contamination(X.frame(spark, docs), bench, max_block_bytes=size)).collect()
        assert {r["doc_id"] for r in got if r["contaminated"]} == {k for k in range(40) if k % 2}


def test_query_matches_brute_force(spark):
    items = [(str(r[0]), r[1]) for r in spark.read.parquet(f"{X.SF}/benchmark.parquet").select("item_id", "text").collect()]
    # brute force only where a ten-word window is anywhere at all: join words, then look closely
    got = {r["doc_id"]: tuple(r) for r in QUERIES["op2_decontamination"](spark, X.SF).collect()}
    docs = X.documents(spark)
    assert len(got) == len(docs)
    grams = {" ".join(w[k:k + 10]) for _, t in items for w in [_words(t)] for k in range(max(1, len(w) - 9))}
    hit = 0
    for i, t in docs:
        line = " " + " ".join(_words(t)) + " "
        if any(f" {g} " in line for g in grams):
            assert D.brute_force([(i, t)], items)[0] == got[i]
            hit += 1
        else:
            assert got[i][2:4] == (0, 0) and not got[i][5]
    assert hit > 5


def _words(t):
    import re
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))


def test_documents_and_spans_are_removed(spark):
    docs, bench = X.frame(spark, X.edge_rows()), _bench(spark, ITEMS)
    kept = D.decontaminate(docs, bench)
    assert kept.columns == docs.columns
    flagged = {(r[0], r[1]) for r in D.brute_force(X.edge_rows(), _known()) if r[5]}
    n = {(i, len(_words(t))) for i, t in X.edge_rows()}
    assert {(r["doc_id"], len(_words(r["text"]))) for r in kept.collect()} == n - flagged
    for size in (D.MAX_BLOCK_BYTES, 5):
        cut = D.decontaminate(docs, bench, mode="spans", max_block_bytes=size).collect()
        assert len(cut) == len(X.edge_rows())
        by = {r["doc_id"]: r["text"] for r in cut}
        assert by[5].split() == [] and by[4] == "" and by[1] is None
        assert len(_words(by[11])) == 80


def test_empty_tables(spark):
    assert D.contamination(X.empty(spark), _bench(spark, ITEMS)).count() == 0
    none = D.report(D.contamination(X.frame(spark, X.edge_rows()), _bench(spark, [])))
    assert none.count() == len(X.edge_rows()) and none.where("contaminated").count() == 0
