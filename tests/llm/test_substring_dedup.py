import random

from tessera.llm import substring_dedup as S
from tessera.llm.queries import QUERIES

from . import fixtures as X


def _rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def _once(rows):
    """Rows as the contract orders them; one id with two texts is left to its own test."""
    seen = {}
    for i, t in rows:
        seen.setdefault(i, t)
    return [(i, t) for i, t in seen.items()]


def test_edge_cases_match_brute_force(spark):
    rows = _once(X.edge_rows())
    assert _rows(S.substring_dedup(X.frame(spark, rows))) == sorted(S.brute_force(rows), key=repr)


def test_small_chunks_and_shifted_copies(spark, monkeypatch):
    r, rows = random.Random(3), []
    passages = [X.words(r.randrange(15, 70), 50 + k, 10_000) for k in range(12)]
    for i in range(80):
        t = []
        for _ in range(r.randrange(0, 5)):
            t += X.words(r.randrange(0, 25), r.random(), 10_000) + r.choice(passages)
        rows.append((i * 3 - 60, " ".join(t)))
    assert _rows(S.substring_dedup(X.frame(spark, rows, 7))) == sorted(S.brute_force(rows), key=repr)


def test_repeated_rows_are_one_document(spark):
    t = " ".join(X.words(50, 9))
    got = S.substring_dedup(X.frame(spark, [(5, t), (5, t), (6, t)]), with_text=True)
    assert sorted((r["doc_id"], r["n_removed"], r["kept_text"]) for r in got.collect()) == [(5, 0, t), (6, 50, "")]


def test_one_id_with_two_texts(spark):
    p = X.words(30, 11)
    got = S.substring_dedup(X.frame(spark, [(1, " ".join(p + ["a"])), (1, " ".join(["b"] + p))]))
    assert sorted(r["n_removed"] for r in got.collect()) == [0, 30]


def test_query_matches_brute_force(spark):
    assert _rows(QUERIES["op5_substring_dedup"](spark, X.SF)) == sorted(S.brute_force(X.documents(spark)), key=repr)


def test_empty_table(spark):
    assert S.substring_dedup(X.empty(spark)).count() == 0
