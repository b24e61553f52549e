import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import pivots, postings, search
from tessera.session import release


INDEXES = [{}, {"block_records": 64}, {"max_broadcast_rows": 0, "block_records": 2}]  # broadcast, with bounds; bucketed tables, many blocks


@pytest.mark.parametrize("index", INDEXES)
def test_ties_and_inclusive_threshold(spark, index):
    q = spark.createDataFrame([(1, 0, "alpha beta")], "q int, f int, t string")
    corpus = spark.createDataFrame([(10, "alpha beta"), (11, "beta alpha"), (12, "gamma")], "id bigint, t string")
    hits = search.sparse_search(q, corpus, qid="q", fid="f", q_text="t", cid="id", c_text="t",
                                distance=0.0, k=10, **index)
    rows = [(r["id"], r["rank"], r["similarity"]) for r in hits.orderBy("rank").collect()]
    # equal similarity: larger id first; similarity exactly 1 - distance is kept
    assert [(i, k) for i, k, _ in rows] == [(11, 1), (10, 2)]
    assert all(abs(s - 1.0) < 1e-12 for _, _, s in rows)


def _brute_sparse(queries, corpus, distance, k):
    tok = lambda s: Counter(re.findall("[a-zà-ÿß]+", s.lower()))
    cv = {i: tok(t) for i, t in corpus}
    best = {}
    for q, f, t in queries:
        a = tok(t)
        for i, b in cv.items():
            dot = sum(a[w] * b[w] for w in a if w in b)
            if not dot:
                continue
            s = dot / math.sqrt(sum(v * v for v in a.values()) * sum(v * v for v in b.values()))
            if s >= 1 - distance:
                best[(q, i)] = max(best.get((q, i), -1), s)
    out = {}
    for (q, i), s in best.items():
        out.setdefault(q, []).append((s, i))
    return {q: [i for s, i in sorted(v, reverse=True)[:k]] for q, v in out.items()}


@pytest.mark.parametrize("index", INDEXES)
def test_sparse_matches_brute_force(spark, index):
    rnd = random.Random(5)
    words = "alpha beta gamma delta épée straße eta theta".split()
    corpus = [(i, " ".join(rnd.choice(words) for _ in range(rnd.randint(1, 6)))) for i in range(30)]
    queries = [(q, f, " ".join(rnd.choice(words) for _ in range(rnd.randint(1, 5)))) for q in range(8) for f in range(3)]
    qdf = spark.createDataFrame(queries, "q int, f int, t string")
    cdf = spark.createDataFrame(corpus, "id bigint, t string")
    hits = search.sparse_search(qdf, cdf, qid="q", fid="f", q_text="t", cid="id", c_text="t", distance=0.4, k=3,
                                **index)
    got = {}
    for r in hits.orderBy("q", "rank").collect():
        got.setdefault(r["q"], []).append(r["id"])
    assert got == _brute_sparse(queries, corpus, 0.4, 3)


@pytest.mark.parametrize("index", INDEXES)
def test_one_document_holds_a_third_of_all_lines(spark, index):
    rnd = random.Random(11)
    words = [f"w{chr(97 + i // 20)}{chr(97 + i % 20)}" for i in range(120)]
    text = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    corpus = [(i, text(rnd.randint(3, 8))) for i in range(120)] + [(200, ""), (201, None), (202, "12 34")]
    queries = [(0 if n < 300 else 1 + n % 60, n, rnd.choice(corpus)[1] if n % 5 == 0 else text(5)) for n in range(900)]
    qdf = spark.createDataFrame([(q, f, t) for q, f, t in queries], "q int, f int, t string").repartition(5)
    cdf = spark.createDataFrame(corpus, "id bigint, t string")
    hits = search.sparse_search(qdf, cdf, qid="q", fid="f", q_text="t", cid="id", c_text="t", distance=0.35, k=5, **index)
    got = {}
    for r in hits.orderBy("q", "rank").collect():
        got.setdefault(r["q"], []).append(r["id"])
    full = [(i, t or "") for i, t in corpus if re.search("[a-z]", t or "")]
    want = {}
    for q, ids in _brute_sparse([(q, f, t or "") for q, f, t in queries], full, 0.35, 10_000).items():
        want[q] = ids[:5]
    assert got == want and len(got[0]) == 5


def test_no_exchange_under_the_first_aggregate(spark):
    q = spark.createDataFrame([(1, 0, "alpha beta beta")], "q int, f int, t string")
    vec = postings.term_vectors(q, ["q", "f"], "t")
    assert [(r["token"], r["n"]) for r in vec.first()["terms"]] == [("alpha", 1.0), ("beta", 2.0)] and vec.first()["ss"] == 5.0
    corpus = spark.createDataFrame([(1, "beta")], "id int, t string")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        for bound in (1000, 0):
            index = postings.build_index(corpus, "id", "t", max_broadcast_rows=bound)
            plan = postings.search(q, index, qid="q", fid="f", text="t", t=0.5)._jdf.queryExecution().executedPlan().toString()
            lines = plan.split("\n")
            depth = lambda x: len(x) - len(x.lstrip(" :+-*()0123456789"))
            own = [x for x in lines if "q#" in x]
            if bound:
                assert "Exchange" not in plan  # one scan
            else:  # the deepest aggregate over fragments has no exchange of theirs below it
                first = max((x for x in own if "HashAggregate(keys=[q#" in x), key=depth)
                assert not any("Exchange hashpartitioning(q#" in x and depth(x) > depth(first) for x in own)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_index_tables_join_without_moving(spark):
    corpus = spark.createDataFrame([(k, f"alpha w{chr(97 + k % 26)}") for k in range(60)], "id int, t string")
    index = postings.build_index(corpus, "id", "t", max_broadcast_rows=0)
    q = spark.createDataFrame([(1, 0, "alpha wb")], "q int, f int, t string")
    hits = postings.search(q, index, qid="q", fid="f", text="t", t=0.9)
    assert {r["id"] for r in hits.collect()} == {1, 27, 53}
    plan = index.maxima.join(q.selectExpr("t as token"), "token")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert text.count("Exchange hashpartitioning") == 1 and "Bucketed: true" in text
    release(index.postings, index.maxima)


def test_dense_matches_numpy(spark):
    rng = np.random.default_rng(1)
    C = rng.normal(size=(50, 8))
    Q = rng.normal(size=(6, 8))
    cdf = spark.createDataFrame([(i, C[i].tolist()) for i in range(50)], "id bigint, v array<double>")
    qdf = spark.createDataFrame([(q // 2, q % 2, Q[q].tolist()) for q in range(6)], "q int, f int, v array<double>")
    for blocks in ({}, {"n_pivots": 3, "block_rows": 4, "group_rows": 2}):  # the second: many blocks and groups
        hits = search.dense_search(qdf, cdf, qid="q", fid="f", q_vec="v", cid="id", c_vec="v",
                                   distance=0.7, k=4, **blocks)
        got = {}
        for r in hits.orderBy("q", "rank").collect():
            got.setdefault(r["q"], []).append(r["id"])
        Cn = C / np.linalg.norm(C, axis=1, keepdims=True)
        Qn = Q / np.linalg.norm(Q, axis=1, keepdims=True)
        want = {}
        for q in range(3):
            s = np.maximum(Cn @ Qn[2 * q], Cn @ Qn[2 * q + 1])
            cand = sorted([(s[i], i) for i in range(50) if s[i] >= 0.3], reverse=True)[:4]
            if cand:
                want[q] = [i for _, i in cand]
        assert got == want


def _clustered(rng, centres, n, spread):
    v = centres[rng.integers(0, len(centres), n)] + spread * rng.normal(size=(n, centres.shape[1]))
    return v / np.linalg.norm(v, axis=1, keepdims=True)


@pytest.mark.parametrize("t", [0.97, 0.8, 0.3, -0.5])
def test_range_join_loses_no_pair(spark, t):
    """Clustered vectors, a third of the corpus equal, exact copies of queries, rows without a direction."""
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(12, 16))
    C, Q = _clustered(rng, centres, 600, 0.15), _clustered(rng, centres, 40, 0.15)
    C[:200] = C[0]
    C[300:310] = Q[:10]
    bad = [(9001, None), (9002, []), (9003, [0.0] * 16), (9004, [None] * 16)]
    cdf = spark.createDataFrame([(i, (3.0 * C[i]).tolist()) for i in range(600)] + bad, "id bigint, v array<double>").repartition(3)
    qdf = spark.createDataFrame([(q, 0, Q[q].tolist()) for q in range(40)] + [(i, 1, v) for i, v in bad], "q int, f int, v array<double>")
    found, pairs = pivots.range_join(qdf, cdf, qkeys=["q", "f"], q_vec="v", cid="id", c_vec="v", t=t, n_pivots=8, block_rows=16, group_rows=20)
    got = {(r["q"], r["id"]): r["s"] for r in found.collect()}
    s = Q @ C.T
    assert set(got) >= {(q, i) for q, i in zip(*np.nonzero(s >= t + 1e-9), strict=True)}
    assert set(got) <= {(q, i) for q, i in zip(*np.nonzero(s >= t - 1e-9), strict=True)}
    assert all(abs(v - s[k]) < 1e-9 for k, v in got.items())
    share = pivots.multiplied_share(pairs, 40, 600)
    assert share < 0.35 if t > 0.9 else share <= 1


def test_range_join_plan_and_empty_sides(spark):
    one = spark.createDataFrame([(1, 0, [1.0, 0.0])], "q int, f int, v array<double>")
    none = one.limit(0)
    corpus = one.selectExpr("q as id", "v")
    for q, c in ((none, corpus), (one, corpus.limit(0))):
        assert search.dense_search(q, c, qid="q", fid="f", q_vec="v", cid="id", c_vec="v").count() == 0
    hits = search.dense_search(one, corpus, qid="q", fid="f", q_vec="v", cid="id", c_vec="v", distance=0.0)
    plan = hits._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastNestedLoopJoin" not in plan and "CartesianProduct" not in plan
    assert [tuple(r) for r in hits.collect()] == [(1, 1, 1.0, 1)]


def test_vectors_of_other_lengths_raise(spark):
    q = spark.createDataFrame([(1, 0, [1.0])], "q int, f int, v array<double>")
    c = spark.createDataFrame([(1, [1.0, 0.0])], "id int, v array<double>")
    with pytest.raises(Exception, match="dimensions"):
        search.dense_search(q, c, qid="q", fid="f", q_vec="v", cid="id", c_vec="v").collect()


def test_empty_query_gives_nothing(spark):
    q = spark.createDataFrame([(1, 0, "   ")], "q int, f int, t string")
    corpus = spark.createDataFrame([(10, "alpha")], "id bigint, t string")
    hits = search.sparse_search(q, corpus, qid="q", fid="f", q_text="t", cid="id", c_text="t")
    assert hits.count() == 0
