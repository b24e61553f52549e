import os
import random

from pyspark.sql import functions as F

from tessera.operators import graph as G


def frames(spark, edges, nodes=None):
    ns = sorted(set(nodes or []) | {x for e in edges for x in e})
    n = spark.createDataFrame([(x,) for x in ns], "id bigint")
    e = spark.createDataFrame(edges, "src bigint, dst bigint")
    return n, e


def test_levels_example(spark):
    n, e = frames(spark, [(1, 2), (1, 3), (2, 4), (3, 4)])
    got = {r["id"]: r["level"] for r in G.dependency_levels(n, e).collect()}
    assert got == {4: 0, 2: 1, 3: 1, 1: 2}
    sizes = {r["level"]: r["n_nodes"] for r in G.level_sizes(G.dependency_levels(n, e)).collect()}
    assert sizes == {0: 1, 1: 2, 2: 1}


def test_relax_two_cycle(spark):
    n, e = frames(spark, [(1, 2), (2, 1), (2, 3)])
    kept, removed = G.relax_cycles(n, e)
    assert sorted(map(tuple, kept.collect())) == [(2, 1), (2, 3)]
    assert sorted(map(tuple, removed.collect())) == [(1, 2)]


def _reach(edges):
    adj = {}
    for a, b in edges:
        adj.setdefault(a, set()).add(b)
    def reach(s):
        seen, todo = set(), [s]
        while todo:
            x = todo.pop()
            for y in adj.get(x, ()):
                if y not in seen:
                    seen.add(y)
                    todo.append(y)
        return seen
    return reach


def test_relax_properties_random(spark):
    rnd = random.Random(7)
    edges = sorted({(rnd.randrange(40), rnd.randrange(40)) for _ in range(90)})
    edges = [e for e in edges if e[0] != e[1]]
    n, e = frames(spark, edges, nodes=range(40))
    kept, removed = G.relax_cycles(n, e)
    kept_l = [tuple(r) for r in kept.collect()]
    removed_l = [tuple(r) for r in removed.collect()]
    reach = _reach(edges)
    # every removed edge was on a cycle, and ran upward inside its component
    for a, b in removed_l:
        assert a in reach(b) and a < b
    assert sorted(kept_l + removed_l) == edges
    # the kept graph is acyclic and levels strictly fall along every kept edge
    lv = {r["id"]: r["level"] for r in G.dependency_levels(n, kept).collect()}
    assert len(lv) == 40
    for a, b in kept_l:
        assert lv[a] > lv[b]
    # level = longest path to a sink
    kreach = {}
    def longest(x):
        if x not in kreach:
            kreach[x] = max([1 + longest(b) for a, b in kept_l if a == x], default=0)
        return kreach[x]
    assert all(lv[x] == longest(x) for x in range(40))


def test_scc_matches_brute_force(spark):
    rnd = random.Random(3)
    edges = sorted({(rnd.randrange(30), rnd.randrange(30)) for _ in range(60)})
    edges = [e for e in edges if e[0] != e[1]]
    n, e = frames(spark, edges, nodes=range(30))
    got = {r["id"]: r["scc"] for r in G.strongly_connected(n, e).collect()}
    reach = _reach(edges)
    for v in range(30):
        comp = {v} | {u for u in range(30) if u in reach(v) and v in reach(u)}
        assert got[v] == max(comp)


def test_components_and_successors(spark):
    n, e = frames(spark, [(1, 2), (3, 2), (5, 6)], nodes=[1, 2, 3, 4, 5, 6])
    comp = {r["id"]: r["component"] for r in G.weak_components(n, e).collect()}
    assert comp == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5, 6: 5}
    succ = sorted(map(tuple, G.successors(e, n.where("id IN (1, 3, 4)")).collect()))
    assert succ == [(1, 2), (3, 2)]


def test_propagate_by_level_sees_direct_successors(spark):
    n, e = frames(spark, [(1, 2), (2, 3), (1, 3)])
    levels = G.dependency_levels(n, e)

    def node_fn(frontier, child):
        # own "signature changes" = 1 + sum of direct successors' values
        if child is None:
            return frontier.select("id", F.lit(1).alias("v"))
        s = child.groupBy("id").agg(F.sum("v").alias("s"))
        return frontier.join(s, "id", "left").select("id", (1 + F.coalesce("s", F.lit(0))).alias("v"))

    got = {r["id"]: r["v"] for r in G.propagate_by_level(levels, e, node_fn).collect()}
    assert got == {3: 1, 2: 2, 1: 4}


def test_batches_levels_and_release(spark):
    """Every batch sees its own nodes and their children; results are written once; release leaves nothing."""
    from tessera.session import checkpoint_dir, release
    rnd = random.Random(2)
    edges = sorted({(a, rnd.randrange(a)) for a in range(1, 30) for _ in range(2)})
    n, e = frames(spark, edges)
    levels = G.dependency_levels(n, e)
    seen = []

    def node_fn(frontier, child):
        ids = {r["id"] for r in frontier.collect()}
        seen.append(ids)
        if child is None:
            return frontier.select("id", F.lit(1).cast("bigint").alias("v"))
        assert {r["id"] for r in child.collect()} <= ids
        s = child.groupBy("id").agg(F.sum("v").alias("s"))
        return frontier.join(s, "id", "left").select("id", (1 + F.coalesce("s", F.lit(0))).alias("v"))

    got = {}
    for size in (None, 2):
        seen.clear()
        before = set(os.listdir(checkpoint_dir(spark).replace("file:", "")))
        out = G.propagate_by_level(levels, e, node_fn, batch_size=size)
        got[size] = {r["id"]: r["v"] for r in out.collect()}
        assert size is None or max(map(len, seen)) <= size
        assert sum(map(len, seen)) == 30
        release(out)
        assert set(os.listdir(checkpoint_dir(spark).replace("file:", ""))) <= before
    want = {}
    for v in range(30):
        want[v] = 1 + sum(want[b] for a, b in edges if a == v)
    assert got[None] == got[2] == want


def test_rounds_move_no_edges(spark):
    n, e = frames(spark, [(k, k + 1) for k in range(50)] + [(9, 3)])
    out = G.adjacency(e, "src")
    state = G._buckets(n.selectExpr("id", "0L AS colour", "id AS label", "true AS _chg"), "id")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = G.step(state, out, "src", "dst")._jdf.queryExecution().executedPlan().toString().split("\n")
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    scans = [k for k, line in enumerate(plan) if "FileScan" in line]
    assert len(scans) == 3
    exchanges = [line for line in plan if "Exchange hashpartitioning" in line]
    # one for the frontier, one for the candidates; none above the scans of the edges and of the state that is updated
    assert len(exchanges) == 2 and sum("Bucketed: true" in line for line in plan) >= 2
    G.release(out, state)


def test_reference_edges_and_owner(spark):
    decl = spark.createDataFrame([(1, "A"), (2, "B"), (3, "B"), (4, "")], "path bigint, symbol string")
    uses = spark.createDataFrame([(1, "B"), (3, "B"), (2, "A"), (2, "Zed")], "path bigint, symbol string")
    owner = G.symbol_owner(decl)
    assert {r["symbol"]: r["path"] for r in owner.collect()} == {"A": 1, "B": 3}
    edges = sorted(map(tuple, G.reference_edges(uses, owner).collect()))
    assert edges == [(1, 3), (2, 1)]


def test_components_random_vs_brute_force(spark):
    rnd = random.Random(11)
    edges = sorted({(rnd.randrange(60), rnd.randrange(60)) for _ in range(45)})
    edges = [e for e in edges if e[0] != e[1]]
    # a long chain as well: pointer jumping must still reach the minimum
    edges += [(100 + i, 101 + i) for i in range(30)]
    n, e = frames(spark, edges, nodes=list(range(60)) + list(range(100, 131)))
    got = {r["id"]: r["component"] for r in G.weak_components(n, e).collect()}
    und = edges + [(b, a) for a, b in edges]
    reach = _reach(und)
    for v in got:
        assert got[v] == min({v} | reach(v))


def test_fixpoints_leave_few_checkpoints(spark):
    """The state of a finished round is deleted: a longer chain leaves no more folders."""
    from tessera.session import checkpoint_dir

    def left(n):
        root = checkpoint_dir(spark).replace("file:", "")
        before = len(os.listdir(root))
        nodes = spark.range(n)
        edges = spark.range(n - 1).selectExpr("id AS src", "id + 1 AS dst")
        assert G.dependency_levels(nodes, edges).agg({"level": "max"}).first()[0] == n - 1
        return len(os.listdir(root)) - before

    assert left(24) <= left(6) + 1


def _longest(edges, nodes):
    level = {}
    out = {v: [b for a, b in edges if a == v] for v in nodes}
    for v in sorted(nodes):  # edges lead to smaller ids
        level[v] = max([1 + level[b] for b in out[v]], default=0)
    return level


def test_levels_take_rounds_by_blocks_not_by_levels(spark, monkeypatch):
    """A deep graph is placed in as many rounds as its paths cross blocks; labels are the same however nodes are dealt."""
    stored = []
    real = G._buckets

    def counted(df, key, n=None, **figures):
        out = real(df, key, n, **figures)
        if "left" in figures:
            stored.append(out.figures)
        return out

    monkeypatch.setattr(G, "_buckets", counted)
    rnd = random.Random(5)
    edges = sorted({(a, rnd.randrange(max(0, a - 9), a)) for a in range(1, 120) for _ in range(3)} | {(a, a - 1) for a in range(1, 120)})
    n, e = frames(spark, edges, nodes=[*range(120), 500])
    want = _longest(edges, [*range(120), 500])
    assert max(want.values()) == 119
    for size, most in ((G.BLOCK_NODES, 1), (30, 8)):
        stored.clear()
        assert {r["id"]: r["level"] for r in G.dependency_levels(n, e, block_nodes=size).collect()} == want
        assert len(stored) <= most
    # against the order of ids: blocks wait for each other, the result stays
    up = [(119 - a, 119 - b) for a, b in edges if rnd.random() < 0.4]
    n, e = frames(spark, up, nodes=range(120))
    back = _longest([(119 - a, 119 - b) for a, b in up], range(120))
    assert {r["id"]: r["level"] for r in G.dependency_levels(n, e, block_nodes=20).collect()} == {119 - v: k for v, k in back.items()}


def test_levels_refuse_cycles_and_lost_ends(spark):
    import pytest
    for bad in ([(1, 2), (2, 3), (3, 1), (4, 1)], [(1, 2), (2, 1)]):
        n, e = frames(spark, bad)
        with pytest.raises(ValueError):
            G.dependency_levels(n, e)
    with pytest.raises(ValueError):
        G.dependency_levels(spark.createDataFrame([(1,)], "id bigint"), spark.createDataFrame([(1, 2)], "src bigint, dst bigint"))
    n = spark.createDataFrame([(1,), (None,)], "id bigint")
    e = spark.createDataFrame([(1, 1), (None, 1), (7, 1)], "src bigint, dst bigint")
    assert {r["id"]: r["level"] for r in G.dependency_levels(n, e).collect()} == {1: 0, None: 0}


def test_level_store_keeps_columns_and_few_folders(spark, monkeypatch):
    """Columns of the levels reach every level's nodes; a level looks into few folders of results, and none is lost."""
    from tessera.session import release
    monkeypatch.setattr(G.LevelStore, "MERGE", 3, raising=False)
    stores, looked = [], []

    class Store(G.LevelStore):
        def __init__(self, *a):
            super().__init__(*a)
            stores.append(self)

        def children(self, level):
            looked.append(len({self.place[k] for k in self.leads_to.get(level, ()) if k < level}))
            return super().children(level)

    monkeypatch.setattr(G, "LevelStore", Store)
    n, e = frames(spark, [(a, b) for a in range(9) for b in range(a)])  # level of k: k, its edges lead to all below
    levels = n.selectExpr("id", "int(id) AS level", "id * 10 AS weight")

    def node_fn(f, child):
        if child is None:
            return f.select("id", F.col("weight").alias("v"))
        return f.join(child.groupBy("id").agg(F.sum("v").alias("s")), "id", "left").select("id", (F.col("weight") + F.coalesce("s", F.lit(0))).alias("v"))

    out = G.propagate_by_level(levels, e, node_fn)
    want = {}
    for k in range(9):
        want[k] = 10 * k + sum(want[j] for j in range(k))
    assert sorted((r["id"], r["v"]) for r in out.collect()) == sorted(want.items())
    assert max(looked) <= 4 and len(set(stores[0].place.values())) == 3
    release(out)
