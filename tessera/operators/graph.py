"""Reference graph: symbol resolution, cycle relaxation, dependency levels, components.

Nodes and edges are DataFrames ``nodes(id)`` and ``edges(src, dst)``. Every fixpoint is a
loop of joins and aggregations whose state is stored in the shared checkpoint folder each round, so lineage stays
short and a lost executor only recomputes one round. Edges are stored once in buckets by the end that rounds join
on, the state in the same buckets: a round moves changed labels, never edges. The driver fetches one
count per round.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import bucketed, checkpoint_dir, cut_lineage, release, ship
from .common import dense_index


def symbol_owner(declares: DataFrame, path: str = "path", symbol: str = "symbol") -> DataFrame:
    """AGG-1: one owner per symbol; with several declaring files the greatest path wins."""
    return (declares.where(F.col(symbol).isNotNull() & (F.col(symbol) != ""))
            .groupBy(symbol).agg(F.max(path).alias(path)))


def symbols_per_file(files: DataFrame, declares: DataFrame, path: str = "path",
                     symbol: str = "symbol") -> DataFrame:
    """AGG-2: sorted declared symbols per file, files without any included (empty list)."""
    d = declares.where(F.col(symbol) != "").select(path, symbol)
    return (files.select(path).join(d, path, "left").groupBy(path)
            .agg(F.array_sort(F.collect_set(symbol)).alias("symbols")))


def reference_edges(uses: DataFrame, owner: DataFrame, path: str = "path",
                    symbol: str = "symbol") -> DataFrame:
    """JOIN-1 / GRF-1: user -> declaring file, self references removed, distinct.

    ``owner`` has one row per symbol, so a very common symbol is a hot key only on the
    ``uses`` side; AQE's skew-join handling splits that side's partitions.
    """
    u = uses.select(F.col(path).alias("src"), symbol)
    o = owner.select(symbol, F.col(path).alias("dst"))
    return u.join(o, symbol).where(F.col("src") != F.col("dst")).select("src", "dst").distinct()


def graph_nodes(files: DataFrame, edges: DataFrame, id_col: str = "id") -> DataFrame:
    """Scanned files plus every edge source (a file can enter through an edge only)."""
    return (files.select(F.col(id_col).alias("id"))
            .unionByName(edges.select(F.col("src").alias("id"))).distinct())


# Steps of a fixpoint evaluated per Spark job; the change count is checked once per job.
UNROLL = 2
#: smaller graphs keep their state in one bucket per so many rows: their joins are broadcasts, and files cost more than rows
BUCKET_ROWS = 100_000


def _buckets(df: DataFrame, key: str, n: int | None = None, **figures) -> DataFrame:
    """A stored table in buckets by ``key``, as many as shuffle partitions: a join on the key moves the other side alone."""
    return bucketed(df, [key], n or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), **figures)


def _state_buckets(nodes: DataFrame, edges: DataFrame) -> int:
    """Buckets of a state over ``nodes``: those of the edges (from ``adjacency``), or fewer in a small graph."""
    return _few(nodes, max(nodes.count(), edges.figures["rows"]))


def _few(df: DataFrame, rows: int) -> int:
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return n if rows >= n * BUCKET_ROWS else max(1, rows // BUCKET_ROWS)


def adjacency(edges: DataFrame, key: str) -> DataFrame:
    """Edges without loops and repeats, once in buckets by their end ``key``; rounds read them where they are."""
    n = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return bucketed(edges.select("src", "dst").where(F.col("src") != F.col("dst")).distinct().repartition(n, key), [key], n, rows=F.count(F.lit(1)))


def step(state: DataFrame, edges: DataFrame, frm: str, to: str) -> DataFrame:
    """One step of ``spread``: changed labels along the edges, then into the state. Edges and state stay in their buckets."""
    frontier = state.where("_chg").select(F.col("id").alias(frm), F.col("colour").alias("_c"), F.col("label").alias("_l"))
    cand = edges.join(frontier, frm).groupBy(F.col(to).alias("_id"), "_c").agg(F.max("_l").alias("_m"))
    return (state.join(cand, (state["id"] == cand["_id"]) & (state["colour"] == cand["_c"]), "left")
            .select("id", "colour", F.greatest("label", F.coalesce("_m", "label")).alias("label"),
                    F.coalesce(F.col("_m") > F.col("label"), F.lit(False)).alias("_chg")))


def spread(labels: DataFrame, edges: DataFrame, frm: str, to: str, n: int | None = None, unroll: int = UNROLL) -> DataFrame:
    """labels(id, colour, label, _chg): label(v) := max over edges u -> v between nodes of one colour, to a fixpoint.

    Semi-naive: only labels that changed in the step before (first those with ``_chg``) are pushed along the
    edges; what reaches a node that is not in the state is dropped there. ``unroll`` steps are chained in one
    plan, then the state is stored and the changes of the last step are looked for; a step past the fixpoint
    changes nothing, so overshooting is harmless.
    """
    state = _buckets(labels, "id", n)
    while True:
        last = state
        for _ in range(unroll):
            state = step(state, edges, frm, to)
        state = _buckets(state, "id", n, changed=F.count_if("_chg"))
        release(last)
        if not state.figures["changed"]:
            return state


def strongly_connected(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """SCC label per node (the greatest id in its component), by repeated forward colouring.

    Each round first trims nodes without an incoming or without an outgoing edge among the unfinished
    nodes (they are components of their own), then colours: colour = greatest id that reaches
    the node; a node whose colour is its own id is a root; the root's component is every
    same-coloured node that reaches it (backward pass within the colour). Found components leave the state; the
    rest is coloured again. Nodes that lack edges into or out of them never enter the state. The edges are stored twice, in buckets by either end, and are only
    rewritten (in place, by their own end) when half of the nodes are done.
    """
    out = adjacency(edges.join(edges.select(F.col("dst").alias("src")).distinct(), "src", "left_semi"), "src")
    back = adjacency(out, "dst")
    all_nodes = nodes.select("id").distinct()
    some = all_nodes.join(out.select(F.col("src").alias("id")).distinct(), "id", "left_semi")
    n = _state_buckets(some, out)
    state = _buckets(some.withColumn("scc", F.lit(None).cast("bigint")), "id", n)
    size = None
    while True:  # every round finds at least one component
        active = state.where(F.col("scc").isNull()).select("id")
        has_out = back.join(active.withColumnRenamed("id", "dst"), "dst").select(F.col("src").alias("id")).distinct()
        has_in = out.join(active.withColumnRenamed("id", "src"), "src").select(F.col("dst").alias("id")).distinct()
        core = active.join(has_out, "id").join(has_in, "id").withColumn("_c", F.lit(True))
        last, state = state, _buckets(
            state.join(core, "id", "left")  # nodes outside the core are components of their own
            .select("id", F.when(F.col("scc").isNull() & F.col("_c").isNull(), F.col("id")).otherwise(F.col("scc")).alias("scc")), "id", n,
            left=F.count_if(F.col("scc").isNull()))
        release(last)
        core = state.where(F.col("scc").isNull()).select("id")
        left = state.figures["left"]
        if not left:
            release(out, back)
            done = cut_lineage(all_nodes.join(state, "id", "left").select("id", F.coalesce("scc", "id").alias("scc")))
            release(state)
            return done
        if size is None or 2 * left <= size:
            size, used = left, (out, back)
            out = _buckets(out.join(core.withColumnRenamed("id", "src"), "src", "left_semi").select("src", "dst"), "src")
            back = _buckets(back.join(core.withColumnRenamed("id", "dst"), "dst", "left_semi").select("src", "dst"), "dst")
            release(*used)
        colour = spread(core.select("id", F.lit(0).cast("bigint").alias("colour"), F.col("id").alias("label"), F.lit(True).alias("_chg")), out, "src", "dst", n)
        root = F.col("id") == F.col("label")
        found = spread(colour.select("id", F.col("label").alias("colour"), root.cast("int").alias("label"), root.alias("_chg")), back, "dst", "src", n)
        won = found.where("label = 1").select("id", F.col("colour").alias("_s"))
        last, state = state, _buckets(state.join(won, "id", "left").select("id", F.coalesce("scc", "_s").alias("scc")), "id", n)
        release(last, colour, found)


def relax_cycles(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """GRF-2: remove, inside every strongly connected component, the edges with src < dst.

    Inside a component ids then strictly fall along kept edges and the condensation is
    acyclic, so the result is a DAG; only edges on a cycle are removed; all nodes stay.
    Returns (kept_edges, removed_edges).
    """
    edges = cut_lineage(edges)  # read four times below
    scc = strongly_connected(nodes, edges)
    tagged = (edges.join(scc.select(F.col("id").alias("src"), F.col("scc").alias("a")), "src")
              .join(scc.select(F.col("id").alias("dst"), F.col("scc").alias("b")), "dst"))
    drop = (F.col("a") == F.col("b")) & (F.col("src") < F.col("dst"))
    tagged = cut_lineage(tagged.withColumn("_drop", drop))
    release(scc, edges)
    kept = tagged.where(~F.col("_drop")).select("src", "dst")
    removed = tagged.where(F.col("_drop")).select("src", "dst")
    return kept, removed


#: edges and nodes of one block of ``dependency_levels``: what a task holds at once
BLOCK_EDGES, BLOCK_NODES = 500_000, 100_000
_PEELED = "block int, pending long, best int, level int, fresh boolean"


def _peel_block(state: pa.Table, inner: pa.Table) -> pa.Table:
    """One round of one block: every node that its own block's edges can place is placed, level by level."""
    ids = state.column("id").to_numpy()
    order = np.argsort(ids)
    pending, best = (state.column(c).to_numpy().copy() for c in ("pending", "best"))
    level = state.column("level").to_pandas().to_numpy(float)
    src, dst = (order[np.searchsorted(ids, inner.column(c).to_numpy(), sorter=order)] for c in ("src", "dst"))
    by = np.argsort(dst)
    src, ends = src[by], np.concatenate([[0], np.cumsum(np.bincount(dst, minlength=len(ids)))])
    fresh = np.zeros(len(ids), bool)
    ready = np.flatnonzero(np.isnan(level) & (pending == 0))
    while len(ready):
        level[ready], fresh[ready] = best[ready] + 1, True
        n = ends[ready + 1] - ends[ready]
        up = src[np.arange(n.sum()) + np.repeat(ends[ready] - np.cumsum(n) + n, n)]  # heads of the placed nodes' edges
        np.subtract.at(pending, up, 1)
        np.maximum.at(best, up, np.repeat(level[ready], n).astype(best.dtype))
        up = np.unique(up)
        ready = up[pending[up] == 0]
    return pa.table([state.column("id"), state.column("block"), pa.array(pending), pa.array(best), pa.array(level, from_pandas=True).cast(pa.int32()), pa.array(fresh)],
                    names=["id", "block", "pending", "best", "level", "fresh"])


def dependency_levels(nodes: DataFrame, dag: DataFrame, block_edges: int = BLOCK_EDGES, block_nodes: int = BLOCK_NODES) -> DataFrame:
    """GRF-3: level 0 for nodes without successors, else 1 + the greatest successor level.

    Peeling with pending-successor counts, over the nodes that some edge leads to; all other levels follow from these in
    one aggregation. The nodes are dealt to blocks by ranges of their ids. A round first takes what the round before placed across
    the edges between blocks, then every block places all that its own edges (stored with the block, read in place) allow, however
    many levels that is. So rounds grow with the crossings from block to block on a path, not with the levels, and every edge
    passes its level on once. A round that places nothing is on a cycle.
    """
    ship(nodes.sparkSession)
    e = adjacency(dag, "dst")
    all_nodes = nodes.select("id").distinct()
    n = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    inner = e.join(e.select(F.col("dst").alias("src")).distinct(), "src", "left_semi")
    heads = all_nodes.join(e.select(F.col("dst").alias("id")).distinct(), "id", "left_semi")
    n_nodes, n_edges = heads.count(), inner.count()
    blocks = max(1, n_nodes // block_nodes, n_edges // block_edges)
    at = cut_lineage(heads.repartitionByRange(blocks, "id").select("id", F.spark_partition_id().alias("block")))
    ends = (inner.join(at.select(F.col("id").alias("src"), F.col("block").alias("sb")), "src")
            .join(at.select(F.col("id").alias("dst"), F.col("block").alias("db")), "dst", "left"))
    ends = cut_lineage(ends)
    local = _buckets(ends.where("sb = db").select(F.col("sb").alias("block"), "src", "dst").repartition(blocks, "block"), "block", blocks)
    cross = _buckets(ends.where("sb <> db").select("dst", "src").repartition(n, "dst"), "dst", n, rows=F.count(F.lit(1)))
    out = ends.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("pending"))
    state = (at.join(out, "id", "left").select("id", "block", F.coalesce("pending", F.lit(0)).cast("bigint").alias("pending"), F.lit(-1).alias("best"),
                                               F.lit(None).cast("int").alias("level"), F.lit(False).alias("fresh")))
    last, schema = None, f"id {dict(at.dtypes)['id']}, {_PEELED}"
    while n_nodes:
        if last is not None:
            new = last.where("fresh").select(F.col("id").alias("dst"), F.col("level").alias("l"))
            got = cross.join(new, "dst").groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("d"), F.max("l").alias("m"))
            state = (last.join(got, "id", "left").select("id", "block", (F.col("pending") - F.coalesce("d", F.lit(0))).alias("pending"),
                                                         F.greatest("best", "m").alias("best"), "level", F.lit(False).alias("fresh")))
        state = state.groupBy("block").cogroup(local.groupBy("block")).applyInArrow(_peel_block, schema)
        before, last = last, _buckets(state, "block", blocks, left=F.count_if(F.col("level").isNull()), placed=F.count_if("fresh"))
        if before is None:
            release(ends)
        else:
            release(before)
        if not last.figures["left"]:
            break
        if not last.figures["placed"]:
            raise ValueError("graph has a cycle; relax it first")
    known = (last.select("id", "level") if last is not None else at.select("id", F.lit(0).alias("level"))).withColumnRenamed("id", "dst")
    top = e.join(known, "dst", "left").groupBy(F.col("src").alias("id")).agg((F.max("level") + 1).alias("level"), F.count_if(F.col("level").isNull()).alias("open"))
    found = _buckets(all_nodes.join(top, "id", "left").select("id", F.coalesce("level", F.lit(0)).cast("int").alias("level"), "open"), "id",
                     _few(nodes, max(n_nodes, n_edges)), open=F.sum("open"))
    release(e, at, local, cross, *([last] if last is not None else []))
    if found.figures["open"]:
        raise ValueError("an edge leads to no node")
    return found.select("id", "level")


def level_sizes(levels: DataFrame) -> DataFrame:
    """AGG-11 / GRF-4: members per level, lowest level first."""
    return levels.groupBy("level").agg(F.count(F.lit(1)).alias("n_nodes"))


def weak_components(nodes: DataFrame, edges: DataFrame, unroll: int = UNROLL) -> DataFrame:
    """GRF-6: component label = smallest id reachable ignoring direction.

    Min-label propagation with pointer jumping: each step first takes the smallest label
    among a changed node's neighbours, then replaces every label by its label's label.
    Labels only fall and always name a node of the same component, so the fixpoint is the
    component minimum; jumping halves label chains, so rounds grow with the logarithm of
    the diameter rather than with the diameter.
    """
    both = adjacency(edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))), "src")
    n = _state_buckets(nodes, both)
    state = _buckets(nodes.select("id", F.col("id").alias("label"), F.lit(True).alias("_chg")), "id", n)
    while True:
        last = state
        for _ in range(unroll):
            frontier = state.where("_chg").select(F.col("id").alias("src"), F.col("label").alias("l"))
            cand = both.join(frontier, "src").groupBy(F.col("dst").alias("_id")).agg(F.min("l").alias("m"))
            hop = (state.join(cand, F.col("id") == F.col("_id"), "left")
                   .select("id", F.col("label").alias("_old"),
                           F.least("label", F.coalesce("m", "label")).alias("label")))
            parent = hop.select(F.col("id").alias("label"), F.col("label").alias("_pl"))
            state = (hop.join(parent, "label", "left")
                     .select("id", F.least("label", F.coalesce("_pl", "label")).alias("label"), "_old")
                     .select("id", "label", (F.col("label") < F.col("_old")).alias("_chg")))
        state = _buckets(state, "id", n, changed=F.count_if("_chg"))
        release(last)
        if not state.figures["changed"]:
            release(both)
            return state.select("id", F.col("label").alias("component"))


def successors(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """GRF-7: direct successors of the given nodes, one row per (id, successor).

    Kept flat so a hub's successors are spread over tasks; nest only at a sink."""
    return (nodes.select("id").join(edges.select(F.col("src").alias("id"), F.col("dst").alias("successor")), "id")
            .distinct())


class LevelStore:
    """Results of a level-ordered job, written once under ``level=k``, and the edges once, partitioned by their source's level.

    A level reads the edge rows of its own level and, of the results, the levels that these edges lead to. Rows are
    written in order of their levels, so a level has as many files as it has full partitions; the results of ``MERGE`` levels
    become one folder when the last of them is there, so a level looks into few folders however deep the graph is. Columns of
    ``levels`` other than the level stay with the nodes.
    """

    MERGE = 16

    def __init__(self, levels: DataFrame, dag: DataFrame):
        self.spark = levels.sparkSession
        self.root = f"{checkpoint_dir(self.spark).rstrip('/')}/levels-{uuid.uuid4().hex}"
        n = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        at = levels.select("id", "level").distinct()
        up, down = at.select(F.col("id").alias("src"), "level"), at.select(F.col("id").alias("dst"), F.col("level").alias("dst_level"))
        dag.select("src", "dst").distinct().join(up, "src").join(down, "dst").repartitionByRange(n, "level", "src").write.partitionBy("level").parquet(f"{self.root}/edges")
        levels.repartitionByRange(n, "level", "id").write.partitionBy("level").parquet(f"{self.root}/nodes")
        edges = self.spark.read.schema("src bigint, dst bigint, dst_level int, level int").parquet(f"{self.root}/edges")
        pairs = edges.groupBy("level", "dst_level").agg(F.count(F.lit(1)).alias("n")).toLocalIterator()  # one row per pair of levels
        self.leads_to: dict[int, list[int]] = {}
        for r in pairs:
            self.leads_to.setdefault(r["level"], []).append(r["dst_level"])
        self.top = at.agg(F.max("level")).first()[0]
        self.schema = None
        self.place: dict[int, str] = {}  # folder with the results of a level
        self.node_schema = levels.drop("level").schema

    def nodes(self, level: int) -> DataFrame:
        return self.spark.read.schema(self.node_schema).parquet(f"{self.root}/nodes/level={level}")

    def children(self, level: int) -> DataFrame | None:
        """(id, child, the child's result columns) of the level's nodes; None where no edge leaves the level."""
        needed = [k for k in sorted(self.leads_to.get(level, ())) if k < level]
        if not needed or self.schema is None:
            return None
        edges = self.spark.read.schema("src bigint, dst bigint").parquet(f"{self.root}/edges/level={level}")
        found = self.spark.read.schema(self.schema).parquet(*sorted({self.place[k] for k in needed}))
        return edges.join(found.withColumnRenamed("id", "dst"), "dst").withColumnRenamed("src", "id").withColumnRenamed("dst", "child")

    def write(self, level: int, results: DataFrame) -> None:
        self.schema = results.schema
        self.place[level] = f"{self.root}/results/level={level}"
        results.write.mode("append").parquet(self.place[level])

    def merge(self, level: int) -> None:
        """After the last batch of ``level``: the results of the last ``MERGE`` levels into one folder."""
        few = range(level + 1 - self.MERGE, level + 1)
        if (level + 1) % self.MERGE:
            return
        old = self.spark.read.schema(self.schema).parquet(*[self.place[k] for k in few])
        path = f"{self.root}/results/to={level}"
        old.write.parquet(path)
        for k in few:
            done = self.spark.createDataFrame([], self.schema)
            done._checkpoint = self.place[k]
            release(done)
            self.place[k] = path

    def results(self, schema=None) -> DataFrame | None:
        if self.schema is None:
            return None
        out = self.spark.read.schema(self.schema).parquet(*sorted(set(self.place.values())))
        out._checkpoint = self.root  # ``release`` drops the whole store
        return out


def propagate_by_level(levels: DataFrame, dag: DataFrame, node_fn, batch_size: int | None = None):
    """GRF-5: process nodes level by level; each node sees only its direct successors' results.

    ``node_fn(frontier, child_results) -> DataFrame`` receives the nodes of one level (``id`` and further columns of ``levels``) and the rows that earlier levels
    produced for their direct successors (``id``, ``child`` and the child's result columns; None where no edge leaves
    the level) and returns result rows keyed by ``id``. Every result is written once (``LevelStore``). With ``batch_size`` a level is
    processed in batches of so many nodes in id order, one after the other; without it a level is one batch.
    ``session.release`` of the returned frame deletes the store.
    """
    store = LevelStore(levels, dag)
    for k in range((store.top if store.top is not None else -1) + 1):
        nodes, child = store.nodes(k), store.children(k)
        if batch_size is None:
            store.write(k, node_fn(nodes, child))
            store.merge(k)
            continue
        numbered = dense_index(nodes, ["id"], index_col="_i")
        placed = cut_lineage(numbered.withColumn("_b", F.floor(F.col("_i") / batch_size)).drop("_i"))
        release(numbered)
        for b in range(placed.agg(F.max("_b")).first()[0] + 1):
            batch = placed.where(F.col("_b") == b).drop("_b")
            store.write(k, node_fn(batch, child.join(batch, "id", "left_semi") if child is not None else None))
        release(placed)
        store.merge(k)
    return store.results()
