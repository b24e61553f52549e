"""Conversation prefix trie with a balanced rollup by centroid decomposition.

Every distinct sequence of the first d turns (role, text) of the conversations is a node; its members are the
conversations that start with it. Shared prefixes are what a cache of attention states could save.

1. Turns, without their texts (two hashes and a length), are sorted by (conversation, turn) over range partitions, so a
   conversation of any length spreads over several. A turn's node is the chain hash of its prefix (127 bits), a
   Horner scheme modulo 2^127 - 1. Each partition gives one summary row of its last conversation (rows, chain value), from
   which the driver composes the state with which every partition starts: one row per partition, never a conversation.
2. Nodes are one partial aggregation over (conversation, node) rows. It also gives ``below``: the number of these rows at or
   below the node, a weight that shrinks along every edge.
3. Centroid decomposition of the parent-edge forest. The centroid of a component is its deepest node with half of
   the component's weight or more below it. Its part (itself and what hangs below it in the component) is
   totalled by a partial aggregation, and the total is added to the nodes on the path from the centroid to the
   component's top. Without the centroid the component falls into its children's parts and the rest above, each of at
   most half the weight; so it goes on, in rounds over all components at once, until a component weighs at
   most ``local``. Such a component goes whole to one task, which goes on splitting it in the same way. A node's
   sum is what its own part totalled plus what was added to it before. Rounds grow with the logarithm of the weight, not with
   the depth of the trie.
4. The members that end at a node are joined in chunks of ``CHUNK`` ids (at most so many a row) and hashed chunk after
   chunk in id order, in constant memory.

Joins on a parent or a node that many rows hold go through ``common.attach``: hot keys, at most a fixed number, by broadcast.

Defined cases: null role or text counts as empty; a null turn comes first; equal turns are ordered by role, then by
hashes of the content, and each counts; rows with a null conv_id are left out; repeated rows are turns each; long texts are
hashed by the JVM; extra columns are ignored; an empty table has no nodes.
"""

from __future__ import annotations

import hashlib
import json
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

PRIME = (1 << 127) - 1
BASE = 0x5851F42D4C957F2D14057B7EF767814F
ROOT = 1
LOCAL = 1 << 16
CHUNK = 4096
SHARED = 5  # turns of another conversation that a rebuilt one may begin with


def _split(state: int) -> tuple[int, int]:
    lo = state & 0xFFFFFFFFFFFFFFFF
    return state >> 64, lo - (1 << 64) if lo >> 63 else lo


def step(state: int, turn: int) -> int:
    return (state * BASE + turn + 1) % PRIME


def own_turns(conv: int) -> tuple[int, int]:
    """A conversation as it is: no other one to begin with, no turns to leave out."""
    return conv, 0


def rebuilt(conv: int) -> tuple[int, int]:
    """The conversation whose first turns a rebuilt one begins with, and how many of them replace its own."""
    base = conv - conv % 100
    return base, 0 if base == conv else zlib.crc32(str(conv).encode()) % 6


def _sorted_turns(turns: DataFrame) -> DataFrame:
    """conv, a, b (content hashes), size (code points), in order within range partitions."""
    role, text = F.coalesce(turns["role"].cast("string"), F.lit("")), F.coalesce(turns["text"].cast("string"), F.lit(""))
    rows = (turns.where(turns["conv_id"].isNotNull())
            .select(turns["conv_id"].cast("long").alias("conv"), turns["turn"].alias("turn"), role.alias("role"), F.xxhash64(role, text).alias("a"),
                    F.xxhash64(F.lit("second"), text, role).alias("b"), F.length(text).cast("long").alias("size")))
    order = ["conv", F.col("turn").asc_nulls_first(), "role", "a", "b"]
    return rows.repartitionByRange(C.partitions(turns.sparkSession), *order).sortWithinPartitions(*order).select("conv", "a", "b", "size")


def _numbered(rows: DataFrame, begin) -> DataFrame:
    """(part, pos, conv, a, b, size) rows, and one summary row per partition (pos -1, the summary as JSON)."""

    def scan(batches):
        part, pos = TaskContext.get().partitionId(), 0
        conv = n = value = first = lead = None
        group = head = None  # the conversation that others of its group may begin with, and its first turns
        for b in batches:
            if not b.num_rows:
                continue
            for c, x, y, size in C.rows_of(b):
                t = (x % (1 << 64) << 64 | y % (1 << 64)) % PRIME
                if c != conv:
                    if conv is not None and lead is None:
                        lead = [conv, n]
                    conv, n, value, first = c, 0, 0, []
                    if begin(c)[0] != group:
                        group, head = begin(c)[0], None
                    if c == group:
                        head = first
                n, value = n + 1, (value * BASE + t + 1) % PRIME
                if n <= SHARED:
                    first.append((t, size))
            at = pa.array(np.arange(pos, pos + b.num_rows))
            pos += b.num_rows
            yield pa.RecordBatch.from_arrays([pa.array([part] * b.num_rows, pa.int32()), at, *b.columns, pa.nulls(b.num_rows, pa.string())], names=names)
        if conv is not None:
            said = json.dumps({"conv": conv, "n": n, "lead": lead or [conv, n], "value": value, "first": first, "group": group, "head": head})
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([-1], pa.int64()), *(pa.array([0], pa.int64()) for _ in range(4)),
                                              pa.array([said])], names=names)

    names = ["part", "pos", "conv", "a", "b", "size", "summary"]
    return rows.mapInArrow(scan, "part int, pos long, conv long, a long, b long, size long, summary string")


def entries(summaries: dict[int, dict], begin) -> tuple[dict[int, dict], dict[int, int]]:
    """State with which each partition starts, and the turns of the conversations that partitions end or start with."""
    state, out, spans = None, {}, {}
    for part in sorted(summaries):
        s = summaries[part]
        out[part] = state
        lead, n = s["lead"]
        if state and lead == state["conv"]:
            spans[lead] = state["seen"] + n
        goes_on = state is not None and state["conv"] == s["conv"]  # the partition holds nothing else
        head = s["head"]
        if state and state["group"] == s["group"]:
            head = [*(state["head"] or []), *(head or [])][:SHARED]
        seen, chain = (state["seen"], state["chain"]) if goes_on else (0, begun(s["conv"], head, begin)[0])
        left = max(0, min(s["n"], begin(s["conv"])[1] - seen))  # turns of this partition that are replaced
        replaced = 0
        for t, _ in s["first"][:left]:
            replaced = (replaced * BASE + t + 1) % PRIME
        shift = pow(BASE, s["n"] - left, PRIME)
        chain = (chain * shift + s["value"] - replaced * shift) % PRIME
        state = {"conv": s["conv"], "seen": seen + s["n"], "chain": chain, "group": s["group"], "head": head}
        spans[s["conv"]] = state["seen"]
    return out, spans


def begun(conv: int, head: list | None, begin) -> tuple[int, list]:
    """Chain value and (value, size) of the turns that a conversation takes from another."""
    base, skip = begin(conv)
    chain, rows = ROOT, []
    if base != conv:
        for t, size in (head or [])[:skip]:
            chain = step(chain, t)
            rows.append((chain, size))
    return chain, rows


def paths(turns: DataFrame, begin=rebuilt) -> DataFrame:
    """(conv, depth, hi, lo, phi, plo, size, turns): one row per conversation and prefix, the root included (depth 0)."""
    spark = turns.sparkSession
    C.ship(spark)
    numbered = C.stored(_numbered(_sorted_turns(turns), begin), "turns")
    summaries = {r["part"]: json.loads(r["summary"]) for r in numbered.where("summary is not null").select("part", "summary").toLocalIterator()}
    start, spans = entries(summaries, begin)
    shared = spark.sparkContext.broadcast((start, spans))

    def scan(batches):
        start, spans = shared.value
        part = None
        held: list = []  # this partition's turns of the current conversation
        conv = seen = chain = group = head = None
        out: list = []

        def close():
            """Rows of the current conversation's turns in this partition."""
            nonlocal seen, chain, head, held
            if conv is None or not held:
                return
            base, skip = begin(conv)
            if conv == base:
                head = [*(head or []), *held][:SHARED] if seen else held[:SHARED]
            total = spans.get(conv, seen + len(held))
            taken = []
            if not seen:
                chain, taken = begun(conv, head, begin)
            k = 0 if base == conv else min(skip, len(head or []))
            length = k + max(0, total - skip)
            if not seen:
                rows = [(ROOT, None, 0), *((c, p, size) for (c, size), p in zip(taken, [ROOT, *(c for c, _ in taken)], strict=False))]
                emit(rows, 0, length)
            left = max(0, min(len(held), skip - seen))
            rows = []
            for t, size in held[left:]:
                last, chain = chain, step(chain, t)
                rows.append((chain, last, size))
            emit(rows, k + 1 + max(0, seen - skip), length)
            seen += len(held)
            held = []

        def emit(rows, depth, length):
            for d, (c, p, size) in enumerate(rows, depth):
                out.append((conv, d, *_split(c), *(_split(p) if p is not None else (None, None)), size, length))

        def batch():
            cols = list(zip(*out, strict=True)) or [()] * 8
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["conv", "depth", "hi", "lo", "phi", "plo", "size", "turns"])

        for b in batches:
            for p, c, x, y, size in C.rows_of(b):
                if p != part:
                    close()
                    part, s = p, start[p]
                    conv, seen, chain, group, head = (s["conv"], s["seen"], s["chain"], s["group"], s["head"]) if s else (None, 0, ROOT, None, None)
                if c != conv:
                    close()
                    conv, seen = c, 0
                    if begin(c)[0] != group:
                        group, head = begin(c)[0], None
                held.append(((x % (1 << 64) << 64 | y % (1 << 64)) % PRIME, size))
            if len(out) > 20_000:
                yield batch()
        close()
        yield batch()

    dealt = (numbered.where("summary is null").repartition(C.partitions(spark), "part").sortWithinPartitions("part", "pos").select("part", "conv", "a", "b", "size"))
    found = C.stored(dealt.mapInArrow(scan, "conv long, depth long, hi long, lo long, phi long, plo long, size long, turns long"), "paths")
    C.discard(numbered)
    return found


def split_component(parent: list[int], below: list[int], own: list[tuple[int, ...]]) -> list[list[int]]:
    """Sums of ``own`` over each node's subtree by centroid decomposition, in memory.

    ``parent``: place of the parent, -1 for a top; ``below``: a weight that shrinks along every edge.
    """
    n, below = len(parent), list(below)
    kids: list[list[int]] = [[] for _ in range(n)]
    for v, p in enumerate(parent):
        if p >= 0:
            kids[p].append(v)
    gone, width = bytearray(n), len(own[0]) if own else 0
    total = [[0] * width for _ in range(n)]
    todo = [v for v in range(n) if parent[v] < 0]
    while todo:
        top = c = todo.pop()
        half = below[top]
        while True:
            heavy = next((u for u in kids[c] if not gone[u] and 2 * below[u] >= half), None)
            if heavy is None:
                break
            c = heavy
        part, queue = [0] * width, [c]
        for v in queue:
            part = [x + y for x, y in zip(part, own[v], strict=True)]
            queue += [u for u in kids[v] if not gone[u]]
        total[c] = [x + y for x, y in zip(total[c], part, strict=True)]
        v = c
        while v != top:
            v = parent[v]
            below[v] -= below[c]
            total[v] = [x + y for x, y in zip(total[v], part, strict=True)]
        gone[c] = 1
        todo += [u for u in kids[c] if not gone[u]]
        if c != top:
            todo.append(top)
    return total


def rollup(nodes: DataFrame, path: DataFrame, measures: list[str], local: int = LOCAL) -> DataFrame:
    """``nodes`` with each of ``measures`` (long) replaced by its sum over the node's subtree.

    ``nodes``: hi, lo, phi, plo, conv (a member), depth, below, measures, any others. ``path``: (conv, depth, hi, lo, phi, plo)
    of every member's prefixes.
    """
    names = nodes.columns
    acc = [f"acc_{m}" for m in measures]
    part = ["chi", "clo"]
    open_ = nodes.select("*", *[F.lit(0).cast("long").alias(a) for a in acc],
                         F.lit(_split(ROOT)[0]).cast("long").alias("chi"), F.lit(_split(ROOT)[1]).cast("long").alias("clo"))
    closed, small = [], []
    while True:
        weight = open_.groupBy(*part).agg(F.max("below").alias("weight"))
        big = C.stored(weight.where(F.col("weight") > local), "components")
        n = big.count()
        if not n:
            small.append(open_)
            break
        small.append(open_.join(_few(big.drop("weight"), n), part, "left_anti"))
        large = open_.join(_few(big, n), part)
        centre = C.stored(large.where("2 * below >= weight").groupBy(*part).agg(F.min(F.struct("below", "hi", "lo", "conv", "depth")).alias("c"))
                          .select(*part, *[F.col(f"c.{k}").alias(f"c_{k}") for k in ("below", "hi", "lo", "conv", "depth")]), "centroids")
        # conversations that go on below a centroid, with the child they go to
        at = (path["phi"] == centre["c_hi"]) & (path["plo"] == centre["c_lo"])
        through = path.join(_few(centre, n), at).select(F.col("conv").alias("t_conv"), *[F.col(k).alias(f"t_{k}") for k in part], F.col("hi").alias("b_hi"), F.col("lo").alias("b_lo"))
        known = large.drop("weight").join(_few(centre.select(*part, "c_hi", "c_lo", "c_depth"), n), part)
        on = (known["conv"] == through["t_conv"]) & (known["chi"] == through["t_chi"]) & (known["clo"] == through["t_clo"])
        marked = (known.join(through, on, "left").drop("t_conv", "t_chi", "t_clo")
                  .withColumn("is_c", (F.col("hi") == F.col("c_hi")) & (F.col("lo") == F.col("c_lo")))
                  .withColumn("lower", F.col("b_hi").isNotNull() & (F.col("depth") > F.col("c_depth"))))
        marked = C.stored(marked, "marked")
        totals = C.stored(marked.where("is_c or lower").groupBy(*part).agg(*[F.sum(m).alias(f"t_{m}") for m in measures]), "totals")
        with_total = _few(totals, n)
        plus = [(F.col(a) + F.coalesce(F.col(f"t_{m}"), F.lit(0))).alias(a) for a, m in zip(acc, measures, strict=True)]
        rest = [c for c in names if c not in ("below", *measures)]
        closed.append(marked.where("is_c").join(with_total, part)
                      .select(*rest, "below", *[(F.col(a) + F.col(f"t_{m}")).alias(m) for a, m in zip(acc, measures, strict=True)]))
        # strict ancestors of a centroid; those above its component's top meet no row of the component
        up = (path.join(_few(centre, n), path["conv"] == centre["c_conv"]).where("depth < c_depth")
              .select(*part, F.col("hi"), F.col("lo"), "c_below").join(with_total, part))
        above = (marked.where("not is_c and not lower").join(up, [*part, "hi", "lo"], "left")
                 .select(*rest, (F.col("below") - F.coalesce("c_below", F.lit(0))).alias("below"), *measures, *plus, *part))
        below = marked.where("lower").select(*rest, "below", *measures, *acc, F.col("b_hi").alias("chi"), F.col("b_lo").alias("clo"))
        open_ = C.stored(above.unionByName(below), "forest")
    whole = small[0]
    for s in small[1:]:
        whole = whole.unionByName(s)
    done = _locally(whole, names, measures, acc)
    for c in closed:
        done = done.unionByName(c.select(*names))
    return done


def _few(df: DataFrame, n: int) -> DataFrame:
    """One row per large component (``n`` of them): broadcast where they are few."""
    return F.broadcast(df) if n <= C.BROADCAST_ROWS else df


def _locally(rows: DataFrame, names: list[str], measures: list[str], acc: list[str]) -> DataFrame:
    """The rest of the decomposition, component by component, in the tasks."""
    kinds = dict(rows.dtypes)
    dealt = (rows.select(*names, *acc, "chi", "clo").repartition(C.partitions(rows.sparkSession), "chi", "clo")
             .sortWithinPartitions("chi", "clo", "depth", "hi", "lo"))
    at = {c: k for k, c in enumerate(dealt.columns)}

    def scan(batches):
        held = []
        for b in batches:
            if not b.num_rows:
                continue
            chi, clo = (b.column(at[c]).to_numpy(zero_copy_only=False) for c in ("chi", "clo"))
            edge = np.flatnonzero((np.diff(chi) != 0) | (np.diff(clo) != 0))
            if held and (held[-1].column(at["chi"])[-1].as_py(), held[-1].column(at["clo"])[-1].as_py()) != (int(chi[0]), int(clo[0])):
                yield settle(held)
                held = []
            if len(edge):  # all but the last component are complete
                cut = int(edge[-1]) + 1
                yield settle([*held, b.slice(0, cut)])
                held = [b.slice(cut)]
            else:
                held.append(b)
        if held:
            yield settle(held)

    def settle(held):
        t = pa.Table.from_batches(held).combine_chunks()
        rows = list(zip(*(t.column(c).to_pylist() for c in ("chi", "clo", "hi", "lo", "phi", "plo")), strict=True))
        place = {r[:4]: k for k, r in enumerate(rows)}
        parent = [place.get((*r[:2], r[4], r[5]), -1) for r in rows]
        own = list(zip(*(t.column(m).to_pylist() for m in measures), strict=True))
        total = split_component(parent, t.column("below").to_pylist(), own)
        more = list(zip(*(t.column(a).to_pylist() for a in acc), strict=True))
        sums = {m: pa.array([x[k] + y[k] for x, y in zip(total, more, strict=True)], pa.int64()) for k, m in enumerate(measures)}
        cols = [sums[c] if c in sums else t.column(c).combine_chunks() for c in names]
        return pa.RecordBatch.from_arrays([c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in cols], names=names)

    return dealt.mapInArrow(scan, ", ".join(f"{c} {kinds[c]}" for c in names))


def ends(path: DataFrame) -> DataFrame:
    """(hi, lo, ends_sha256) of the nodes at which members end."""
    chunks = (path.where("depth = turns").groupBy("hi", "lo", F.floor(F.col("conv") / CHUNK).alias("chunk")).agg(F.array_sort(F.collect_list("conv")).alias("ids"))
              .select("hi", "lo", "chunk", F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids")))
    dealt = chunks.repartition(C.partitions(path.sparkSession), "hi", "lo").sortWithinPartitions("hi", "lo", "chunk").select("hi", "lo", "ids")

    def scan(batches):
        last = h = None
        for b in batches:
            out = []
            for hi, lo, ids in C.rows_of(b):
                if (hi, lo) != last:
                    if h is not None:
                        out.append((*last, h.hexdigest()))
                    last, h = (hi, lo), hashlib.sha256(ids.encode())
                else:
                    h.update(b"," + ids.encode())
            yield batch(out)
        if h is not None:
            yield batch([(*last, h.hexdigest())])

    def batch(rows):
        cols = list(zip(*rows, strict=True)) or [(), (), ()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.string()), strict=True)], names=["hi", "lo", "ends_sha256"])

    return dealt.mapInArrow(scan, "hi long, lo long, ends_sha256 string")


def prefix_trie(turns: DataFrame, begin=rebuilt, local: int = LOCAL) -> DataFrame:
    """Per node: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    ``begin`` maps a conversation to the one whose first turns it begins with and the number of own turns that these replace, at
    most ``SHARED``. The ids that begin with the same one must be a range that starts with it. ``own_turns`` takes
    conversations as they are.
    """
    path = paths(turns, begin)
    nodes = C.stored(path.groupBy("hi", "lo").agg(F.first("phi").alias("phi"), F.first("plo").alias("plo"), F.first("depth").alias("depth"), F.first("size").alias("size"),
                                                  F.min("conv").alias("conv"), F.count(F.lit(1)).alias("n_convs"), F.sum("turns").alias("turns")), "nodes")
    children = nodes.where("depth > 0").groupBy(F.col("phi").alias("hi"), F.col("plo").alias("lo")).agg(F.count(F.lit(1)).alias("n_children"))
    full = C.stored(nodes.join(children, ["hi", "lo"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))), "nodes")
    parents = full.where("n_children > 0").select(F.col("hi").alias("phi"), F.col("lo").alias("plo"), F.col("conv").alias("parent_conv_id"), F.col("n_children").alias("n"))
    met = C.attach(full, parents, ["phi", "plo"], "n")
    forest = C.stored(met.select("hi", "lo", "phi", "plo", "conv", "depth", "parent_conv_id", "n_convs", "n_children",
                                 (F.col("turns") - F.col("n_convs") * (F.col("depth") - 1)).alias("below"),
                                 (F.col("n_children") == 0).cast("long").alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("size")).alias("saved_tokens")), "forest")
    C.discard(nodes, full)
    rolled = rollup(forest, path, ["n_leaves", "saved_tokens"], local)
    return (rolled.join(ends(path), ["hi", "lo"], "left")
            .select(F.col("conv").alias("conv_id"), "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
                    F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256")))
