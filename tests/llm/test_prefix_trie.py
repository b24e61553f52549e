import hashlib
import random
import zlib

import pytest

from tessera.llm import prefix_trie as T
from tessera.llm.queries import QUERIES

SCHEMA = "conv_id long, turn long, role string, text string, hi long, depth long, n long, size string"


def frame(spark, rows, parts=5):
    return spark.createDataFrame([(*r, 1, 2, 3, "x") for r in rows], SCHEMA).repartition(parts)


def contract(own):
    """Rebuilt conversations, straight from the statement."""
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = own.get(c - c % 100, [])[:h] + turns[h:]
    return out


def as_they_are(own):
    return own


def brute(rows, rebuild):
    own = {}
    for c, turn, role, text in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], (r[1] is not None, r[1] or 0), r[2] or "")):
        own.setdefault(c, []).append((role or "", text or ""))
    seqs = {c: tuple(s) for c, s in rebuild(own).items()}
    members, kids = {}, {}
    for c, s in seqs.items():
        for d in range(len(s) + 1):
            members.setdefault(s[:d], []).append(c)
            if d:
                kids.setdefault(s[:d - 1], set()).add(s[:d])
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        below = kids.get(node, ())
        leaves[node] = sum(leaves[k] for k in below) if below else 1
        saved[node] = (len(members[node]) - 1) * (len(node[-1][1]) if node else 0) + sum(saved[k] for k in below)
    return sorted(((min(m), len(n), min(members[n[:-1]]) if n else None, len(m), len(kids.get(n, ())), leaves[n], saved[n],
                    hashlib.sha256(",".join(map(str, sorted(c for c in m if len(seqs[c]) == len(n)))).encode()).hexdigest())
                   for n, m in members.items()), key=repr)


def _rows(df):
    assert df.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted(map(tuple, df.collect()), key=repr)


def conversations(seed, n=150, longest=9):
    r, rows = random.Random(seed), []
    for c in r.sample(range(-120, 520), n):
        for t in range(r.randrange(1, longest)):
            rows.append((c, None if t == 0 and r.random() < 0.3 else t, r.choice(["user", "system"]) if t % 3 else "user", r.choice(["a", "bb", "çé", "", None])))
    return rows


@pytest.mark.parametrize("local", [1 << 16, 300])
def test_random_conversations(spark, local):
    rows = conversations(local) + [(7, k, None, "abc"[k % 3]) for k in range(20, 60)] + [(8, k, None, "abc"[k % 3]) for k in range(20, 50)]
    rows += [(None, 1, "user", "x"), (None, None, None, None), (105, 3, "user", "same"), (105, 3, "user", "same"), (106, None, None, None)]
    got = T.prefix_trie(frame(spark, rows), local=local)
    assert _rows(got) == brute(rows, contract)


def test_long_conversations_span_partitions(spark):
    """Two conversations with most of all rows, one of which others begin with; a component of one path."""
    rows = [(200, k, "user", f"t{k % 50}") for k in range(700)] + [(317, k, "user", f"t{k % 50}") for k in range(400)]
    rows += [(c, k, "user", f"t{k}") for c in (201, 202, 203, 300, 318, 319) for k in range(6)]
    got = T.prefix_trie(frame(spark, rows), local=2000)
    assert _rows(got) == brute(rows, contract)


def test_plain_conversations_and_hot_nodes(spark, monkeypatch):
    monkeypatch.setattr(T.C, "HOT_SHARE", 3)
    monkeypatch.setattr(T, "CHUNK", 4)
    rows = conversations(5, 300, 4)
    assert _rows(T.prefix_trie(frame(spark, rows), T.own_turns, 100)) == brute(rows, as_they_are)


def test_centroids_in_memory():
    r = random.Random(4)
    for n in [1, 2, 5, 60, 400]:
        for kind in range(3):
            parent = [-1] + [(v - 1 if kind == 0 else r.randrange(v) if kind == 1 else 0) for v in range(1, n)]
            own = [(r.randrange(9), 1) for _ in range(n)]
            want, below = [list(o) for o in own], [1] * n
            for v in range(n - 1, 0, -1):
                want[parent[v]] = [x + y for x, y in zip(want[parent[v]], want[v], strict=True)]
                below[parent[v]] += below[v]
            assert T.split_component(parent, below, own) == want


def test_carry_over_partitions():
    """Any cut of the sorted turns into partitions gives the chain values of one partition."""
    r = random.Random(6)
    turns = [(c, r.randrange(1 << 120)) for c in sorted(r.sample(range(100, 330), 40)) for _ in range(r.randrange(1, 9))]
    by = {}
    for c, t in turns:
        by.setdefault(c, []).append(t)
    for _ in range(50):
        cuts = sorted(r.sample(range(1, len(turns)), 12))
        summaries = {}
        for p, (a, z) in enumerate(zip([0, *cuts], [*cuts, len(turns)], strict=True)):
            part = turns[a:z]
            own = lambda c: [t for x, t in part if x == c]  # noqa: E731, B023
            last, group = part[-1][0], part[-1][0] // 100 * 100
            value = 0
            for t in own(last):
                value = (value * T.BASE + t + 1) % T.PRIME
            summaries[p] = {"conv": last, "n": len(own(last)), "lead": [part[0][0], len(own(part[0][0]))], "value": value, "group": group,
                            "first": [(t, 1) for t in own(last)][:5], "head": [(t, 1) for t in own(group)][:5] or None}
        start, spans = T.entries(summaries, T.rebuilt)
        for p, cut in enumerate(cuts, 1):
            c = turns[cut - 1][0]
            seen = sum(x == c for x, _ in turns[:cut])
            base, h = T.rebuilt(c)
            chain = T.ROOT
            for t in (by.get(base, [])[:h] if base != c else []) + by[c][h:seen]:
                chain = T.step(chain, t)
            assert (start[p]["conv"], start[p]["seen"], start[p]["chain"]) == (c, seen, chain)
        assert all(spans[c] == len(by[c]) for c in spans)


def test_query_matches_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    rows = [tuple(x) for x in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert _rows(QUERIES["op11_prefix_trie"](spark, sf)) == brute(rows, contract)


def test_empty_table(spark):
    assert T.prefix_trie(spark.createDataFrame([], SCHEMA)).count() == 0
