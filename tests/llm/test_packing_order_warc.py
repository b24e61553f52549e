"""Packing, training order and archives: exact round trips."""

import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tessera.llm import common, packing, training_order, warc
from tessera.llm.queries import QUERIES

from . import fixtures as X


@pytest.fixture(scope="module")
def tokenizer():
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return lambda text: t.encode(text or "", add_special_tokens=False).ids + [2]


SPACES = [(900 + k, t) for k, t in enumerate((
    "a  b", " a", "a ", "a \nb", "a\n b", "a\n\n b  \t c", "it's 'tis", "x<|endoftext|>y", "<|endoftext|>", "a <|endoftext|><|endoftext|>  b", "<|endoftext", "é à b", "　a b", "1 23,4 5", "  ", " "))]


def test_ids_equal_the_tokenizers_ids(tokenizer):
    files = packing.tokenizer_files()
    for _, t in SPACES + X.edge_rows():
        got = np.frombuffer(packing.encode(t, *files), "<u4").tolist() if t else []
        assert got + [2] == tokenizer(t)


def test_ids_next_to_every_kind_of_white_space(tokenizer):
    files = packing.tokenizer_files()
    kinds = [chr(c) for c in range(0x3001) if chr(c).isspace()] + ["\u200b", "\u180e", "\ufeff", "x"]
    for a in kinds:
        for t in [f"one{a}{b}two{a}three" for b in kinds] + [f"{a}one", f"one{a}", a]:
            assert np.frombuffer(packing.encode(t, *files), "<u4").tolist() + [2] == tokenizer(t), repr(t)


def _check_packing(rows, pieces, tokenizer, capacity=1024):
    ids = defaultdict(list)
    for i, t in rows:
        ids[i].append(tokenizer(t))
    per_doc, bins = defaultdict(list), defaultdict(list)
    for p in pieces:
        per_doc[p["doc_id"]].append(p)
        bins[p["sequence_id"]].append((p["offset"], p["length"]))
    want = Counter()
    for i, texts in ids.items():
        for t in texts:
            n, first = len(t), len(t) % capacity or capacity
            edges = [0, *range(first, n, capacity), n]
            for k, (a, z) in enumerate(zip(edges, edges[1:], strict=False)):
                want[i, k, a, z - a, zlib.crc32(np.array(t[a:z], "<u4").tobytes())] += 1
    assert Counter((p["doc_id"], p["piece"], p["start"], p["length"], p["ids_crc32"]) for p in pieces) == want
    for b in bins.values():
        at = 0
        for o, n in sorted(b):
            assert o == at
            at += n
        assert at <= capacity
    return len(bins), -(-sum(k[3] * c for k, c in want.items()) // capacity)


def test_edge_cases_are_packed_whole(spark, tokenizer):
    rows = X.edge_rows() + SPACES
    used, least = _check_packing(rows, packing.pack(packing.pieces(X.frame(spark, rows))).collect(), tokenizer)
    alone = sum(len(tokenizer(t)) % 1024 > 512 for _, t in rows)  # two of these never share a sequence
    assert used <= max(least, alone + sum(len(tokenizer(t)) // 1024 for _, t in rows)) + 2
    used, least = _check_packing(rows, packing.pack(packing.pieces(X.frame(spark, rows)), group_rows=9).collect(), tokenizer)


def test_query_is_nearly_full(spark, tokenizer):
    used, least = _check_packing(X.documents(spark), QUERIES["op8_best_fit_packing"](spark, X.SF).collect(), tokenizer)
    assert used <= 1.02 * least + 1


def test_sum_of_squares_choice():
    """Each placement has the smallest sum of squared open-bin counts per gap."""
    lengths = np.random.default_rng(2).integers(1, 21, 200)
    place, offset, gaps = packing.sum_of_squares(lengths, 20)
    level: list[int] = []
    for s, b, o in zip(lengths.tolist(), place.tolist(), offset.tolist(), strict=True):
        def cost(k, s=s):
            after = [*level, 0] if k == len(level) else list(level)
            after[k] += s
            return sum(v * v for v in Counter(20 - x for x in after if x < 20).values())

        options = [k for k in range(len(level)) if level[k] + s <= 20] + [len(level)]
        assert cost(b) == min(cost(k) for k in options)
        if b == len(level):
            level.append(0)
        assert o == level[b]
        level[b] += s
    assert [20 - x for x in level] == gaps.tolist()


def test_pack_empty(spark):
    assert packing.pack(packing.pieces(X.empty(spark))).count() == 0


@pytest.mark.parametrize("n", [1, 2, 3, 5, 64, 1000, 4097])
def test_feistel_is_a_bijection(n):
    f = training_order.Feistel(n, 42)
    slots = f.slots(np.arange(n))
    assert sorted(slots.tolist()) == list(range(n))
    assert f.sequences(slots).tolist() == list(range(n))
    assert n < 64 or (slots != training_order.Feistel(n, 43).slots(np.arange(n))).any()


def test_shards_round_trip(spark, tokenizer):
    docs = X.frame(spark, X.edge_rows())
    rows, folder, n = training_order.materialise(docs, seq_len=64, shard_slots=50)
    rows = rows.collect()
    assert sorted(r["slot"] for r in rows) == list(range(n))
    shards, f = training_order.Shards(folder), training_order.Feistel(n)
    by_slot = dict(shards.read())
    assert len(by_slot) == n
    assert [s for s, _ in shards.read(37, 70)] == list(range(37, min(n, 107)))
    for r in rows:
        assert f.slots([r["sequence"]])[0] == r["slot"] and r["shard"] == r["slot"] // 50
        assert zlib.crc32(by_slot[r["slot"]].tobytes()) == r["ids_crc32"]
    # the stream in the numbering's order holds every document's ids once
    got, want = Counter(), Counter()
    for r in rows:
        got.update(by_slot[r["slot"]][:r["n_ids"]].tolist())
    for _, t in X.edge_rows():
        want.update(tokenizer(t))
    assert got == want
    flat = [x for r in sorted(rows, key=lambda r: r["sequence"]) for x in by_slot[r["slot"]][:r["n_ids"]].tolist()]
    text = ",".join(map(str, flat))
    assert all(",".join(map(str, tokenizer(t))) in text for _, t in X.edge_rows())


def test_several_shards_a_reducer_and_no_leftovers(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(training_order, "REDUCERS", 1)
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    try:
        rows, folder, n = training_order.materialise(X.frame(spark, X.edge_rows()), path=str(tmp_path / "s"), seq_len=16, shard_slots=40)
        assert rows.count() == n and n > 400
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert sorted(p.name for p in (tmp_path / "s").iterdir()) == ["_SHARDS.json", *(training_order.shard_name(k) for k in range(-(-n // 40)))]
    assert [s for s, _ in training_order.Shards(folder).read()] == list(range(n))


def test_other_order_in_the_second_pass_raises(spark, monkeypatch):
    """As many ids, but another text first: the checksums differ."""
    real, calls = training_order._streams, []

    def streams(base, files, end_id):
        run = real(base, files, end_id)

        def changed(batches, swap=False):
            rows = list(run(batches))
            return reversed(rows) if __import__("os").path.exists(mark) else iter(rows)

        return changed

    import tempfile
    mark = tempfile.mkdtemp() + "/second"
    monkeypatch.setattr(training_order, "_streams", streams)
    stored = training_order.C.stored
    monkeypatch.setattr(training_order.C, "stored", lambda df, name: (open(mark, "w").close(), stored(df, name))[1])
    with pytest.raises(Exception, match="changed between the passes"):
        training_order.materialise(spark.createDataFrame([(1, "a b c"), (2, "c d e")], "doc_id long, text string").coalesce(1))


def test_order_query_and_empty(spark):
    got = QUERIES["op4_training_order"](spark, X.SF).collect()
    assert sorted(r["slot"] for r in got) == list(range(len(got)))
    assert all(r["ids_crc32"] == r["stored_crc32"] for r in got)
    rows, folder, n = training_order.materialise(X.empty(spark))
    assert n == 0 and rows.count() == 0 and list(training_order.Shards(folder).read()) == []


PAGES = [(1, "u1", "x" * 200), (2, "u2", "x" * 200), (3, "u3", "y" * 99), (4, "u4", "y" * 99), (5, None, None), (6, "u6", ""),
         (7, "u7", "é" * 60), (9, "u9", "é" * 60), (8, "u8", "é" * 60), (None, "n", "x" * 200), (10, "ten\r\nWARC-Type: evil", "z" * 300_000), (1, "u1", "x" * 200)]


def _brute_pages(pages):
    first = {}
    for i, _, h in pages:
        b = (h or "").encode()
        if len(b) >= 100 and i is not None:
            first[b] = min(first.get(b, i), i)
    out = []
    for i, _, h in pages:
        b = (h or "").encode()
        ref = first.get(b) if i is not None else None
        again = ref is not None and ref != i
        out.append((i, len(b), hashlib.sha256(b).hexdigest(), "revisit" if again else "response", ref if again else None))
    return sorted(out, key=repr)


@pytest.mark.parametrize("compression,hot", [("gzip", 10_000), ("none", 1)])
def test_archives_round_trip(spark, compression, hot, monkeypatch):
    monkeypatch.setattr(warc, "HOT_DIGESTS", hot)
    path = common.scratch(spark, "warc")
    pages = spark.createDataFrame([(*r, 1, "k") for r in PAGES], "page_id long, url string, html string, digest int, key string").repartition(3)
    warc.write_pages(pages, path, compression)
    assert sorted(map(tuple, warc.page_report(spark, path).collect()), key=repr) == _brute_pages(PAGES)
    back = {r["record_id"]: r for r in warc.read_records(spark, path).collect()}
    assert bytes(back["urn:page:10"]["payload"]) == b"z" * 300_000 and back["urn:page:10"]["record_type"] == "response"
    only = spark.read.format("warc").option("recordTypes", "revisit").option("headerEquals", "WARC-Refers-To=urn:page:1").load(path)
    assert {r["record_id"] for r in only.collect()} == {"urn:page:2"}
    pushed = warc.read_records(spark, path).where("record_type = 'revisit' and refers_to = 'urn:page:7'")
    assert {r["record_id"] for r in pushed.collect()} == {"urn:page:8", "urn:page:9"}


def test_unwanted_payloads_are_not_decoded():
    """A reader that skips a record neither inflates nor reads its payload."""
    import io

    class Counted(io.BytesIO):
        got = 0

        def size(self):
            return len(self.getvalue())

        def read(self, *a):
            b = super().read(*a)
            self.got += len(b)
            return b

    big = np.random.default_rng(0).bytes(500_000)
    data = b"".join(warc.record_bytes([("WARC-Type", "response")], big, g) for g in (True, False, True))
    f = Counted(data)
    assert len([h for h, _ in warc.Records(f, "x")]) == 3 and f.got < 20_000
    assert [p() for _, p in warc.Records(Counted(data), "x")] == [big] * 3
    with pytest.raises(ValueError):
        list(warc.Records(Counted(b"no archive at all" * 100), "x"))


def test_warc_query_and_empty(spark):
    pages = [tuple(r) for r in spark.read.parquet(f"{X.SF}/pages.parquet").select("page_id", "url", "html").collect()]
    assert sorted(map(tuple, QUERIES["op6_warc"](spark, X.SF).collect()), key=repr) == _brute_pages(pages)
    path = common.scratch(spark, "warc")
    warc.write_pages(spark.createDataFrame([], "page_id long, url string, html string"), path)
    assert warc.page_report(spark, path).count() == 0


def test_archives_of_other_tools(spark):
    """Plain gzip members (one a record, all in one, a record over two), header names in any case and without white space."""
    import gzip
    import os
    import random

    import pyarrow.fs as pafs

    noise = random.Random(1).randbytes(200_000)
    records = [("warc-type: response\r\nwarc-record-id:urn:page:1\r\ncontent-length:200000", noise),
               ("WARC-Type:response\r\nWARC-Record-ID: <urn:page:2>\r\nContent-Length:  3", b"abc"),
               ("WARC-TYPE:\trevisit\r\nWARC-Record-ID:urn:page:3\r\nCONTENT-LENGTH: 0", b"")]
    raw = [b"WARC/1.0\r\n" + h.encode() + b"\r\n\r\n" + p + b"\r\n\r\n" for h, p in records]
    whole = b"".join(raw)
    sl = warc.record_bytes([("WARC-Type", "response"), ("WARC-Record-ID", "urn:page:4")], b"own", True)
    forms = {"each": b"".join(map(gzip.compress, raw)), "one": gzip.compress(whole), "torn": gzip.compress(whole[:150_000]) + gzip.compress(whole[150_000:]),
             "mixed": b"".join(map(gzip.compress, raw)) + sl, "plain": whole}
    for name, data in forms.items():
        path = common.scratch(spark, "warc")
        fs, folder = warc.open_fs(path)
        fs.create_dir(folder, recursive=True)
        with fs.open_output_stream(os.path.join(folder, "a.warc" + ".gz" * (name != "plain")), compression=None) as f:
            f.write(data)
        want = [("urn:page:1", "response", 200_000, noise), ("<urn:page:2>", "response", 3, b"abc"), ("urn:page:3", "revisit", 0, b"")]
        want += [("urn:page:4", "response", 3, b"own")] * (name == "mixed")
        rows = warc.read_records(spark, path).select("record_id", "record_type", "payload_length", "payload").collect()
        assert sorted((*r[:3], bytes(r[3])) for r in rows) == sorted(want), name
        assert warc.read_records(spark, path, payload=False).where("record_type = 'response'").count() == len(want) - 1
        only = spark.read.format("warc").option("recordTypes", "revisit").option("headerEquals", "WARC-Record-ID=urn:page:3").load(path)
        assert only.count() == 1
    cut = forms["one"][:1000]
    with pafs.LocalFileSystem().open_input_file(_file(spark, cut)) as f, pytest.raises(ValueError):
        list(warc.Records(f, "x"))


def _file(spark, data):
    fs, path = warc.open_fs(common.scratch(spark, "warc"))
    with fs.open_output_stream(path, compression=None) as f:
        f.write(data)
    return path
