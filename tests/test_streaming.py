import json
import os
import tempfile

from tessera.streaming.refresh import run_refresh_stream


def test_refresh_stream_available_now(spark):
    d = tempfile.mkdtemp(prefix="tessera-stream-")
    incoming = os.path.join(d, "in")
    os.makedirs(incoming)
    with open(os.path.join(incoming, "a.json"), "w") as fh:
        json.dump([{"id": 1, "example": "abc", "rewrite": "xyz"}, {"id": 2, "example": "q", "rewrite": "r"}], fh)
    out = run_refresh_stream(spark, incoming, os.path.join(d, "corpus"), os.path.join(d, "ck"))
    rows = {r["id"]: r for r in out.collect()}
    assert set(rows) == {1, 2} and rows[1]["example_embedding"] is not None
    with open(os.path.join(incoming, "b.json"), "w") as fh:
        json.dump([{"id": 2, "example": "q2", "rewrite": "r"}, {"id": 3, "example": "n", "rewrite": "m"}], fh)
    out = run_refresh_stream(spark, incoming, os.path.join(d, "corpus"), os.path.join(d, "ck"))
    rows = {r["id"]: r for r in out.collect()}
    assert set(rows) == {1, 2, 3} and rows[2]["example"] == "q2"


def test_refresh_stream_new_checkpoint_adds_a_version(spark):
    d = tempfile.mkdtemp(prefix="tessera-stream-")
    incoming, corpus = os.path.join(d, "in"), os.path.join(d, "corpus")
    os.makedirs(incoming)
    with open(os.path.join(incoming, "a.json"), "w") as fh:
        json.dump([{"id": 1, "example": "a", "rewrite": "x"}, {"id": 1, "example": "b", "rewrite": "y"}], fh)
    out = run_refresh_stream(spark, incoming, corpus, os.path.join(d, "ck1"))
    assert [(r["id"], r["example"]) for r in out.collect()] == [(1, "b")]   # one row an id
    other = os.path.join(d, "in2")
    os.makedirs(other)
    with open(os.path.join(other, "b.json"), "w") as fh:
        json.dump([{"id": 3, "example": "n", "rewrite": "m"}], fh)
    out = run_refresh_stream(spark, other, corpus, os.path.join(d, "ck2"))
    assert {r["id"] for r in out.collect()} == {1, 3}


def _files(root):
    return {os.path.join(d, f) for d, _, fs in os.walk(root) for f in fs if f.endswith(".parquet")}


def test_one_record_rewrites_one_bucket(spark):
    from tessera.streaming.store import BucketStore
    root = tempfile.mkdtemp(prefix="tessera-store-")
    schema, calls = "id bigint, example string, rewrite string", os.path.join(tempfile.mkdtemp(), "calls")
    open(calls, "w").close()

    def embed(texts, calls=calls):
        with open(calls, "a") as f:
            f.writelines(t + "\n" for t in texts)
        return [[float(len(t))] for t in texts]

    first = spark.createDataFrame([(k, f"e{k}", f"r{k % 5}") for k in range(200)], schema)
    BucketStore(spark, root, 16).upsert(first, "s", 0, embed)
    with open(calls) as f:
        assert len(f.readlines()) == 205  # every string once
    old, before = BucketStore(spark, root).manifest, _files(root)
    BucketStore(spark, root).upsert(spark.createDataFrame([(7, "e8", "r1")], schema), "s", 1, embed)
    store = BucketStore(spark, root)
    changed = {k: [b for b in store.manifest[k] if store.manifest[k][b] != old[k][b]] for k in ("records", "vectors")}
    assert len(changed["records"]) == 1 and not changed["vectors"] and len(_files(root) - before) == 1
    with open(calls) as f:
        assert len(f.readlines()) == 205  # both strings were known
    rows = {r["id"]: r for r in store.read("records").collect()}
    assert len(rows) == 200 and (rows[7]["example"], rows[7]["example_embedding"]) == ("e8", [2.0]) and rows[8]["rewrite"] == "r3"
    now = _files(root)
    BucketStore(spark, root).upsert(spark.createDataFrame([(7, "other", "text")], schema), "s", 1, embed)  # a replayed epoch
    assert _files(root) == now and BucketStore(spark, root).version == store.version == 1
    BucketStore(spark, root).upsert(spark.createDataFrame([(7, None, "text"), (None, "x", "y")], schema), "t", 0, embed)
    last = {r["id"]: r for r in BucketStore(spark, root).read("records").collect()}
    assert len(last) == 200 and last[7]["example"] is None and last[7]["example_embedding"] is None and last[7]["rewrite_embedding"] == [4.0]
