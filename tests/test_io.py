import json
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from tessera.operators.embed import embed_texts, refresh_corpus
from tessera.sources import corpus, loaders, sinks, tree


def _tmp():
    return tempfile.mkdtemp(prefix="tessera-test-")


def test_scan_corpus_prunes_directories(spark):
    root = _tmp()
    files = ["src/A.java", "src/dao/B.java", ".git/C.java", "src/test/D.java", "target/E.java",
             "build/F.xml", "src/G.txt", "testdata_top/H.java", "src/buildx/I.xml"]
    for f in files:
        p = os.path.join(root, f)
        os.makedirs(os.path.dirname(p), exist_ok=True)
        with open(p, "wb") as fh:
            fh.write(b"class X {}\n" if not f.endswith("H.java") else b"\xff\xfe bad")
    got = sorted(r["relpath"] for r in corpus.scan_corpus(spark, root).collect())
    assert got == ["src/A.java", "src/dao/B.java"]
    edge = sorted(r["relpath"] for r in corpus.scan_corpus(spark, root, suffixes=(".java",),
                                                            prune_prefixes=corpus.EDGE_PRUNE_PREFIXES).collect())
    assert edge == ["src/A.java", "src/dao/B.java", "target/E.java"]
    listing = corpus.scan_corpus(spark, root, suffixes=(".txt",), prune_prefixes=(), with_content=False)
    assert [r["relpath"] for r in listing.collect()] == ["src/G.txt"]


@pytest.mark.parametrize("partitions", [1, 3, 64])
def test_walk_opens_nothing_in_pruned_folders(spark, partitions):
    """A pipe without a writer blocks whoever opens it; an unreadable file is a row without content."""
    root = _tmp()
    os.makedirs(os.path.join(root, "test", "deep"))
    os.makedirs(os.path.join(root, "src", "main", "a"))
    os.mkfifo(os.path.join(root, "test", "deep", "Pipe.java"))
    os.mkfifo(os.path.join(root, "test", "Pipe.java"))
    os.mkfifo(os.path.join(root, "src", "pipe.txt"))
    for k in range(40):
        with open(os.path.join(root, "src", "main", "a" if k % 2 else "", f"F{k:02d}.java"), "w") as fh:
            fh.write(f"class F{k} {{}}\n")
    os.symlink("/proc/self/mem", os.path.join(root, "src", "Broken.java"))  # reading it fails
    os.symlink(root, os.path.join(root, "src", "loop"))
    spark.dataSource.register(tree.TreeSource)
    corpus.scan_corpus(spark, root)
    df = (spark.read.format("source_tree").option("path", root).option("suffixes", ".java").option("prune", "test").option("partitions", partitions).load())
    rows = {r["relpath"]: r for r in df.collect()}
    assert len(rows) == 41 and rows["src/main/a/F01.java"]["text"] == "class F1 {}\n"
    assert rows["src/Broken.java"]["content"] is None and rows["src/Broken.java"]["text"] is None
    reader = tree.TreeReader({"path": root, "suffixes": ".java", "prune": "test", "partitions": str(partitions)})
    opened = []
    real = tree.TreeReader._read
    try:
        tree.TreeReader._read = lambda self, fs, path: (opened.append(path), real(self, fs, path))[1]
        listed = [x for p in reader.partitions() for b in reader.read(p) for x in b.column("relpath").to_pylist()]
    finally:
        tree.TreeReader._read = real
    assert sorted(listed) == sorted(rows) and not [p for p in opened if "/test/" in p] and len(opened) == 41


def test_later_record_wins_whatever_the_split(spark):
    folder = _tmp()
    rows = [(k % 50, f"e{k}", f"r{k}", [float(k)], [0.0]) for k in range(1000)]
    for n in range(4):
        spark.createDataFrame(rows[250 * n:250 * n + 250], loaders.EMBEDDED_SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}/p{n}")
    flat = os.path.join(folder, "flat")
    os.makedirs(flat)
    for n in range(4):
        name = next(f for f in os.listdir(f"{folder}/p{n}") if f.endswith(".parquet"))
        os.link(f"{folder}/p{n}/{name}", f"{flat}/part-{n}.parquet")
    for size in ("128m", "2k"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            got = {r["id"]: r["example"] for r in loaders.load_embedded(spark, flat).collect()}
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
        assert got == {k: f"e{950 + k}" for k in range(50)}
    one = os.path.join(folder, "all.json")
    with open(one, "w") as fh:
        json.dump([dict(zip(("id", "example", "rewrite", "example_embedding", "rewrite_embedding"), r, strict=True)) for r in rows], fh)
    assert {r["id"]: r["example"] for r in loaders.load_embedded(spark, one).collect()} == got


def test_undecodable_text_is_null(spark):
    root = _tmp()
    with open(os.path.join(root, "A.java"), "wb") as fh:
        fh.write(b"\xff\xfe\xfa")
    r = corpus.scan_corpus(spark, root).first()
    assert r["text"] is None


def test_side_text_missing_is_empty(spark):
    assert corpus.read_side_text(spark, "/nonexistent/schema.sql").first()["text"] == ""
    p = os.path.join(_tmp(), "s.sql")
    with open(p, "w") as fh:
        fh.write("CREATE TABLE t (a INT);\n")
    assert corpus.read_side_text(spark, p).first()["text"] == "CREATE TABLE t (a INT);\n"


def test_load_examples_integrity(spark):
    d = _tmp()
    good = os.path.join(d, "good.json")
    with open(good, "w") as fh:
        json.dump([{"id": 1, "example": "a", "rewrite": {"theory": "t", "options": []}},
                   {"id": 2, "example": "b", "rewrite": {"theory": "u"}}], fh)
    df = loaders.load_examples(spark, good)
    assert df.count() == 2 and json.loads(df.where("id = 1").first()["rewrite"])["theory"] == "t"
    dup = os.path.join(d, "dup.json")
    with open(dup, "w") as fh:
        json.dump([{"id": 1, "example": "a", "rewrite": "x"}, {"id": 1, "example": "b", "rewrite": "y"}], fh)
    with pytest.raises(loaders.IntegrityError):
        loaders.load_examples(spark, dup)


def test_test_cases_loader(spark):
    d = _tmp()
    assert loaders.load_test_cases(spark, os.path.join(d, "missing.json")).count() == 0
    bad = os.path.join(d, "bad.json")
    with open(bad, "w") as fh:
        fh.write("{not json")
    assert loaders.load_test_cases(spark, bad).count() == 0
    extra = os.path.join(d, "extra.json")
    with open(extra, "w") as fh:
        json.dump([{f: "x" for f in loaders.TEST_CASE_FIELDS} | {"oops": 1}], fh)
    with pytest.raises(ValueError):
        loaders.load_test_cases(spark, extra)
    lost = os.path.join(d, "lost.json")  # one record without a field, beside a whole one
    with open(lost, "w") as fh:
        json.dump([{f: "x" for f in loaders.TEST_CASE_FIELDS},
                   {f: "x" for f in loaders.TEST_CASE_FIELDS if f != "description"}], fh)
    with pytest.raises(ValueError):
        loaders.load_test_cases(spark, lost)
    null = os.path.join(d, "null.json")
    with open(null, "w") as fh:
        json.dump([{f: None for f in loaders.TEST_CASE_FIELDS}], fh)
    assert loaders.load_test_cases(spark, null).collect() == [(None,) * 6]
    ok = os.path.join(d, "ok.json")
    with open(ok, "w") as fh:
        json.dump([{f: f for f in loaders.TEST_CASE_FIELDS}], fh)
    assert loaders.load_test_cases(spark, ok).columns == loaders.TEST_CASE_FIELDS


def test_previous_output_missing_or_corrupt(spark):
    d = _tmp()
    assert loaders.load_previous_output(spark, os.path.join(d, "none")).count() == 0
    bad = os.path.join(d, "bad")
    os.makedirs(bad)
    with open(os.path.join(bad, "part-0.parquet"), "w") as fh:
        fh.write("garbage")
    assert loaders.load_previous_output(spark, bad).count() == 0
    mixed = os.path.join(d, "mixed")  # the broken file is not the first
    spark.createDataFrame([(1, "a", "b", [1.0], [1.0])], loaders.EMBEDDED_SCHEMA).write.parquet(mixed)
    assert loaders.load_previous_output(spark, mixed).count() == 1
    with open(os.path.join(mixed, "zzz.parquet"), "w") as fh:
        fh.write("garbage")
    assert loaders.load_previous_output(spark, mixed).count() == 0


class _CallLog:
    """embed_fn runs in Python workers; calls are logged to a file the test reads back."""

    def __init__(self):
        self.path = os.path.join(_tmp(), "calls.txt")
        open(self.path, "w").close()

    def __iter__(self):
        with open(self.path) as fh:
            return iter([[line.rstrip("\n")] for line in fh if line.strip()])

    def __eq__(self, other):
        return list(self) == other

    def clear(self):
        open(self.path, "w").close()


def test_refresh_is_incremental_and_idempotent(spark):
    calls = _CallLog()
    log = calls.path

    def fake_embed(texts):
        with open(log, "a") as fh:
            fh.writelines(t + "\n" for t in texts)
        return [[float(len(t)), 1.0] for t in texts]

    new = spark.createDataFrame([(1, "aa", "bbb"), (2, "cc", "aa")], "id bigint, example string, rewrite string")
    first = refresh_corpus(new, None, embed=fake_embed).collect()
    assert sorted(t for c in calls for t in c) == ["aa", "bbb", "cc"]
    stored = spark.createDataFrame(first, loaders.EMBEDDED_SCHEMA)
    calls.clear()
    newer = spark.createDataFrame([(2, "cc", "dddd")], "id bigint, example string, rewrite string")
    second = {r["id"]: r for r in refresh_corpus(newer, stored, embed=fake_embed).collect()}
    assert sorted(t for c in calls for t in c) == ["dddd"]          # only the new string
    assert second[1]["rewrite"] == "bbb"                              # stored-only record kept
    assert list(second[2]["rewrite_embedding"]) == [4.0, 1.0]         # new value wins
    calls.clear()
    again = refresh_corpus(newer, spark.createDataFrame(list(second.values()), loaders.EMBEDDED_SCHEMA),
                           embed=fake_embed).collect()
    assert calls == [] and len(again) == 2


def test_sinks_roundtrip(spark):
    d = _tmp()
    ch = spark.createDataFrame(
        [("F", "x", 3, 4, "s", "d", "SIMPLE", ["n"], ["w"]), ("F", "y", 1, 2, "s", "d", "COMPLEX", [], [])],
        "filename string, code_sample string, start_line int, end_line int, suggested_change string, "
        "description string, complexity string, notes array<string>, warnings array<string>")
    sinks.write_change_set(ch, os.path.join(d, "changes"))
    back = spark.read.json(os.path.join(d, "changes")).first()
    assert [c["code_sample"] for c in back["changes"]] == ["y", "x"]
    from pyspark.sql import functions as F
    sinks.write_change_set(ch.withColumn("pos", F.when(F.col("code_sample") == "x", 0).otherwise(1)), os.path.join(d, "ordered"))
    back = spark.read.json(os.path.join(d, "ordered")).first()
    assert [c["code_sample"] for c in back["changes"]] == ["x", "y"]   # the answer's order
    m = sinks.metric_record(spark.createDataFrame([(0.5,)], "accuracy double")).first()
    assert (m["name"], m["unit"], m["value"]) == ("Overall Eval Result", "Accuracy (percent)", 50.0)
    rows = spark.createDataFrame([('say "a"', *"bcdef") + (0.9, "g", "h", 0.7)],
                                 ", ".join(f"{c} {'double' if 'similarity' in c else 'string'}"
                                           for c in sinks.EVAL_COLUMNS))
    sinks.write_evaluation_csv(rows, os.path.join(d, "eval"))
    csv = spark.read.option("header", "true").csv(os.path.join(d, "eval"))
    assert csv.columns == sinks.EVAL_COLUMNS
    lines = spark.read.text(os.path.join(d, "eval")).collect()
    assert any(r["value"].startswith('"say ""a""",b') for r in lines)
    emb = spark.createDataFrame([(2, "b", "r", [1.0], [2.0]), (1, "a", "r", [1.0], [2.0])], loaders.EMBEDDED_SCHEMA)
    sinks.write_embedded(emb, os.path.join(d, "emb"))
    assert [r["id"] for r in loaders.load_embedded(spark, os.path.join(d, "emb") + "/").orderBy("id").collect()] == [1, 2]


def test_embed_texts_batches(spark):
    df = spark.createDataFrame([(1, "hello world"), (2, "")], "k int, t string")
    out = {r["k"]: r["embedding"] for r in embed_texts(df, "t").collect()}
    assert len(out[1]) == 256 and abs(sum(x * x for x in out[1]) - 1.0) < 1e-5
    assert all(x == 0.0 for x in out[2])


def test_report_tables_and_later_duplicate_wins(spark):
    d = _tmp()
    tables = {"efforts": spark.createDataFrame([("Major", 2)], "effort string, n int"),
              "totals": spark.createDataFrame([(10, 3)], "lines_of_code bigint, n_files bigint")}
    sinks.write_report_tables(tables, os.path.join(d, "report"))
    assert spark.read.parquet(os.path.join(d, "report", "efforts")).first()["n"] == 2
    assert spark.read.parquet(os.path.join(d, "report", "totals")).first()["n_files"] == 3
    p = os.path.join(d, "emb.json")
    with open(p, "w") as fh:
        json.dump([{"id": 1, "example": "old", "rewrite": "r", "example_embedding": [1.0], "rewrite_embedding": [2.0]},
                   {"id": 2, "example": "b", "rewrite": "r", "example_embedding": [1.0], "rewrite_embedding": [2.0]},
                   {"id": 1, "example": "new", "rewrite": "r", "example_embedding": [3.0], "rewrite_embedding": [4.0]}], fh)
    got = {r["id"]: r for r in loaders.load_embedded(spark, p).collect()}
    assert got[1]["example"] == "new" and list(got[1]["example_embedding"]) == [3.0] and len(got) == 2


def test_root_itself_is_never_pruned(spark):
    root = os.path.join(_tmp(), "test_root")
    os.makedirs(os.path.join(root, "pkg"))
    with open(os.path.join(root, "pkg", "A.java"), "w") as fh:
        fh.write("class A {}")
    assert [r["relpath"] for r in corpus.scan_corpus(spark, root).collect()] == ["pkg/A.java"]
