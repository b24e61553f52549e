"""Stages against brute force on their own inputs."""

import re

import corpus_pipeline
import pyarrow as pa
from pyspark.sql import functions as F

from tessera.llm import common, decontaminate, ranking, secrets

from . import fixtures as X
from .test_jaccard_join import brute
from .test_packing_order_warc import _check_packing, tokenizer  # noqa: F401


def test_stages(spark, tokenizer):  # noqa: F811
    docs = spark.read.parquet(f"{X.SF}/documents.parquet")
    bench = [(str(r["item_id"]), r["text"]) for r in spark.read.parquet(f"{X.SF}/benchmark.parquet").collect()]
    columns, rows = docs.columns, {}
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality_classifier", "ngram_jaccard_join", "benchmark_decontamination", "secret_scans", "best_fit_packing"]
    model = ranking.train(docs, spark.read.parquet(f"{X.SF}/labels.parquet"))
    for name, stage in list(stages.items())[:-1]:
        before = {r["doc_id"]: r["text"] for r in docs.collect()}
        docs = common.stored(stage(spark, docs, X.SF), name)
        assert docs.columns == columns
        after = {r["doc_id"]: r["text"] for r in docs.collect()}
        if name == "quality_classifier":
            want = {i: t for i, t in before.items() if model.scores(ranking.features((t or "").encode())[None])[0] >= 0.5}
        elif name == "ngram_jaccard_join":
            want = {i: before[i] for i, _, c in brute(list(before.items()), 5, 80) if i == c}
        elif name == "benchmark_decontamination":
            windows = decontaminate.WindowSet([(i, t.encode()) for i, t in bench], 10)
            want = {i: t for i, t in before.items() if not windows.scan(decontaminate.words_of((t or "").encode()))[0].any()}
        else:
            allow = [re.compile(p) for p in secrets.ALLOW]
            want = {i: t and secrets.redact(t, allow) for i, t in before.items()}
            assert sum(a != before[i] for i, a in want.items()) > 0
        assert after == want
        rows[name] = len(after)
    assert rows["quality_classifier"] > rows["ngram_jaccard_join"] > rows["benchmark_decontamination"] == rows["secret_scans"]
    _check_packing(list(after.items()), stages["best_fit_packing"](spark, docs, X.SF).collect(), tokenizer)


def test_run_equals_its_stages(spark):
    got = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert got.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] and got.count() > 50


def test_batches_to_python_are_bounded(spark):
    """20 MB of texts in one partition reach a worker in small batches, narrow rows still in large ones; a session's own bound stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    had = spark.conf.get(key, None)

    def size(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], names=["n", "size"])

    ids = spark.range(0, 10_000, 1, 1).withColumnRenamed("id", "doc_id")
    docs = ids.withColumn("text", F.repeat(F.lit("0123456789"), 200))
    try:
        for name, stage in corpus_pipeline.STAGES[2:4]:
            spark.conf.unset(key)
            stage(spark, docs, X.SF)
            got = docs.mapInArrow(size, "n long, size long").collect()
            assert sum(r["n"] for r in got) == 10_000 and max(r["size"] for r in got) < 5 << 20, name
            assert [r["n"] for r in ids.mapInArrow(size, "n long, size long").collect()] == [10_000]
        spark.conf.set(key, "8m")
        stage(spark, docs, X.SF)
        assert spark.conf.get(key) == "8m"
    finally:
        spark.conf.set(key, had) if had else spark.conf.unset(key)
