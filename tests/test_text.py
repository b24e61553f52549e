from pyspark.sql import functions as F

from tessera.functions import jsontext as J
from tessera.functions import text as T
from tessera.operators.textops import normalise_code, normalise_code_lines


def one(spark, values, fn, schema="s string"):
    df = spark.createDataFrame([(v,) for v in values], schema)
    return [r[0] for r in df.select(fn(F.col(df.columns[0]))).collect()]


def test_line_count(spark):
    assert one(spark, ["a\nb", "a\nb\n", ""], T.line_count) == [1, 2, 0]


def test_normaliser_braces(spark):
    df = spark.createDataFrame([(1, "class A{int x;}"), (2, "}a{")], "k int, s string")
    out = {r["k"]: r["normalised"] for r in normalise_code(df, "k", "s").collect()}
    assert out[1] == "class A{\n    int x;\n}"
    # level goes to -1 and back to 0; no indent is printed for negative levels
    assert out[2] == "}\na{"
    lv = [(r["pos"], r["level"]) for r in normalise_code_lines(df, "k", "s").where("k = 2").orderBy("pos").collect()]
    assert lv == [(0, -1), (1, -1)]


def test_normaliser_unescape_and_blank_runs(spark):
    df = spark.createDataFrame([(1, 'f(\\"x\\");\\n\\n  g();')], "k int, s string")
    assert normalise_code(df, "k", "s").first()["normalised"] == 'f("x");\ng();'


def test_fragments(spark):
    assert one(spark, ["a\n\n \n\nb"], lambda c: T.fragments(c)) == [["a", "b"]]


def test_response_status(spark):
    vals = ["", "```json\n\n```", '{"a":1}', "[1]", "x", '```json\n{"a":1}', "  {\"b\": 2}\n",
            '{"k": 96}}', '{"a":1} x', '{"a":1}, {"b":2}', '{"a": [1, {"b": "}"}]}']
    st = one(spark, vals, J.response_status)
    assert st == ["empty", "empty", "ok", "not_object", "invalid", "invalid", "ok",
                  "invalid", "invalid", "invalid", "ok"]
    body = one(spark, ['```json\n{"a":1}\n```'], J.response_body)
    assert body == ['{"a":1}']


def test_prune_delimiters(spark):
    vals = ["DELIMITER_CODE_START@x@DELIMITER_CODE_END", "DELIMITER_CODE_STARTx",
            "DELIMITER_CODE_START@DELIMITER_CODE_STARTy", None, "zDELIMITER_CODE_END\n"]
    assert one(spark, vals, T.prune_code_delimiters) == ["x", "x", "y", "", "zDELIMITER_CODE_END\n"]
    arr = spark.createDataFrame([(["DELIMITER_CODE_STARTa", "b@DELIMITER_CODE_END"],), (None,)], "a array<string>")
    assert [r[0] for r in arr.select(T.prune_code_delimiters_array("a")).collect()] == [["a", "b"], []]


def test_default_cast(spark):
    vals = [None, "7", "7a"]
    assert one(spark, vals, J.int_or_default) == [-1, 7, None]
    assert one(spark, vals, J.quarantine) == [None, None, "7a"]


def test_base_name_and_truncate(spark):
    assert one(spark, ["a/b/c.java", "c", "a/"], T.base_name) == ["c.java", "c", ""]
    toks = one(spark, [" ".join(str(i) for i in range(100))], lambda c: F.size(T.truncate(T.word_tokens(c), 64)))
    assert toks == [64]


def test_row_json_keeps_nulls(spark):
    df = spark.createDataFrame([(1, None, "x")], "a int, b string, c string")
    assert df.select(J.row_json(df, exclude=["c"])).first()[0] == '{"a":1,"b":null}'


def test_code_lines_leave_the_worker_in_small_batches(spark):
    """What a worker holds of its result does not grow with its rows or with a text; nulls give no lines."""
    import pyarrow as pa

    from tessera.operators import textops as O
    long = "a{\n" * 3 + "b;\n" * 30_000 + "}"
    rows = pa.RecordBatch.from_pydict({"key": pa.array([*range(3_000), None, 9], pa.int64()), "text": pa.array(["x{\ny;\n}"] * 3_000 + [long, None])})
    sizes, got = [], []
    for b in O._line_batches(iter([rows])):
        sizes.append(b.num_rows)
        got += zip(*(c.to_pylist() for c in b.columns), strict=True)
    assert max(sizes) <= O.BATCH_LINES and len(got) == 9_000 + 30_004
    assert got[:3] == [(0, 0, 0, "x{"), (0, 1, 1, "    y;"), (0, 2, 0, "}")]
    assert [g[:3] for g in got[9_000:]] == [(None, k, min(k, 3) if k < 30_003 else 2) for k in range(30_004)]
    df = spark.createDataFrame([(1, "a{b;}"), (None, "c"), (2, None)], "k bigint, s string")
    assert sorted(((r["k"] or 0, r["pos"], r["level"], r["line"]) for r in normalise_code_lines(df, "k", "s").collect())) == [
        (0, 0, 0, "c"), (1, 0, 0, "a{"), (1, 1, 1, "    b;"), (1, 2, 0, "}")]
    assert {(r["k"], r["normalised"]) for r in normalise_code(df, "k", "s").collect()} == {(1, "a{\n    b;\n}"), (None, "c"), (2, None)}
