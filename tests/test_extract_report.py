from pyspark.sql import functions as F

from tessera.operators import extract as X
from tessera.operators import report as RP
from tessera.operators.common import dense_index


def test_attempt_resolution(spark):
    rows = [(1, 0, "nope"), (1, 1, "[1]"), (1, 2, '```json\n{"a": 1}\n```'),
            (2, 0, "  "), (2, 1, '{"b": 2}'),
            (3, 0, "x"), (3, 1, "y"), (3, 2, "z"), (3, 3, '{"late": 1}')]
    df = spark.createDataFrame(rows, "k int, attempt int, text string")
    got = {r["k"]: (r["winning_attempt"], r["status"], r["value"])
           for r in X.resolve_attempts(df, "k", max_attempts=3).collect()}
    assert got == {1: (2, "ok", '{"a": 1}'), 2: (0, "empty", "{}"), 3: (None, "failed", "{}")}


def test_explode_changes_defaults(spark):
    ans = ('{"file_modifications": [{"code_sample": "a", "start_line": "7", "complexity": "SIMPLE"},'
           '{"code_sample": "b", "end_line": 9, "start_line": "7a", "warnings": ["w"]}],'
           '"method_signature_changes": [{"original_signature": "f()", "new_signature": "g()"}]}')
    df = spark.createDataFrame([("F.java", ans), ("G.java", "{}")], "filename string, value string")
    ch = X.explode_changes(df, "filename").orderBy("pos").collect()
    assert [(r["start_line"], r["end_line"], r["warnings"], r["bad_start_line"]) for r in ch] == \
        [(7, -1, [], None), (None, 9, ["w"], "7a")]
    sig = X.explode_signatures(df, "filename").collect()
    assert [(r["filename"], r["new_signature"], r["explanation"]) for r in sig] == [("F.java", "g()", None)]
    qs = spark.createDataFrame([(1, '{"questions": ["a", "b"]}'), (2, "{}")], "k int, value string")
    got = sorted((r["k"], r["pos"], r["question"]) for r in X.explode_questions(qs, "k").collect())
    assert got == [(1, 0, "a"), (1, 1, "b"), (2, None, None)]


def test_context_block_numbering(spark):
    q = spark.createDataFrame([(1, 1, "q1"), (1, 2, "q2"), (1, 3, "q3"), (2, 1, "lonely")],
                              "k int, q_no int, question string")
    h = spark.createDataFrame([(1, 1, 1, "r11"), (1, 3, 1, "r31"), (1, 3, 2, "r32")],
                              "k int, q_no int, r_no int, result string")
    out = {r["k"]: r for r in X.context_block(q, h, "k").collect()}
    block = out[1]["block"]
    assert "* **Question 1:** q1\n" in block and "* **Question 3:** q3\n" in block
    assert "Question 2" not in block
    assert block.index("Search Result 1:** r31") < block.index("Search Result 2:** r32")
    assert out[2]["n_answered"] == 0
    final = out[1]["n_answered"]
    assert final == 2


def test_effort_order(spark):
    t = spark.createDataFrame([(0, "Minor"), (1, "Major"), (2, "X"), (3, "Moderate")], "i bigint, effort string")
    out = RP.tasks_by_effort(t, "i", {"Major": 1, "Moderate": 2, "Minor": 3}).orderBy("sorted_pos").collect()
    assert [r["effort"] for r in out] == ["Major", "Moderate", "Minor", "X"]


def test_dense_index_groups_span_partitions(spark):
    df = spark.range(0, 5000).select(F.col("id"), (F.col("id") % 3 == 0).cast("int").alias("g"))
    ix = dense_index(df, ["id"], ["g"], index_col="i", num_partitions=7).collect()
    by = {}
    for r in ix:
        by.setdefault(r["g"], []).append((r["id"], r["i"]))
    for g, v in by.items():
        v.sort()
        assert [i for _, i in v] == list(range(len(v)))


def test_accuracy_denominator(spark):
    from tessera.plans.bindings import T as Tx  # percent helper lives in functions.text
    cases = spark.createDataFrame([(0,), (1,), (2,)], "k int")
    answers = spark.createDataFrame([(0, 0.9, 0.7), (1, 0.85, 0.65)], "k int, code double, desc double")
    j = cases.join(answers, "k", "left")
    ok = F.when((F.col("code") >= 0.8) & (F.col("desc") >= 0.6), 1).otherwise(0)
    acc = j.agg(F.coalesce(F.avg(ok), F.lit(0.0)).alias("a")).first()["a"]
    assert abs(acc - 2 / 3) < 1e-12
    empty = cases.limit(0).join(answers, "k", "left").agg(F.coalesce(F.avg(ok), F.lit(0.0))).first()[0]
    assert empty == 0.0
    assert spark.range(1).select(Tx.percent(F.lit(0.5))).first()[0] == 50.0


def test_report_totals(spark):
    files = spark.createDataFrame([("a", 10), ("b", None), ("c", 5)], "filename string, line_count int")
    imp = spark.createDataFrame([("a",), ("a",)], "filename string")
    t = RP.app_totals(files, imp).first()
    assert (t["lines_of_code"], t["n_files"], t["n_impacted"]) == (15, 3, 1)
    s = RP.impact_split(files, imp).first()
    assert (s["modified_files"], s["unchanged_files"], s["modified_lines"], s["unchanged_lines"]) == (1, 2, 10, 5)


def test_example_block_rank_order_and_empty(spark):
    keys = spark.createDataFrame([(1,), (2,)], "k int")
    hits = spark.createDataFrame([(1, 2, "e2", "r2"), (1, 1, "e1", "r1")], "k int, rank int, example string, rewrite string")
    out = {r["k"]: r for r in X.example_block(keys, hits, "k").collect()}
    assert out[2]["examples"] == "" and out[2]["n_examples"] == 0
    b = out[1]["examples"]
    assert b.startswith(X.EXAMPLES_HEADER) and b.index("e1") < b.index("e2") and out[1]["n_examples"] == 2
    assert "```\ne1\n```\n\ncan be rewritten as follows:\n\n```\nr1\n```\n" in b


def _answer_all(prompts):
    return ['{"file_modifications": []}' if "dao" in p else "" for p in prompts]


def test_bad_end_line_is_kept(spark):
    a = spark.createDataFrame([("F", '{"file_modifications": [{"start_line": 1, "end_line": "9z"}]}')], "filename string, value string")
    r = X.explode_changes(a, "filename").first()
    assert (r["start_line"], r["end_line"], r["bad_start_line"], r["bad_end_line"]) == (1, None, None, "9z")


def test_attach_responses_answers_prompts_with_null_answers(spark):
    prompts = spark.createDataFrame([("a", "pa"), ("b", "pb"), ("c", "pc")], "prompt_key string, prompt string")
    recorded = spark.createDataFrame([("a", 1, "x"), ("b", 1, None)], "prompt_key string, attempt int, text string")
    got = X.attach_responses(prompts, recorded, model_fn=lambda ps: [p.upper() for p in ps]).collect()
    assert sorted((r["prompt_key"], r["text"]) for r in got) == [("a", "x"), ("b", "PB"), ("c", "PC")]


def test_tasks_without_changes_stay(spark):
    tasks = spark.createDataFrame([(1, [1, 2]), (2, [1]), (3, None)], "task int, indexes array<int>")
    changes = spark.createDataFrame([(1, 2, 5.0)], "task int, idx int, lines double")
    got = RP.task_changes(tasks, changes, "task", "lines", "total").collect()
    assert sorted(map(tuple, got)) == [(1, 1, "2", 5.0), (2, 0, "", 0.0), (3, 0, "", 0.0)]


def test_null_groups_keep_their_rows(spark):
    t = spark.createDataFrame([(1, None), (2, "Major"), (3, None), (4, "x")], "k int, effort string")
    got = RP.tasks_by_effort(t, "k", {"Major": 1}).collect()
    assert sorted((r["k"], r["group_pos"], r["sorted_pos"]) for r in got) == [(1, 0, 1), (2, 0, 0), (3, 1, 2), (4, 0, 3)]


def test_attach_responses_with_model_fn(spark):
    prompts = spark.createDataFrame([(1, "dao prompt"), (2, "plain prompt"), (3, "recorded")],
                                    "prompt_key int, prompt string")
    recorded = spark.createDataFrame([(3, 0, '{"a": 1}')], "prompt_key int, attempt int, text string")
    got = {r["prompt_key"]: (r["attempt"], r["text"])
           for r in X.attach_responses(prompts, recorded, model_fn=_answer_all).collect()}
    assert got == {1: (0, '{"file_modifications": []}'), 2: (0, ""), 3: (0, '{"a": 1}')}
    # without a model, prompts lacking an answer stay with a null answer
    plain = {r["prompt_key"]: r["text"] for r in X.attach_responses(prompts, recorded).collect()}
    assert plain == {1: None, 2: None, 3: '{"a": 1}'}
