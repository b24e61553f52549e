import os

from tessera.operators import answers as A


def _model(folder):
    """Mends on the second try, unless told never to; notes every call in a file of its own."""

    def model(prompts):
        import os
        import uuid
        out = []
        for p in prompts:
            with open(os.path.join(folder, uuid.uuid4().hex), "w") as f:
                f.write(p)
            first = "cannot be used" not in p
            if p.startswith("good"):
                out.append('{"a": 1}')
            elif p.startswith("blank"):
                out.append("  ")
            elif p.startswith("never"):
                out.append("[1]")
            else:
                out.append("oops" if first else '```json\n{"fixed": true}\n```')
        return out

    return model


def _calls(folder):
    out = []
    for n in os.listdir(folder):
        with open(os.path.join(folder, n)) as f:
            out.append(f.read())
    return out


def test_repair_loop_asks_equal_prompts_once_and_resumes(spark, tmp_path):
    calls = tmp_path / "calls"
    calls.mkdir()
    rows = [(1, "good one"), (2, "mend me"), (3, "mend me"), (4, "never good"), (5, "blank"), (6, None)]
    prompts = spark.createDataFrame(rows, "id int, prompt string")
    store = A.AnswerStore(spark, str(tmp_path / "store"))
    got = {r["id"]: (r["winning_attempt"], r["status"], r["value"]) for r in A.ask(prompts, "id", _model(str(calls)), store, max_attempts=3).collect()}
    assert got == {1: (0, "ok", '{"a": 1}'), 2: (1, "ok", '{"fixed": true}'), 3: (1, "ok", '{"fixed": true}'), 4: (None, "failed", "{}"),
                   5: (0, "empty", "{}"), 6: (None, "failed", "{}")}
    said = _calls(calls)
    assert len(said) == 1 + 2 + 3 + 1  # good; mended once; never, three times; blank
    again = [p for p in said if p.startswith("mend me") and p != "mend me"]
    assert len(again) == 1 and "it is not valid JSON" in again[0] and "oops" in again[0]
    assert sum("but not an object" in p for p in said) == 2
    assert store.attempts().count() == 7
    # a second run asks nothing; an edited prompt is another one; one more attempt goes on from the last
    assert A.ask(prompts, "id", _model(str(calls)), store).count() == 6 and len(_calls(calls)) == 7
    edited = spark.createDataFrame([(1, "good two")], "id int, prompt string")
    assert A.ask(edited, "id", _model(str(calls)), store).first()["status"] == "ok" and len(_calls(calls)) == 8
    A.ask(prompts, "id", _model(str(calls)), store, max_attempts=4)
    assert len(_calls(calls)) == 9


def test_uncommitted_attempts_are_not_read(spark, tmp_path):
    store = A.AnswerStore(spark, str(tmp_path / "store"))
    assert store.attempts().count() == 0
    store.add(spark.createDataFrame([("s", 0, "{}")], "sha string, attempt int, text string"))
    broken = tmp_path / "store" / "run-broken"
    broken.mkdir()
    (broken / "part-0.parquet").write_bytes(b"half")
    assert [tuple(r) for r in store.attempts().collect()] == [("s", 0, "{}", "ok", None, "{}")]


def test_no_prompts_no_calls(spark, tmp_path):
    store = A.AnswerStore(spark, str(tmp_path / "store"))
    empty = spark.createDataFrame([], "id int, prompt string")
    assert A.ask(empty, "id", lambda p: 1 / 0, store).count() == 0
