"""Batch extraction over recorded model answers (INF-1..INF-6, COL-12..COL-14).

Model answers are input tables: ``responses(id, attempt, text)``. Live calls go through
``model_fn`` inside ``mapInPandas`` for prompts without a recorded answer.
"""

from __future__ import annotations

from typing import Callable, Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import jsontext as J
from ..functions import text as TX
from ..session import ship
from . import search

# Schemas of the answers (leaves parsed as strings; casts come after, see COL-8).
CHANGE_FIELDS = ["code_sample", "start_line", "end_line", "suggested_change", "description", "complexity"]
FILE_RESPONSE_SCHEMA = T.StructType([
    T.StructField("file_modifications", T.ArrayType(T.StructType(
        [T.StructField(f, T.StringType()) for f in CHANGE_FIELDS]
        + [T.StructField("warnings", T.ArrayType(T.StringType()))]))),
    T.StructField("method_signature_changes", T.ArrayType(T.StructType(
        [T.StructField(f, T.StringType()) for f in ("original_signature", "new_signature", "explanation")]))),
    T.StructField("general_warnings", T.ArrayType(T.StringType())),
])
QUESTIONS_SCHEMA = T.StructType([T.StructField("questions", T.ArrayType(T.StringType()))])


def attach_responses(prompts: DataFrame, responses: DataFrame, key: str = "prompt_key",
                     model_fn: Callable[[list], list] | None = None) -> DataFrame:
    """INF-1: prompts(key, prompt, ...) left-joined with recorded responses(key, attempt, text).

    With ``model_fn`` (list of prompts -> list of answers), prompts without any recorded
    non-null answer are answered batch-wise in ``mapInPandas`` and appended as attempt 0.
    """
    out = prompts.join(responses, key, "left")
    if model_fn is None:
        return out
    ship(prompts.sparkSession)
    missing = prompts.join(responses.where(F.col("text").isNotNull()).select(key).distinct(), key, "left_anti")
    schema = T.StructType(missing.schema.fields + [T.StructField("attempt", T.IntegerType()),
                                                   T.StructField("text", T.StringType())])

    def run(batches: Iterable):
        for pdf in batches:
            if len(pdf) == 0:
                continue
            pdf = pdf.copy()
            pdf["attempt"] = 0
            pdf["text"] = list(model_fn(pdf["prompt"].tolist()))
            yield pdf

    answered = missing.mapInPandas(run, schema)
    return out.where(F.col("text").isNotNull()).unionByName(answered, allowMissingColumns=True)


def route_prompts(files: DataFrame, old_schema: str, new_schema: str, key: str = "prompt_key", examples: DataFrame | None = None) -> DataFrame:
    """INF-2: files(key, path, content, is_dao) -> (key, route, prompt), one plan for both routes.

    The full route (data-access files) gets both schemas and the retrieved examples (``examples(key, examples)``, COL-13) before
    the file, the short one the file alone. A file without a verdict takes the short route.
    """
    f = files
    block = F.lit("")
    if examples is not None:
        f = f.join(examples.select(key, "examples"), key, "left")
        block = F.when(F.coalesce("examples", F.lit("")) != "", F.concat("examples", F.lit("\n"))).otherwise(F.lit(""))
    code = F.concat(F.lit("File "), F.col("path"), F.lit(":\n"), F.coalesce("content", F.lit("")))
    full = F.concat(F.lit(f"Old schema:\n{old_schema}\nNew schema:\n{new_schema}\n"), block, F.lit("Change this data-access file.\n"), code)
    dao = F.coalesce("is_dao", F.lit(False))
    return f.select(key, F.when(dao, F.lit("full")).otherwise(F.lit("short")).alias("route"),
                    F.when(dao, full).otherwise(F.concat(F.lit("Check this file.\n"), code)).alias("prompt"))


def resolve_attempts(responses: DataFrame, key: str, attempt: str = "attempt", text: str = "text",
                     max_attempts: int = 3) -> DataFrame:
    """INF-3: per key, the first attempt (below ``max_attempts``) that is a JSON object or
    empty wins; with none the result is ``{}`` and status ``failed``.

    Returns (key, winning_attempt, status, value) where value is the object's JSON text.
    """
    st = J.response_status(text)
    cand = (responses.where(F.col(attempt) < max_attempts)
            .select(key, attempt, st.alias("_st"), J.response_body(text).alias("_b")))
    good = cand.where(F.col("_st").isin("ok", "empty"))
    best = good.groupBy(key).agg(F.min_by(F.struct(attempt, "_st", "_b"), F.col(attempt)).alias("_w"))
    keys = responses.select(key).distinct()
    out = keys.join(best, key, "left")
    return out.select(
        key, F.col("_w")[attempt].alias("winning_attempt"),
        F.coalesce(F.col("_w._st"), F.lit("failed")).alias("status"),
        F.when(F.col("_w._st") == "ok", F.col("_w._b")).otherwise(F.lit("{}")).alias("value"))


def explode_changes(answers: DataFrame, key: str, value: str = "value") -> DataFrame:
    """INF-4 with COL-8: one row per file modification; line numbers default to -1."""
    parsed = answers.select(key, F.from_json(value, FILE_RESPONSE_SCHEMA).alias("_r"))
    mods = parsed.select(key, F.posexplode(F.coalesce("_r.file_modifications", F.array())).alias("pos", "m"))
    return mods.select(
        key, "pos", F.col("m.code_sample").alias("code_sample"),
        J.int_or_default(F.col("m.start_line")).alias("start_line"),
        J.int_or_default(F.col("m.end_line")).alias("end_line"),
        F.col("m.suggested_change").alias("suggested_change"),
        F.col("m.description").alias("description"), F.col("m.complexity").alias("complexity"),
        F.coalesce(F.col("m.warnings"), F.array().cast("array<string>")).alias("warnings"),
        J.quarantine(F.col("m.start_line")).alias("bad_start_line"),
        J.quarantine(F.col("m.end_line")).alias("bad_end_line"))


def explode_signatures(answers: DataFrame, key: str, value: str = "value") -> DataFrame:
    """INF-5."""
    parsed = answers.select(key, F.from_json(value, FILE_RESPONSE_SCHEMA).alias("_r"))
    sig = parsed.select(key, F.posexplode(F.coalesce("_r.method_signature_changes", F.array())).alias("pos", "s"))
    return sig.select(key, "pos", F.col("s.original_signature").alias("original_signature"),
                      F.col("s.new_signature").alias("new_signature"),
                      F.col("s.explanation").alias("explanation"))


def explode_questions(answers: DataFrame, key: str, value: str = "value") -> DataFrame:
    """INF-6: null-safe; an answer without questions keeps one row with null position."""
    parsed = answers.select(key, F.from_json(value, QUESTIONS_SCHEMA).alias("_r"))
    return parsed.select(key, F.posexplode_outer("_r.questions").alias("pos", "question"))


# The header of the numbered context block and its line formats.
CONTEXT_HEADER = ("Use the following questions and their answers which are required for the code "
                  "conversions**Questions and Search Results:**\n\n")


def context_block(questions: DataFrame, hits: DataFrame, key: str) -> DataFrame:
    """COL-12 / WIN-5: numbered block per key.

    questions(key, q_no, question) with the original 1-based number; hits(key, q_no, r_no,
    result). Questions without hits are skipped but keep their number. Returns
    (key, n_questions, n_answered, block) with block = '' when nothing was answered.
    """
    per_q = (hits.groupBy(key, "q_no")
             .agg(F.array_sort(F.collect_list(F.struct("r_no", "result"))).alias("_r")))
    lines = per_q.select(key, "q_no", F.array_join(F.transform(
        "_r", lambda x: F.concat(F.lit("    * **Search Result "), x["r_no"].cast("string"), F.lit(":** "),
                                 x["result"], F.lit("\n\n"))), "").alias("_res"))
    q = questions.join(lines, [key, "q_no"], "left")
    piece = F.when(F.col("_res").isNotNull(), F.concat(
        F.lit("* **Question "), F.col("q_no").cast("string"), F.lit(":** "), F.col("question"), F.lit("\n"),
        F.col("_res")))
    agg = q.groupBy(key).agg(
        F.count(F.lit(1)).alias("n_questions"), F.count("_res").alias("n_answered"),
        F.array_sort(F.collect_list(F.when(piece.isNotNull(), F.struct("q_no", piece.alias("p"))))).alias("_p"))
    block = F.concat(F.lit(CONTEXT_HEADER), F.array_join(F.transform("_p", lambda x: x["p"]), ""))
    return agg.select(key, "n_questions", "n_answered", block.alias("block"))


def extend_prompt(prompt, block, answered):
    """COL-14: append the block only when at least one question was answered."""
    return F.when(answered > 0, F.concat(prompt, F.lit("\n"), block)).otherwise(prompt)


def attach_hits(rows: DataFrame, corpus: DataFrame, text: str, out: str, cid: str = "id", example: str = "example", rewrite: str = "rewrite",
                distance: float = 0.25, k: int = 10) -> DataFrame:
    """JOIN-10 / JOIN-11: ``rows`` with ``out``, the rewrites of the ``k`` best corpus records for ``text``, in rank order.

    Equal texts are searched once; a text is split into fragments at blank lines (COL-4). Rows without a text or a hit get an
    empty array. The hits of a text (at most ``k``) are one small row that joins all rows of the text.
    """
    key = F.sha2(F.col(text).cast("string"), 256)
    asked = rows.where(F.col(text).isNotNull()).select(key.alias("_q"), F.col(text).alias("_text")).dropDuplicates(["_q"])
    parts = asked.select("_q", F.posexplode(TX.fragments("_text", "\n\n")).alias("_f", "_part"))
    hits = search.sparse_search(parts, corpus, qid="_q", fid="_f", q_text="_part", cid=cid, c_text=example, distance=distance, k=k)
    found = (hits.join(corpus.select(cid, F.col(rewrite).cast("string").alias("_r")), cid).groupBy("_q")
             .agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "_r"))), lambda x: x["_r"]).alias(out)))
    return (rows.withColumn("_k", key).join(found.withColumnRenamed("_q", "_k"), "_k", "left")
            .withColumn(out, F.coalesce(out, F.array().cast("array<string>"))).drop("_k"))


# The wording around retrieved examples in a data-access prompt.
EXAMPLES_HEADER = "The following are examples of how to rewrite code.\n\n"
EXAMPLE_FORMAT = ("Code like the following\n```\n{example}\n```\n\n"
                  "can be rewritten as follows:\n\n```\n{rewrite}\n```\n")


def example_block(keys: DataFrame, hits: DataFrame, key: str) -> DataFrame:
    """COL-13: per key, the retrieved (example, rewrite) pairs formatted in rank order.

    hits(key, rank, example, rewrite) come from the top-k search (bounded by k per key);
    keys without hits get ``''``.
    """
    pre, mid = EXAMPLE_FORMAT.split("{example}")
    mid, post = mid.split("{rewrite}")
    one = F.concat(F.lit(pre), F.col("example"), F.lit(mid), F.col("rewrite"), F.lit(post))
    per = hits.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("rank", one.alias("b")))).alias("_b"))
    block = F.concat(F.lit(EXAMPLES_HEADER), F.array_join(F.transform("_b", lambda x: x["b"]), "\n"))
    out = keys.select(key).join(per, key, "left")
    return out.select(key, F.when(F.col("_b").isNotNull(), block).otherwise(F.lit("")).alias("examples"),
                      F.coalesce(F.size("_b"), F.lit(0)).alias("n_examples"))
