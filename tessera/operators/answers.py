"""Content-addressed answer store with a repair loop (INF-1, INF-3).

Answers are kept under the hash of their prompt: an edited prompt never meets an old answer, equal prompts are
asked once, and a run that was ended goes on where it stopped. Every attempt is a row of the store
(sha, attempt, text, status, error, value); an attempt that is no JSON object (and not empty) builds the next
prompt from the first one, the text that came back and its error, up to ``max_attempts``.

The store is a folder with one committed table per asked attempt; a table that was not committed is not read. The model is
called in Arrow batches. Should an executor be lost, a batch may be asked again, as with any remote call from a task.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import jsontext as J
from ..session import ship

SCHEMA = "sha string, attempt int, text string, status string, error string, value string"
#: what the status of an answer says about it in the next prompt
ERRORS = {"invalid": "it is not valid JSON", "not_object": "it is JSON, but not an object"}


def prompt_key(prompt) -> Column:
    return F.sha2(F.col(prompt) if isinstance(prompt, str) else prompt, 256)


def repair_prompt(prompt: Column, text: Column, error: Column) -> Column:
    """The prompt of the next attempt."""
    return F.concat(prompt, F.lit("\n\nYour last answer cannot be used: "), error, F.lit(".\nIt was:\n"), F.coalesce(text, F.lit("")),
                    F.lit("\nAnswer again with one JSON object and nothing else."))


class AnswerStore:
    """Recorded attempts below ``root``."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _folders(self) -> list[str]:
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(self.root)
        fs = p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(p):
            return []
        found = [s.getPath() for s in fs.listStatus(p) if s.isDirectory()]
        return sorted(x.toString() for x in found if fs.exists(jvm.org.apache.hadoop.fs.Path(x, "_SUCCESS")))

    def attempts(self) -> DataFrame:
        folders = self._folders()
        return self.spark.read.schema(SCHEMA).parquet(*folders) if folders else self.spark.createDataFrame([], SCHEMA)

    def add(self, attempts: DataFrame) -> None:
        """Judge and keep attempts(sha, attempt, text); of one that is already there the first stays."""
        status = J.response_status("text")
        names = [F.when(status == k, F.lit(v)) for k, v in ERRORS.items()]
        rows = attempts.select("sha", F.col("attempt").cast("int").alias("attempt"), "text", status.alias("status"),
                               F.coalesce(*names).alias("error"), F.when(status == "ok", J.response_body("text")).otherwise(F.lit("{}")).alias("value"))
        rows.write.parquet(f"{self.root}/run-{uuid.uuid4().hex}")

    def state(self, max_attempts: int) -> DataFrame:
        """One row per asked prompt: its first good attempt, the number of attempts, and the last one's text and error."""
        known = self.attempts().where(F.col("attempt") < max_attempts).dropDuplicates(["sha", "attempt"])
        good = F.col("status").isin("ok", "empty")
        return (known.groupBy("sha").agg(F.min(F.when(good, F.struct("attempt", "status", "value"))).alias("won"),
                                         F.max("attempt").alias("last"), F.max(F.struct("attempt", "text", "error")).alias("seen"))
                .select("sha", "won", "last", F.col("seen.text").alias("text"), F.col("seen.error").alias("error")))


def ask(prompts: DataFrame, key: str, model_fn: Callable[[list], list], store: AnswerStore, max_attempts: int = 3, prompt: str = "prompt",
        tasks: int | None = None) -> DataFrame:
    """INF-1 with INF-3: (key, sha, winning_attempt, status, value) for every row of ``prompts(key, prompt)``.

    Only prompts without a good attempt and with attempts left are asked; ``model_fn`` maps a list of prompts to a list of
    answers. Prompts that never get a usable answer have the status ``failed`` and the value ``{}``, as null prompts have.
    """
    spark = prompts.sparkSession
    ship(spark)
    keyed = prompts.select(key, F.col(prompt).alias("_prompt"), prompt_key(prompt).alias("sha"))
    asked = keyed.where(F.col("sha").isNotNull()).groupBy("sha").agg(F.first("_prompt").alias("_prompt"))
    tasks = tasks or int(spark.conf.get("spark.sql.shuffle.partitions"))
    for attempt in range(max_attempts):
        state = store.state(max_attempts)
        open_ = asked.join(state, "sha", "left").where(F.col("won").isNull() & (F.coalesce(F.col("last") + 1, F.lit(0)) == attempt))
        if not open_.limit(1).count():
            continue  # a later attempt may be open from an earlier run
        text = F.when(F.col("last").isNull(), F.col("_prompt")).otherwise(repair_prompt(F.col("_prompt"), F.col("text"), F.coalesce("error", F.lit("it is unknown"))))
        todo = open_.select("sha", F.lit(attempt).alias("attempt"), text.alias("prompt")).repartition(tasks, "sha")

        def run(batches: Iterable):
            for pdf in batches:
                if len(pdf):
                    out = pdf[["sha", "attempt"]].copy()
                    out["text"] = list(model_fn(pdf["prompt"].tolist()))
                    yield out

        store.add(todo.mapInPandas(run, "sha string, attempt int, text string"))
    state = store.state(max_attempts).select("sha", "won")
    return (keyed.join(state, "sha", "left")
            .select(key, "sha", F.col("won.attempt").alias("winning_attempt"), F.coalesce("won.status", F.lit("failed")).alias("status"),
                    F.coalesce("won.value", F.lit("{}")).alias("value")))
