"""SRC-5..SRC-8: retrieval corpus, embedded corpus, previous output, evaluation cases."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

EMBEDDED_SCHEMA = ("id bigint, example string, rewrite string, "
                   "example_embedding array<float>, rewrite_embedding array<float>")

# The six fields of an evaluation case.
TEST_CASE_FIELDS = ["functionality", "source_code", "mysql_schema", "spanner_schema",
                    "ground_truth_solution", "description"]
TEST_CASE_SCHEMA = T.StructType([T.StructField(f, T.StringType()) for f in TEST_CASE_FIELDS])


class IntegrityError(ValueError):
    pass


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.exists(p)


def id_problems(df: DataFrame, id_col: str = "id") -> DataFrame:
    """AGG-10: ids that are missing or appear more than once, with their count."""
    return (df.groupBy(id_col).agg(F.count(F.lit(1)).alias("n"))
            .where(F.col(id_col).isNull() | (F.col("n") > 1)))


def load_examples(spark: SparkSession, path: str) -> DataFrame:
    """SRC-5: retrieval corpus (JSON array); every record needs a unique ``id``.

    ``rewrite`` is kept as JSON text when it is an object, so both corpus variants
    (plain string, or theory + options) share one schema.
    """
    raw = spark.read.option("multiLine", "true").option("primitivesAsString", "false").json(path)
    if "id" not in raw.columns:
        raise IntegrityError("records have no id")
    rewrite = F.col("rewrite")
    if isinstance(raw.schema["rewrite"].dataType, (T.StructType, T.ArrayType, T.MapType)):
        rewrite = F.to_json(rewrite)
    df = raw.select(F.col("id").cast("bigint").alias("id"), F.col("example").cast("string").alias("example"),
                    rewrite.cast("string").alias("rewrite"))
    bad = id_problems(df).limit(1).collect()
    if bad:
        raise IntegrityError(f"missing or duplicate id: {bad[0]['id']!r}")
    return df


def load_embedded(spark: SparkSession, path: str) -> DataFrame:
    """SRC-6: embedded corpus (JSON array files, or parquet written by SNK-4); vectors as float32; of records with the
    same id the later one wins: the greater file name, then the later place in the file, however the files are split.
    """
    if path.rstrip("/").endswith(".json"):
        found = (spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("_file"), "value")
                 .select("_file", F.posexplode(F.from_json("value", f"array<struct<{EMBEDDED_SCHEMA.replace(' ', ':').replace(',:', ',')}>>")).alias("_row", "_r"))
                 .select("_r.*", "_file", F.col("_row").cast("long").alias("_row")))
    else:
        df = spark.read.schema(EMBEDDED_SCHEMA).parquet(path)
        found = df.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    w = Window.partitionBy("id").orderBy(F.desc("_file"), F.desc("_row"))
    return found.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "_file", "_row")


def load_previous_output(spark: SparkSession, path: str) -> DataFrame:
    """SRC-7: the previous embedded corpus; missing or not Parquet -> typed empty frame.

    The count reads every file's footer, so a broken file behind the first is seen as well. Any
    other failure (permissions, network) is raised: starting empty would overwrite a good corpus.
    """
    empty = spark.createDataFrame([], EMBEDDED_SCHEMA)
    if not _exists(spark, path):
        return empty
    df = spark.read.schema(EMBEDDED_SCHEMA).parquet(path)
    try:
        df.count()
    except Exception as e:  # noqa: BLE001 - only "this is no Parquet file" means "start from scratch"
        if "is not a Parquet file" in str(e) or "not a Parquet file" in str(getattr(e, "java_exception", "")):
            return empty
        raise
    return df


def load_test_cases(spark: SparkSession, path: str) -> DataFrame:
    """SRC-8: evaluation cases (JSON array of six-field objects).

    A missing file or invalid JSON gives an empty frame; a record with an unexpected or a missing
    field is an error (a null value is not). Records are read as maps, so each one shows its own
    fields; a column reader would fill missing ones with null.
    """
    empty = spark.createDataFrame([], TEST_CASE_SCHEMA)
    if not _exists(spark, path):
        return empty
    cases = (spark.read.text(path, wholetext=True)
             .select(F.explode(F.from_json("value", "array<map<string,string>>")).alias("m")))
    fields = F.array_sort(F.map_keys("m"))
    wrong = cases.where(~fields.eqNullSafe(F.array(*[F.lit(f) for f in sorted(TEST_CASE_FIELDS)])))
    bad = wrong.select(fields.alias("fields")).limit(1).collect()
    if bad:
        raise ValueError(f"test case fields: {bad[0]['fields']}, expected {sorted(TEST_CASE_FIELDS)}")
    return cases.select(*[F.col("m")[f].alias(f) for f in TEST_CASE_FIELDS])
