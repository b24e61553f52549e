"""Session construction and the shared checkpoint folder."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import Observation, SparkSession

# Defaults sized for local[N] tests; a cluster passes its own values through spark-defaults.
_DEFAULTS = {
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # checkpoint files go when their frames are garbage-collected
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    # max_by/min_by and top-k rely on deterministic tie breaks; keep ANSI on (Spark 4 default).
    "spark.sql.ansi.enabled": "true",
}


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app: str = "tessera", extra: dict | None = None) -> SparkSession:
    """Get or create a session with AQE and skew-join handling switched on."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    conf = dict(_DEFAULTS)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.setdefault("spark.driver.memory", os.environ.get("TESSERA_DRIVER_MEMORY", "16g"))
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once per context (they need not have it installed).

    The archive is made in the driver's own temporary folder; Spark's file service carries it.
    """
    sc = spark.sparkContext
    if getattr(sc, "_tessera_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    if os.path.isdir(root):  # already inside an archive: nothing to ship
        name = os.path.join(tempfile.mkdtemp(prefix="tessera-"), "tessera_pkg.zip")
        with zipfile.ZipFile(name, "w") as z:
            for d, _, files in os.walk(root):
                for f in sorted(files):
                    if f.endswith(".py"):
                        full = os.path.join(d, f)
                        z.write(full, os.path.relpath(full, os.path.dirname(root)))
        sc.addPyFile(name)
    sc._tessera_shipped = True


def checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by the cluster.

    Read from the session (``spark.checkpoint.dir`` or an already set SparkContext
    folder). Only a local-mode session without one gets a private folder, as in tests;
    a cluster session without the setting is an error, never a machine-local folder.
    """
    sc = spark.sparkContext
    d = sc.getCheckpointDir()
    if d:
        return d
    d = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if d:
        sc.setCheckpointDir(d)
        return sc.getCheckpointDir() or d
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a shared folder for iterative jobs")
    d = tempfile.mkdtemp(prefix="tessera-ckpt-")
    sc.setCheckpointDir(d)
    return sc.getCheckpointDir() or d


def cut_lineage(df):
    """Materialise ``df`` in the shared checkpoint folder (reliable, survives executor loss).

    A checkpointed frame normally keeps the optimizer's size estimate of the plan it
    replaces; joins multiply estimates, so in a fixpoint loop the estimate grows
    exponentially round after round (planning time explodes). The checkpointed rows are
    therefore re-wrapped as a new frame over the same checkpoint files, without the old
    estimate; AQE still sees true sizes at run time.
    """
    spark = df.sparkSession
    checkpoint_dir(spark)
    ck = df.checkpoint(eager=True)
    js = spark._jsparkSession
    try:
        # the checkpointed rows as they are (no conversion), in a plan without the estimate
        rdd = ck._jdf.queryExecution().analyzed().rdd()
        jdf = js.internalCreateDataFrame(rdd, ck._jdf.schema(), False)
    except Exception:  # noqa: BLE001 - public fallback: same rows through external Row objects
        jdf = js.createDataFrame(ck._jdf.rdd(), ck._jdf.schema())
    out = type(df)(jdf, spark)
    out._checkpoint = _checkpoint_file(ck)
    return out


def bucketed(df, keys: list[str], n: int, **figures):
    """Write ``df`` into ``n`` sorted buckets by ``keys`` in the shared folder and return it as a table.

    Joins and aggregations on the keys read the buckets as they are; the other side alone is
    shuffled. ``release`` drops the table. Aggregates given in ``figures`` are observed while the table is
    written, without another pass; they come back as the dictionary ``figures`` of the table.
    """
    spark = df.sparkSession
    name = f"tessera_{uuid.uuid4().hex}"
    path = f"{checkpoint_dir(spark).rstrip('/')}/{name}"
    seen = Observation(name) if figures else None
    if seen is not None:
        df = df.observe(seen, *[c.alias(k) for k, c in figures.items()])
    df.write.option("path", path).bucketBy(n, *keys).sortBy(*keys).saveAsTable(name)
    out = spark.table(name)
    out._table, out._checkpoint = name, path
    out.figures = seen.get if seen is not None else {}
    return out


def _checkpoint_file(ck) -> str | None:
    """Folder of the frame's checkpoint, or None where the plan does not tell."""
    try:
        f = ck._jdf.queryExecution().analyzed().rdd().getCheckpointFile()
        return f.get() if f.isDefined() else None
    except Exception:  # noqa: BLE001 - left to the context cleaner
        return None


def release(*frames) -> None:
    """Delete the checkpoints of frames from ``cut_lineage`` (tables of ``bucketed``) that nothing reads any more.

    A loop calls it on the state of the round before, once the next state is materialised, so the
    shared folder holds one state instead of one per round. Unreleased ones go with the cleaner.
    """
    for df in frames:
        name = getattr(df, "_checkpoint", None)
        if getattr(df, "_table", None):
            df.sparkSession.sql(f"DROP TABLE IF EXISTS {df._table}")
        if name:
            jvm = df.sparkSession.sparkContext._jvm
            p = jvm.org.apache.hadoop.fs.Path(name)
            p.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
