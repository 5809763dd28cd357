"""Session helpers.

Nothing here overrides settings a cluster already provides: every value is a
default that is applied only when the session has none.
"""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

# Defaults for local runs and tests.  A cluster's own configuration wins.
LOCAL_DEFAULTS = {
    "spark.sql.shuffle.partitions": "8",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.driver.memory": "16g",
}

#: Bytes of rows that go to a Python worker at a time.  Spark's own default (64 MB) is held several times over, in
#: the JVM's direct memory and in Arrow, Python and numpy form, by each of an executor's workers.
ARROW_BATCH = ("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))
SPARK_ARROW_BATCH = "67108864b"


def get_spark(master: str | None = None, app_name: str = "recipeflow", **conf) -> SparkSession:
    """Return the active session, or build a local one with sane defaults."""
    active = SparkSession.getActiveSession()
    if active is not None:
        return active
    builder = SparkSession.builder.appName(app_name)
    builder = builder.master(master or os.environ.get("RECIPEFLOW_MASTER", "local[8]"))
    for k, v in {**LOCAL_DEFAULTS, **conf}.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("WARN")
    ship_package(spark)
    return spark


def stage_root(spark: SparkSession) -> str:
    """The shared folder for intermediate data.

    ``spark.checkpoint.dir`` of the session, else the folder given to
    ``setCheckpointDir``.  A single-process master (``local[N]``) may fall back
    to a folder of its own; on any other master a missing setting is an error,
    because a machine-local folder is invisible to the other executors.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if base:
        return base.rstrip("/")
    master = spark.sparkContext.master or ""
    if master == "local" or master.startswith("local["):
        base = tempfile.mkdtemp(prefix="recipeflow-ckpt-")
        spark.sparkContext.setCheckpointDir(base)
        return base
    raise RuntimeError(
        "no shared folder for intermediate data: set spark.checkpoint.dir (or call "
        "SparkContext.setCheckpointDir) to a folder that every executor can reach"
    )


_STAGES: dict[str, list[str]] = {}


def work_dir(spark: SparkSession, *parts: str) -> str:
    """A fresh folder under :func:`stage_root`, removed when the application ends
    (or earlier, by :func:`clear_stages`)."""
    name = "-".join(parts) if parts else "stage"
    path = f"{stage_root(spark)}/recipeflow/{name}-{uuid.uuid4().hex[:12]}"
    app = spark.sparkContext.applicationId
    if app not in _STAGES:
        _STAGES[app] = []
        atexit.register(clear_stages, spark)
    _STAGES[app].append(path)
    return path


def clear_stages(spark: SparkSession) -> int:
    """Delete this application's stage folders; frames that read them are dead
    afterwards.  Returns how many were listed."""
    sc = spark.sparkContext
    if sc._jsc is None:  # already stopped
        return 0
    paths = _STAGES.pop(sc.applicationId, [])
    try:
        for p in paths:
            _delete(sc, p)
    except Exception:  # noqa: BLE001 - the JVM may be gone at interpreter exit
        return 0
    return len(paths)


#: Spark deletes the shuffle files of a finished statement, not first when the driver collects its objects.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stage(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write ``df`` once as parquet into the shared folder and read it back.

    Cuts lineage like a reliable ``checkpoint()`` and computes ``df`` exactly
    once; the files outlive any executor.  The write's own shuffle files go when it has ended:
    nothing reads them again.
    """
    spark = df.sparkSession
    path = work_dir(spark, name)
    before = spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        df.write.mode("overwrite").parquet(path)
    finally:
        if before is None:
            spark.conf.unset(SHUFFLE_CLEANUP)
        else:
            spark.conf.set(SHUFFLE_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._stage_path = path
    return out


def is_stage(df: DataFrame) -> bool:
    """Whether ``df`` is a frame that :func:`stage` returned: it can be read again without being computed again."""
    return getattr(df, "_stage_path", None) is not None


def discard(*frames: DataFrame) -> None:
    """Delete the files of frames that :func:`stage` returned, once what was made of them is written: frames that read them are dead."""
    for df in frames:
        path, sc = getattr(df, "_stage_path", None), df.sparkSession.sparkContext
        if path in _STAGES.get(sc.applicationId, []):
            _delete(sc, path)
            _STAGES[sc.applicationId].remove(path)


def _delete(sc, path: str) -> None:
    hp = sc._jvm.org.apache.hadoop.fs.Path(path)
    hp.getFileSystem(sc._jsc.hadoopConfiguration()).delete(hp, True)


def read_table_if_any(spark: SparkSession, path: str) -> DataFrame | None:
    """The parquet table at ``path``, or None if nothing was written there yet."""
    hp = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = hp.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return spark.read.parquet(path) if fs.exists(hp) else None


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``recipeflow`` importable by Python workers, wherever the driver was
    started: the package's code is zipped once per application and distributed
    with ``addPyFile`` (code only, some hundred KB; data never takes this route).
    Batches to the workers are kept small unless the application's settings size them."""
    sc = spark.sparkContext
    app = sc.applicationId
    if app in _SHIPPED:
        return
    _SHIPPED.add(app)
    if spark.conf.get(ARROW_BATCH[0], SPARK_ARROW_BATCH) == SPARK_ARROW_BATCH and not sc.getConf().contains(ARROW_BATCH[0]):
        spark.conf.set(*ARROW_BATCH)
    pkg_dir = os.path.dirname(os.path.abspath(__file__))
    parent = os.path.dirname(pkg_dir)
    archive = os.path.join(tempfile.mkdtemp(prefix="recipeflow-pyfiles-"), "recipeflow.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for root, _, files in os.walk(pkg_dir):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(root, f)
                    z.write(full, os.path.relpath(full, parent))
    sc.addPyFile(archive)
