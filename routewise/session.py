"""Spark session settings, the shared checkpoint folder and package shipping."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zipfile

from pyspark import SparkConf
from pyspark.sql import DataFrame, SparkSession

# Defaults for settings the submitter left open: UTC wall clock (timestamps are
# NTZ anyway), ANSI arithmetic (bad casts raise instead of silently nulling),
# adaptive execution for runtime broadcast / coalescing / skew splitting.
BASE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Broadcast only what the runtime statistics prove small.
    "spark.sql.autoBroadcastJoinThreshold": str(32 * 1024 * 1024),
    "spark.sql.adaptive.autoBroadcastJoinThreshold": str(32 * 1024 * 1024),
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    # lineage cuts are written to the shared checkpoint folder; delete them
    # once the DataFrame that owns them is garbage-collected
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def _submitted() -> dict[str, str]:
    """Settings that are already fixed: spark-submit's (Java properties of a
    launched gateway) or the running session's."""
    active = SparkSession.getActiveSession()
    conf = active.sparkContext.getConf() if active else SparkConf()
    return dict(conf.getAll())


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app_name: str = "routewise", extra: dict | None = None) -> SparkSession:
    """Session with this package's defaults. A setting the submitter already
    made is never overridden; ``shuffle_partitions`` and ``extra`` are
    defaults too."""
    conf = {**BASE_CONF, **(extra or {})}
    if shuffle_partitions is not None:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    if master and master.startswith("local"):
        conf.setdefault("spark.driver.memory", "8g")
    taken = _submitted()
    b = SparkSession.builder
    if "spark.app.name" not in taken:
        b = b.appName(app_name)
    if master and "spark.master" not in taken:
        b = b.master(master)
    for k, v in conf.items():
        if k not in taken:
            b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    prepare_session(spark)
    return spark


def prepare_session(spark: SparkSession) -> None:
    """What every job needs of a session it did not build itself."""
    ensure_checkpoint_dir(spark)
    ship_package(spark)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``. Only a local master may
    leave it unset (a fresh scratch folder is used, as in tests); on a
    cluster a missing shared folder is an error."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get(
        "spark.checkpoint.dir", None)
    if not configured:
        if not (sc.master.startswith("local[") or sc.master == "local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        configured = tempfile.mkdtemp(prefix="routewise-ckpt-")
    sc.setCheckpointDir(configured)
    return configured


def ship_package(spark: SparkSession) -> None:
    """Give the Python workers this package: a zip of its sources is added to
    the application once, so functions pickled by reference import on any
    executor whatever its working folder or PYTHONPATH."""
    sc = spark.sparkContext
    if getattr(sc, "_routewise_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    if os.path.isdir(root):  # else this very module already runs from a shipped zip
        path = os.path.join(tempfile.mkdtemp(prefix="routewise-pkg-"), "routewise_pkg.zip")
        with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
            for folder, _, names in os.walk(root):
                for name in sorted(names):
                    if name.endswith(".py"):
                        full = os.path.join(folder, name)
                        z.write(full, os.path.relpath(full, os.path.dirname(root)))
        sc.addPyFile(path)
    sc._routewise_shipped = True


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the shared checkpoint folder (survives the
    loss of the executors that computed ``df``)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def save_table(df: DataFrame, *partition_by: str) -> DataFrame:
    """``df`` written as Parquet into the shared checkpoint folder and read
    back: survives lost executors like a checkpoint, and later scans read only
    the columns and row groups they need. The files of a session are removed
    when its Python process ends."""
    spark = df.sparkSession
    sc = spark.sparkContext
    folder = getattr(sc, "_routewise_tables", None)
    if folder is None:
        folder = f"{ensure_checkpoint_dir(spark)}/tables-{sc.applicationId}"
        sc._routewise_tables = folder
        atexit.register(_remove_folder, sc, folder)
    path = f"{folder}/{uuid.uuid4().hex}"
    df.write.partitionBy(*partition_by).parquet(path)
    return spark.read.parquet(path)


def _remove_folder(sc, folder: str) -> None:
    if sc._jsc is None or sc._jsc.sc().isStopped():
        return
    path = sc._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)
