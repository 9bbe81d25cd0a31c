"""Session defaults and the shared scratch folder."""

from __future__ import annotations

import atexit
import contextlib
import sys
import tempfile
import uuid

from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession

_ROOTS: set[str] = set()
_SCOPES: list[str] = []


def local_session(cores: str = "8", memory: str = "12g", shuffle_partitions: int = 8) -> SparkSession:
    """A session for tests and the bench; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("docketry")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def scratch_root(spark: SparkSession) -> str:
    """The shared folder for this application's intermediate tables.

    It lies under the folder that the cluster names in ``spark.checkpoint.dir``.
    Without that setting a local session gets a folder of its own, as in tests;
    elsewhere a missing setting is an error, because executors on other machines
    could not read it. What is left there goes when the driver ends.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
        root = tempfile.gettempdir()
    path = f"{root.rstrip('/')}/docketry-{spark.sparkContext.applicationId}"
    if path not in _ROOTS:
        _ROOTS.add(path)
        atexit.register(delete_folder, spark, path)
    return path


def delete_folder(spark: SparkSession, path: str) -> None:
    """Remove a folder of the shared store; a session that is gone leaves it."""
    context = spark.sparkContext
    jvm = SparkContext._jvm  # also there when the session has stopped
    try:
        settings = context._jsc.hadoopConfiguration() if context._jsc else jvm.org.apache.hadoop.conf.Configuration()
        place = jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(settings).delete(place, True)
    except Exception as error:  # the JVM has ended
        print(f"left {path}: {type(error).__name__}", file=sys.stderr)


@contextlib.contextmanager
def scratch_scope(spark: SparkSession):
    """Intermediate tables written inside the block are deleted at its end, so use up the results before."""
    _SCOPES.append(uuid.uuid4().hex)
    path = "/".join([scratch_root(spark), *_SCOPES])
    try:
        yield
    finally:
        _SCOPES.pop()
        delete_folder(spark, path)


@contextlib.contextmanager
def small_batches(spark: SparkSession, rows: int = 1000):
    """Plans that run inside the block send so many rows to Python at once, for rows that hold whole texts.

    The buffers of a batch lie outside the JVM's heap, and twice in the Python worker.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh folder name under the shared scratch root."""
    return "/".join([scratch_root(spark), *_SCOPES, f"{label}-{uuid.uuid4().hex}"])


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and continue from the written table.

    The table outlives lost executors, and its size is known to the planner.
    """
    return written_table(df)[0]


def written_table(df: DataFrame) -> tuple[DataFrame, str]:
    """As ``cut_lineage``, with the folder, for a caller that deletes it when the table is used up."""
    path = scratch_path(df.sparkSession, "table")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path
