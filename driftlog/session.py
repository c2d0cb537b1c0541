"""Session helpers: local sessions for tests, shipping the package, shared scratch space, lean Python workers."""

from __future__ import annotations

import ctypes
import functools
import gc
import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

PACKAGE = Path(__file__).resolve().parent


def local_session(cores: int | str = "*", app: str = "driftlog", **conf: str) -> SparkSession:
    """A local session with the settings that tests and the bench share."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "6g")
        .config("spark.sql.adaptive.enabled", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship_package(spark: SparkSession) -> None:
    """Make ``driftlog`` importable in Python workers, whatever their working folder is."""
    context = spark.sparkContext
    if getattr(context, "_driftlog_shipped", False):
        return
    target = os.path.join(tempfile.mkdtemp(prefix="driftlog-"), "driftlog_pkg.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as archive:
        for source in sorted(PACKAGE.rglob("*.py")):
            archive.write(source, Path("driftlog") / source.relative_to(PACKAGE))
    context.addPyFile(target)
    context._driftlog_shipped = True


def scratch_dir(spark: SparkSession) -> str:
    """The folder all executors share (``spark.checkpoint.dir``). Where it is unset, a folder of this machine
    serves a local session; on a cluster executors couldn't see it, so that is an error."""
    context = spark.sparkContext
    shared = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not shared:
        if not context.master.startswith("local[") and context.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        shared = tempfile.mkdtemp(prefix="driftlog-checkpoints-")
        context.setCheckpointDir(shared)
    return shared.rstrip("/")


def written(df: DataFrame, tag: str, compression: str = "zstd") -> DataFrame:
    """Write ``df`` to the shared folder as Parquet and read it back: lineage is cut, and losing
    an executor costs no more than the running tasks. ``discard`` removes the files."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.written_path = path
    return table


def remove_path(spark: SparkSession, path: str) -> None:
    """Removes a file or folder from whatever store the path names."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(target, True)


def discard(*tables: DataFrame) -> None:
    """Removes the files of tables from ``written`` that no later step reads. Only after all that was made of them is
    itself written, so that a lost executor's tasks never need them again."""
    for table in tables:
        if path := getattr(table, "written_path", None):
            remove_path(table.sparkSession, path)


def trim_memory() -> None:
    """Gives back what a Python worker has freed; workers are reused and would carry it into later stages."""
    gc.collect()
    try:
        import pyarrow

        pyarrow.default_memory_pool().release_unused()
        ctypes.CDLL(None).malloc_trim(0)
    except (ImportError, OSError, AttributeError):  # other platforms keep it
        pass


def lean(batches_of: Callable[..., Iterator]) -> Callable[..., Iterator]:
    """A function over batches that gives its memory back when its task ends."""

    @functools.wraps(batches_of)
    def run(*args, **kwargs):
        try:
            yield from batches_of(*args, **kwargs)
        finally:
            trim_memory()

    return run
