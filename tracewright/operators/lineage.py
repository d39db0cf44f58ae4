"""Cutting lineage, and scratch space, in the folder that all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession

_LOCAL_ROOT: list[str] = []
_SCRATCH: set[str] = set()


def shared_root(spark: SparkSession) -> str:
    """The folder the cluster names in spark.checkpoint.dir; a temporary one, deleted at the end, only where it is unset (tests, local mode)."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if not _LOCAL_ROOT:
        _LOCAL_ROOT.append(tempfile.mkdtemp(prefix="tracewright-"))
        atexit.register(shutil.rmtree, _LOCAL_ROOT[0], True)
    return "file://" + _LOCAL_ROOT[0]


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder; what is written there goes when the program ends, if not before."""
    return _remembered(f"{shared_root(spark)}/tw-{name}-{uuid.uuid4().hex[:12]}")


def _remembered(path: str) -> str:
    if not _SCRATCH:
        atexit.register(_delete_all)
    _SCRATCH.add(path)
    return path


def delete(path: str) -> None:
    """Remove a file or folder, wherever Spark keeps it."""
    context = SparkContext._active_spark_context
    jvm = SparkContext._jvm
    if jvm is not None:
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(context._jsc.hadoopConfiguration() if context else jvm.org.apache.hadoop.conf.Configuration()).delete(target, True)
    _SCRATCH.discard(path)


def _delete_all() -> None:
    for path in sorted(_SCRATCH):
        try:
            delete(path)
        except Exception:  # the JVM is gone: nothing more can be done at the program's end
            return


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the checkpoint folder and read back from it."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_root(df.sparkSession))
    out = df.checkpoint()
    written = out._jdf.queryExecution().logical().rdd().getCheckpointFile()
    if written.isDefined():
        _remembered(written.get())
    return out
