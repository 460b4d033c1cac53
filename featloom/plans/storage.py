"""Cutting lineage through the shared folder of the cluster."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import weakref

from pyspark.sql import DataFrame, SparkSession

_paths: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()
_written: dict[str, SparkSession] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Only a local session without the setting gets a folder of its own, which goes when the
    process ends; on a cluster such a folder would vanish with its machine, so there a
    missing setting is an error.
    """
    context = spark.sparkContext
    configured = context.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if configured is None:
        if not context.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="featloom-")
        atexit.register(shutil.rmtree, configured, ignore_errors=True)
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(configured)
    return configured


def scratch_path(spark: SparkSession, label: str) -> str:
    path = f"{shared_folder(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    _written[path] = spark
    return path


def materialise(frame: DataFrame, label: str) -> DataFrame:
    """Write a frame to the shared folder as parquet and read it back.

    The result survives the loss of executors, is columnar, and hides the cost of
    the plan that produced it from all later jobs.  ``release`` deletes it; what is left
    goes when the session ends.
    """
    path = scratch_path(frame.sparkSession, label)
    frame.write.parquet(path)
    stored = frame.sparkSession.read.schema(frame.schema).parquet(path)
    _paths[stored] = path
    return stored


def release(*frames: DataFrame | None) -> None:
    """Delete materialised frames that no later job reads.  Other frames are left alone."""
    for frame in frames:
        path = None if frame is None else _paths.pop(frame, None)
        if path is not None:
            _delete(_written.pop(path), path)


def _delete(spark: SparkSession, path: str) -> None:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


@atexit.register
def _release_all() -> None:
    for path, spark in _written.items():
        if spark.sparkContext._jsc is None:
            continue
        try:
            _delete(spark, path)
        except Exception:  # noqa: BLE001, S112  the session's JVM may be gone already
            continue
    _written.clear()
