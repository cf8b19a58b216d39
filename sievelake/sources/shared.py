"""The folder that all executors share."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import SparkSession


def shared_dir(spark: SparkSession) -> str:
    """Folder that all executors share, as the cluster names it in spark.checkpoint.dir.

    Where the setting is absent, as in tests, a local master gets a temporary folder; a cluster gets an error.
    """
    path = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        path = current.get() if current.isDefined() else f"file://{tempfile.mkdtemp(prefix='sievelake-')}"
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(path)
    return path


def new_folder(spark: SparkSession, kind: str) -> str:
    """Name of a new folder in the shared one."""
    return os.path.join(shared_dir(spark), f"{kind}-{uuid.uuid4().hex}")


_temporary: list[tuple[SparkSession, str]] = []


def forget(spark: SparkSession, path: str) -> None:
    """Remove this folder when the Python process ends."""
    if not _temporary:
        atexit.register(_clean)
    _temporary.append((spark, path))


def _clean() -> None:
    for spark, path in _temporary:
        try:
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # noqa: BLE001 - the session may be gone, and its folder with it
            pass
