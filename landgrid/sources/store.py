"""Tables that queries store once and read again: indexes and features in key order, in the folder that all machines share."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_stored: dict[tuple[str, str, str], tuple[SparkSession, str]] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; only where that is unset and one machine does all (tests), a new local one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        given = spark.sparkContext._jsc.sc().getCheckpointDir()
        folder = given.get() if given.isDefined() else None
    if not folder:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="landgrid-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that goes when the process ends."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    _stored[spark.sparkContext.applicationId, path, name] = (spark, path)
    return path


def stored_once(spark: SparkSession, source: str, name: str, write: Callable[[str], None]) -> DataFrame:
    """The table that write(path) makes from a source, made at its first use in an application and read from then on."""
    key = (spark.sparkContext.applicationId, source, name)
    if key not in _stored:
        path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        write(path)
        _stored[key] = (spark, path)
    return spark.read.parquet(_stored[key][1])


@atexit.register
def _discard_all() -> None:
    for spark, path in _stored.values():
        try:
            if spark.sparkContext._jsc is not None:
                target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
                target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
        except Exception:  # the session may be gone; its folder then goes with it
            return
