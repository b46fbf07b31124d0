"""Makes the package importable in Python workers."""

from __future__ import annotations

import os
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent.parent
_sent: set[str] = set()
VECTORED = "parquet.hadoop.vectored.io.enabled"
BATCH_ROWS, BATCH_BYTES = "2000", str(2 << 20)  # of the batches that Python workers get; Spark's own defaults are 10000 rows of any length


def ship(spark: SparkSession) -> SparkSession:
    """Sends the package to the executors once a session, unless their PYTHONPATH has it (inherited from the driver's), and bounds batches.

    Parquet's vectored reads are turned off unless set: each thread of their pool keeps a direct buffer of the largest
    range it has read, beside the heap.
    """
    context = spark.sparkContext
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    if spark.conf.get(VECTORED, None) is None and context._jsc.hadoopConfiguration().get(VECTORED) is None:
        spark.conf.set(VECTORED, "false")
    if str(ROOT) in os.environ.get("PYTHONPATH", "").split(os.pathsep) or context.applicationId in _sent:
        return spark
    _sent.add(context.applicationId)
    folder = tempfile.mkdtemp(prefix="landgrid-")
    context.addPyFile(shutil.make_archive(f"{folder}/landgrid", "zip", ROOT, "landgrid"))
    return spark
