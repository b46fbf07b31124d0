"""Tables in the folder that the driver and all executors share."""

from __future__ import annotations

import atexit
import ctypes
import gc
import math
import uuid
from collections.abc import Callable
from contextvars import ContextVar
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from landgrid.session import ship
from landgrid.sources.store import shared_folder

SPACE = r"[\x20\x09-\x0D]+"
M_MMAP_THRESHOLD = -3  # of mallopt
GROUP_BYTES = 16 << 20  # of a Parquet row group, which a writing task holds in memory
MAP_BITS = 24  # of a key bitmap: 2 MB at most, whatever the input
_written: list[tuple[SparkSession, str]] = []  # to be discarded when the process ends


class Scratch:
    """Tables written inside a ``with`` block; at its end all but the kept ones are discarded.

    What leaves the block may depend on kept tables only.
    """

    def __init__(self):
        self.tables: list[tuple[SparkSession, str]] = []
        self.kept: set[str] = set()

    def keep(self, table: DataFrame) -> DataFrame:
        self.kept.add(table.written_to)
        return table

    def __enter__(self) -> "Scratch":
        self.outer = _scratch.get()
        self.token = _scratch.set(self)
        return self

    def __exit__(self, *failed) -> None:
        _scratch.reset(self.token)
        beyond = _written if self.outer is None else self.outer.tables
        for spark, path in self.tables:
            if path in self.kept or failed[0] is not None:
                beyond.append((spark, path))
            else:
                discard(spark, path)


_scratch: ContextVar[Scratch | None] = ContextVar("scratch", default=None)


def written(df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
    """df as a Parquet table in the shared folder: it cuts lineage and survives the loss of executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("parquet.block.size", GROUP_BYTES).parquet(path, compression=codec)
    table = spark.read.schema(df.schema).parquet(path)
    table.written_to = path
    open_scratch = _scratch.get()
    (_written if open_scratch is None else open_scratch.tables).append((spark, path))
    return table


def discard(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


@atexit.register
def _discard_all() -> None:
    for spark, path in _written:
        try:
            if spark.sparkContext._jsc is not None:
                discard(spark, path)
        except Exception:  # the session may be gone; its folder then goes with it
            return


_held: dict[str, Callable[[], None]] = {}


def hold(name: str, forget: Callable[[], None] = lambda: None) -> None:
    """Said by a task as it starts: what other operators' tasks have left in this Python worker is forgotten.

    Workers live on from stage to stage; so they hold what one operator remembers at a time.
    """
    others = [n for n in _held if n != name]
    for n in others:
        _held.pop(n)()
    _held[name] = forget
    if others:
        gc.collect()
    _give_back()


def tidy(rows: Callable) -> Callable:
    """A task's function that returns freed memory when it has ended, as its worker may wait long for another task."""

    def run(batches):
        yield from rows(batches)
        _give_back()

    return run


@lru_cache(maxsize=1)
def _libc():
    """The C library, told to return arrays of a megabyte and more to the system once they are freed; None elsewhere."""
    try:
        libc = ctypes.CDLL("libc.so.6")
        libc.mallopt(M_MMAP_THRESHOLD, 1 << 20)
        return libc
    except (OSError, AttributeError):
        return None


def _give_back() -> None:
    """Returns memory that earlier tasks have freed."""
    pa.default_memory_pool().release_unused()
    if (libc := _libc()) is not None:
        libc.malloc_trim(0)


def body(text: str = "text") -> Column:
    """The text; null counts as empty."""
    return F.coalesce(F.col(text).cast("string"), F.lit(""))


def unused(columns: list[str], *names: str) -> list[str]:
    """The names, lengthened until they are none of the columns'."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/documents.parquet")


def key_bitmap(keys: DataFrame) -> tuple[np.ndarray, int]:
    """A bitmap over the low bits of key (long), by which a scan passes over rows that a later join would drop.

    It has about 16 bits for each key, up to MAP_BITS in the exponent; fuller, it only passes over fewer rows.
    """
    bits = min(MAP_BITS, max(12, math.ceil(math.log2(max(1, keys.count()))) + 4))
    low = keys.select(F.col("key").bitwiseAND(F.lit((1 << bits) - 1)).alias("bit"))
    words = low.groupBy(F.shiftright("bit", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("v")).collect()
    table = np.zeros(1 << (bits - 6), np.uint64)
    for word, value in words:
        table[word] = value & ((1 << 64) - 1)
    return table, bits
