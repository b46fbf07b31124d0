"""What operators hold beside Spark's heap is bounded, whatever the texts."""

import hashlib
import tracemalloc

import pyarrow as pa

from landgrid.llm.suffix_dedup import _find_anchors
from landgrid.session import VECTORED, ship
from tests.llm.conftest import prose

LEAST = 200


def test_anchors_are_found_within_a_few_megabytes():
    texts = [prose(seed, 3000).encode() for seed in range(900, 930)] + [prose(930, 60_000).encode(), b"x" * 50_000]
    keys = [hashlib.sha256(t).digest()[:16] for t in texts]
    batch = pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(texts, pa.binary())], ["key", "t"])
    windows = dict.fromkeys(keys, 0)
    tracemalloc.start()
    try:
        for rows in _find_anchors(LEAST)(iter([batch])):
            for key, n, firsts in zip(*(rows.column(c).to_pylist() for c in ("key", "windows", "firsts"))):
                windows[key] += n * len(firsts)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert windows == {k: len(t) - LEAST + 1 for k, t in zip(keys, texts)}  # each window is dealt once
    assert peak < 14 << 20, peak


def test_reads_keep_no_direct_buffers(spark):
    fresh = ship(spark.newSession())
    assert fresh.conf.get(VECTORED) == "false"
    told = spark.newSession()
    told.conf.set(VECTORED, "true")
    assert ship(told).conf.get(VECTORED) == "true"
