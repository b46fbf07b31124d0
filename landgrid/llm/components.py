"""Connected components of an edge table.

Each task first reduces the edges it has to a spanning forest. Up to ``in_one`` edges that remain go to one task;
beyond that bound, alternating large and small stars do it in rounds of joins.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from landgrid.llm.shared import written

EDGES = "a long, b long"


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    rest = down.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return rest.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


class Forest:
    """Components by least member, while edges come in."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        up, root = self.up, x
        while (above := up.get(root, root)) != root:
            root = above
        while x != root:
            up[x], x = root, up.get(x, x)
        return root

    def add(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)

    def stars(self) -> list[tuple[int, int]]:
        return [(x, self.find(x)) for x in list(self.up)]


def _table(forest: Forest) -> pa.Table:
    stars = forest.stars()
    return pa.table({"a": pa.array([a for a, _ in stars], pa.int64()), "b": pa.array([b for _, b in stars], pa.int64())})


def _reduced(batches):
    forest = Forest()
    for batch in batches:
        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist()):
            forest.add(a, b)
    yield from _table(forest).to_batches()


def _whole(table: pa.Table) -> pa.Table:
    forest = Forest()
    for a, b in zip(table.column("a").to_pylist(), table.column("b").to_pylist()):
        forest.add(a, b)
    return _table(forest)


def components(edges: DataFrame, in_one: int = 1_000_000) -> DataFrame:
    """a, b: for each node that isn't the least of its component, the least. Edges are pairs a, b of longs."""
    edges = written(edges.select("a", "b").filter("a <> b").mapInArrow(_reduced, EDGES), "edges")
    if edges.count() <= in_one:
        return written(edges.groupBy(F.lit(0).alias("all")).applyInArrow(_whole, EDGES), "stars")
    while True:
        edges = written(_small_star(_large_star(edges)), "stars")
        middle = edges.select(F.col("b").alias("a")).distinct().join(edges.select("a"), "a", "left_semi")
        if middle.isEmpty() and edges.count() == edges.select("a").distinct().count():
            return edges
