"""Connected components by local contraction and alternating star steps.

Kiveris et al., "Connected Components in MapReduce and Beyond" (2014). Each
round first replaces the edges of a partition (PART_EDGES or so) by stars on the
least node of each local component, which keeps connectivity, then moves edges
between partitions by a large-star and a small-star step. Edges stay
distributed; when they fit one partition, the contraction alone ends it.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .storage import cut

PART_EDGES = 100_000


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b) for each node a of the partition that isn't the least b of its component."""
    up: dict[int, int] = {}

    def root(x: int) -> int:
        while (y := up.setdefault(x, x)) != x:
            up[x] = up.setdefault(y, y)
            x = up[x]
        return x

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            x, y = root(a), root(b)
            if x != y:
                up[max(x, y)] = min(x, y)
    pairs = [(x, r) for x in list(up) if (r := root(x)) != x]
    yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in pairs], pa.int64()), pa.array([r for _, r in pairs], pa.int64())], ["a", "b"])


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
    return moved.union(least.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node with an edge; root is the least node of its component.

    edges: long columns a and b without nulls, in any direction, repeats and
    loops allowed; they are read twice, so come checkpointed. No edges give no rows.
    """
    now, before = edges.select("a", "b").where("a <> b"), None
    while True:
        n, total = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if (n, total) == before or not n:
            break
        before = (n, total)
        parts = n // PART_EDGES + 1
        now = now.coalesce(parts).mapInArrow(_stars, "a long, b long")
        if parts == 1:
            now = cut(now)
            break
        now = cut(_small_star(_large_star(now)))
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
