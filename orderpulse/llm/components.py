"""Connected components by alternating large and small stars.

First each task hangs the edges it reads on the least node of their components
within the task. Then each round hangs every node on the least node it sees
(large star: the larger neighbours; small star: the smaller ones); the number of
rounds grows with the logarithm of the longest chain. Least neighbours are
grouped minima joined back to the edges, so a node with very many edges is never
gathered in one place.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderpulse.llm.common import stage

_LIMIT = 1_000_000  # nodes a task holds before it passes on what it has


def _forests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, least node of its component) for the edges of a task."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := root.setdefault(x, x)) != x:
            root[x] = x = root[up]
        return x

    def flush() -> pa.RecordBatch:
        hung = [(x, find(x)) for x in list(root)]
        hung = [(x, r) for x, r in hung if x != r]
        root.clear()
        return pa.RecordBatch.from_arrays(
            [pa.array([x for x, _ in hung], pa.int64()), pa.array([r for _, r in hung], pa.int64())], ["u", "v"])

    for b in batches:
        for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            x, y = find(x), find(y)
            if x != y:
                root[max(x, y)] = min(x, y)
        if len(root) >= _LIMIT:
            yield flush()
    yield flush()


def _star(edges: DataFrame) -> DataFrame:
    """Edges (u, v) with ``least``, the least of u and its neighbours."""
    least = edges.groupBy("u").agg(F.min("v").alias("least")).select(
        F.col("u"), F.least("u", "least").alias("least"))
    return edges.join(least, "u")


def _mark(edges: DataFrame) -> tuple:
    """Number and joint hash of the edges: equal when no edge changes."""
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b): the least node it is linked with."""
    edges = stage(edges.select("a", "b").where("a <> b").mapInArrow(_forests, "u long, v long").distinct(), "edges")
    before = _mark(edges)  # u > v throughout
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _star(both).where("v > u").select(F.col("v").alias("u"), F.col("least").alias("v"))
        large = stage(large.where("u <> v").distinct(), "large-star")
        hung = _star(large)
        small = hung.select(F.col("v").alias("u"), F.col("least").alias("v")).union(
            hung.select("u", F.col("least").alias("v")))
        edges = stage(small.where("u <> v").distinct(), "small-star")
        now = _mark(edges)
        if now == before:
            break
        before = now
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)
