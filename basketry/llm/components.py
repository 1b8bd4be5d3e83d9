"""Connected components of an edge table: tasks contract chunks of edges to stars, then large-star and small-star rounds alternate."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.llm.common import stored

#: Edges that a task contracts at once. Where all fit in one chunk no rounds are needed.
CHUNK = 100_000


def least_of_each(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For nodes 0 .. n - 1 the least node reachable by the edges (a[i], b[i]): roots hook onto lesser roots, paths are halved."""
    root = np.arange(max(a.max(initial=-1), b.max(initial=-1)) + 1)
    while True:
        x, y = root[a], root[b]
        new = root.copy()
        np.minimum.at(new, np.maximum(x, y), np.minimum(x, y))
        while (new[new] != new).any():
            new = new[new]
        if (new == root).all():
            return root
        root = new


def contracted(edges: DataFrame, chunk: int) -> DataFrame:
    """Edges (a, b) with the same components: each chunk of a partition's edges becomes stars around its least nodes."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def stars(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
            table = pa.Table.from_batches(parts)
            node, place = np.unique(np.concatenate([c.to_numpy() for c in table.columns]), return_inverse=True)
            root = least_of_each(place[: len(table)], place[len(table) :])
            far = np.flatnonzero(root != np.arange(len(node)))
            return pa.RecordBatch.from_arrays([pa.array(node[far], table.schema.types[0]), pa.array(node[root[far]], table.schema.types[1])], names=["a", "b"])

        held, rows = [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, chunk):
                part = batch.slice(at, chunk)
                if rows + part.num_rows > chunk:
                    yield stars(held)
                    held, rows = [], 0
                held.append(part)
                rows += part.num_rows
        if rows:
            yield stars(held)

    kept = edges.select("a", "b").where("a <> b")
    return kept.mapInArrow(work, kept.schema)


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.hash("a", "b").cast("bigint")), F.sum(F.hash("b", "a").cast("bigint"))).first())


def _large_star(edges: DataFrame) -> DataFrame:
    """Every neighbour larger than a node moves to the least of the node and its neighbours."""
    both = edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
    return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours all move to the least of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b")
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionAll(least.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(node, component) of every node with an edge to a lesser node, at once or by others; component is the least one, which has no row.

    edges has columns a and b of one type. The rounds grow with the logarithm of the
    longest path, and each is written to the shared folder; they end when nothing changes
    or when what is left fits in one chunk, which one task then contracts. Loops and
    repeated edges are harmless; no edges give no rows.
    """
    edges, before = stored(contracted(edges, chunk), "edges"), None
    while (now := _state(edges)) != before:
        if now[0] <= chunk:
            edges = stored(contracted(edges.coalesce(1), chunk), "edges")
            break
        edges, before = stored(_small_star(_large_star(edges)), "edges"), now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
