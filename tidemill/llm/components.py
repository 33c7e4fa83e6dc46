"""Connected components of a distributed set of links.

Alternating large-star and small-star steps: every step takes the least neighbour of each node
(aggregated before the shuffle) and joins it back; the rows of a node with many links are dealt over
several tasks for that. Each round is cut off by a checkpoint in the shared folder.

A round writes some files for every partition of each of its shuffles, however few the links are. Up
to ``FEW`` links (16 bytes each) are therefore united within one task, without rounds; the result is
the same.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, checkpoint, fair_share, join_spread, tidy

#: Links that one task unites at most.
FEW = 1 << 20


def unite(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Join the components of i[k] and j[k] for all k at once. All of root point at true roots
    before and after, so that no node but a root is given a new parent."""
    while True:
        a, b = root[i], root[j]
        differ = a != b
        if not differ.any():
            return
        np.minimum.at(root, np.maximum(a, b)[differ], np.minimum(a, b)[differ])
        while (deeper := root[root] != root).any():
            root[deeper] = root[root][deeper]


@tidy
def _united(links: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All links (a, b) in, (node, root) out."""
    held = [np.stack([batch[c].to_numpy() for c in ("a", "b")]) for batch in links]
    if not held:
        return
    node, at = np.unique(np.concatenate(held, axis=1), return_inverse=True)
    i, j = at.reshape(2, -1)
    root = np.arange(len(node))
    unite(root, i, j)  # nodes are in order, so the least place is the least node
    yield from batches(pa.schema([("node", pa.int64()), ("root", pa.int64())]), [node, node[root]])


def _star(edges: DataFrame, large: bool, most: int) -> DataFrame:
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count("*").alias("n"))
    side = F.col("v") > F.col("u") if large else F.col("v") < F.col("u")
    moved = join_spread(both.where(side), least, "u", "n", most)
    out = moved.select(F.col("v").alias("a"), F.col("m").alias("b"))
    if not large:
        out = out.unionByName(least.where(F.col("m") < F.col("u")).select(F.col("u").alias("a"), F.col("m").alias("b")))
    return out.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def components(edges: DataFrame, few: int = FEW) -> DataFrame:
    """edges (a long, b long) in; (node long, root long) out, root being the least node of the
    component. Only nodes with a link appear."""
    edges = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = checkpoint(edges)
    state = None
    while True:
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == state or not now[0]:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        if now[0] <= few:
            return checkpoint(edges.coalesce(1).mapInArrow(_united, "node long, root long"))
        state = now
        most = fair_share(edges.sparkSession, 2 * now[0])
        edges = checkpoint(_star(_star(edges, True, most), False, most))
