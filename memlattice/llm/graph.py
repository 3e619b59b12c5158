"""Connected components of links: in one task where they are few, else by alternating large and small stars, every round a written table."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memlattice.llm import _text
from memlattice.llm._shared import forget, written

ALONE = 1_000_000  # links of 16 bytes that one task takes; beyond, they are joined


def reachable(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of the links, in order, and for each the least node reachable.

    Each round ties roots to the least root that a link leads to, and nodes to their roots. A root that neither is tied nor gets
    another one in a round is tied in the next, so the rounds grow with the logarithm of the number of nodes.
    """
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    ends = ends.reshape(2, -1)
    root = np.arange(len(nodes))
    while True:
        x, y = root[ends]
        apart = x != y
        if not apart.any():
            return nodes, nodes[root]
        ends, x, y = ends[:, apart], x[apart], y[apart]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while not (root == (up := root[root])).all():
            root = up


def _alone(edges: DataFrame) -> DataFrame:
    """(a, b): b is the root of a, for links of at most ALONE rows; one task reads them, without a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        links = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if b.num_rows]
        if links:
            nodes, roots = reachable(*map(np.concatenate, zip(*links, strict=True)))
            tied = nodes != roots
            yield pa.RecordBatch.from_arrays([pa.array(nodes[tied]), pa.array(roots[tied])], names=["a", "b"])

    return written(edges.coalesce(1).mapInArrow(_text.trimmed(run), "a long, b long"), "stars")


def _rooted(edges: DataFrame) -> DataFrame:
    out = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    out.written_to = edges.written_to
    return out


def components(links: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """(node, root) for every node of a link; root is the least node reachable. Roots themselves are left out. Nodes are longs.

    A round of stars is several shuffles however few its links, and the driver holds plans, threads and broadcasts of all of them; so up
    to ALONE links are left to one task. Beyond, a large star ties each node's larger neighbours to its least neighbour, a small star
    ties its smaller ones and itself to the least. Both take the least neighbour by an aggregation with map-side combine and
    a join of (node, neighbour) with (node, least). A node with very many links is 16 bytes a link in that join's larger
    side, which adaptive execution splits where it exceeds its skew threshold. The rounds grow with the logarithm
    of the number of nodes; a round's table goes when the next one is written.
    """
    edges = written(links.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where("a <> b").distinct(), "links")
    before = (edges.count(), None)
    for _ in range(rounds):
        if before[0] <= ALONE:
            old, edges = edges, _alone(edges)
            forget(old)
            return _rooted(edges)
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct("b", "m"), F.struct(F.col("a").alias("b"), "m"))).alias("x")).select(F.col("x.b").alias("a"), F.col("x.m").alias("b"))
        old, edges = edges, written(small.where("a <> b").distinct(), "stars")
        forget(old)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if now == before:
            return _rooted(edges)
        before = now
    raise RuntimeError(f"components did not settle in {rounds} rounds")
