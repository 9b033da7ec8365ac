"""Connected components of an edge table, without gathering it.

Partitions of at most ``EDGES_PER_TASK`` edges are first contracted to star forests;
if one partition held all edges that is the answer. Otherwise large-star and
small-star steps alternate until nothing changes, each round written to the shared
folder, so lost executors cost one round at most.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from frameloom.llm.common import materialize

EDGES_PER_TASK = 1_000_000


class Forest:
    """Union-find whose roots are the smallest members."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        up = self.up
        root = x
        while (parent := up.get(root, root)) != root:
            root = parent
        while x != root:
            up[x], x = root, up.get(x, x)
        return root

    def union(self, a: int, b: int) -> int:
        a, b = self.find(a), self.find(b)
        low, high = (a, b) if a < b else (b, a)
        self.up.setdefault(low, low)
        self.up[high] = low
        return low


def _contract(batches):
    forest = Forest()
    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            forest.union(a, b)
    nodes = [x for x in forest.up if forest.find(x) != x]
    for k in range(0, len(nodes), 50_000):
        part = nodes[k : k + 50_000]
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array([forest.find(x) for x in part], pa.int64())], names=["a", "b"])


def _round(edges: DataFrame) -> DataFrame:
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    lowest = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    large = both.join(lowest, "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
    least = large.groupBy("a").agg(F.min("b").alias("m"))
    joined = large.join(least, "a")
    return joined.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def connected_components(edges: DataFrame, edges_per_task: int = EDGES_PER_TASK) -> DataFrame:
    """edges: (a, b) longs. Gives (node, label) of every node of an edge; label is the smallest node of its component.

    Null ends and loops are ignored; repeated edges do no harm; no edges give no rows.
    """
    edges = materialize(edges.select("a", "b").where("a <> b"), "edges")
    tasks = max(1, -(-edges.count() // edges_per_task))
    stars = materialize((edges.repartition(tasks, "a") if tasks > 1 else edges.coalesce(1)).mapInArrow(_contract, "a long, b long"), "stars")
    seen = None
    while tasks > 1:
        stars = materialize(_round(stars), "stars")
        now = tuple(stars.agg(F.count("*"), F.expr("bit_xor(xxhash64(a, b))")).first())
        if now == seen:
            break
        seen = now
    return stars.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(stars.select(F.col("b").alias("node"), F.col("b").alias("label"))).distinct()
