"""Connected components of an edge table, distributed: alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import materialise, passing


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % 1_000_003), F.sum("b")).first())


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """node, component (smallest node reachable) for every node of the edges (a, b: long). Loops and repeated edges do no harm.

    Each step is an aggregation with map-side combine and an equi-join back, so a node with very many edges is no one task's burden;
    each round's edges are written to the shared folder, and nothing but a checksum of them comes to the driver. Rounds grow with the logarithm
    of the longest path; what has not settled after max_rounds raises an error.
    """
    with passing(edges.sparkSession) as keep:
        e = edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
        e = materialise(e, "edges")
        before = _state(e)
        for _ in range(max_rounds):
            both = e.union(e.select("b", "a"))
            least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
            # large star: every larger neighbour of u hangs on u's smallest neighbour
            large = both.join(least, both.a == least.u).where("b > u").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
            # small star: u and its smaller neighbours hang on the smallest of them
            low = large.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "u")
            hung = large.join(low, large.a == low.u)
            small = hung.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select(F.col("u").alias("a"), F.col("m").alias("b"))).distinct()
            e = materialise(small, "edges")
            after = _state(e)
            if after == before:
                break
            before = after
        else:
            raise RuntimeError("components did not settle")
        keep.append(e)
    roots = e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)
