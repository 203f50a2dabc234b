"""Connected components of a graph of links, distributed (alternating large-star and small-star steps)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlark.llm.common import discard, stage_table


def _least_neighbour(edges: DataFrame) -> DataFrame:
    """``edges`` (u, v) with the least v of each u as m.

    The minima are grouped by (u, h) and joined by u alone, so that both sides
    of the join are dealt anew and Spark can split the rows of a hot node.
    """
    least = edges.groupBy("u", F.pmod(F.xxhash64("u"), F.lit(2)).alias("h")).agg(F.min("v").alias("m"))
    return edges.join(least.select(F.col("u"), "m"), "u")


def connected_components(links: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(node, component) of each node that has a link; the component is its smallest node.

    ``links`` may hold repeated, reversed and self links and nulls (which count as
    no link). Each round writes its edges to the shared folder; only two numbers
    a round reach the driver. Rounds grow with the logarithm of the diameter; a
    graph that is not done after ``max_rounds`` raises an error.
    """
    kind = dict(links.dtypes)[a]
    edges = links.select(F.col(a).cast(kind).alias("u"), F.col(b).cast(kind).alias("v")).where("u IS NOT NULL AND v IS NOT NULL AND u <> v")
    edges = stage_table(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    before = None
    for _ in range(max_rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _least_neighbour(both).select("u", "v", F.least("u", "m").alias("m")).where("v > u")
        large = large.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        small = _least_neighbour(large)
        small = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(large.groupBy("u").agg(F.min("v").alias("v")))
        old, edges = edges, stage_table(small.distinct(), "edges")
        discard(old)
        now = tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components are not complete after {max_rounds} rounds")
    nodes = edges.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node")
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return nodes.unionByName(roots.join(nodes.select("node"), "node", "left_anti"))
