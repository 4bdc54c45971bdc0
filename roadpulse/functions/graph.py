"""Connected components of an edge table, as rounds of joins and aggregations.

Alternating large-star / small-star contraction: each round replaces a node's
edges by edges to its least neighbour, first towards larger, then towards
smaller nodes.  The rounds end when the edge set no longer changes; it is then
one star per component.  Each round's edges are written to the shared folder, so
a lost executor costs at most one round.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpoint_dir


def _written(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node of ``edges``; ``root`` is the least node of its component.

    Nodes may be of any orderable type; self-loops only name a node.
    """
    base = f"{checkpoint_dir(edges.sparkSession).rstrip('/')}/components-{uuid.uuid4().hex}"
    u, v = F.col("u"), F.col("v")
    all_edges = _written(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).distinct(), f"{base}/edges")
    e = all_edges.filter(u != v)
    last, step = None, 0
    while True:
        both = e.select("u", "v").union(e.select(v.alias("u"), u.alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter(v > u).join(least, "u").select(v.alias("u"), F.col("m").alias("v")).distinct()
        large = large.filter(u != v)          # always u > v
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").filter(v != F.col("m")).select(v.alias("u"), F.col("m").alias("v"))
        nxt = _written(small.union(low.select("u", F.col("m").alias("v"))).distinct(), f"{base}/round{step}")
        state = nxt.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))")).first()
        if state == last:
            break
        e, last, step = nxt, state, step + 1
    nodes = all_edges.select(u.alias("node")).union(all_edges.select(v.alias("node"))).distinct()
    return nodes.join(nxt.select(u.alias("node"), v.alias("root")), "node", "left").select(
        "node", F.coalesce("root", "node").alias("root"))
