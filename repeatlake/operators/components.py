"""Connected components of an undirected graph given as an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repeatlake.plans.storage import discard, materialize


def _signature(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)")).alias("s")).first()
    return row["n"], row["s"]


def _smallest(pairs: DataFrame, key: str, value: str) -> DataFrame:
    # written out, so that the join that follows has a plain exchange on both sides and a hub's rows can be split
    return materialize(pairs.groupBy(F.col(key).alias("node")).agg(F.min(value).alias("least")), "cc-min")


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """``(node, component)`` for every node that has an edge; component is its smallest node.

    Alternates two star contractions until nothing changes: every larger
    neighbour of a node is hung on the node's smallest neighbour, then the
    smaller neighbours are. Each round is two grouped minima and two equi
    joins, so a hub's rows are never gathered in one task. Loops, repeated
    edges and edges with a null end are ignored; no edges give no rows.
    """
    hi, lo = F.greatest(F.col(a), F.col(b)), F.least(F.col(a), F.col(b))
    plain = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    now = materialize(plain.select(hi.alias("hi"), lo.alias("lo")).distinct(), "cc-edges")
    seen = _signature(now)
    for _ in range(max_rounds):
        if not seen[0]:
            break
        both = now.select(F.col("lo").alias("u"), F.col("hi").alias("v")).unionByName(now.select(F.col("hi").alias("u"), F.col("lo").alias("v")))
        near = _smallest(both, "u", "v")
        large = now.join(near, now["lo"] == near["node"]).select("hi", F.least("lo", "least").alias("lo")).distinct()
        large = materialize(large, "cc-large")
        least = _smallest(large, "hi", "lo")
        hung = large.join(least, large["hi"] == least["node"])
        small = hung.where(F.col("lo") != F.col("least")).select(F.col("lo").alias("hi"), F.col("least").alias("lo"))
        after = materialize(small.unionByName(large.groupBy("hi").agg(F.min("lo").alias("lo"))).distinct(), "cc-edges")
        for old in (now, near, large, least):
            discard(old)
        now, before = after, seen
        seen = _signature(now)
        if seen == before:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = now.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct()
    return now.select(F.col("hi").alias("node"), F.col("lo").alias("component")).unionByName(roots)
