"""Connected components of a graph of links, by joins that halve the distance to the least node."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from demandry.session import materialize


def _both(edges: DataFrame) -> DataFrame:
    return edges.select("hi", "lo").union(edges.select(F.col("lo").alias("hi"), F.col("hi").alias("lo")))


def _pairs(a: str, b: str) -> list:
    return [F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")]


def tightened(links: DataFrame, a: str = "a", b: str = "b", rounds: int | None = None) -> DataFrame:
    """(hi, lo): edges that connect the same nodes as ``links``, after so many rounds, or until nothing changes.

    Each round ties every neighbour of a node, and the node, to the least of them. The number of edges never grows
    beyond that of the links, a hot node is aggregated before it is shuffled, and each round is a written table, so
    a lost executor costs one round at most."""
    edges = materialize(links.where(F.col(a) != F.col(b)).select(*_pairs(a, b)).distinct(), "links")
    before, done = None, 0
    while done != rounds:
        if rounds is None:
            sign = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("hi", "lo")).alias("x")).first()
            if sign["n"] == 0 or sign == before:
                break
            before = sign
        both = _both(edges)
        least = both.groupBy(F.col("hi").alias("at")).agg(F.min("lo").alias("m")).select("at", F.least("at", "m").alias("m"))
        tied = both.join(least, F.col("hi") == F.col("at")).select(F.explode(F.array("hi", "lo")).alias("node"), "m")
        edges = materialize(tied.where(F.col("node") != F.col("m")).select(*_pairs("node", "m")).distinct(), "links")
        done += 1
    return edges


def roots(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) of all nodes that are not the least of their component; any sortable node type."""
    return tightened(links, a, b).select(F.col("hi").alias("node"), F.col("lo").alias("root"))
