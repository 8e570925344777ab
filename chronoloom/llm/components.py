"""Connected components by alternating large-star and small-star steps (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, stored


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, label) of all nodes of edges (u long, v long) but the least of each component; label: that least node.

    Each round is written to the shared folder, so that no lineage grows. Minima are taken by partial aggregates
    and joined back, so that a node with very many neighbours is never gathered in one place.
    """
    e = stored(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    state = _state(e)
    for _ in range(rounds):
        both = e.select(F.col("u").alias("a"), F.col("v").alias("b")).union(e.select(F.col("v").alias("a"), F.col("u").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))).distinct()
        new = stored(small, "edges")
        now = _state(new)
        discard(e)
        e = new
        if now == state:
            return e.select(F.col("u").alias("node"), F.col("v").alias("label"))
        state = now
    raise RuntimeError("components did not settle")


def _state(e: DataFrame) -> tuple:
    return tuple(e.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
