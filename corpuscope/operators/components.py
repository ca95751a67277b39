"""Connected components over an edge table by alternating star contraction
(Kiveris et al., "Connected Components in MapReduce and Beyond", 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .skew import HOT_ROWS, split_join


def _is_star_forest(edges: DataFrame) -> bool:
    """Every ``hi`` has one ``lo`` and no ``lo`` is a ``hi`` itself."""
    nodes = edges.select(F.col("hi").alias("node"), F.lit(1).alias("as_hi"), F.lit(0).alias("as_lo"))
    nodes = nodes.unionByName(
        edges.select(F.col("lo").alias("node"), F.lit(0).alias("as_hi"), F.lit(1).alias("as_lo"))
    )
    state = nodes.groupBy("node").agg(F.sum("as_hi").alias("h"), F.max("as_lo").alias("l"))
    return state.filter((F.col("h") > 1) | ((F.col("h") > 0) & (F.col("l") > 0))).isEmpty()


def _large_star(edges: DataFrame, hot_rows: int | None) -> DataFrame:
    """Connect every larger neighbour of a node to the smallest of its neighbourhood."""
    both = edges.select(F.col("lo").alias("u"), F.col("hi").alias("v")).unionByName(
        edges.select(F.col("hi").alias("u"), F.col("lo").alias("v"))
    )
    lows = both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
    lows = lows.select("u", F.least("u", "m").alias("m"), "n")
    joined = split_join(both.filter(F.col("v") > F.col("u")), lows, ["u"], "n", hot_rows=hot_rows)
    return joined.select(F.col("m").alias("lo"), F.col("v").alias("hi")).distinct()


def _small_star(edges: DataFrame, hot_rows: int | None) -> DataFrame:
    """Connect a node and its smaller neighbours to the smallest of them."""
    lows = edges.groupBy("hi").agg(F.min("lo").alias("m"), F.count(F.lit(1)).alias("n"))
    joined = split_join(edges, lows, ["hi"], "n", hot_rows=hot_rows)
    moved = joined.filter(F.col("lo") != F.col("m")).select(F.col("m").alias("lo"), F.col("lo").alias("hi"))
    own = lows.select(F.col("m").alias("lo"), "hi")
    return moved.unionByName(own).distinct()


def star_components(edges: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Edges (lo < hi, distinct) to a star forest: ``lo`` is the smallest node of
    the component of ``hi``. Rounds grow with the logarithm of the longest chain;
    each round's edges are written to the scratch area."""
    current = materialize(edges, "edges")
    while not _is_star_forest(current):
        # No node has more edges than there are; contraction adds none.
        hot = hot_rows if current.count() >= hot_rows else None
        current = materialize(_small_star(_large_star(current, hot), hot), "edges")
    return current
