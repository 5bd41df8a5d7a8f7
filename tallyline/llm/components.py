"""Connected components of a link table by alternating large and small stars; every round is a written table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tallyline.session import pin


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node in ``links`` (a, b); ``root`` is the smallest node reachable.

    A round joins every link with the smallest neighbour of its node: no neighbourhood is collected, a node with many
    links is a skewed join key at most.
    """
    edges = links.where("a <> b").selectExpr("greatest(a, b) AS a", "least(a, b) AS b").distinct()
    edges, last = pin(edges, "links"), None
    while True:
        both = edges.union(edges.selectExpr("b AS a", "a AS b"))
        lows = both.groupBy("a").agg(F.min("b").alias("m")).selectExpr("a", "least(a, m) AS m")
        large = both.join(lows, "a").where("b > a").selectExpr("b AS a", "m AS b").distinct()
        lows = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(lows, "a").selectExpr("b AS a", "m AS b").where("a <> b").union(lows.selectExpr("a", "m AS b")).distinct()
        edges = pin(small.selectExpr("greatest(a, b) AS a", "least(a, b) AS b"), "links")
        now = tuple(edges.distinct().agg(F.count("*"), F.expr("bit_xor(xxhash64(a, b))")).first())
        if now == last:
            return edges.distinct().selectExpr("a AS node", "b AS root").union(edges.selectExpr("b AS node", "b AS root").distinct())
        last = now
