"""Connected components of a link table by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latent.session import Workspace


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """One star step over links (a, b) with a > b, giving links of the same kind."""
    both = edges if not large else edges.unionByName(edges.selectExpr("b AS a", "a AS b"))
    least = both.groupBy("a").agg(F.min("b").alias("m"))
    joined = both.join(least, "a").withColumn("m", F.least("a", "m"))
    if large:  # neighbours above the node hang below the least one
        out = joined.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"),
                                                           F.col("m").alias("b"))
    else:  # the node and its lower neighbours hang below the least one
        out = (joined.where(F.col("b") != F.col("m")).select(F.col("b").alias("a"),
                                                             F.col("m").alias("b"))
               .unionByName(least.select("a", F.col("m").alias("b"))))
    return out.where("a > b").distinct()


def components(ws: Workspace, links: DataFrame) -> DataFrame:
    """(node, root) of every linked node; the root is the least node of its component.

    ``links`` holds (a, b) in any direction, each a node key of an orderable type. Every
    round is one written table; about log(longest path) rounds are needed. A node's row
    count never grows beyond the number of its links.
    """
    edges = ws.cut(links.where("a != b").select(F.greatest("a", "b").alias("a"),
                                                F.least("a", "b").alias("b")).distinct(), "links")
    mark = None
    while True:
        new = ws.cut(_stars(_stars(edges, True), False), "stars")
        now = new.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == mark:
            return new.select(F.col("a").alias("node"), F.col("b").alias("root"))
        edges, mark = new, now
