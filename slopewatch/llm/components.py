"""Connected components of an undirected graph by DataFrame joins alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace


def contracted(edges: DataFrame, ws: Workspace) -> DataFrame:
    """Fewer edges (a, b), a < b, of the same vertices and components.

    A vertex's smaller neighbours are all linked with the smallest of them, and the vertex as well.  Vertices that share
    their smaller neighbours, as the members of a group do that meet in many lists, then have one edge each and those
    neighbours one for all of them.
    """
    down = ws.table(edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "down")
    low = down.groupBy("b").agg(F.min("a").alias("low"))
    across = down.join(low, "b").filter("a > low").select(F.col("low").alias("a"), F.col("a").alias("b"))
    return low.select(F.col("low").alias("a"), "b").unionByName(across)


def components(edges: DataFrame, ws: Workspace) -> DataFrame:
    """(id, component): the smallest id that each vertex of (a long, b long) reaches.

    Each round takes the smallest label of the neighbours, then the label of that label.  Rounds are written tables; the
    driver sees one flag of each round.  A vertex with many edges only meets minima that are combined before a shuffle.
    Before the rounds, edges are made few (``contracted``): every round meets all of them in both directions.
    """
    edges = contracted(edges, ws)
    both = ws.table(edges.filter("a <> b").select("a", "b").union(edges.filter("a <> b").select("b", "a")).distinct(), "edges")
    labels = ws.table(both.groupBy("a").agg(F.min("b").alias("low")).select(F.col("a").alias("id"), F.least("a", "low").alias("component"), F.lit(True).alias("moved")), "labels")
    while labels.filter("moved").limit(1).count():
        near = both.join(labels.select(F.col("id").alias("b"), "component"), "b").groupBy("a").agg(F.min("component").alias("near"))
        step = labels.join(near.withColumnRenamed("a", "id"), "id", "left").select("id", F.col("component").alias("old"), F.least("component", F.coalesce("near", "component")).alias("mid"))
        jump = labels.select(F.col("id").alias("mid"), F.col("component").alias("far"))
        new = F.least("mid", F.coalesce("far", "mid"))
        labels = ws.table(step.join(jump, "mid", "left").select("id", new.alias("component"), (new < F.col("old")).alias("moved")), "labels")
    return labels.select("id", "component")
