"""Connected components of an edge table, by contraction in Parquet-backed rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import join_evenly, stored


def components(edges: DataFrame, spark: SparkSession) -> DataFrame:
    """Rows (node, comp) for the nodes of edges (a, b); nodes of one component share comp.

    Each round every node hooks onto its smallest neighbour and the edges are
    rewritten to the hooks, until none is left; the rounds are stored, never
    collected. Groups are aggregated map-side, and the hook of a hub (a node
    with a good part of all edges) goes by broadcast, so a hub is no hot key.
    """
    edges = stored(spark, edges.select("a", "b").where("a <> b").distinct(), "edges")
    labels = None
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hook = stored(spark, both.groupBy("a").agg(F.min("b").alias("_m"), F.count("*").alias("degree")).select(F.col("a").alias("node"), F.least("a", "_m").alias("hook"), "degree"), "hooks")
        if labels is None:
            labels = hook.select("node", F.col("hook").alias("comp"))
        else:
            sizes = labels.groupBy("comp").agg(F.count("*").alias("size"))
            found = stored(spark, sizes.join(hook.select(F.col("node").alias("comp"), "hook"), "comp"), "moves")
            labels = join_evenly(labels, found, "comp", "size", ["node"]).select("node", F.coalesce("hook", "comp").alias("comp"))
            labels = stored(spark, labels, "labels")
        moved = join_evenly(edges, hook.select(F.col("node").alias("a"), F.col("hook").alias("ha"), "degree"), "a", "degree", ["b"])
        moved = join_evenly(moved, hook.select(F.col("node").alias("b"), F.col("hook").alias("hb"), "degree"), "b", "degree", ["a"])
        edges = stored(spark, moved.select(F.least("ha", "hb").alias("a"), F.greatest("ha", "hb").alias("b")).where("a <> b").distinct(), "edges")
    return labels if labels is not None else spark.createDataFrame([], "node long, comp long")
