"""Connected components of a table of edges, by hooking and pointer jumping."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.shared import cut


def components(edges: DataFrame, cut: Callable[[DataFrame, str], DataFrame] = cut) -> DataFrame:
    """(node, label) for every node of ``edges`` (a, b): the smallest node that it is connected to.

    A round gives each node the smallest label of its neighbours, lets all nodes of one label
    follow the best of them, and then takes the label of that label.  Whole trees move at once,
    so the rounds grow with the logarithm of a component's size.  Each round starts from a
    written table (by ``cut``), of no more partitions than there are cores.
    """
    cores = edges.sparkSession.sparkContext.defaultParallelism
    keep = lambda df, name: cut(df.coalesce(cores), name)
    both = keep(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "component-edges")
    labels = keep(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("label")).withColumnRenamed("a", "node"), "component-labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("label").alias("near")).withColumnRenamed("a", "node")
        lower = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("near"))
        hooks = lower.groupBy("old").agg(F.min("near").alias("hook"))
        roots = hooks.join(labels.select(F.col("node").alias("hook"), F.col("label").alias("next")), "hook").select("old", F.least("hook", "next").alias("root"))
        new = keep(lower.join(roots, "old").select("node", "old", F.least("near", "root").alias("label")), "component-labels")
        labels = new.select("node", "label")
        if new.where("old <> label").isEmpty():
            return labels
