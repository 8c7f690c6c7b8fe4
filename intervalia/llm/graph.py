"""Connected components by contraction, with partial aggregation and no unbounded group."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from intervalia.llm.common import dropped, rows_of, saved


def components(links: DataFrame) -> DataFrame:
    """node, label for every node of links (a, b): label is the smallest node reachable.

    Every node takes its smallest neighbour as parent, parents are followed once more, and the links
    between different parents go on to the next round; the rounds end when none is left. The label of a
    root is itself, and as parents are never larger than their nodes, it is the smallest of its tree. The labels
    are the steps of all rounds, one after the other.
    """
    edges = saved(links.select("a", "b").where("a <> b").distinct(), "edges")
    steps = []
    while rows_of(edges):
        both = edges.union(edges.select("b", "a"))
        parent = saved(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("p")), "parents")
        up = parent.select(F.col("a").alias("x"), F.col("p").alias("q"))
        step = saved(parent.join(up, F.col("p") == F.col("x")).select("a", F.col("q").alias("p")), "steps")
        to = step.select(F.col("a").alias("x"), F.col("p").alias("q"))
        one = edges.join(to, F.col("a") == F.col("x")).select(F.col("q").alias("a"), "b")
        two = one.join(to, F.col("b") == F.col("x")).select("a", F.col("q").alias("b")).where("a <> b")
        rest = saved(two.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
        dropped(edges, parent)
        steps.append(step)
        edges = rest
    labels = steps[0].select(F.col("a").alias("node"), F.col("p").alias("label")) if steps else edges.select(F.col("a").alias("node"), F.col("b").alias("label"))
    for step in steps[1:]:
        to = step.select(F.col("a").alias("x"), F.col("p").alias("q"))
        labels = labels.join(to, F.col("label") == F.col("x"), "left").select("node", F.coalesce("q", "label").alias("label"))
    labels = saved(labels, "labels")
    dropped(edges, *steps)
    return labels
