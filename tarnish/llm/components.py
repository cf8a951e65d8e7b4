"""Connected components by hooking and pointer jumping on tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(id, label) for each end of ``edges`` (a, b): the smallest id of its
    component.  A round sends labels along the edges, to vertices and to the
    roots they had, and then takes each label's own label, so the number of
    rounds grows with the logarithm of a component's size.  Each round's
    labels are a table in the shared scratch folder."""
    both = written(edges.where("a <> b").select("a", "b").unionAll(edges.where("a <> b").select("b", "a")).distinct(), "cc-edges")
    labels = written(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("id"), F.least("a", "b").alias("label")), "cc-labels")
    for _ in range(rounds):
        near = both.join(labels.select(F.col("id").alias("a"), F.col("label").alias("la")), "a").join(labels.select(F.col("id").alias("b"), F.col("label").alias("lb")), "b").where("la > lb")
        near = written(near.select("a", "la", "lb"), "cc-news")
        if near.isEmpty():
            return labels
        news = near.select(F.col("a").alias("id"), F.col("lb").alias("label")).unionAll(near.select(F.col("la").alias("id"), F.col("lb").alias("label")))
        best = news.unionAll(labels).groupBy("id").agg(F.min("label").alias("label"))
        best = written(best, "cc-best")
        up = best.select(F.col("id").alias("label"), F.col("label").alias("up"))
        labels = written(best.join(up, "label", "left").select("id", F.least("label", F.coalesce("up", "label")).alias("label")), "cc-labels")
    raise RuntimeError("components did not settle")
