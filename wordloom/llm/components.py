"""Connected components of a link table, distributed: least labels with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .stage import drop, written


def components(links: DataFrame) -> DataFrame:
    """(id, label) of every id in ``links`` (a, b), label being the least id reachable.

    Each round takes the least label among neighbours and then that label's own label, so rounds
    grow with the logarithm of a component's width. Every table is keyed by id; a hub's links are
    pre-aggregated before the shuffle, and its join is one that Spark can split. No links: no rows.
    """
    edges = written(
        links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(),
        "edges",
    )
    labels = written(edges.groupBy(F.col("a").alias("id")).agg(F.least(F.col("id"), F.min("b")).alias("label")), "labels")
    while True:
        heard = edges.join(labels, edges.a == labels.id).select(F.col("b").alias("id"), "label", F.lit(None).cast("long").alias("was"))
        nearest = (
            heard.unionByName(labels.select("id", "label", F.col("label").alias("was")))
            .groupBy("id")
            .agg(F.min("label").alias("label"), F.max("was").alias("was"))
        )
        own = labels.select(F.col("id").alias("via"), F.col("label").alias("further"))
        jumped = nearest.join(own, nearest.label == own.via).select(
            "id", F.least("label", "further").alias("label"), (F.least("label", "further") < F.col("was")).alias("moved")
        )
        new = written(jumped, "labels")
        done = new.where("moved").isEmpty()
        drop(labels)
        labels = new.select("id", "label")
        if done:
            drop(edges)
            return labels
