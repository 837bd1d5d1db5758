"""Connected components by label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, written


def components(edges: DataFrame) -> DataFrame:
    """``id, component`` (smallest id reachable) for all ids in edges ``a, b``.

    Every round takes the neighbours' smallest label and then the label's label,
    so rounds grow with the logarithm of the diameter.  Messages are combined on
    the map side; labels are written each round, which cuts the lineage.
    """
    both = written(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = written(both.groupBy(F.col("a").alias("id")).agg(F.least(F.first("a"), F.min("b")).alias("component")), "labels")
    while True:
        heard = both.join(labels.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(F.min("component").alias("near"))
        near = labels.join(heard, "id", "left").select("id", F.col("component").alias("old"), F.least("component", "near").alias("component"))
        jump = labels.select(F.col("id").alias("component"), F.col("component").alias("far"))
        new = written(near.join(jump, "component", "left").select("id", "old", F.least("component", "far").alias("component")), "labels")
        discard(labels)
        labels = new.select("id", "component")
        if not new.where("component != old").limit(1).count():
            discard(both)
            return labels
