"""Connected components of an edge table by label spreading, all in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waybill.llm.common import Tables, stored


def component_labels(edges: DataFrame, a: str = "a", b: str = "b", tables: Tables | None = None) -> DataFrame:
    """(v, label): label is the smallest vertex that v reaches.

    Each round a vertex takes the smallest label among itself and its
    neighbours, and then its label's label; the number of rounds is about the
    logarithm of the longest path.  Each round's table is written to the shared
    folder, to ``tables`` if given, where those of earlier rounds are dropped.  The neighbours' minimum is aggregated map-side first, so a vertex
    with very many neighbours is no large group.  Vertices without edges have
    no row; an empty edge table gives none."""
    both = edges.select(F.col(a).alias("v"), F.col(b).alias("u")).union(edges.select(F.col(b).alias("v"), F.col(a).alias("u")))
    put = tables.put if tables else stored
    both = put(both.where("v <> u").distinct(), "edges")
    labels = put(both.groupBy("v").agg(F.least(F.min("u"), F.first("v")).alias("label")), "labels")
    while True:
        near = both.join(labels.select(F.col("v").alias("u"), F.col("label")), "u").groupBy("v").agg(F.min("label").alias("near"))
        step = labels.select("v", "label").join(near, "v").select("v", F.least("label", "near").alias("to"), F.col("label").alias("was"))
        step = put(step, "labels")
        jump = step.select(F.col("v").alias("to"), F.col("to").alias("label"))
        after = put(step.join(jump, "to", "left").select("v", F.coalesce("label", "to").alias("label"), "was"), "labels")
        if tables:
            tables.drop(labels, step)
        labels = after
        if after.where("label <> was").isEmpty():
            return after.select("v", "label")
