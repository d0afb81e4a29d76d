"""Connected components of an edge table, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged


def components(edges: DataFrame, label: str = "cc") -> DataFrame:
    """(node, label) for every node of ``edges`` (u, v: long): the smallest node that it is connected with.

    Each round hangs every node on its smallest smaller neighbour, moves the edges to where their ends now hang, and
    drops those that closed; a few rounds empty the table. Tables are written between rounds. A node with very many
    neighbours is a hot key only of joins between two shuffled tables, which Spark splits.
    Repeated edges count once; a node that only has an edge to itself, and an edge with a null end, is left out; no edges
    give no rows. Other columns do not matter.
    """
    ends = edges.select(F.greatest("u", "v").alias("hi"), F.least("u", "v").alias("lo")).where("hi <> lo").distinct()
    left = staged(ends, f"{label}-edges")
    nodes = left.select(F.explode(F.array("hi", "lo")).alias("node")).distinct().withColumn("label", F.col("node"))
    rounds = []
    while not left.isEmpty():
        hung = left.groupBy("hi").agg(F.min("lo").alias("to"))
        hung = staged(hung, f"{label}-hung")
        above = hung.select(F.col("hi").alias("at"), F.col("to").alias("far"))
        hung = staged(hung.join(above, F.col("to") == F.col("at"), "left").select("hi", F.coalesce("far", "to").alias("to")), f"{label}-hung")
        rounds.append(hung)
        one = hung.select(F.col("hi").alias("a"), F.col("to").alias("a_to"))
        two = hung.select(F.col("hi").alias("b"), F.col("to").alias("b_to"))
        moved = left.join(one, F.col("hi") == F.col("a"), "left").join(two, F.col("lo") == F.col("b"), "left")
        # where a node moved past its neighbour's place, the link to that place stays
        pair = moved.select(F.coalesce("a_to", "hi").alias("x"), F.coalesce("b_to", "lo").alias("y"))
        left = staged(pair.where("x <> y").select(F.greatest("x", "y").alias("hi"), F.least("x", "y").alias("lo")).distinct(), f"{label}-edges")
    for hung in rounds:
        nodes = nodes.join(hung, nodes["label"] == hung["hi"], "left").select("node", F.coalesce("to", "label").alias("label"))
    return staged(nodes, f"{label}-labels")
