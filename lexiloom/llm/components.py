"""Connected components of an edge table, by minimum labels that are hooked and jumped.

A label is a node of the same component, no greater than the node it stands for, so labels form trees.
Each round, the smallest label among a node's neighbours goes to the node and to the node's own label (so
that a whole tree hangs itself on a smaller one), and each label is then replaced by its label's label.
Rounds go on until no label changes, however many that takes: then both ends of each edge have one label,
which is the smallest node of the component. On chains of shuffled keys they grow with the logarithm.

Edges of a hub are many rows of one key, so joins on it are left to Spark's splitting of skewed
partitions and the minimum is taken map-side first. Each round is written to the shared folder; nothing
but its row count reaches the driver.

Where nodes have many edges to few others (the leaders of stars), ``grouped`` first keeps one edge of each
node, to the smallest of its leaders, and only the distinct pairs of leaders that its other edges tell of
take part in the rounds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiloom.session import cut


def components(edges: DataFrame) -> DataFrame:
    """edges: a, b (any orderable type). node, label: the smallest node of its component."""
    edges = edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").distinct()
    both = cut(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    labels = cut(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("label")))
    own = F.struct("node", F.col("label").alias("was"), F.least("label", "m").alias("label"))
    hook = F.struct(F.col("label").alias("node"), F.lit(None).alias("was"), F.col("m").alias("label"))
    while True:
        near = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("label").alias("m"))
        told = labels.join(near, F.col("node") == F.col("a")).select(F.inline(F.when(F.col("m") < F.col("label"), F.array(own, hook)).otherwise(F.array(own))))
        lower = cut(told.groupBy("node").agg(F.max("was").alias("was"), F.min("label").alias("label")))
        jump = lower.select(F.col("node").alias("n"), F.col("label").alias("further"))
        new = cut(lower.join(jump, F.col("label") == F.col("n"), "left").select("node", "was", F.least("label", F.coalesce("further", "label")).alias("label")))
        labels = new.select("node", "label")
        if new.where("label <> was").isEmpty():
            return labels


def grouped(edges: DataFrame) -> DataFrame:
    """edges: a node, b its leader (few for each a). node, label: a node of its component, the same for all."""
    edges = edges.where("a <> b")
    own = cut(edges.groupBy("a").agg(F.collect_set("b").alias("leaders")).withColumn("m", F.least("a", F.array_min("leaders"))))
    leaders = own.select(F.explode("leaders").alias("node")).distinct()
    beside = own.select(F.col("m").alias("a"), F.explode(F.array_except("leaders", F.array("m"))).alias("b")).distinct()
    chosen = own.select("a", F.col("m").alias("b")).join(leaders, F.col("a") == F.col("node"), "left_semi")
    labels = components(beside.unionByName(chosen))
    nodes = own.select(F.col("a").alias("node"), "m").unionByName(leaders.join(own, F.col("node") == F.col("a"), "left_anti").withColumn("m", F.col("node")))
    found = nodes.join(labels.select(F.col("node").alias("n"), "label"), F.col("m") == F.col("n"), "left")
    return found.select("node", F.coalesce("label", "m").alias("label"))
