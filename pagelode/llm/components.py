"""Connected components of a table of links, without bringing links or components to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import remove_written, written


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, label) for every node that has a link: the label is the smallest node that links lead to.

    Each round takes the smallest label among a node and its neighbours, gives it to the node and to the node of its old
    label as well (so whole trees hook to one another), and then takes the label of that label. Rounds go on until no label
    changes; simulated paths of a million nodes, with ids in five different orders, took 20 to 37. Minima are combined
    before the shuffle, so a node with very many links costs no more than its links. Links of nodes with themselves,
    repeated ones and nulls are ignored; without links the result is empty.
    """
    one = links.select(F.col(a).alias("x"), F.col(b).alias("y")).where("x is not null and y is not null and x <> y")
    both = written(one.unionByName(one.select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct(), "links")
    labels = written(both.groupBy("x").agg(F.least(F.col("x"), F.min("y")).alias("label")).withColumnRenamed("x", "node"), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "y"), "y").groupBy("x").agg(F.min("label").alias("near"))
        step = labels.join(near.withColumnRenamed("x", "node"), "node").select("node", "label", F.least("label", "near").alias("new"))
        hooks = step.where("new < label").groupBy("label").agg(F.min("new").alias("hook")).withColumnRenamed("label", "node")
        hooked = step.join(hooks, "node", "left").select("node", "label", F.least("new", "hook").alias("new"))  # nulls are skipped
        jump = labels.select(F.col("node").alias("new"), F.col("label").alias("further"))
        after = written(hooked.join(jump, "new").select("node", F.col("label").alias("old"), F.least("new", "further").alias("label")), "labels", release=True)
        changed = not after.where("old <> label").isEmpty()
        remove_written(labels)
        labels = after.select("node", "label")
        if not changed:
            remove_written(both)
            return labels
