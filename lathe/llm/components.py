"""Connected components of an edge table by least labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch


def connected(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(node, component) for every node of edges (a, b); component is the least node reachable.

    Each round gives a node the least label around it, gives what a node is labelled with the least
    label around that node, and then takes the label of the label. So whole labelled groups are hooked
    to lower ones and chains halve in length. Rounds end when no label changes, however many it takes:
    labels only fall, and when none does, both ends of every edge have the same one.
    Every round's labels are a table in the shared folder, which cuts the lineage. All aggregations
    combine on the map side, so a node with many edges or a large group is no hot key there.
    """
    pairs = edges.select("a", "b").filter("a <> b")
    both = scratch.save(pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), f"{name}-edges")
    labels = scratch.save(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("label")), f"{name}-0")
    changed, i = True, 0
    while changed:
        i += 1
        around = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        step = labels.join(around, "node")
        hooks = step.filter("near < label").groupBy(F.col("label").alias("node")).agg(F.min("near").alias("hook"))
        step = step.join(hooks, "node", "left").select("node", "label", F.least("label", "near", "hook").alias("new"))  # least skips nulls
        jump = labels.select(F.col("node").alias("new"), F.col("label").alias("far"))
        step = step.join(jump, "new", "left").select("node", F.least("new", F.coalesce("far", "new")).alias("new"), "label")
        saved = scratch.save(step, f"{name}-{i}")
        changed = saved.filter("new < label").limit(1).count() > 0
        scratch.drop(f"{name}-{i - 1}")
        labels = saved.select("node", F.col("new").alias("label"))
    scratch.drop(f"{name}-edges")
    return labels.select("node", F.col("label").alias("component"))
