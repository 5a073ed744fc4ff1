"""Survivors, ancestors and independent groups over edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import written as _written


def independence_groups(pairs: DataFrame, rounds: int = 40) -> DataFrame:
    """(node, root) for the nodes of an edge table (u, v): the least node that each is connected with.

    Labels go along edges and along themselves (pointer jumping), so long chains need few rounds; a
    round's state is written to the shared folder and only a sum of changes reaches the driver.
    """
    both = _written(pairs.select("u", "v").unionAll(pairs.select(F.col("v").alias("u"), F.col("u").alias("v"))).where("u <> v").distinct())
    label = _written(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("root")).withColumnRenamed("u", "node"))
    for _ in range(rounds):
        near = both.join(label, both["v"] == label["node"]).groupBy("u").agg(F.min("root").alias("near"))
        moved = label.join(near, label["node"] == near["u"]).select("node", F.least("root", "near").alias("root"), F.col("root").alias("before"))
        up = moved.select(F.col("node").alias("at"), F.col("root").alias("over"))
        moved = _written(moved.join(up, moved["root"] == up["at"], "left").select("node", F.least("root", F.coalesce("over", "root")).alias("root"), "before"))
        label = moved.select("node", "root")
        if not moved.where("root <> before").limit(1).count():
            return label
    raise RuntimeError(f"groups did not settle in {rounds} rounds")


def ancestors(edges: DataFrame, most: int = 8) -> DataFrame:
    """(node, ancestor, depth) along (child, parent) edges up to a depth; a node's own chain stops when it would return to the node."""
    out = level = edges.select(F.col("child").alias("node"), F.col("parent").alias("ancestor"), F.lit(1).cast("long").alias("depth"))
    for d in range(2, most + 1):
        step = edges.select(F.col("child").alias("at"), "parent")
        level = level.join(step, level["ancestor"] == step["at"]).where("parent <> node").select("node", F.col("parent").alias("ancestor"), F.lit(d).cast("long").alias("depth")).distinct()
        out = out.unionAll(level)
    return out.groupBy("node", "ancestor").agg(F.min("depth").alias("depth"))


def survivors(merges: DataFrame) -> DataFrame:
    """(id, survivor) of rows (id, resolved_to): the end of each chain, null where the chain turns in a circle.

    Each round doubles how far a row looks ahead; no chain is longer than the table, so what still moves
    after the logarithm of its size moves in a circle.
    """
    rounds = merges.count().bit_length() + 1
    now = merges.select("id", F.col("resolved_to").alias("survivor"))
    for _ in range(rounds):
        step = now.select(F.col("id").alias("at"), F.col("survivor").alias("next"))
        moved = _written(now.join(step, now["survivor"] == step["at"], "left").select("id", F.coalesce("next", "survivor").alias("survivor"), F.col("next").isNotNull().alias("moved")))
        now = moved.select("id", "survivor")
        if not moved.where("moved").limit(1).count():
            return now
    open_ = now.join(merges.select(F.col("id").alias("survivor")), "survivor", "left_semi").select("id", F.lit(True).alias("circle"))
    return now.join(open_, "id", "left").select("id", F.when(F.col("circle").isNull(), F.col("survivor")).alias("survivor"))
