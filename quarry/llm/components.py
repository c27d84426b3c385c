"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import drop_stage, write_stage


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 100) -> DataFrame:
    """Rows (node, component) for every node of an edge other than the smallest of its component;
    component is that smallest node. Loops and repeated edges change nothing; edges with a null end
    are ignored. Each round is a grouped minimum and an equi-join, written to the shared folder; no
    node, edge or label goes to the driver. A hub is a join key only, so AQE can split it."""
    ends = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b")
    current = write_stage(ends.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    seen = None
    for _ in range(max_rounds):
        mark = current.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == seen or not mark[0]:
            out = current.select(F.col("u").alias("node"), F.col("v").alias("component"))
            out.stage_path = current.stage_path
            return out
        seen = mark
        both = current.union(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = write_stage(large, "large-star")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        following = write_stage(moved.union(low.select("u", F.col("m").alias("v"))).distinct(), "small-star")
        drop_stage(current)
        drop_stage(large)
        current = following
    raise RuntimeError("components did not settle")


def local_roots(linked: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The smallest id that each row and each column of a block of links reaches within it."""
    top = np.iinfo(np.int64).max
    a, b = left.astype(np.int64), right.astype(np.int64)
    while True:
        x = np.minimum(a, np.where(linked, b[None, :], top).min(axis=1, initial=top))
        y = np.minimum(b, np.where(linked, x[:, None], top).min(axis=0, initial=top))
        if (x == a).all() and (y == b).all():
            return x, y
        a, b = x, y


def block_turns(block: Column, blocks: Column) -> Column:
    """For a member of `block` of a group cut into `blocks`: the block pairs (i, j), i <= j, it takes
    part in, and whether as i (side 0) or j (side 1). A group within one block has the pair (0, 0)."""
    return F.transform(
        F.sequence(F.lit(0), blocks - 1),
        lambda o: F.struct(F.least(block, o).alias("i"), F.greatest(block, o).alias("j"), (block > o).cast("int").alias("side")),
    )


def named_by_smallest(labels: DataFrame, members: DataFrame) -> DataFrame:
    """Rows (node, component, component_id) for all nodes of the components in labels(node, component),
    with the smallest id among the members(node, id) of each, by a partial and a final grouped minimum."""
    whole = labels.union(labels.select("component", "component").distinct()).join(members.select("node", "id"), "node")
    low = whole.groupBy("component").agg(F.min("id").alias("component_id"))
    return whole.select("node", "component").join(low, "component").select("node", "component", "component_id")
