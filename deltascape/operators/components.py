"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deltascape.plans.storage import discard, join_groups, materialise

#: Rounds after which something must be wrong; a component of n nodes takes about log n.
MOST_ROUNDS = 60


def _stars(pairs: DataFrame, total: int) -> DataFrame:
    """pairs (u, v), total in number, with, for each, the least of u and all its v as m."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("degree"))
    return join_groups(pairs, least, "u", "degree", total).withColumn("m", F.least("u", "m"))


def least_roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of n places with edges from a to b the least of each one's component, by hooking roots to the least and halving paths."""
    root = np.arange(n)
    while True:
        ra, rb = root[a], root[b]
        unlike = ra != rb
        if not unlike.any():
            return root
        np.minimum.at(root, np.maximum(ra, rb)[unlike], np.minimum(ra, rb)[unlike])
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up


def _union_find(frame: pd.DataFrame) -> pd.DataFrame:
    """Labels of a bounded edge table."""
    nodes, ends = np.unique(frame[["u", "v"]].to_numpy(np.int64), return_inverse=True)
    return pd.DataFrame({"node": nodes, "root": nodes[least_roots(len(nodes), *ends.reshape(-1, 2).T)]})


def connected_components(edges: DataFrame, one_task_edges: int = 0) -> DataFrame:
    """node and root, the smallest node of its component, of every node that stands in edges (columns u, v: long).

    Edges may repeat, run either way or join a node to itself. Every round is one table in the shared folder; hubs are
    joined without moving them into one task. A table of at most one_task_edges edges is solved by one executor task
    instead, which saves the rounds; the result is the same.
    """
    loops = edges.filter("u = v").select(F.col("u").alias("node"))
    now = materialise(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    if one_task_edges and now.count() <= one_task_edges:
        found = now.groupBy(F.lit(0).alias("all")).applyInPandas(_union_find, "node long, root long")
        alone = loops.distinct().join(now.select(F.explode(F.array("u", "v")).alias("node")), "node", "left_anti")
        return found.unionByName(alone.select("node", F.col("node").alias("root")))
    seen = None
    for _ in range(MOST_ROUNDS):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = materialise(_stars(both, 2 * now.count()).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct(), "large")
        small = _stars(large, large.count())
        after = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        after = materialise(after, "edges")
        for old in (now, large):
            discard(old)
        now = after
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == seen:
            break
        seen = mark
    else:
        raise RuntimeError("components did not settle")
    members = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    roots = now.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("root"))
    alone = loops.distinct().join(members.unionByName(roots).select("node"), "node", "left_anti").select("node", F.col("node").alias("root"))
    return members.unionByName(roots).unionByName(alone)
