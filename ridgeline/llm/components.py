"""Connected components of an edge table, by alternating stars; nothing is collected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridgeline.llm.shared import Workspace


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step over (u, v) edges with u > v. Minima are summed up before the shuffle, so a hub is no burden."""
    if large:
        around = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = around.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        moved = around.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        moved = edges.join(least, "u").select(F.explode(F.expr("array(struct(v as u, m as v), struct(u as u, m as v))")).alias("e")).select("e.*")
    return moved.filter("u > v").distinct()


def connect(edges: DataFrame, work: Workspace, tag: str) -> DataFrame:
    """node, label: every node of the (u, v) edges with the smallest node that it is connected to, written to the shared folder.

    Large and small stars alternate until the edges are stars around the smallest nodes; that takes about as many rounds
    as the logarithm of the longest path. Loops and repeated edges do no harm.
    """
    now = work.put(f"{tag}-0", edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    mark, most = None, 200
    for turn in range(1, most + 1):
        following = work.put(f"{tag}-{turn}", _star(work.put(f"{tag}-{turn}-large", _star(now, True)), False))
        seen = following.agg(F.count(F.lit(1)).alias("n"), F.expr("bit_xor(xxhash64(u, v))").alias("x")).first()
        work.drop(f"{tag}-{turn - 1}")
        work.drop(f"{tag}-{turn}-large")
        now = following
        if (seen["n"], seen["x"]) == mark:
            break
        mark = seen["n"], seen["x"]
    else:
        raise RuntimeError(f"the edges of {tag} are no stars after {most} rounds")
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(roots)
