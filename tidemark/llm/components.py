"""Connected components of an edge table that may be of any size.

Each round every node hooks to the smallest node beside it (even rounds: by id,
odd rounds: by a hash, which shrinks long chains by a constant share) and edges
are drawn anew between hooks, without loops and repeats. No edge list is ever
collected; edges shrink each round, and the tables of each round are written to
the shared folder, so a lost executor costs one round at most. A hub's edges
meet in joins only, which adaptive execution splits, and in minima, which are
taken before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import written

MAX_ROUNDS = 200


def components(edges: DataFrame) -> DataFrame:
    """edges(u, v) -> (node, component): component is the smallest node reachable. Loops, repeats and nulls do no harm;
    a node without an edge isn't in the result."""
    e = written(edges.where("u is not null and v is not null and u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "edges")
    labels = None
    for k in range(MAX_ROUNDS):
        if e.isEmpty():
            break
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        order = (lambda c: F.col(c)) if k % 2 == 0 else (lambda c, k=k: F.xxhash64(F.col(c), F.lit(k)))
        least = both.groupBy("u").agg(F.min(F.struct(order("v").alias("o"), F.col("v").alias("v"))).alias("m"))
        hook = written(least.select(F.col("u").alias("node"), F.when(F.struct(order("u").alias("o"), F.col("u").alias("v")) < F.col("m"), F.col("u")).otherwise(F.col("m.v")).alias("hook")), "hooks")
        if labels is None:
            labels = hook.select("node", F.col("hook").alias("label"))
        else:
            labels = labels.join(hook.select(F.col("node").alias("label"), "hook"), "label", "left").select("node", F.coalesce("hook", "label").alias("label"))
        if k % 4 == 3:
            labels = written(labels, "labels")
        a, b = hook.select(F.col("node").alias("u"), F.col("hook").alias("hu")), hook.select(F.col("node").alias("v"), F.col("hook").alias("hv"))
        moved = e.join(a, "u").join(b, "v").where("hu <> hv")
        e = written(moved.select(F.least("hu", "hv").alias("u"), F.greatest("hu", "hv").alias("v")).distinct(), "edges")
    else:
        raise RuntimeError(f"no end after {MAX_ROUNDS} rounds")
    if labels is None:
        return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).limit(0)
    labels = written(labels, "labels")
    roots = labels.groupBy("label").agg(F.min("node").alias("component"))
    return labels.join(roots, "label").select("node", "component")
