"""G19 lineage closure: every upstream or downstream node of a start set.

Breadth-first expansion with one join per level against the edge table; the
frontier shrinks to the nodes seen for the first time, so each level only
joins new nodes. The loop runs until a level adds nothing; a caller's own
``max_depth`` raises if nodes remain beyond it.
The edge table is hash-partitioned on its join key and checkpointed once, so
each level shuffles only the frontier; frontier and visited set are reliably
checkpointed every level, so no level re-runs the plans of earlier levels.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeweave.session import cut_lineage, materialize


def lineage(edges: DataFrame, start: DataFrame, direction: str = "upstream", max_depth: int | None = None,
            child: str = "child", parent: str = "parent", checkpoint_every: int = 1) -> DataFrame:
    """Nodes reachable from ``start`` (column ``node``) with their depth.

    upstream: follow child -> parent; downstream: parent -> child. Each node
    is reported once, at its smallest depth."""
    if direction not in ("upstream", "downstream"):
        raise ValueError(direction)
    src, dst = (child, parent) if direction == "upstream" else (parent, child)
    e = cut_lineage(edges.select(F.col(src).alias("__from"), F.col(dst).alias("node"))
                    .repartition("__from").dropDuplicates(["__from", "node"]))
    seen = start.select("node").distinct().withColumn("depth", F.lit(0))
    frontier = seen.select("node")
    depth = 0
    while True:
        depth += 1
        nxt = (frontier.select(F.col("node").alias("__from")).join(e, "__from").select("node").distinct()
               .join(seen.select("node"), "node", "left_anti"))
        if depth % checkpoint_every == 0:
            nxt = cut_lineage(nxt)
        if nxt.isEmpty():
            break
        if max_depth is not None and depth > max_depth:
            raise ValueError(f"lineage goes deeper than max_depth={max_depth}")
        seen = seen.unionByName(nxt.withColumn("depth", F.lit(depth)))
        if depth % checkpoint_every == 0:
            seen = cut_lineage(seen)
        frontier = nxt
    return seen.filter(F.col("depth") > 0)


def lineage_doubling(edges: DataFrame, start: DataFrame, direction: str = "upstream", child: str = "child", parent: str = "parent") -> DataFrame:
    """The result of :func:`lineage` for deep graphs, in rounds that grow with the logarithm of the depth.

    Besides the nodes reached so far there are shortcuts: pairs of nodes with their least number of steps. In
    each round the nodes reached take one shortcut, and the shortcuts are joined with themselves, so
    both reach twice as far ((min, +) products). Shortcuts that begin behind the outermost nodes are no longer needed.
    A round writes the nodes it added and the shortcuts; the nodes of earlier rounds are not written again.
    Shortcuts are pairs: for shallow wide graphs :func:`lineage` moves less."""
    if direction not in ("upstream", "downstream"):
        raise ValueError(direction)
    src, dst = (child, parent) if direction == "upstream" else (parent, child)
    steps = materialize(edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).filter("a IS NOT NULL AND b IS NOT NULL AND a <> b").distinct()
                        .withColumn("n", F.lit(1)), "shortcuts")
    seen = materialize(start.select("node").distinct().withColumn("depth", F.lit(0)), "reached")
    outermost, rounds = 0, 0
    while True:
        rounds += 1
        reach = (seen.filter(F.col("depth") == outermost).join(steps, F.col("node") == F.col("a"))
                 .groupBy(F.col("b").alias("node")).agg(F.min(F.col("depth") + F.col("n")).alias("depth")))
        added = materialize(reach.join(seen.select("node"), "node", "left_anti"), "reached")
        far = added.agg(F.max("depth")).first()[0]
        if far is None:
            return seen.filter(F.col("depth") > 0)
        seen = seen.unionByName(added)
        behind = seen.filter(F.col("depth") < far).select(F.col("node").alias("a"))
        kept = steps.join(behind, "a", "left_anti")
        twice = kept.alias("x").join(kept.alias("y"), F.col("x.b") == F.col("y.a")).select(F.col("x.a"), F.col("y.b"), (F.col("x.n") + F.col("y.n")).alias("n"))
        steps = materialize(kept.unionByName(twice.filter("a <> b")).groupBy("a", "b").agg(F.min("n").alias("n")), "shortcuts")
        outermost = far


def key_lineage_edges(orders: DataFrame, customer: DataFrame, nation: DataFrame) -> DataFrame:
    """Record-level provenance edges of the fixture star schema:
    order -> customer -> nation -> region (child, parent)."""
    o = orders.select(F.concat(F.lit("order:"), F.col("o_orderkey").cast("string")).alias("child"),
                      F.concat(F.lit("customer:"), F.col("o_custkey").cast("string")).alias("parent"))
    c = customer.select(F.concat(F.lit("customer:"), F.col("c_custkey").cast("string")).alias("child"),
                        F.concat(F.lit("nation:"), F.col("c_nationkey").cast("string")).alias("parent"))
    n = nation.select(F.concat(F.lit("nation:"), F.col("n_nationkey").cast("string")).alias("child"),
                      F.concat(F.lit("region:"), F.col("n_regionkey").cast("string")).alias("parent"))
    return o.unionByName(c).unionByName(n)
