"""Graph operators over edge tables: traversal, components, merging, pruning."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemospark.session import materialize


def undirected(edges: DataFrame, src: str, dst: str) -> DataFrame:
    """(u, v) both ways, distinct; a null end is no node."""
    e = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).filter("u is not null and v is not null")
    return e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct()


def expand(seeds: DataFrame, edges: DataFrame, src: str, dst: str, depth: int = 2) -> DataFrame:
    """(seed, node, hops): nodes within `depth` hops of each seed, along edges in both directions; the seed itself at 0.

    One join per hop with the frontier, and an anti join with what was reached before.
    """
    both = undirected(edges, src, dst)
    reached = seeds.select("seed").distinct().select("seed", F.col("seed").alias("node"), F.lit(0).alias("hops"))
    frontier = reached
    for hop in range(1, depth + 1):
        step = frontier.join(both, F.col("node") == F.col("u")).select("seed", F.col("v").alias("node")).distinct()
        frontier = materialize(step.join(reached, ["seed", "node"], "left_anti").withColumn("hops", F.lit(hop)), "frontier")
        reached = reached.unionByName(frontier)
    return reached


def components(edges: DataFrame, src: str, dst: str, most_rounds: int = 60) -> DataFrame:
    """(node, component): weakly connected components, named by their least node.

    Alternating large-star and small-star steps, each one aggregation and one join on
    node, so the number of rounds grows with the logarithm of the longest path; every
    round is written to the shared folder. A node with many edges only sends its least
    neighbour along them. Stops when the edges no longer change.
    """
    both = undirected(edges, src, dst)
    nodes = both.select(F.col("u").alias("node")).distinct()
    e = both.filter("u > v")
    e = materialize(e, "edges")
    before = None
    for _ in range(most_rounds):
        around = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = around.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = around.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small_least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(small_least, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(joined.select("u", F.col("m").alias("v"))).filter("u > v").distinct()
        e = materialize(small, "edges")
        now = e.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if before == now:
            break
        before = now
    labels = e.groupBy("u").agg(F.min("v").alias("component"))
    return nodes.join(labels, nodes["node"] == labels["u"], "left").select("node", F.coalesce("component", "node").alias("component"))


def greedy_groups(edges: DataFrame, src: str, dst: str, least_peers: int = 2) -> DataFrame:
    """(seed, node): in order of id, a node with enough peers that is in no earlier group forms one with all its peers, itself among them.

    Groups may share nodes, as a peer may be in one already. Each round settles every
    open node that is less than all open nodes beside it, and those beside these, until
    none is open.
    """
    both = materialize(undirected(edges, src, dst).filter("u <> v"), "peers")
    apt = both.groupBy("u").count().filter(F.col("count") >= least_peers).select("u")
    # only nodes that could form a group stand in each other's way
    rival = materialize(both.join(apt, "u", "left_semi").join(apt.select(F.col("u").alias("v")), "v", "left_semi").select("u", "v"), "rivals")
    left = materialize(apt, "open")
    seeds = None
    while not left.isEmpty():
        least = rival.join(left, "u", "left_semi").join(left.select(F.col("u").alias("v")), "v", "left_semi").groupBy("u").agg(F.min("v").alias("m"))
        new = materialize(left.join(least, "u", "left").filter("m is null or u < m").select("u"), "seeds")
        seeds = new if seeds is None else seeds.unionByName(new)
        gone = new.unionByName(rival.join(new, "u", "left_semi").select(F.col("v").alias("u")))
        left = materialize(left.join(gone, "u", "left_anti"), "open")
    seeds = apt.limit(0) if seeds is None else seeds
    return seeds.select(F.col("u").alias("seed"), F.col("u").alias("node")).unionByName(both.join(seeds, "u", "left_semi").select(F.col("u").alias("seed"), F.col("v").alias("node")))


def merge_nodes(edges: DataFrame, merges: DataFrame, src: str, dst: str, keep: list[str], count: str) -> DataFrame:
    """Edges with merged nodes in the place of the old ones: loops go, edges that became equal add up their counts.

    `merges` has old and new, one row per old node.
    """
    a = merges.select(F.col("old").alias("_a"), F.col("new").alias("_na"))
    b = merges.select(F.col("old").alias("_b"), F.col("new").alias("_nb"))
    e = edges.join(a, F.col(src) == F.col("_a"), "left").join(b, F.col(dst) == F.col("_b"), "left")
    e = e.withColumn(src, F.coalesce("_na", src)).withColumn(dst, F.coalesce("_nb", dst)).filter(F.col(src) != F.col(dst))
    return e.groupBy(src, dst, *keep).agg(F.sum(count).alias(count))
