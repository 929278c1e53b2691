"""Reachability, closure and cycles of directed graphs, whose edges are a table (a, b).

Every step is a join of the edges with a state of one row a node (the closure apart, which is a table of pairs). Several
steps make one job, whose result is written to the checkpoint folder; only counts come to the driver. No walk has a longest length.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from forgeline.sources.scratch import cut, written

#: Steps of a walk that make one job.
HOPS = 4


def _dealt(edges: DataFrame, by: str) -> DataFrame:
    """The edges, dealt by one end once and cut off, so that a step shuffles nothing but the nodes it finds."""
    return cut(edges.repartition(int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions")), by))


def closure(edges: DataFrame) -> DataFrame:
    """(a, b) wherever a path leads from a to b; a node reaches itself only on a cycle.

    Before each round `state` has the pairs at distances up to 2**k, those at 2**k exactly marked `far`. Only these, which no round has
    had before, are joined, with all: a far pair leads to a far one over at most 2**(k + 1), to another over less. The least way by which a pair
    came tells whether it is far in the next round, so that a round is one join and one grouping. The rounds grow with the logarithm of
    the longest distance, and end when no pair is so far apart.
    """
    state = written(edges.select("a", "b").distinct().withColumn("far", F.lit(True)), "pairs")
    while not state.filter("far").isEmpty():
        first = state.filter("far").select("a", F.col("b").alias("over"))
        way = first.join(state.select(F.col("a").alias("over"), "b", F.when(F.col("far"), 2).otherwise(1).alias("way")), "over").select("a", "b", "way")
        pairs = state.select("a", "b", F.lit(0).alias("way")).union(way).groupBy("a", "b").agg((F.min("way") == 2).alias("far"))
        state = written(pairs, "pairs")
    return state.select("a", "b")


def reachable(edges: DataFrame, start) -> DataFrame:
    """(node) that paths from `start` lead to; start itself only on a cycle. What was found last alone meets the edges."""
    edges = edges.select("a", "b").distinct()
    stay = edges.select("b").union(edges.select("a")).distinct()
    hops = _dealt(edges.union(stay.select("b", F.col("b").alias("b2"))), "a")
    last = found = cut(edges.filter(F.col("a") == start).select(F.col("b").alias("node")))
    while not last.isEmpty():
        for _ in range(HOPS):
            last = hops.join(last.select(F.col("node").alias("a")), "a", "left_semi").select(F.col("b").alias("node")).distinct()
        last = cut(last.join(found, "node", "left_anti"))
        found = found.union(last)
    return found


def _trimmed(edges: DataFrame) -> DataFrame:
    """The edges between nodes that endless walks lead to and from; all cycles are among them."""
    for start, end in (("a", "b"), ("b", "a")):
        dealt = _dealt(edges, start)
        alive = dealt.select(F.col(end).alias("node")).distinct()
        before = alive.count()
        while True:
            for _ in range(HOPS):
                alive = dealt.join(alive.withColumnRenamed("node", start), start, "left_semi").select(F.col(end).alias("node")).distinct()
            alive = cut(alive)
            now = alive.count()
            if now == before:
                break
            before = now
        edges = dealt.join(alive.withColumnRenamed("node", "a"), "a", "left_semi").join(alive.withColumnRenamed("node", "b"), "b", "left_semi").select("a", "b")
    return cut(edges)


def _contracted(edges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(edges where each chain is one edge, (node, behind, ahead) of the chains' nodes, (node, component) of rings).

    A chain's nodes have one edge in and one out each. By pointer jumping each finds the first nodes behind and ahead that are in no chain; a
    node that finds none lies on a ring. `on` tells that the node ahead is in a chain. Each round has fewer such nodes on open chains, and names on a
    ring stop falling only when all have its least one. So the rounds end when both stay, after the logarithm of the longest chain or ring.
    The rounds go through Parquet: Spark keeps the estimated size of what a checkpoint was made from, and a join's is the product of its sides'
    sizes, a number whose digits would treble in each round until the driver can't hold it.
    """
    into = edges.groupBy(F.col("b").alias("node")).agg(F.count(F.lit(1)).alias("ins"), F.min("a").alias("behind"))
    out = edges.groupBy(F.col("a").alias("node")).agg(F.count(F.lit(1)).alias("outs"), F.min("b").alias("ahead"))
    chain = written(into.join(out, "node").filter("ins = 1 AND outs = 1").select("node", "behind", "ahead", F.col("node").alias("least")), "chain")
    inside = chain.select("node")
    held = inside.select(F.col("node").alias("ahead"), F.lit(True).alias("on"))
    at, before = written(chain.join(held, "ahead", "left").select("node", "behind", "ahead", "least", F.coalesce("on", F.lit(False)).alias("on"), F.lit(True).alias("fell")), "chain"), None
    while True:
        now = at.agg(F.count_if("on"), F.count_if(F.col("on") & F.col("fell"))).first()
        if now[0] == 0 or now == (before, 0):
            break
        before = now[0]
        further = at.select(F.col("node").alias("ahead"), F.col("ahead").alias("further"), F.col("least").alias("lower"), F.col("on").alias("still"))
        earlier = at.select(F.col("node").alias("behind"), F.col("behind").alias("earlier"))
        at = at.join(further, "ahead", "left").join(earlier, "behind", "left").select("node", F.coalesce("earlier", "behind").alias("behind"), F.coalesce("further", "ahead").alias("ahead"), F.least("least", "lower").alias("least"), F.coalesce("still", F.lit(False)).alias("on"), F.coalesce(F.col("lower") < F.col("least"), F.lit(False)).alias("fell"))
        at = written(at, "chain")
    rings = at.filter("on").select("node", F.col("least").alias("component"))
    chains = at.filter("NOT on").select("node", "behind", "ahead")
    kept = edges.join(inside.withColumnRenamed("node", "a"), "a", "left_anti").join(inside.withColumnRenamed("node", "b"), "b", "left_anti").select("a", "b")
    return written(kept.union(chains.select("behind", "ahead")).distinct(), "edges"), chains, rings


def _coloured(edges: DataFrame) -> DataFrame:
    """(node, component) of the strongly connected components with two nodes or more.

    Each node takes the least name that leads to it as its colour. What leads, within a colour, back to the node that gave
    it is that node's component. Edges between colours lie in none; the rest is trimmed and begun anew.
    """
    found = edges.select(F.col("a").alias("node"), F.col("a").alias("component")).limit(0)
    while not edges.isEmpty():
        nodes = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
        hops = _dealt(edges.union(nodes.select("node", F.col("node").alias("b"))), "a")
        colours = nodes.select("node", F.col("node").alias("colour"))
        while True:
            new = colours
            for _ in range(HOPS):
                new = hops.join(new.withColumnRenamed("node", "a"), "a").groupBy(F.col("b").alias("node")).agg(F.min("colour").alias("colour"))
            new = written(new, "colours")
            same = new.join(colours, ["node", "colour"], "left_anti").isEmpty()
            colours = new
            if same:
                break
        within = written(edges.join(colours.select(F.col("node").alias("a"), F.col("colour").alias("one")), "a").join(colours.select(F.col("node").alias("b"), F.col("colour").alias("other")), "b").filter("one = other").select("a", "b"), "edges")
        back = _dealt(within.select("b", "a").union(nodes.select("node", F.col("node").alias("a"))), "b")
        marked, before = colours.filter("node = colour").select("node"), -1
        while True:
            for _ in range(HOPS):
                marked = back.join(marked.withColumnRenamed("node", "b"), "b", "left_semi").select(F.col("a").alias("node")).distinct()
            marked = cut(marked)
            now = marked.count()
            if now == before:
                break
            before = now
        members = colours.join(marked, "node", "left_semi")
        whole = members.groupBy("colour").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
        found = written(found.union(members.join(whole, "colour", "left_semi").select("node", F.col("colour").alias("component"))), "found")
        edges = cut(within.join(marked.withColumnRenamed("node", "a"), "a", "left_anti").join(marked.withColumnRenamed("node", "b"), "b", "left_anti").select("a", "b"))
        edges = edges if edges.isEmpty() else _trimmed(edges)
    return found


def components_on_cycles(edges: DataFrame) -> DataFrame:
    """(node, component) of all nodes that lie on a cycle, an edge to oneself among them; nodes on a common cycle share a component.

    Edges with a null end are left out. No edges give no rows. Ends that lead nowhere are trimmed and chains contracted, until neither changes
    anything; what is left is coloured, and then the chains are put back: a chain lies on a cycle if its ends share a component.
    """
    pairs = written(edges.select("a", "b").filter("a IS NOT NULL AND b IS NOT NULL").distinct(), "edges")
    core, levels = _trimmed(pairs.filter("a != b")), []
    while True:
        core, chains, rings = _contracted(core)
        if chains.isEmpty() and rings.isEmpty():
            break
        levels.append((chains, rings))
        # contraction leaves each node an edge in and one out, but for edges of a node to itself
        if not core.filter("a = b").isEmpty():
            core = _trimmed(core.filter("a != b"))
    found = _coloured(core)
    for chains, rings in reversed(levels):
        own = chains.filter("behind = ahead").select(F.col("behind").alias("node")).distinct()
        found = found.union(own.join(found, "node", "left_anti").select("node", F.col("node").alias("component"))).union(rings)
        ends = chains.join(found.select(F.col("node").alias("behind"), "component"), "behind").join(found.select(F.col("node").alias("ahead"), F.col("component").alias("other")), "ahead")
        found = written(found.union(ends.filter("component = other").select("node", "component")), "found")
    loops = pairs.filter("a = b").select(F.col("a").alias("node"))
    return found.union(loops.join(found, "node", "left_anti").select("node", F.col("node").alias("component")))
