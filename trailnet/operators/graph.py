"""Graphs as edge tables: components, cycles, reachability, shortest paths, bounded paths.

Iterations are joins and groupings over edges; each round is written to the shared folder of the cluster (spark.checkpoint.dir), which cuts the
lineage and outlives executors. Nothing is gathered by component or node.
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that every executor sees: spark.checkpoint.dir, or a local one where none is set and all runs on this machine."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        path = tempfile.mkdtemp(prefix="trailnet-")
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame) -> DataFrame:
    """df, written as Parquet into the shared folder and read back. The files of the shuffles that led to it go at once; the session's setting is put back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/graph-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP)
    try:
        spark.conf.set(CLEANUP, "true")
        # A frame keeps the plan it has once been given: this one is planned under the setting.
        df.select("*").write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def unsent(df: DataFrame) -> DataFrame:
    """df, never to be broadcast in a join: the planner takes rows that are exploded or unpacked from Parquet for as small as what they come from."""
    return df.hint("merge")


def components(nodes: DataFrame, edges: DataFrame, max_rounds: int = 200) -> DataFrame:
    """(node, component) for nodes(node) and undirected edges(src, dst): the smallest node that can be reached.

    Each round links every node's larger neighbours to its smallest one, then all its neighbours to that: grouped minima and joins on nodes, never on
    components, so a giant component is spread like any other rows. Rounds grow with the logarithm of the longest path; the last changes nothing.
    """

    def told(df: DataFrame):
        return df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20, 0)"))).first()

    links = stored(edges.where("src <> dst").select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct())
    was = told(links)
    for _ in range(max_rounds):
        both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("_m")).select("u", F.least("u", "_m").alias("_m"))
        star = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("_m").alias("v")).distinct()
        least = star.groupBy("u").agg(F.min("v").alias("_m"))
        ends = star.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("_m").alias("v")), F.struct(F.col("v").alias("u"), F.col("_m").alias("v")))).alias("e"))
        links = stored(ends.select("e.*").where("u <> v").distinct())
        now = told(links)
        if now == was:
            labels = links.select(F.col("u").alias("node"), F.col("v").alias("component"))
            return nodes.select("node").distinct().join(labels, "node", "left").select("node", F.coalesce("component", "node").alias("component"))
        was = now
    raise RuntimeError("components did not settle")


def reachable(edges: DataFrame, max_rounds: int = 64) -> DataFrame:
    """(src, dst) for every directed path of one or more edges, by squaring: paths of up to 2^k edges after k rounds.

    For graphs of places within a route; the result is quadratic in the size of a strongly connected part.
    """
    known = stored(edges.select("src", "dst").distinct())
    n = known.count()
    for _ in range(max_rounds):
        longer = known.alias("a").join(known.alias("b"), F.col("a.dst") == F.col("b.src")).select(F.col("a.src"), F.col("b.dst"))
        known = stored(known.union(longer).distinct())
        m = known.count()
        if m == n:
            return known
        n = m
    raise RuntimeError("reachability did not settle")


def cyclic(edges: DataFrame) -> DataFrame:
    """(node, scc) of the nodes on directed cycles: the smallest node of their strongly connected component.

    Nodes without an edge in or out are peeled off first, so that only the cyclic core is squared.
    """
    core = stored(edges.select("src", "dst").distinct())
    n = core.count()
    while n:
        core = stored(core.join(core.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(core.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst"))
        m = core.count()
        if m == n:
            break
        n = m
    r = reachable(core)
    back = r.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return r.join(back, ["src", "dst"]).groupBy(F.col("src").alias("node")).agg(F.least(F.min("dst"), F.col("src")).alias("scc"))


def shortest_paths(edges: DataFrame, sources: DataFrame, max_rounds: int = 500, targets: DataFrame | None = None) -> DataFrame:
    """(source, node, distance_m, hops) from every sources(source) over undirected edges(src, dst, weight).

    Frontier relaxation: a round relaxes the edges of nodes whose distance has just shrunk. With targets(node) a path that is
    longer than the farthest target found so far, for all of them, is not followed. Unreachable nodes have no row.
    """
    links = stored(edges.select("src", "dst", "weight").union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")).groupBy("src", "dst").agg(F.min("weight").alias("weight")))
    best = stored(sources.select("source", F.col("source").alias("node"), F.lit(0.0).alias("distance_m"), F.lit(0).alias("hops"), F.lit(True).alias("fresh")).distinct())
    for _ in range(max_rounds):
        front = best.where("fresh")
        if targets is not None:
            goals = targets.select("node").distinct()
            reach = best.join(goals, "node").groupBy("source").agg(F.max("distance_m").alias("far"), F.count("*").alias("met"))
            reach = reach.where(F.col("met") == goals.count()).select("source", "far")
            front = front.join(reach, "source", "left").where("far IS NULL OR distance_m < far").drop("far")
        step = front.join(links, front["node"] == links["src"]).select("source", F.col("dst").alias("node"), (F.col("distance_m") + F.col("weight")).alias("d"), (F.col("hops") + 1).alias("h"))
        step = step.groupBy("source", "node").agg(F.min(F.struct("d", "h")).alias("new"))
        both = best.join(step, ["source", "node"], "full")
        shorter = F.col("distance_m").isNull() | (F.col("new.d") < F.col("distance_m"))
        take = F.coalesce(F.col("new").isNotNull() & shorter, F.lit(False))
        best = stored(both.select(
            "source", "node", F.when(take, F.col("new.d")).otherwise(F.col("distance_m")).alias("distance_m"),
            F.when(take, F.col("new.h")).otherwise(F.col("hops")).alias("hops"), take.alias("fresh"),
        ))
        if best.where("fresh").isEmpty():
            return best.select("source", "node", "distance_m", "hops")
    raise RuntimeError("paths did not settle")


def bounded_paths(edges: DataFrame, pairs: DataFrame, max_hops: int = 8, stretch: float = 3.0, least_bound_m: float = 100_000.0) -> DataFrame:
    """(start, goal, hops, length_m, path) of the shortest chain of up to max_hops directed edges(src, dst, length_m) for each pairs(start, goal, gap_m).

    No place comes twice; a chain may be no longer than the larger of least_bound_m and stretch times the gap. Of the partial chains between the same ends
    with equal hops only the shortest goes on, ties by the path, so a round is bounded by pairs times places.
    """
    bound = F.greatest(F.lit(least_bound_m), F.col("gap_m") * stretch)
    live = pairs.select("start", "goal", bound.alias("bound"), F.col("start").alias("at"), F.lit(0.0).alias("length_m"), F.array("start").alias("path")).distinct()
    steps = edges.groupBy("src", "dst").agg(F.min("length_m").alias("step_m"))
    done = None
    for hops in range(1, max_hops + 1):
        nxt = live.join(steps, live["at"] == steps["src"]).where(~F.array_contains("path", F.col("dst")))
        nxt = nxt.select("start", "goal", "bound", F.col("dst").alias("at"), (F.col("length_m") + F.col("step_m")).alias("length_m"), F.array_append("path", F.col("dst")).alias("path"))
        nxt = nxt.where("length_m <= bound").groupBy("start", "goal", "bound", "at").agg(F.min(F.struct("length_m", "path")).alias("m"))
        live = stored(nxt.select("start", "goal", "bound", "at", "m.length_m", "m.path"))
        here = live.where("at = goal").select("start", "goal", F.lit(hops).alias("hops"), "length_m", "path")
        done = here if done is None else done.union(here)
        live = live.where("at <> goal")
    return done.groupBy("start", "goal").agg(F.min(F.struct("length_m", "hops", "path")).alias("m")).select("start", "goal", "m.hops", "m.length_m", "m.path")


def spanning_gaps(nodes: DataFrame, candidates: DataFrame, max_rounds: int = 64) -> DataFrame:
    """The candidates(src, dst, gap_m) of a minimum spanning forest over nodes(node), by rounds of each component's least link; ties by src, dst."""
    labels = stored(nodes.select("node", F.col("node").alias("component")).distinct())
    taken = None
    for _ in range(max_rounds):
        own = candidates.join(labels.withColumnsRenamed({"node": "src", "component": "ca"}), "src").join(labels.withColumnsRenamed({"node": "dst", "component": "cb"}), "dst").where("ca <> cb")
        edge = F.struct("gap_m", "src", "dst", "ca", "cb")
        low = own.select(F.explode(F.array(F.struct(F.col("ca").alias("c"), edge.alias("e")), F.struct(F.col("cb").alias("c"), edge.alias("e")))).alias("x"))
        low = stored(low.groupBy("x.c").agg(F.min("x.e").alias("e")).select("e.*").distinct())
        if low.isEmpty():
            return taken if taken is not None else candidates.limit(0).select("src", "dst", "gap_m")
        joined = components(labels.select(F.col("component").alias("node")).distinct(), low.select(F.col("ca").alias("src"), F.col("cb").alias("dst")))
        labels = stored(labels.join(joined.select(F.col("node").alias("c1"), F.col("component").alias("c2")), F.col("component") == F.col("c1")).select("node", F.col("c2").alias("component")))
        taken = low.select("src", "dst", "gap_m") if taken is None else taken.union(low.select("src", "dst", "gap_m"))
    raise RuntimeError("forest did not settle")
