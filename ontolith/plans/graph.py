"""Fixpoints over edge tables. Each round's table is written to the shared checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import term

NIL = term("rdf:nil")


def settle(df: DataFrame) -> DataFrame:
    """Writes a table to spark.checkpoint.dir and reads it back: no lineage, no lost blocks."""
    spark = df.sparkSession
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not where:
        # A session on one machine sees its own folders; a cluster's executors don't see the driver's.
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        where = tempfile.mkdtemp(prefix="ontolith-")
        spark.conf.set("spark.checkpoint.dir", where)
    path = f"{where}/settled-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._settled = path
    return out


def forget(*frames: DataFrame) -> None:
    """Deletes settled tables that nothing reads any more."""
    for df in frames:
        if path := getattr(df, "_settled", None):
            p = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(p, True)


def connected_components(edges: DataFrame, rounds: int = 64) -> DataFrame:
    """(node, component) with the least node of each component: least neighbour, then a pointer jump, a round."""
    both = settle(edges.select("a", "b").where("a <> b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")).where("a <> b")).distinct())
    label = settle(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("component")))
    for _ in range(rounds):
        near = both.join(label.select(F.col("node").alias("b"), F.col("component").alias("c")), "b").groupBy(F.col("a").alias("node")).agg(F.min("c").alias("c"))
        low = label.join(near, "node").select("node", F.col("component").alias("was"), F.least("component", "c").alias("low"))
        jump = label.select(F.col("node").alias("low"), F.col("component").alias("top"))
        new = settle(low.join(jump, "low", "left").select("node", "was", F.least("low", F.coalesce("top", "low")).alias("component")))
        forget(label)
        label = new.select("node", "component")
        label._settled = new._settled
        if not new.where("was <> component").limit(1).count():
            return label
    raise RuntimeError(f"components not settled after {rounds} rounds")


def reachable(edges: DataFrame, seeds: DataFrame | None = None, rounds: int = 512) -> DataFrame:
    """(start, node, depth): what each start reaches by edges (a, b), itself at depth 0. Cycles end by the anti join."""
    starts = seeds.select(F.col("node").alias("start")) if seeds is not None else edges.select(F.col("a").alias("start"))
    steps = edges.select("a", "b").where("a is not null and b is not null").distinct()
    frontier = settle(starts.distinct().select("start", F.col("start").alias("node"), F.lit(0).alias("depth")))
    # Each frontier is written once; what has been seen is their folders read together.
    schema, folders, steps = frontier.schema, [frontier._settled], settle(steps)
    for depth in range(1, rounds + 1):
        seen = frontier.sparkSession.read.schema(schema).parquet(*folders)
        frontier = settle(frontier.join(steps, F.col("node") == F.col("a")).select("start", F.col("b").alias("node")).distinct().join(seen, ["start", "node"], "left_anti").withColumn("depth", F.lit(depth)))
        if not frontier.limit(1).count():
            return seen
        folders.append(frontier._settled)
    raise RuntimeError(f"not all reached after {rounds} rounds")


def descend(edges: DataFrame, rounds: int = 512) -> DataFrame:
    """(container, node, depth) below the roots of a forest of (parent, child)."""
    roots = edges.select(F.col("parent").alias("node")).join(edges.select(F.col("child").alias("node")), "node", "left_anti").distinct()
    found = reachable(edges.select(F.col("parent").alias("a"), F.col("child").alias("b")), roots, rounds)
    return found.where("depth > 0").select(F.col("start").alias("container"), "node", "depth")


def list_items(cells: DataFrame, nil: str = NIL) -> DataFrame:
    """(head, position, item) of linked lists (node, first, rest, head flag), by pointer doubling.

    Position i of a list is i steps from its head; rounds grow with the logarithm of the longest.
    Nodes that reach nil are found first, one row a node and round; lists that don't (cycles, broken
    tails) and cells with several rests are left out. Lists that share a tail each have its items.
    """
    cells = settle(cells)
    links = cells.groupBy("node").agg(F.min("rest").alias("rest"), F.countDistinct("rest").alias("n")).where("n = 1").select("node", "rest")
    ended = settle(links.where(F.col("rest") == nil).select("node"))
    jumps = [settle(links.where(F.col("rest") != nil))]
    while True:
        # Nodes whose jump lands on one that ends: distances to nil have no gaps, so none new is the end.
        new = settle(jumps[-1].join(ended.select(F.col("node").alias("rest")), "rest", "left_semi").select("node").join(ended, "node", "left_anti"))
        if not new.limit(1).count():
            break
        ended = ended.unionByName(new)
        j = jumps[-1]
        jumps.append(settle(j.alias("x").join(j.alias("y"), F.col("x.rest") == F.col("y.node")).select("x.node", "y.rest")))
    found = settle(cells.where("head = 1").select(F.col("node").alias("head")).distinct().join(ended.select(F.col("node").alias("head")), "head", "left_semi").select("head", F.col("head").alias("node"), F.lit(0).alias("position")))
    for k, jump in enumerate(jumps):
        more = found.join(jump.join(ended, "node", "left_semi"), "node").select("head", F.col("rest").alias("node"), (F.col("position") + (1 << k)).alias("position"))
        grown = settle(found.unionByName(more))
        forget(found)
        found = grown
    items = cells.select("node", F.col("first").alias("item")).distinct()
    return found.join(items, "node").select("head", "position", "item")


def shared_tails(cells: DataFrame, nil: str = NIL) -> DataFrame:
    """Nodes that several cells have as their rest: lists that share a tail."""
    return cells.where(F.col("rest") != nil).select("node", "rest").distinct().groupBy("rest").agg(F.count("*").alias("n")).where("n > 1").select(F.col("rest").alias("node"), "n")
