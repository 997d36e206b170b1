"""Tables, row identity and lineage cuts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RID = "__rid"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's spark.checkpoint.dir; without it there is no folder that all machines see."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        # A session on one machine sees its own folders; a cluster's executors don't see the driver's.
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="ontolith-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def cut(df: DataFrame) -> DataFrame:
    """Writes a table into the shared folder and reads it back: ends lineage, survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/cut-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._cut_path = path
    return out


def release(*frames: DataFrame) -> None:
    """Deletes tables made by cut() that nothing reads any more."""
    for df in frames:
        if path := getattr(df, "_cut_path", None):
            jvm = df.sparkSession._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(p, True)


def numbered(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """docs with columns in0, in1, ... and these names by the old ones, so that no name inside an operator clashes."""
    names = {c: f"in{i}" for i, c in enumerate(docs.columns)}
    return docs.toDF(*names.values()), names


def with_rid(docs: DataFrame) -> DataFrame:
    """Adds a row identity that is the same each time the rows are read.

    A file scan gives file and row number. Anything else is written once with a generated number.
    """
    docs = docs.drop(RID)
    try:
        out = docs.withColumn(RID, F.concat(F.lpad(F.hex(F.xxhash64("_metadata.file_path")), 16, "0"), F.lpad(F.hex("_metadata.row_index"), 10, "0")))
        out.schema  # noqa: B018  resolves now
        return out
    except PySparkException:
        return cut(docs.withColumn(RID, F.lpad(F.hex(F.monotonically_increasing_id()), 26, "0")))


def crc_mod(column: str, n: int):
    """crc32 of the id as text, modulo n; null where the id is null."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % n


def held_out(column: str, n: int):
    """Whether the remainder is 1; rows without an id aren't held out."""
    return F.coalesce(crc_mod(column, n) == 1, F.lit(False))


def components(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """Connected components of (a, b): returns (node, label), label being the least node.

    Each round every node takes its least neighbour, if that is less, and then what that one took,
    to the end of the chain, which halves what is left of it by a self-join. Edges are drawn anew
    between what their ends took, and those inside one node go: only edges that are still open are
    joined again, each from its two ends, and a round leaves at most half of the nodes. Tables are
    written each round; only a count reaches the driver. Raises if it hasn't ended.
    """
    ends = lambda a, b: (F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))
    still = cut(edges.where("a <> b").select(*ends(F.col("a"), F.col("b"))).distinct())
    # A component's least node takes itself, so what is left of it is that one.
    label = cut(still.select(F.explode(F.array("a", "b")).alias("node")).distinct().select("node", F.col("node").alias("label")))
    for _ in range(rounds):
        if not still.limit(1).count():
            release(still)
            return label
        took = cut(still.groupBy(F.col("b").alias("of")).agg(F.min("a").alias("took")))
        while True:
            up = took.select(F.col("of").alias("took"), F.col("took").alias("top"))
            far = cut(took.join(up, "took", "left").select("of", F.coalesce("top", "took").alias("took"), F.col("top").isNotNull().alias("moved")))
            release(took)
            took = far
            if not far.where("moved").limit(1).count():
                break
        new = cut(label.join(took, F.col("label") == F.col("of"), "left").select("node", F.coalesce("took", "label").alias("label")))
        half = still.join(took, F.col("b") == F.col("of")).select("a", F.col("took").alias("b"))
        moved = half.join(took, F.col("a") == F.col("of"), "left").select(F.coalesce("took", "a").alias("a"), "b")
        fewer = cut(moved.where("a <> b").select(*ends(F.col("a"), F.col("b"))).distinct())
        release(still, label, took)
        still, label = fewer, new
    raise RuntimeError(f"components not settled after {rounds} rounds")
