"""Connected components of an edge table, by alternating large-star and small-star steps.

Edges point from the larger node to the smaller. A round moves every edge to the least neighbour of its lower end
(large star), then joins the lower ends of each node (small star); the number of rounds grows with the log of the longest
path. A round's minima and edges are tables written to the folder of spark.checkpoint.dir: they survive lost executors,
are computed once, and, since both sides of the large-star join are plain exchanges, AQE can split the join at a root
with a large part of all nodes. The minima themselves are combined before they are shuffled.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The cluster's checkpoint folder, spark.checkpoint.dir; a temporary one only where none is set and the master is local."""
    where = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = tempfile.mkdtemp(prefix="strandline-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def written(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def removed(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of an edge; component is the least node reached. Self-loops only name a node.
    Edges with a null end are left out."""
    spark = edges.sparkSession
    root, turn = f"{shared_folder(spark)}/components-{uuid.uuid4().hex[:12]}", 0
    pairs = written(edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a is not null and b is not null"), f"{root}/edges")
    nodes = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    now = pairs.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    seen = None
    while True:
        low = written(now.groupBy("a").agg(F.min("b").alias("m")), f"{root}/low{turn}")
        large = now.join(low.select(F.col("a").alias("b"), "m"), "b", "left").select("a", F.coalesce("m", "b").alias("b"))
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b <> m").select(F.greatest("b", "m").alias("a"), F.least("b", "m").alias("b"))
        after = small.unionAll(least.select("a", F.col("m").alias("b"))).distinct()
        state = Observation()
        after = after.observe(state, F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")).alias("h"))
        now = written(after, f"{root}/{turn}")
        removed(spark, f"{root}/low{turn}")
        if turn:
            removed(spark, f"{root}/{turn - 1}")
        turn += 1
        if state.get == seen:
            break
        seen = state.get
    # No node points at a node that points on, so the lower ends are the roots.
    return nodes.join(now.select(F.col("a").alias("node"), F.col("b").alias("component")), "node", "left").withColumn("component", F.coalesce("component", "node"))
