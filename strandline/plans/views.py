"""The driver tables seen as reads, junctions, loci and intervals; the same views in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Tolerances of the junction queries, in the two positions.
TOL1, TOL2 = 2000, 20000
#: Half-window of the locus queries.
HALF = 50


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).cast("long").alias("rid"),
        F.col("l_orderkey").cast("long").alias("qname"),
        F.col("l_returnflag").alias("contig"),
        F.col("l_orderkey").cast("long").alias("pos0"),
        (F.col("l_orderkey") + F.floor("l_quantity")).cast("long").alias("end0"),
        (F.col("l_linenumber") * 10).cast("long").alias("mapq"),
        F.col("l_linestatus").alias("mate_contig"),
        (F.col("l_linenumber") % 2).cast("long").alias("strand"),
        F.col("l_suppkey").cast("long").alias("supp"),
    )


READS = """reads AS (SELECT CAST(l_orderkey*10+l_linenumber AS BIGINT) AS rid, CAST(l_orderkey AS BIGINT) AS qname, l_returnflag AS contig,
 CAST(l_orderkey AS BIGINT) AS pos0, CAST(l_orderkey + floor(l_quantity) AS BIGINT) AS end0, CAST(l_linenumber*10 AS BIGINT) AS mapq,
 l_linestatus AS mate_contig, CAST(l_linenumber % 2 AS BIGINT) AS strand, CAST(l_suppkey AS BIGINT) AS supp FROM lineitem)"""


def junctions(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    li = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("pe"), F.sum("l_linenumber").cast("long").alias("sr"), (F.max("l_discount") >= 0.05).alias("pass"))
    names = F.array(*[F.lit(x) for x in ("3to5", "5to3", "3to3", "5to5")])
    base = o.select(
        F.col("o_orderkey").cast("long").alias("id"),
        F.col("o_orderpriority").alias("chrom1"),
        (F.col("o_orderkey") * 100).cast("long").alias("pos1"),
        F.col("o_orderstatus").alias("chrom2"),
        F.floor("o_totalprice").cast("long").alias("pos2"),
        F.get(names, (F.col("o_orderkey") % 4).cast("int")).alias("orientation"),
        F.when(F.col("o_custkey") % 2 == 1, "A").otherwise("B").alias("callset"),
    )
    return base.join(li, base["id"] == li["l_orderkey"], "left").drop("l_orderkey")


JUNCTIONS = """junctions AS (SELECT CAST(o_orderkey AS BIGINT) AS id, o_orderpriority AS chrom1, CAST(o_orderkey*100 AS BIGINT) AS pos1, o_orderstatus AS chrom2,
 CAST(floor(o_totalprice) AS BIGINT) AS pos2, CASE o_orderkey % 4 WHEN 0 THEN '3to5' WHEN 1 THEN '5to3' WHEN 2 THEN '3to3' ELSE '5to5' END AS orientation,
 CASE WHEN o_custkey % 2 = 1 THEN 'A' ELSE 'B' END AS callset, pe, sr, pass FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS pe, CAST(sum(l_linenumber) AS BIGINT) AS sr,
 max(l_discount) >= 0.05 AS pass FROM lineitem GROUP BY 1) l ON o_orderkey = l_orderkey)"""


def loci(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").where(F.col("o_orderkey") % 100 == 0)
    names = F.array(F.lit("A"), F.lit("N"), F.lit("R"))
    return o.select(F.col("o_orderkey").cast("long").alias("locus"), F.get(names, F.floor(F.col("o_orderkey") / 100).cast("int") % 3).alias("l_contig"), F.col("o_orderkey").cast("long").alias("centre"))


LOCI = """loci AS (SELECT CAST(o_orderkey AS BIGINT) AS locus, CASE (o_orderkey // 100) % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'N' ELSE 'R' END AS l_contig,
 CAST(o_orderkey AS BIGINT) AS centre FROM orders WHERE o_orderkey % 100 = 0)"""


def intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.select(F.col("p_partkey").cast("long").alias("gene"), (F.col("p_partkey") * 10).cast("long").alias("g_start"), (F.col("p_partkey") * 10 + F.col("p_size")).cast("long").alias("g_end"), F.col("p_type").alias("g_type"), F.col("p_size").cast("long").alias("g_size"))


INTERVALS = """intervals AS (SELECT CAST(p_partkey AS BIGINT) AS gene, CAST(p_partkey*10 AS BIGINT) AS g_start, CAST(p_partkey*10+p_size AS BIGINT) AS g_end,
 p_type AS g_type, CAST(p_size AS BIGINT) AS g_size FROM part)"""

#: Overlaps of reads and loci, each once.
OVERLAPS = f"""seen_at AS (SELECT r.*, l.locus, l.centre FROM loci l JOIN reads r ON r.contig = l.l_contig AND r.pos0 < l.centre + {HALF} AND r.end0 > l.centre - {HALF})"""
BANDS_ON = f"a.chrom1 = b.chrom1 AND a.chrom2 = b.chrom2 AND abs(a.pos1 - b.pos1) <= {TOL1} AND abs(a.pos2 - b.pos2) <= {TOL2}"
#: DuckDB plans an equality on bins as a hash join, as the Spark side does.
BANDS_BIN = f"a.chrom1 = b.chrom1 AND a.chrom2 = b.chrom2 AND b.bin = a.pos1 // {TOL1} AND abs(a.pos1 - b.pos1) <= {TOL1} AND abs(a.pos2 - b.pos2) <= {TOL2}"


def binned(where: str = "") -> str:
    """DuckDB: junctions with their bin and both neighbours."""
    return f"(SELECT *, unnest([pos1 // {TOL1} - 1, pos1 // {TOL1}, pos1 // {TOL1} + 1]) AS bin FROM junctions {where})"


def with_(*parts: str) -> str:
    return "WITH " + ", ".join(parts) + " "
