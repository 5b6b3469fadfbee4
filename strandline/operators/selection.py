"""Order statistics of groups of any size: values at given ranks, and rows with their ranks.

No group is gathered or sorted in one task. ``at_ranks`` narrows all targets of all groups at once, by histograms of a few
bins each; ``ranked`` cuts the whole order into even ranges and adds up where each begins.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..graph import removed, shared_folder, written

#: Bins of a histogram, and the most values of a span that are sorted in one place.
BINS = 1024
SORTED = 1 << 16


#: Types whose differences are taken exactly.
WHOLE = ("tinyint", "smallint", "int", "bigint")


def exact_share() -> Column:
    """Where v lies from lo (0) to hi (1), for whole numbers and decimals."""
    gap = lambda a, b: (F.col(a).cast("decimal(38,6)") - F.col(b).cast("decimal(38,6)")).cast("double")
    return gap("v", "lo") / gap("hi", "lo")


def double_share(turn: int) -> Column:
    """The same for doubles: by the values, and in every second round by their logarithms, so that a few far values don't crowd
    the others into one bin."""

    def scale(c: str) -> Column:
        x = F.col(c).cast("double")
        return x if turn % 2 == 0 else F.when(x == 0, 0.0).otherwise(F.signum(x) * (F.log2(F.abs(x)) + 1100))

    v, lo, hi = map(scale, ("v", "lo", "hi"))
    half = F.when(hi / 2 > lo / 2, (v / 2 - lo / 2) / (hi / 2 - lo / 2))
    return F.when((hi > lo) & (hi - lo < float("inf")), (v - lo) / (hi - lo)).otherwise(half)


def at_ranks(df: DataFrame, group: str, value: str, ranks: list[Column]) -> DataFrame:
    """(group, turn, value): for each group with values, the value at each of ``ranks`` in its sorted values, from 0.

    ``ranks``: expressions over n, the number of the group's values; turn is the place in the list. Nulls and NaN are left
    out; a null group is a group. Values may be numbers of any kind.

    A target begins as the span from the group's least to its greatest value. In a round, every value inside a target's span
    counts in one of ``BINS`` bins, and the bin that holds the rank becomes the span, from the least to the greatest value that
    it has. Bins are even in the values and in their logarithms by turns, so spans end after a few rounds however the values lie.
    A span of at most ``SORTED`` values is sorted. Rounds write their spans, a row a target, to the folder of
    spark.checkpoint.dir.
    """
    spark = df.sparkSession
    root, turn = f"{shared_folder(spark)}/ranks-{uuid.uuid4().hex[:12]}", 0
    x = df.select(F.col(group).alias("g"), F.col(value).alias("v")).where(F.col("v").isNotNull() & ~F.isnan(F.col("v").cast("double")))
    kind = dict(x.dtypes)["v"]
    whole = x.groupBy("g").agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    targets = whole.select("g", "lo", "hi", F.col("n").alias("c"), F.posexplode(F.array(*[r.cast("long") for r in ranks])).alias("turn", "rank"))
    now = written(targets, f"{root}/0")
    wide = (F.col("lo") != F.col("hi")) & (F.col("c") > SORTED)
    meet = lambda spans: x.join(spans.withColumnRenamed("g", "tg").drop("c"), F.col("g").eqNullSafe(F.col("tg")) & F.col("v").between(F.col("lo"), F.col("hi")))
    while not now.where(wide).isEmpty():
        inside = meet(now.where(wide))
        share = exact_share() if kind in WHOLE or kind.startswith("decimal") else double_share(turn)
        place = F.coalesce(F.least(F.lit(BINS - 1), F.floor(share * BINS)).cast("int"), F.when(F.col("v") > F.col("lo"), BINS - 1).otherwise(0))
        bins = inside.groupBy("g", "turn", "rank", place.alias("bin")).agg(F.count("*").alias("c"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        upto = F.sum("c").over(W.partitionBy("g", "turn").orderBy("bin"))
        hit = bins.withColumn("upto", upto).where((F.col("rank") < F.col("upto")) & (F.col("rank") >= F.col("upto") - F.col("c")))
        after = hit.select("g", "lo", "hi", "c", "turn", (F.col("rank") - F.col("upto") + F.col("c")).alias("rank"))
        turn += 1
        now = written(now.where(~wide).unionByName(after), f"{root}/{turn}")
        removed(spark, f"{root}/{turn - 1}")
    few = meet(now.where("lo <> hi")).groupBy("g", "turn", "rank").agg(F.sort_array(F.collect_list("v")).alias("all"))
    found = few.select("g", "turn", F.get("all", F.col("rank").cast("int")).alias("value"))
    return found.unionAll(now.where("lo = hi").select("g", "turn", F.col("lo").alias("value"))).withColumnRenamed("g", group)


def medians(df: DataFrame, group: str, value: str) -> DataFrame:
    """(group, median): exact medians, of an even number of values the mean of the two in the middle."""
    two = at_ranks(df, group, value, [F.floor((F.col("n") - 1) / 2), F.floor(F.col("n") / 2)])
    return two.groupBy(group).agg(((F.min("value") + F.max("value")) / 2).alias("median"))


def ranked(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """``df`` with rank: a row's place, from 0, among the rows of equal ``keys`` in the given order.

    Rows are dealt out by ranges of keys and order together, so a large group takes many tasks. Ranks run within a range's
    part of a group (a cell), and begin after the sizes of the cells before it, of which there are few. The ranges are written
    to the folder of spark.checkpoint.dir, so that both see the same ones.
    """
    spark = df.sparkSession
    dealt = df.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *keys, *order).withColumn("_cell", F.spark_partition_id())
    cells = written(dealt, f"{shared_folder(spark)}/cells-{uuid.uuid4().hex[:12]}")
    counts = cells.groupBy(*keys, "_cell").agg(F.count("*").alias("_size"))
    before = W.partitionBy(*keys).orderBy("_cell").rowsBetween(W.unboundedPreceding, -1)
    starts = counts.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_cell").alias("_c"), F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_start"))
    own = cells.withColumn("_i", F.row_number().over(W.partitionBy(*keys, "_cell").orderBy(*order)) - 1)
    same = F.col("_cell") == F.col("_c")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return own.join(starts, same).select(*df.columns, (F.col("_start") + F.col("_i")).alias("rank"))
