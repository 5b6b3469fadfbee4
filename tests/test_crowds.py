"""Tables that crowd at one place: work follows the rare side, and results stay those of all pairs."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandline import joins
from strandline.operators import audit, junctions


def test_truths_meet_at_their_rarest_breakpoint(spark, monkeypatch):
    """Every truth and event has a breakpoint at one crowded place; each truth's other one has one event near it."""
    n = 300
    far = spark.range(n).select("id", F.lit("a").alias("contig"), (F.col("id") * 1000).alias("pos"))
    crowd = spark.range(n).select("id", F.lit("b").alias("contig"), (F.col("id") % 7).alias("pos"))
    odd = spark.createDataFrame([(n, "a", 5), (n, None, 7), (n + 1, "a", None)], "id bigint, contig string, pos bigint")
    both = far.unionByName(crowd).unionByName(crowd).unionByName(odd)
    met = []
    monkeypatch.setattr(audit, "band_join", lambda *a: met.append(joins.band_join(*a)) or met[-1])
    found = audit.found_truths(both.withColumnRenamed("id", "truth"), both.withColumnRenamed("id", "event"), 10)
    # The truth with one known breakpoint is found by event 0 too, which has one near it; event 300 lacks the crowded place.
    assert sorted(map(tuple, found.collect())) == sorted([(i, i) for i in range(n)] + [(0, n), (n, n)])
    assert met[0].count() <= 2 * n


def _above_join(df) -> str:
    """The optimized plan down to its first join, with the join's condition."""
    lines = df._jdf.queryExecution().optimizedPlan().toString().splitlines()
    return "\n".join(lines[: next(i for i, x in enumerate(lines) if "Join " in x) + 1])


def test_texts_of_records_are_read_before_the_join(spark):
    reads = "file_ord bigint, qname string, flag int, contig string, pos0 bigint, end0 bigint, mapq int, cigar string, mate_contig string, mate_pos0 bigint, tags map<string,string>"
    x = junctions.review(spark.createDataFrame([], reads), spark.createDataFrame([], "id bigint, ca string, pa bigint, cb string, pb bigint"), 100)
    for seen in (x.where("kind is not null").groupBy("id").count(), x.where("is_pair or is_split").groupBy("id").count()):
        assert "regexp" not in _above_join(seen) and "split(" not in _above_join(seen)


def test_bands_part_each_others_crowds(spark):
    """20,000 rows at one place of the first band, far apart in the second: bins of the first alone would meet all pairs."""
    n = 20_000
    a = spark.range(n).select(F.col("id").alias("i"), F.lit("x").alias("k"), F.lit(5).alias("p"), (F.col("id") * 100).alias("q"))
    b = a.select(F.col("i").alias("j"), F.col("k").alias("m"), F.col("p").alias("r"), (F.col("q") + 100).alias("s"))
    pairs = joins.band_join(a, b, [("k", "m")], [("p", "r", 3), ("q", "s", 100)])
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "__bin0" in plan and "__bin1" in plan
    assert sorted(map(tuple, pairs.select("i", "j").collect())) == sorted((i, j) for i in range(n) for j in (i - 2, i - 1, i) if 0 <= j)
