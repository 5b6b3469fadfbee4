"""Operators over junction call sets: filter funnel, pages, recurrence between sets, merging, truth matching.

A call set is a DataFrame with at least id, chrom1, pos1, chrom2, pos2, orientation. Support counts may be null: absent
is not zero, and only predicates treat it as zero.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..graph import components
from ..joins import band_join, interval_join

Steps = list[tuple[str, Column]]


def holds(p: Column) -> Column:
    return F.coalesce(p, F.lit(False))


def funnel(calls: DataFrame, steps: Steps) -> DataFrame:
    """(ord, step, survivors, removed_alone, removed_here) of a chain of predicates, from one aggregate over the calls.

    survivors: rows that pass this step and all before it; removed_alone: rows that this predicate alone would remove;
    removed_here: rows that this step removes of those that came to it.
    """
    cumulative, aggs = F.lit(True), [F.count("*").cast("long").alias("n")]
    for i, (_, p) in enumerate(steps):
        before = cumulative
        cumulative = cumulative & holds(p)
        aggs += [F.count_if(cumulative).alias(f"s{i}"), F.count_if(~holds(p)).alias(f"a{i}"), F.count_if(before & ~holds(p)).alias(f"h{i}")]
    one = calls.agg(*aggs)
    rows = [F.struct(F.lit(i).cast("long").alias("ord"), F.lit(name).alias("step"), F.col(f"s{i}").alias("survivors"), F.col(f"a{i}").alias("removed_alone"), F.col(f"h{i}").alias("removed_here")) for i, (name, _) in enumerate(steps)]
    return one.select(F.inline(F.array(*rows)))


def keep(calls: DataFrame, steps: Steps) -> DataFrame:
    """Rows that pass every step."""
    for _, p in steps:
        calls = calls.where(holds(p))
    return calls


def removed_by(steps: Steps) -> Column:
    """Array of the names of all steps that a row fails."""
    return F.filter(F.array(*[F.when(~holds(p), F.lit(n)) for n, p in steps]), lambda x: x.isNotNull())


def masked(calls: DataFrame, mask: DataFrame) -> DataFrame:
    """``calls`` with masked1 and masked2: whether an end lies in a masked interval (start <= pos < end) or on a contig that is
    masked whole, and masked: whether either does. ``mask`` as ``text_formats.mask`` gives it; ``calls`` needs a unique id.

    The ends meet the mask by an interval join, so a mask may hold intervals of any length; whole contigs by equality. An end
    without a contig or position is not masked.
    """
    ends = calls.select("id", F.explode(F.array(*[F.struct(F.lit(k).alias("turn"), F.col(f"chrom{k}").alias("m_chrom"), F.col(f"pos{k}").cast("long").alias("m_pos")) for k in (1, 2)])).alias("e")).select("id", "e.*")
    spans = mask.where(~holds(F.col("is_whole"))).select(F.col("contig").alias("x_contig"), F.col("start").alias("x_start"), F.col("end").alias("x_end"))
    whole = mask.where(holds(F.col("is_whole"))).select(F.col("contig").alias("m_chrom")).distinct()
    inside = interval_join(ends, spans, [("m_chrom", "x_contig")], (F.col("m_pos"), F.col("m_pos") + 1), (F.col("x_start"), F.col("x_end")), 256, "left_semi", (1, None))
    hit = inside.select("id", "turn").unionAll(ends.join(whole, "m_chrom", "left_semi").select("id", "turn"))
    found = hit.groupBy("id").agg(F.bool_or(F.col("turn") == 1).alias("masked1"), F.bool_or(F.col("turn") == 2).alias("masked2"))
    out = calls.drop("masked1", "masked2", "masked").join(found, "id", "left")
    out = out.withColumns({c: F.coalesce(c, F.lit(False)) for c in ("masked1", "masked2")})
    return out.withColumn("masked", F.col("masked1") | F.col("masked2"))


def mask_step(name: str = "exclude_masked") -> tuple[str, Column]:
    """The funnel's step on ``masked`` calls: neither end is masked."""
    return name, ~F.col("masked")


def first_loss(steps: Steps) -> Column:
    """The first step that a row fails; null for survivors."""
    return F.coalesce(*[F.when(~holds(p), F.lit(n)) for n, p in steps])


def page(calls: DataFrame, order: list[Column], offset: int, limit: int, where: Column | None = None) -> DataFrame:
    """A page of the matching rows with total_in_set, total_matching and truncated, which are counted before the cut."""
    kept = calls if where is None else calls.where(holds(where))
    totals = calls.agg(F.count("*").alias("total_in_set"), (F.count("*") if where is None else F.count_if(holds(where))).alias("total_matching"))
    rows = kept.orderBy(*order).offset(offset).limit(limit)
    return rows.crossJoin(F.broadcast(totals)).withColumn("truncated", F.col("total_matching") > offset + limit)


def renamed(calls: DataFrame, tag: str) -> DataFrame:
    return calls.select([F.col(c).alias(f"{tag}_{c}") for c in calls.columns])


def recurrence(a: DataFrame, b: DataFrame, tol1: int, tol2: int) -> DataFrame:
    """All pairs (a_*, b_*) of one chromosome pair within both tolerances, whatever their orientations."""
    return band_join(renamed(a, "a"), renamed(b, "b"), [("a_chrom1", "b_chrom1"), ("a_chrom2", "b_chrom2")], [("a_pos1", "b_pos1", tol1), ("a_pos2", "b_pos2", tol2)])


def merge(calls: DataFrame, tol1: int, tol2: int) -> DataFrame:
    """One row for each single-linkage group of calls of equal chromosomes and orientation within both tolerances.

    The representative passes the filter if any does, then has most pe + sr, then most sr, then the least id; n_merged
    counts the group. Groups are transitive, so their spread may exceed the tolerances.
    """
    a, b = renamed(calls, "a"), renamed(calls.select("id", "chrom1", "chrom2", "orientation", "pos1", "pos2"), "b")
    pairs = band_join(a, b, [("a_chrom1", "b_chrom1"), ("a_chrom2", "b_chrom2"), ("a_orientation", "b_orientation")], [("a_pos1", "b_pos1", tol1), ("a_pos2", "b_pos2", tol2)]).where("a_id < b_id")
    groups = components(pairs.select("a_id", "b_id"), "a_id", "b_id")
    own = calls.join(groups, calls["id"] == groups["node"], "left").withColumn("component", F.coalesce("component", "id")).drop("node")
    pe, sr = F.coalesce("pe", F.lit(0)), F.coalesce("sr", F.lit(0))
    best = F.max_by(F.struct("id", "chrom1", "pos1", "chrom2", "pos2", "orientation", "pe", "sr", "pass"), F.struct(F.coalesce("pass", F.lit(False)), pe + sr, sr, -F.col("id")))
    return own.groupBy("component").agg(F.count("*").alias("n_merged"), best.alias("r")).select("r.*", "component", "n_merged")


def closest_truth(calls: DataFrame, truth: DataFrame, tol1: int, tol2: int) -> DataFrame:
    """For each truth row (t_*) the matching call (c_*) of the least summed distance; ties to the least id."""
    c, t = renamed(calls, "c"), renamed(truth, "t")
    near = band_join(t, c, [("t_chrom1", "c_chrom1"), ("t_chrom2", "c_chrom2")], [("t_pos1", "c_pos1", tol1), ("t_pos2", "c_pos2", tol2)])
    near = near.withColumn("distance", F.abs(F.col("t_pos1") - F.col("c_pos1")) + F.abs(F.col("t_pos2") - F.col("c_pos2")))
    order = W.partitionBy("t_id").orderBy("distance", "c_id")
    return near.withColumn("rn", F.row_number().over(order)).where("rn = 1").drop("rn")


def first_match(a: DataFrame, b: DataFrame, tol1: int, tol2: int) -> DataFrame:
    """The older comparison: each row of a keeps only its first match in b, by id; not symmetric."""
    order = W.partitionBy("a_id").orderBy("b_id")
    return recurrence(a, b, tol1, tol2).withColumn("rn", F.row_number().over(order)).where("rn = 1").drop("rn")


def mate_pairs(calls: DataFrame, mate: Column) -> DataFrame:
    """One row for each unordered pair of records that name each other's id; records without a mate stay, with null mate.

    Of a pair the record of the smaller id stays; supports are the larger of the two, nulls ignored.
    """
    own = calls.withColumn("mate", mate)
    other = own.select(F.col("id").alias("m_id"), F.col("mate").alias("m_mate"), F.col("pe").alias("m_pe"), F.col("sr").alias("m_sr"))
    both = own.join(other, (F.col("mate") == F.col("m_id")) & (F.col("m_mate") == F.col("id")), "left")
    both = both.where(F.col("m_id").isNull() | (F.col("id") < F.col("m_id")))
    return both.withColumns({"pe": F.greatest("pe", "m_pe"), "sr": F.greatest("sr", "m_sr"), "mate": F.col("m_id")}).drop("m_id", "m_mate", "m_pe", "m_sr")


def grid(calls: DataFrame, group: str, pes: list[int], srs: list[int]) -> DataFrame:
    """(group, min_pe, min_sr, survivors) for every combination of two thresholds, from one aggregate."""
    cells = [(p, s) for p in pes for s in srs]
    aggs = [F.count_if((F.coalesce("pe", F.lit(0)) >= p) & (F.coalesce("sr", F.lit(0)) >= s)).alias(f"c{i}") for i, (p, s) in enumerate(cells)]
    rows = [F.struct(F.lit(p).cast("long").alias("min_pe"), F.lit(s).cast("long").alias("min_sr"), F.col(f"c{i}").alias("survivors")) for i, (p, s) in enumerate(cells)]
    return calls.groupBy(group).agg(*aggs).select(group, F.inline(F.array(*rows)))
