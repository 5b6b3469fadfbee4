"""Evidence at loci: windowed statistics of aligned reads for a whole table of loci at once.

Every operator takes the output of ``reads_at``: read columns plus locus, centre (and whatever else the loci carry). One
interval join serves all layers; each layer is a conditional aggregate over it. Empty windows are not zero: fractions are
null without reads, and 0.0 where all reads lie below the mapping quality asked for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..joins import ANY_LENGTH, interval_join


def reads_at(reads: DataFrame, loci: DataFrame, contig: tuple[str, str], half: int, width: int | None = None) -> DataFrame:
    """Reads [pos0, end0) that overlap [centre - half, centre + half) on the locus' contig, a row for each pair."""
    return interval_join(reads, loci, [contig], (F.col("pos0"), F.col("end0")), (F.col("centre") - half, F.col("centre") + half), width or max(2 * half, 64), longest=(ANY_LENGTH, 2 * half))


def fraction(part: Column, total: Column, below: Column) -> Column:
    """part / total; 0.0 where only reads below the floor exist; null without any."""
    return F.when(total > 0, part / total).when(below > 0, F.lit(0.0))


def statistics(at: DataFrame, half: int, low: int) -> DataFrame:
    """locus, n_reads, covered (aligned bases in the window), mean_depth, mean_mapq, low_fraction, forward, reverse."""
    inside = F.least("end0", F.col("centre") + half) - F.greatest("pos0", F.col("centre") - half)
    g = at.groupBy("locus").agg(
        F.count("*").alias("n_reads"),
        F.sum(inside).cast("long").alias("covered"),
        F.sum("mapq").cast("long").alias("mapq_sum"),
        F.count_if(F.col("mapq") < low).alias("n_low"),
        F.count_if(F.col("strand") == 0).alias("forward"),
    )
    return g.select("locus", "n_reads", "covered", (F.col("covered") / (2 * half)).alias("mean_depth"), (F.col("mapq_sum") / F.col("n_reads")).alias("mean_mapq"), (F.col("n_low") / F.col("n_reads")).alias("low_fraction"), "forward", (F.col("n_reads") - F.col("forward")).alias("reverse"))


def discordance(at: DataFrame, mapq: int, other: Column) -> DataFrame:
    """locus, total, discordant, below_mapq, fraction. ``other``: the mate is on another primary contig."""
    good = F.col("mapq") >= mapq
    g = at.groupBy("locus").agg(F.count_if(good).alias("total"), F.count_if(good & other).alias("discordant"), F.count_if(~good).alias("below_mapq"))
    return g.withColumn("fraction", fraction(F.col("discordant"), F.col("total"), F.col("below_mapq")))


def partners(at: DataFrame, keep: Column, partner: Column) -> DataFrame:
    """locus, partner, n, share, rank of the partners of the kept reads: most first, ties by name."""
    g = at.where(keep).groupBy("locus", partner.alias("partner")).agg(F.count("*").alias("n"))
    all_ = W.partitionBy("locus")
    return g.withColumns({"share": F.col("n") / F.sum("n").over(all_), "rank": F.row_number().over(all_.orderBy(F.col("n").desc(), "partner")).cast("long")})


def partner_sentence(top: Column, n: Column, share: Column, kinds: Column) -> Column:
    """all one contig, predominant (three reads and 60 %), single or scattered."""
    return (
        F.when(kinds == 1, F.when(n == 1, F.format_string("single read to %s", top)).otherwise(F.format_string("all %d reads to %s", n, top)))
        .when((n >= 3) & (share >= 0.6), F.format_string("predominantly %s (%d reads)", top, n))
        .otherwise(F.lit("scattered"))
    )


def pile(at: DataFrame, side: Column, pos: Column, tie: Column) -> DataFrame:
    """locus, side, n_side, consensus, n_consensus: the position with most ends on each side; ties by the least ``tie``,
    then by the least position, so that reruns agree."""
    g = at.groupBy("locus", side.alias("side"), pos.alias("pos")).agg(F.count("*").alias("n"), F.min(tie).alias("tie"))
    return g.groupBy("locus", "side").agg(F.sum("n").cast("long").alias("n_side"), F.max_by("pos", F.struct("n", -F.col("tie"), -F.col("pos"))).alias("consensus"), F.max("n").alias("n_consensus"))


def depth_bins(reads: DataFrame, loci: DataFrame, contig: tuple[str, str], half: int, width: int) -> DataFrame:
    """locus, centre, bin, bin_start, bin_end, covered: bases in bins from the window's start; bins without reads are 0.

    Read and bin spans meet by an interval join over the bins that a read touches, never base by base.
    """
    n = -(-2 * half // width)
    bins = loci.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumns({"bin_start": (F.col("centre") - half + F.col("bin") * width).cast("long"), "bin_end": F.least(F.col("centre") - half + (F.col("bin") + 1) * width, F.col("centre") + half).cast("long")})
    # Loci that share a bin share its reads: each different span meets them once.
    span = [contig[1], "bin_start", "bin_end"]
    pairs = interval_join(reads, bins.select(*span).distinct(), [contig], (F.col("pos0"), F.col("end0")), (F.col("bin_start"), F.col("bin_end")), max(width, 256), longest=(ANY_LENGTH, width))
    inside = F.least("end0", "bin_end") - F.greatest("pos0", "bin_start")
    got = pairs.groupBy(*span).agg(F.sum(inside).cast("long").alias("covered"))
    return bins.join(got, span, "left").select("locus", "centre", F.col("bin").cast("long").alias("bin"), "bin_start", "bin_end", F.coalesce("covered", F.lit(0)).cast("long").alias("covered"))


def depth_dip(bins: DataFrame, reach: int) -> DataFrame:
    """locus, n_bins, min_depth, mean_depth, ratio, dip (centre of the leftmost lowest bin), distance, at_focus, likely_deletion."""
    depth = F.col("covered") / (F.col("bin_end") - F.col("bin_start"))
    g = bins.withColumn("depth", depth).groupBy("locus", "centre").agg(F.count("*").alias("n_bins"), F.min("depth").alias("min_depth"), (F.sum("depth") / F.count("*")).alias("mean_depth"), F.min_by(F.struct("bin_start", "bin_end"), F.struct("depth", "bin")).alias("low"))
    middle = F.floor((F.col("low.bin_start") + F.col("low.bin_end")) / 2).cast("long")
    g = g.withColumns({"dip": middle, "ratio": F.when(F.col("mean_depth") > 0, F.col("min_depth") / F.col("mean_depth"))}).withColumn("distance", F.abs(F.col("dip") - F.col("centre")))
    return g.select("locus", "n_bins", "min_depth", "mean_depth", "ratio", "dip", "distance", (F.col("distance") <= reach).alias("at_focus"), (F.col("ratio") < 0.7).alias("likely_deletion"))
