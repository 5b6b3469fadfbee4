"""Genes, disorders and bands at positions, by interval and nearest joins over the whole table of positions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..joins import interval_join, nearest


def at(points: DataFrame, genes: DataFrame, margin: int = 0) -> DataFrame:
    """Points (point, contig, pos; 1-based) with the genes that hold them, protein-coding first, then by start."""
    g = genes.withColumnRenamed("chrom", "g_chrom")
    x = interval_join(points, g, [("contig", "g_chrom")], (F.col("pos") - margin, F.col("pos") + margin + 1), (F.col("start"), F.col("end") + 1), 4096, longest=(2 * margin + 1, None))
    return x.withColumn("where", where(F.col("pos"), F.col("exons"), F.col("strand")))


def where(pos: Column, exons: Column, strand: Column) -> Column:
    """``exon k of n`` or ``intron k of n-1``, counted along the strand; ``outside exons`` before the first or after the last."""
    n = F.size(exons)
    inside = F.filter(F.transform(exons, lambda e, i: F.struct(e["s"].alias("s"), e["e"].alias("e"), i.alias("i"))), lambda e: (e["s"] <= pos) & (pos <= e["e"]))
    before = F.size(F.filter(exons, lambda e: e["e"] < pos))
    k = F.get(inside, F.lit(0))["i"] + 1
    exon = F.format_string("exon %d of %d", F.when(strand == "-", n - k + 1).otherwise(k), n)
    intron = F.format_string("intron %d of %d", F.when(strand == "-", n - before).otherwise(before), n - 1)
    return F.when(F.coalesce(n, F.lit(0)) <= 0, F.lit(None).cast("string")).when(F.size(inside) > 0, exon).when((before > 0) & (before < n), intron).otherwise("outside exons")


def neighbours(points: DataFrame, genes: DataFrame, reach: int = 1_000_000) -> DataFrame:
    """(point, side, name, distance): nearest gene strictly to either side; ties go to the earlier start."""
    g = genes.withColumnRenamed("chrom", "g_chrom")
    sides = []
    for side, edge in (("left", F.col("end")), ("right", F.col("start"))):
        sides.append(nearest(points, "point", g, [("contig", "g_chrom")], F.col("pos"), edge, side, reach, [F.col("start"), F.col("name")], ["name"]).withColumn("side", F.lit(side)))
    return sides[0].unionByName(sides[1])


def marks(named: DataFrame, mim: DataFrame, disorders: DataFrame, most: int = 12) -> DataFrame:
    """Rows (name) with mim, phenotype and at most ``most`` diseases of the symbol, n_diseases before the cut."""
    m = mim.withColumnRenamed("symbol", "m_symbol")
    d = disorders.withColumnRenamed("symbol", "d_symbol")
    x = named.join(m, F.col("name") == F.col("m_symbol"), "left").join(d, F.col("name") == F.col("d_symbol"), "left")
    return x.withColumns({"n_diseases": F.coalesce(F.size("diseases"), F.lit(0)), "diseases": F.slice("diseases", 1, most)}).drop("m_symbol", "d_symbol")


def segment_counts(segments: DataFrame, genes: DataFrame, disorders: DataFrame, most: int = 200) -> DataFrame:
    """(segment, total, coding, with_disorder, names): genes in [start, end] of segments (segment, contig, s_start, s_end)."""
    g = genes.withColumnRenamed("chrom", "g_chrom").join(disorders.select(F.col("symbol").alias("name"), F.lit(True).alias("marked")), "name", "left")
    x = interval_join(segments, g, [("contig", "g_chrom")], (F.col("s_start"), F.col("s_end") + 1), (F.col("start"), F.col("end") + 1), 4096, longest=(None, None))
    coding = F.col("type") == "protein_coding"
    names = F.transform(F.slice(F.array_sort(F.collect_list(F.struct((~coding).alias("x"), "start", "name"))), 1, most), lambda s: s["name"])
    return x.groupBy("segment").agg(F.count("*").alias("total"), F.count_if(coding).alias("coding"), F.count_if("marked").alias("with_disorder"), names.alias("names"))


def band(points: DataFrame, bands: DataFrame) -> DataFrame:
    """Points with the band that holds them: start0 < pos <= end."""
    b = bands.withColumnRenamed("contig", "b_contig")
    return interval_join(points, b, [("contig", "b_contig")], (F.col("pos") - 1, F.col("pos")), (F.col("start0"), F.col("end")), 65_536, longest=(1, None))


def canonical(transcripts: DataFrame) -> DataFrame:
    """(gene_id, transcript_id): the transcript of the highest tag rank, then most exonic bases, then first."""
    return transcripts.groupBy("gene_id").agg(F.max_by("transcript_id", F.struct("tag_rank", "bases", -F.col("ord"))).alias("transcript_id"))


def bed12(genes: DataFrame) -> DataFrame:
    """One tab-separated BED12 line for each gene with exons: block sizes and starts from the exons."""
    sizes = F.array_join(F.transform("exons", lambda e: (e["e"] - e["s"] + 1).cast("string")), ",")
    starts = F.array_join(F.transform("exons", lambda e: (e["s"] - F.col("start")).cast("string")), ",")
    s0, e = (F.col("start") - 1).cast("string"), F.col("end").cast("string")
    return genes.where(F.size("exons") > 0).select(F.concat_ws("\t", "chrom", s0, e, "name", F.lit("0"), "strand", s0, e, F.lit("0"), F.size("exons"), sizes, starts).alias("value"))
