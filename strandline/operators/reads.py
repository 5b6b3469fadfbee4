"""Locus evidence from aligned records (the columns of ``sources.text_formats.sam``), for a table of loci at once.

``loci``: locus, l_contig, centre. Layers keep their own scopes: primary mapped records for statistics, discordance, split
reads and depth; supplementary records also count for soft clips. Duplicates and failed records are counted, as the
evidence tools do; junction support (``operators.junctions``) leaves them out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import rules as R
from ..functions import alignments as A
from ..functions.contigs import contig_class, primary, resolve
from ..joins import ANY_LENGTH, interval_join
from . import locus as L


def prepared(reads: DataFrame) -> DataFrame:
    """Records with parsed parts: blk (aligned blocks), clip, sa, strand, and the scopes of the layers."""
    # A column of its own, so that a CIGAR is read once.
    reads = reads.withColumn("ops", A.operations(F.col("cigar")))
    ops, flag = F.col("ops"), F.col("flag")
    return reads.select(
        "file_ord", "qname", "flag", "contig", "pos0", "end0", "mapq", "mate_contig", "mate_pos0",
        A.blocks(F.col("pos0"), ops).alias("blk"),
        A.clips(ops).alias("clip"),
        A.segments(F.element_at("tags", F.lit("SA")), 2).alias("sa"),
        F.when(A.has(flag, A.REVERSE), 1).otherwise(0).cast("long").alias("strand"),
        A.lacks(flag, A.NOT_PRIMARY).alias("is_primary"),
        A.lacks(flag, A.NOT_CLIP).alias("in_clip_scope"),
        (A.has(flag, A.PAIRED) & A.lacks(flag, A.MATE_UNMAPPED)).alias("mated"),
    )


def at(reads: DataFrame, loci: DataFrame, half: int) -> DataFrame:
    return interval_join(reads, loci, [("contig", "l_contig")], (F.col("pos0"), F.col("end0")), (F.greatest(F.lit(0), F.col("centre") - half), F.col("centre") + half), max(2 * half, 256), longest=(ANY_LENGTH, 2 * half))


def statistics(reads: DataFrame, loci: DataFrame, half: int, low: int = 20) -> DataFrame:
    """n_reads, covered, mean_depth, mean_mapq, low_fraction, forward, reverse; depth counts aligned bases only."""
    start, stop = F.greatest(F.lit(0), F.col("centre") - half), F.col("centre") + half
    x = at(reads.where("is_primary"), loci, half).withColumn("bases", A.overlap(F.col("blk"), start, stop))
    g = x.groupBy("locus").agg(F.count("*").alias("n_reads"), F.sum("bases").alias("covered"), F.avg("mapq").alias("mean_mapq"), (F.count_if(F.col("mapq") < low) / F.count("*")).alias("low_fraction"), F.count_if(F.col("strand") == 0).alias("forward"))
    out = loci.select("locus").join(g, "locus", "left").withColumns({"n_reads": F.coalesce("n_reads", F.lit(0)), "covered": F.coalesce("covered", F.lit(0)), "forward": F.coalesce("forward", F.lit(0))})
    return out.withColumns({"mean_depth": F.col("covered") / (2 * half), "reverse": F.col("n_reads") - F.col("forward")})


def is_discordant(contig: Column, mate: Column) -> Column:
    """The mate lies on another primary contig; alternates of the read's own contig do not count."""
    return mate.isNotNull() & (primary(mate) != primary(contig))


def discordance(reads: DataFrame, loci: DataFrame, half: int = 500, mapq: int = 20) -> DataFrame:
    """total, discordant, below_mapq, fraction, assessable, and the partners as sorted ``name:count`` text."""
    other = F.col("mated") & is_discordant(F.col("contig"), F.col("mate_contig"))
    own = reads.where("is_primary").select("contig", "pos0", "end0", "mapq", other.alias("other"), primary(F.col("mate_contig")).alias("partner"))
    x = at(own, loci, half)
    g = L.discordance(x, mapq, F.col("other"))
    p = L.partners(x, (F.col("mapq") >= mapq) & F.col("other"), F.col("partner")).groupBy("locus").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "partner", "n"))), lambda s: F.concat_ws(":", s["partner"], s["n"])).alias("partners"))
    out = loci.select("locus").join(g, "locus", "left").join(p, "locus", "left")
    return out.withColumn("assessable", F.col("total").isNotNull() & (F.coalesce("total", F.lit(0)) + F.coalesce("below_mapq", F.lit(0)) > 0))


def clip_piles(reads: DataFrame, loci: DataFrame, half: int = 200, least: int = 10, mapq: int = 20) -> DataFrame:
    """total, left, right, consensus, max_at, side (left, right or tied): one side counts for each record, the left one first."""
    left = F.col("clip.left") >= least
    right = ~left & (F.col("clip.right") >= least)
    pos = F.when(left, F.col("pos0")).when(right, F.col("end0"))
    x = at(reads.where(F.col("in_clip_scope") & (F.col("mapq") >= mapq)), loci, half).withColumns({"side": F.when(left, "left").when(right, "right"), "at": pos}).where("side is not null")
    piles = x.groupBy("locus", "at").agg(F.count("*").alias("n"), F.min("file_ord").alias("tie"))
    best = piles.groupBy("locus").agg(F.max_by("at", F.struct("n", -F.col("tie"))).alias("consensus"), F.max("n").alias("max_at"))
    sides = x.groupBy("locus").agg(F.count("*").alias("total"), F.count_if(F.col("side") == "left").alias("left"), F.count_if(F.col("side") == "right").alias("right"))
    out = loci.select("locus").join(sides, "locus", "left").join(best, "locus", "left")
    return out.withColumn("side", F.when(F.col("left") > F.col("right"), "left").when(F.col("right") > F.col("left"), "right").when(F.col("total") > 0, "tied"))


def split_reads(reads: DataFrame, loci: DataFrame, half: int = 200, mapq: int = 20) -> DataFrame:
    """total, below_mapq, split, entries, fraction, partners (distinct contigs), examples (five first-seen places).

    A segment on a decoy contig is no partner, as it holds what the assembly lacks; decoys (reads that name one) and
    decoy_only (reads that name nothing else) say how many there were. same_strand counts entries on the read's own strand.
    """
    good = F.filter("sa", lambda s: F.coalesce(s["mapq"] >= mapq, F.lit(True)) & (primary(s["chrom"]) != primary(F.col("contig"))))
    x = reads.where("is_primary").withColumn("other", good)
    decoy = lambda s: contig_class(s["chrom"]) == "decoy"
    x = x.withColumns({"far": F.filter("other", lambda s: ~decoy(s)), "bait": F.exists("other", decoy)})
    ok = F.col("mapq") >= mapq
    has = ok & (F.size("far") > 0)
    x = x.withColumn("same", F.size(F.filter("far", lambda s: s["strand"] == F.when(F.col("strand") == 1, "-").otherwise("+"))))
    x = at(x.select("file_ord", "contig", "pos0", "end0", "mapq", "far", "bait", "same"), loci, half)
    g = x.groupBy("locus").agg(
        F.count_if(ok).alias("total"), F.count_if(~ok).alias("below_mapq"), F.count_if(has).alias("split"),
        F.sum(F.when(ok, F.size("far")).otherwise(0)).cast("long").alias("entries"), F.sum(F.when(ok, F.col("same")).otherwise(0)).cast("long").alias("same_strand"),
        F.count_if(ok & F.col("bait")).alias("decoys"), F.count_if(ok & F.col("bait") & (F.size("far") == 0)).alias("decoy_only"),
    )
    e = x.where(has).select("locus", "file_ord", F.explode("far").alias("s"))
    p = e.groupBy("locus").agg(F.array_sort(F.collect_set(primary(F.col("s.chrom")))).alias("partners"))
    seen = e.groupBy("locus", F.concat_ws(":", "s.chrom", "s.pos").alias("place")).agg(F.min("file_ord").alias("o"))
    first = seen.groupBy("locus").agg(F.transform(F.slice(F.array_sort(F.collect_list(F.struct("o", "place"))), 1, 5), lambda s: s["place"]).alias("examples"))
    out = loci.select("locus").join(g, "locus", "left").join(p, "locus", "left").join(first, "locus", "left")
    return out.withColumn("fraction", L.fraction(F.col("split"), F.col("total"), F.col("below_mapq")))


def depth(reads: DataFrame, loci: DataFrame, half: int, width: int) -> DataFrame:
    """Depth bins of ``operators.locus.depth_bins`` from aligned blocks, so deletions are not covered; no quality filter."""
    spans = reads.where("is_primary").select("contig", F.explode("blk").alias("b")).select("contig", F.col("b.s").alias("pos0"), F.col("b.e").alias("end0"))
    return L.depth_bins(spans, loci, ("contig", "l_contig"), half, width)


def counted(reads: DataFrame, loci: DataFrame, half: int, near: int) -> DataFrame:
    """Reads that the layers could look at, whatever their quality: n_reads and n_low of primary records, clip_seen and
    clip_good of those that may be clipped, by locus, from one join over the wider window."""
    x = at(reads.where("in_clip_scope"), loci, half)
    close = (F.col("pos0") < F.col("centre") + near) & (F.col("end0") > F.greatest(F.lit(0), F.col("centre") - near))
    g = x.groupBy("locus").agg(
        F.count_if("is_primary").alias("n_reads"), F.count_if(F.col("is_primary") & (F.col("mapq") < 20)).alias("n_low"),
        F.count_if(close).alias("clip_seen"), F.count_if(close & (F.col("mapq") >= 20)).alias("clip_good"),
    )
    return loci.select("locus").join(g, "locus", "left").na.fill(0, ["n_reads", "n_low", "clip_seen", "clip_good"])


#: Layers in the order in which summaries name them.
LAYERS = ("discordant", "clip", "split", "depth")


def summary(reads: DataFrame, loci: DataFrame, half: int = 500, mapq: int = 20, applicable: tuple[str, ...] = LAYERS) -> DataFrame:
    """All layers with scores, raw and normalised total, strength, layers with signal, and the thresholds that were applied.

    A layer without any read to look at is null and leaves the denominator; one whose reads all lie below ``mapq`` was
    looked at and scores 0. Layers outside ``applicable`` count in neither. With reads that mostly map badly the score is
    withheld (null) and the strength is QUALITY-LIMITED; without any layer it is NOT ASSESSABLE. raw sums what there is.
    """
    near = min(half, 200)
    n = counted(reads, loci, half, near)
    d = discordance(reads, loci, half, mapq).select("locus", "discordant", F.col("below_mapq").alias("d_below"), F.col("total").alias("d_total"), "fraction", "partners")
    c = clip_piles(reads, loci, near, 10, mapq).select("locus", F.col("total").alias("clips"), F.col("max_at").alias("clip_max"))
    s = split_reads(reads, loci, near, mapq).select("locus", "split", F.col("total").alias("s_total"), F.col("below_mapq").alias("s_below"), F.col("fraction").alias("split_fraction"), F.col("partners").alias("split_partners"))
    p = L.depth_dip(depth(reads, loci, 2000, 200), 1000).select("locus", "ratio", "at_focus", "distance")
    x = loci.select("locus").join(n, "locus").join(d, "locus").join(c, "locus").join(s, "locus").join(p, "locus")
    need = R.minimum_support(F.lit(half))
    dip = R.ladder("depth", F.col("ratio"))
    x = x.withColumns(
        {
            "s_discordant": R.ladder("discordant", F.col("fraction"), F.col("discordant"), need),
            "s_clip": F.when(F.col("clip_seen") > 0, R.ladder("clip", F.coalesce("clip_max", F.lit(0)).cast("double"))),
            "s_split": R.ladder("split", F.col("split_fraction"), F.col("split"), need),
            "s_depth": F.when(F.col("at_focus"), dip).otherwise(F.when(F.col("ratio").isNotNull(), 0.0)),
            "off_dip": ~F.col("at_focus") & (dip > 0),
            "low_fraction": F.when(F.col("n_reads") > 0, F.col("n_low") / F.col("n_reads")),
            "need": need,
        }
    )
    used = [F.col(f"s_{k}") for k in LAYERS if k in applicable]
    total = F.round(R.normalised(used), 1)
    x = x.withColumns({"raw": F.round(sum((F.coalesce(f"s_{k}", F.lit(0.0)) for k in LAYERS), F.lit(0.0)), 1), "strength": R.band(total, F.coalesce("low_fraction", F.lit(0.0)))})
    x = x.withColumn("score", F.when(F.col("strength") != "QUALITY-LIMITED", total))
    signal = sum((F.when(c > 0, 1).otherwise(0) for c in used), F.lit(0))
    judged = sum((F.when(c.isNotNull(), 1).otherwise(0) for c in used), F.lit(0))
    thresholds = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(float(v)).alias("value")) for n, v in (("window_bp", half), ("near_bp", near), ("min_mapq", mapq), ("depth_half", 2000), ("depth_bin", 200), ("dip_tolerance", 1000))])
    return x.withColumns({"signal": F.concat_ws("/", signal, judged), "thresholds": thresholds})


def subthreshold(summary: DataFrame, half: int = 500, mapq: int = 20) -> DataFrame:
    """``summary`` with absence: for a score of 0 over reads, the support that each layer has below its threshold and the
    threshold, joined to one text; a plain denial only where no layer has any. Null for other scores."""
    floor = F.format_string(f"below the %d-read minimum for this {half}bp window", F.col("need"))
    parts = F.array(
        F.when(F.col("discordant") > 0, F.format_string("%d discordant pair(s), %s", F.col("discordant"), floor)),
        F.when(F.col("split") > 0, F.format_string("%d split read(s), %s", F.col("split"), floor)),
        F.when(F.col("clips") > 0, F.format_string("%d soft-clipped read(s), at most %d at one position, 3 needed to score", F.col("clips"), F.col("clip_max"))),
        F.when(F.col("off_dip"), F.format_string("a depth dip %dbp off the queried position", F.col("distance"))),
        F.when((F.col("d_total") == 0) & (F.col("d_below") > 0), F.format_string(f"discordant_pairs had %d read(s) all below MAPQ {mapq}", F.col("d_below"))),
        F.when((F.col("clip_seen") > 0) & (F.col("clip_good") == 0), F.format_string(f"soft_clipped_reads had %d read(s) all below MAPQ {mapq}", F.col("clip_seen"))),
        F.when((F.col("s_total") == 0) & (F.col("s_below") > 0), F.format_string(f"split_reads had %d read(s) all below MAPQ {mapq}", F.col("s_below"))),
    )
    said = F.filter(parts, lambda p: p.isNotNull())
    some = F.concat(F.lit("No layer reached its scoring threshold. Support is present but sub-threshold: "), F.array_join(said, "; "), F.lit("."))
    none = F.lit("No discordant pairs, soft-clipping, split reads, or depth changes detected near this position.")
    return summary.withColumn("absence", F.when((F.col("strength") == "none") & (F.col("n_reads") > 0), F.when(F.size(said) > 0, some).otherwise(none)))


#: Aligners that write SA tags, and technologies whose reads have them.
SPLIT_ALIGNERS = ["bwa-mem", "bwa-mem2", "minimap2"]
LONG_READS = ["pacbio_hifi", "ont_nanopore"]


def layers_of(technology: Column, aligner: Column, paired: Column) -> Column:
    """The layers that a sample's metadata make informative, as an array; null metadata speak for no layer."""
    splits = F.coalesce(aligner.isin(SPLIT_ALIGNERS), F.lit(False)) | F.coalesce(technology.isin(LONG_READS), F.lit(False))
    return F.filter(F.array(F.lit("clip"), F.lit("depth"), F.when(F.coalesce(paired, F.lit(False)), "discordant"), F.when(splits, "split")), lambda x: x.isNotNull())


def non_duplicate_depth(reads: DataFrame, sites: DataFrame) -> DataFrame:
    """``sites`` (contig, pos0) with depth: primary records that are neither duplicates nor failed and cover the site with
    an aligned base, from records with blk (``prepared``)."""
    own = reads.where(F.col("is_primary") & A.lacks(F.col("flag"), A.DUPLICATE | A.QC_FAIL)).select("contig", "pos0", "end0", "blk")
    wanted = sites.select(F.col("contig").alias("s_contig"), F.col("pos0").alias("site")).distinct()
    x = interval_join(own, wanted, [("contig", "s_contig")], (F.col("pos0"), F.col("end0")), (F.col("site"), F.col("site") + 1), 1024, longest=(ANY_LENGTH, 1))
    n = x.where(F.exists("blk", lambda b: (b["s"] <= F.col("site")) & (F.col("site") < b["e"]))).groupBy(F.col("s_contig").alias("contig"), F.col("site").alias("pos0")).agg(F.count("*").alias("depth"))
    return sites.join(n, ["contig", "pos0"], "left").na.fill(0, ["depth"])


def flag_statistics(reads: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Totals of alignment flags: total, primary_reads, secondary, supplementary, duplicates, mapped, paired, proper,
    both_mapped, singletons, mate_other_contig, duplicate_fraction (of primary mapped); by the columns given."""
    f = F.col("flag")
    first = A.lacks(f, A.SECONDARY | A.SUPPLEMENTARY)
    mapped, mate = A.lacks(f, A.UNMAPPED), A.lacks(f, A.MATE_UNMAPPED)
    pair = first & A.has(f, A.PAIRED)
    both = pair & mapped & mate
    own = first & mapped
    return reads.groupBy(*(by or [])).agg(
        F.count("*").alias("total"), F.count_if(first).alias("primary_reads"), F.count_if(A.has(f, A.SECONDARY)).alias("secondary"),
        F.count_if(A.has(f, A.SUPPLEMENTARY)).alias("supplementary"), F.count_if(A.has(f, A.DUPLICATE)).alias("duplicates"),
        F.count_if(mapped).alias("mapped"), F.count_if(pair).alias("paired"), F.count_if(pair & A.has(f, A.PROPER) & mapped).alias("proper"),
        F.count_if(both).alias("both_mapped"), F.count_if(pair & mapped & ~mate).alias("singletons"),
        F.count_if(both & (F.col("mate_contig") != F.col("contig"))).alias("mate_other_contig"),
        F.when(F.count_if(own) > 0, F.count_if(own & A.has(f, A.DUPLICATE)) / F.count_if(own)).alias("duplicate_fraction"),
    )


def contig_statistics(reads: DataFrame, contigs: DataFrame) -> DataFrame:
    """(name, length, mapped, unmapped) of every contig of a header (name, length, ord) and of ``*`` for records placed
    nowhere; unmapped counts unmapped records placed at their mate's contig."""
    un = A.has(F.col("flag"), A.UNMAPPED)
    n = reads.groupBy(F.coalesce("contig", F.lit("*")).alias("name")).agg(F.count_if(~un).alias("mapped"), F.count_if(un).alias("unmapped"))
    every = contigs.select("name", "length").unionByName(contigs.sparkSession.range(1).select(F.lit("*").alias("name"), F.lit(0).cast("long").alias("length")))
    return every.join(n, "name", "left").na.fill(0, ["mapped", "unmapped"])


def far_pairs(reads: DataFrame, mapq: int = 20) -> DataFrame:
    """One row: far (names whose two primary mates lie on different contigs) and good (both of them at ``mapq`` or more)."""
    own = reads.where(A.lacks(F.col("flag"), A.SECONDARY | A.SUPPLEMENTARY))
    side = lambda bit, c: F.max(F.when(A.has(F.col("flag"), bit), F.col(c)))
    named = own.groupBy("qname").agg(side(0x40, "contig").alias("c1"), side(0x80, "contig").alias("c2"), side(0x40, "mapq").alias("m1"), side(0x80, "mapq").alias("m2"))
    far = F.col("c1") != F.col("c2")
    return named.agg(F.count_if(far).alias("far"), F.count_if(far & (F.least("m1", "m2") >= mapq)).alias("good"))


def realigned(one: DataFrame, two: DataFrame) -> DataFrame:
    """(qname, mate, state) of primary reads under two alignments: only one, only two, same, or what differs of moved, mapq
    and sa, joined by commas."""
    sides = []
    for k, d in (("x", one), ("y", two)):
        own = d.where(A.lacks(F.col("flag"), A.SECONDARY | A.SUPPLEMENTARY))
        sides.append(own.select("qname", F.when(A.has(F.col("flag"), 0x80), 2).otherwise(1).alias("mate"), F.struct("contig", "pos0").alias(f"{k}_at"), F.col("mapq").alias(f"{k}_mapq"), F.element_at("tags", F.lit("SA")).alias(f"{k}_sa"), F.lit(True).alias(f"{k}_in")))
    j = sides[0].join(sides[1], ["qname", "mate"], "full_outer")
    differs = F.concat_ws(",", *[F.when(~F.col(f"x_{c}").eqNullSafe(F.col(f"y_{c}")), name) for c, name in (("at", "moved"), ("mapq", "mapq"), ("sa", "sa"))])
    return j.select("qname", "mate", F.when(F.col("y_in").isNull(), "only one").when(F.col("x_in").isNull(), "only two").when(differs == "", "same").otherwise(differs).alias("state"))


def applicable_layers(reads: DataFrame, first: int = 1000) -> DataFrame:
    """paired, split_capable over the first primary mapped records in file order."""
    own = reads.where(A.lacks(F.col("flag"), A.NOT_PRIMARY)).orderBy("file_ord").limit(first)
    return own.agg(F.bool_or(A.has(F.col("flag"), A.PAIRED)).alias("paired"), F.bool_or(F.map_contains_key("tags", "SA")).alias("split_capable"), F.count("*").alias("n"))


def checked_regions(regions: DataFrame, contigs: DataFrame) -> DataFrame:
    """``regions`` (contig, start, end as text or numbers) with name (as the header spells the contig), first, stop (held to
    the contig) and error: null, or why the region can't be read, as data. The first that holds counts: a bound that is no
    whole number, a negative one, start after end, no width, a contig that the header lacks, a start past its end."""
    number = lambda c: F.when(F.trim(F.col(c).cast("string")).rlike(r"^[+-]?\d+$"), F.col(c).cast("string").try_cast("long"))
    x = resolve(regions.withColumns({"first": number("start"), "stop": number("end")}), "contig", contigs)
    error = (
        F.when(F.col("first").isNull() | F.col("stop").isNull(), "not an integer").when((F.col("first") < 0) | (F.col("stop") < 0), "negative")
        .when(F.col("first") > F.col("stop"), "start after end").when(F.col("first") == F.col("stop"), "zero width")
        .when(F.col("name").isNull(), "unknown contig").when(F.col("first") >= F.col("length"), "past the end")
    )
    return x.withColumn("error", error).withColumn("stop", F.when(F.col("error").isNull(), F.least("stop", "length")).otherwise(F.col("stop")))


def clamp(loci: DataFrame, contigs: DataFrame, half: int) -> DataFrame:
    """Loci with start, end held to their contig, and error (null, or bad_parameter, invalid_region, out_of_range)."""
    named = contigs.select(F.col("name").alias("l_contig"), "length")
    x = loci.join(named, "l_contig", "left")
    error = F.when(F.col("centre").isNull() | (F.col("centre") < 0), "bad_parameter").when(F.col("length").isNull(), "invalid_region").when(F.col("centre") >= F.col("length"), "out_of_range")
    return x.withColumns({"error": error, "start": F.greatest(F.lit(0), F.col("centre") - half), "end": F.least("length", F.col("centre") + half)})


def pileup(reads: DataFrame, sites: DataFrame, mapq: int = 20, baseq: int = 13) -> DataFrame:
    """(contig, pos0, base, n) at single positions from ungapped blocks; records below the quality floors are left out."""
    ops = A.operations(F.col("cigar"))
    steps = F.aggregate(
        ops,
        F.struct(F.col("pos0").alias("r"), F.lit(0).cast("long").alias("q"), F.from_json(F.lit("[]"), "array<struct<s:bigint,e:bigint,q:bigint>>").alias("out")),
        lambda s, o: F.struct(
            (s["r"] + F.when(o["op"].isin(list("MDN=X")), o["len"]).otherwise(0)).alias("r"),
            (s["q"] + F.when(o["op"].isin(list("MIS=X")), o["len"]).otherwise(0)).alias("q"),
            F.when(o["op"].isin(list("M=X")), F.concat(s["out"], F.array(F.struct(s["r"].alias("s"), (s["r"] + o["len"]).alias("e"), s["q"].alias("q"))))).otherwise(s["out"]).alias("out"),
        ),
        lambda s: s["out"],
    )
    own = reads.where(A.lacks(F.col("flag"), A.NOT_JUNCTION | A.SUPPLEMENTARY) & (F.col("mapq") >= mapq)).select("contig", "pos0", "end0", "seq", "qual", steps.alias("runs"))
    x = interval_join(own, sites.select(F.col("contig").alias("s_contig"), F.col("pos0").alias("site")), [("contig", "s_contig")], (F.col("pos0"), F.col("end0")), (F.col("site"), F.col("site") + 1), 1024, longest=(ANY_LENGTH, 1))
    run = F.get(F.filter("runs", lambda r: (r["s"] <= F.col("site")) & (F.col("site") < r["e"])), F.lit(0))
    x = x.withColumn("run", run).where("run is not null").withColumn("k", (F.col("run.q") + F.col("site") - F.col("run.s") + 1).cast("int"))
    x = x.withColumns({"base": F.substring(F.col("seq"), F.col("k"), F.lit(1)), "bq": F.ascii(F.substring(F.col("qual"), F.col("k"), F.lit(1))) - 33})
    return x.where(F.col("bq") >= baseq).groupBy("contig", F.col("site").alias("pos0"), "base").agg(F.count("*").alias("n"))
