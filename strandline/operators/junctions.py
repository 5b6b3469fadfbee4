"""Support of junctions at both ends: read pairs, split reads, and fragments, by the orientation that they show.

``junctions``: id, ca, pa, cb, pb (1-based positions). Records in scope are mapped, neither secondary, duplicate nor
failed; supplementary ones count. A piece of a read shows its 3' side at a breakpoint that it ends at or before, else its
5' side; both ends' sides name the orientation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import alignments as A
from ..functions.contigs import plain, primary
from ..joins import ANY_LENGTH, interval_join


def in_scope(reads: DataFrame) -> DataFrame:
    return reads.where(A.lacks(F.col("flag"), A.NOT_JUNCTION))


def pair_sides(reverse: Column) -> Column:
    """The side a mate faces: forward mates read towards the 3' side of their piece, reverse ones towards its 5' side."""
    return F.when(reverse, "5").otherwise("3")


def ends(junctions: DataFrame) -> DataFrame:
    """Two rows for each junction: own end (e_*) and partner (p_*)."""
    near = "array<struct<c:string,p:bigint>>"
    other = F.col("related").cast(near) if "related" in junctions.columns else F.lit(None).cast(near)
    junctions = junctions.withColumn("related", other)
    one = junctions.select("id", "related", F.lit("A").alias("end"), F.col("ca").alias("e_c"), (F.col("pa") - 1).alias("e_p"), F.col("cb").alias("p_c"), (F.col("pb") - 1).alias("p_p"))
    two = junctions.select("id", "related", F.lit("B").alias("end"), F.col("cb").alias("e_c"), (F.col("pb") - 1).alias("e_p"), F.col("ca").alias("p_c"), (F.col("pa") - 1).alias("p_p"))
    return one.unionByName(two)


#: Kinds of abnormal reads at an end; a read is drawn by its first one.
KINDS = (
    "split_partner", "split_other", "mate_unmapped", "pair_partner", "pair_related", "pair_other_chrom", "pair_alt_contig",
    "pair_orientation", "pair_insert_size", "clipped", "ambiguous",
)


def _nearer(here: Column, other: Column) -> Column:
    """Within one chromosome: ``here`` belongs to the own end rather than to the partner, compared with ``other``."""
    lean = lambda p: F.abs(p - F.col("e_p")) - F.abs(p - F.col("p_p"))
    return lean(here) < lean(other)


def _piece_side(start: Column, last: Column, at: Column) -> Column:
    return F.when(F.abs(last - at) <= F.abs(start - at), "3").otherwise("5")


def review(reads: DataFrame, junctions: DataFrame, window: int = 1000, mapq: int = 20, clip: int = 10) -> DataFrame:
    """Every record near an end: id, end, qname, kind, kinds, low, is_pair, pair_o, is_split, split_o, joins_o, clip, pos0,
    end0, e_p, file_ord, flag.

    kinds lists what is abnormal (``KINDS``), empty for a normal record, and kind is its first. A segment near the partner
    comes before a mate there, and a mate there before a segment elsewhere. Within one chromosome proper pairs never join
    the ends, and where both reads of a pair (or both pieces of one) lie in both windows, each end counts the one nearer to
    itself. is_pair and is_split say what counts as support: good mapping quality on both sides, at the end's own read.
    Orientations are seen from this end. ``junctions`` may have related (array of struct c, p, 1-based): other ends of the
    same rearrangement.
    """
    length = lambda s: A.reference_length(A.operations(s["cigar"]))
    piece = lambda s: F.struct(plain(s["chrom"]).alias("c"), (s["pos"] - 1).alias("start"), (s["pos"] + length(s) - 2).alias("last"), s["mapq"].alias("mapq"))
    # Texts are read once for each record or end, before the join; a pair of both compares numbers and names only.
    mate, near = F.col("mate_contig"), lambda pos, at: F.abs(pos - at) <= window
    own = in_scope(reads).withColumn("ops", A.operations(F.col("cigar"))).withColumns(
        {
            "sa": F.transform(A.segments(F.element_at("tags", F.lit("SA"))), piece), "clip": A.clips(F.col("ops"), "SH"),
            "rev": A.has(F.col("flag"), A.REVERSE), "mrev": A.has(F.col("flag"), A.MATE_REVERSE),
            "m_plain": plain(mate), "m_off": primary(mate) != primary(F.col("contig")),
        }
    )
    at_ends = ends(junctions).withColumns({"e_plain": plain(F.col("e_c")), "p_plain": plain(F.col("p_c"))})
    if "related" in junctions.columns:
        at_ends = at_ends.withColumn("related", F.transform("related", lambda r: F.struct(plain(r["c"]).alias("c"), (r["p"] - 1).alias("p"))))
    x = interval_join(own.drop("ops", "cigar", "tags"), at_ends, [("contig", "e_c")], (F.col("pos0"), F.col("end0")), (F.greatest(F.lit(0), F.col("e_p") - window), F.col("e_p") + window), max(2 * window, 256), longest=(ANY_LENGTH, 2 * window))
    hit = F.filter("sa", lambda s: (s["c"] == F.col("p_plain")) & (near(s["start"], F.col("p_p")) | near(s["last"], F.col("p_p"))))
    x = x.withColumns({"hit": F.when(F.size("sa") > 0, F.get(hit, F.lit(0))), "intra": F.col("e_plain") == F.col("p_plain"), "low": F.col("mapq") < mapq, "last": F.col("end0") - 1})
    x = x.withColumns({"h_start": F.col("hit.start"), "h_last": F.col("hit.last")})
    middle = lambda a, b: F.floor((F.col(a) + F.col(b)) / 2)
    primary_read = A.lacks(F.col("flag"), A.SUPPLEMENTARY) & A.has(F.col("flag"), A.PAIRED)
    proper = A.has(F.col("flag"), A.PROPER)
    at_partner = (F.col("m_plain") == F.col("p_plain")) & near(F.col("mate_pos0"), F.col("p_p")) & ~(F.col("intra") & proper)
    at_related = F.lit(False)
    if "related" in junctions.columns:
        at_related = F.coalesce(F.exists("related", lambda r: (r["c"] == F.col("m_plain")) & near(F.col("mate_pos0"), r["p"])), F.lit(False)) & (F.col("m_plain") != F.col("e_plain"))
    left_read = F.col("pos0") <= F.col("mate_pos0")
    outward = F.when(left_read, F.col("rev")).otherwise(~F.col("rev"))
    of_pair = (
        F.when(A.has(F.col("flag"), A.MATE_UNMAPPED), "mate_unmapped")
        .when(mate.isNull(), None)
        .when(at_partner, "pair_partner")
        .when(at_related, "pair_related")
        .when(F.col("m_off") & (F.col("m_plain") != F.col("e_plain")), "pair_other_chrom")
        .when(mate != F.col("contig"), "pair_alt_contig")
        .when(proper, None)
        .when((F.col("rev") == F.col("mrev")) | outward, "pair_orientation")
        .otherwise("pair_insert_size")
    )
    of_split = F.when(F.col("hit").isNotNull(), "split_partner").when(F.size("sa") > 0, "split_other")
    x = x.withColumns({"k_pair": F.when(primary_read, of_pair), "k_split": of_split})
    pair_first = F.coalesce((F.col("k_split") == "split_other") & F.col("k_pair").isin("pair_partner", "pair_related"), F.lit(False))
    alone = F.when((F.col("clip.left") >= clip) | (F.col("clip.right") >= clip), "clipped").when(F.col("low"), "ambiguous")
    x = x.withColumn("kind", F.when(pair_first, F.col("k_pair")).otherwise(F.coalesce("k_split", "k_pair", alone)))
    second = F.when(pair_first, F.col("k_split")).when(F.col("k_split").isNotNull(), F.col("k_pair"))
    x = x.withColumn("kinds", F.array_compact(F.array(F.col("kind"), second)))
    split_mine = ~F.col("intra") | _nearer(middle("pos0", "last"), middle("h_start", "h_last"))
    pair_mine = ~F.col("intra") | _nearer(F.col("pos0"), F.col("mate_pos0"))
    seen = lambda s, e: F.concat(s, F.lit("to"), e)
    mine_o = seen(_piece_side(F.col("pos0"), F.col("last"), F.col("e_p")), _piece_side(F.col("h_start"), F.col("h_last"), F.col("p_p")))
    their_o = seen(_piece_side(F.col("h_start"), F.col("h_last"), F.col("e_p")), _piece_side(F.col("pos0"), F.col("last"), F.col("p_p")))
    here_s, mate_s = pair_sides(F.col("rev")), pair_sides(F.col("mrev"))
    is_split, is_pair = F.col("k_split") == "split_partner", F.col("k_pair").isin("pair_partner", "pair_related")
    x = x.withColumns(
        {
            "is_split": F.coalesce(is_split & split_mine & ~F.col("low") & (F.col("hit.mapq") >= mapq), F.lit(False)),
            "is_pair": F.coalesce((F.col("k_pair") == "pair_partner") & pair_mine & ~F.col("low"), F.lit(False)),
            "split_o": F.when(is_split, F.when(split_mine, mine_o).otherwise(their_o)),
            "pair_o": F.when(is_pair, F.when(pair_mine, seen(here_s, mate_s)).otherwise(seen(mate_s, here_s))),
        }
    )
    return x.select("id", "end", "qname", "kind", "kinds", "low", "is_pair", "pair_o", "is_split", "split_o", F.coalesce("split_o", "pair_o").alias("joins_o"), "clip", "pos0", "end0", "e_p", "file_ord", "flag", "mapq", "mate_contig", "contig")


def scan(reads: DataFrame, junctions: DataFrame, window: int = 1000, mapq: int = 20) -> DataFrame:
    """``review`` with a coarser kind: low_mapq, split, pair (as far as they count), elsewhere (the mate on another contig),
    clip (ten or more clipped bases), proper, other."""
    x = review(reads, junctions, window, mapq)
    mated = A.has(F.col("flag"), A.PAIRED) & A.lacks(F.col("flag"), A.MATE_UNMAPPED)
    kind = (
        F.when(F.col("low"), "low_mapq")
        .when(F.col("is_split"), "split")
        .when(F.col("is_pair"), "pair")
        .when(mated & (F.col("mate_contig") != F.col("contig")), "elsewhere")
        .when((F.col("clip.left") >= 10) | (F.col("clip.right") >= 10), "clip")
        .when(A.has(F.col("flag"), A.PROPER), "proper")
        .otherwise("other")
    )
    return x.withColumn("kind", kind)


def end_counts(reviewed: DataFrame) -> DataFrame:
    """(id, end, primary_reads, low_mapq_reads, normal_reads, by_kind): by_kind has a count for each of ``KINDS``."""
    first = A.lacks(F.col("flag"), A.SUPPLEMENTARY)
    by = F.create_map(*[v for k in KINDS for v in (F.lit(k), F.count_if(F.col("kind") == k))])
    return reviewed.groupBy("id", "end").agg(F.count_if(first).alias("primary_reads"), F.count_if(first & F.col("low")).alias("low_mapq_reads"), F.count_if(F.col("kind").isNull()).alias("normal_reads"), by.alias("by_kind"))


def view(reviewed: DataFrame, most: int = 300) -> DataFrame:
    """The abnormal records to draw of each end, at most ``most``: those that join the ends first, by file order, and the rest
    evenly over the window. A drawing's limit, not a cut of evidence: counts are ``end_counts``."""
    joins = F.col("kind").isin("split_partner", "pair_partner", "pair_related")
    x = reviewed.where("kind is not null")
    per = W.partitionBy("id", "end")
    # Ranked first, those that join the ends before the rest; the counts then need no sort of their own.
    x = x.withColumn("_joins", joins).withColumn("_i", F.row_number().over(per.orderBy(F.col("_joins").desc(), "file_ord", "pos0", "qname")) - 1)
    x = x.withColumns({"_n": F.count_if(~F.col("_joins")).over(per), "_j": F.count_if("_joins").over(per)})
    x = x.withColumn("_i", F.when(F.col("_joins"), F.col("_i")).otherwise(F.col("_i") - F.col("_j")))
    room = F.greatest(F.lit(0), F.lit(most) - F.col("_j"))
    share = lambda i: F.floor(i * room / F.col("_n"))
    rest = (room > 0) & ((F.col("_n") <= room) | (F.col("_i") == 0) | (share(F.col("_i")) > share(F.col("_i") - 1)))
    return x.where(F.when(F.col("_joins"), F.col("_i") < most).otherwise(rest)).drop("_joins", "_n", "_j", "_i")


def support(scanned: DataFrame) -> DataFrame:
    """(id, orientation, pairs, splits, fragments): pairs are names seen from both ends, splits names seen from either,
    the first end's view preferred; fragments are distinct names of both."""
    ways = F.array(F.when(F.col("is_pair"), F.struct(F.lit("pair").alias("kind"), F.col("pair_o").alias("o"))), F.when(F.col("is_split"), F.struct(F.lit("split").alias("kind"), F.col("split_o").alias("o"))))
    x = scanned.where("is_pair or is_split").select("id", "end", "qname", F.explode(F.filter(ways, lambda w: w.isNotNull())).alias("w"))
    turned = F.concat(F.substring("w.o", 4, 1), F.lit("to"), F.substring("w.o", 1, 1))
    x = x.select("id", "end", "qname", F.col("w.kind").alias("kind"), F.when(F.col("end") == "A", F.col("w.o")).otherwise(turned).alias("o"))
    named = x.groupBy("id", "kind", "qname").agg(F.min(F.struct("end", "o")).alias("m"), F.count_if(F.col("end") == "A").alias("a"), F.count_if(F.col("end") == "B").alias("b"))
    named = named.where("kind = 'split' or (a > 0 and b > 0)").select("id", F.col("m.o").alias("orientation"), "kind", "qname")
    return named.groupBy("id", "orientation").agg(F.count_if(F.col("kind") == "pair").alias("pairs"), F.count_if(F.col("kind") == "split").alias("splits"), F.countDistinct("qname").alias("fragments"))


def one_sided(scanned: DataFrame) -> DataFrame:
    """(id, n): names of pairs that only one end shows."""
    g = scanned.where("is_pair").groupBy("id", "qname").agg(F.countDistinct("end").alias("ends"))
    return g.groupBy("id").agg(F.count_if(F.col("ends") == 1).alias("n"))


def kinds(scanned: DataFrame) -> DataFrame:
    """(id, end, kind, n)."""
    return scanned.groupBy("id", "end", "kind").agg(F.count("*").alias("n"))


def piles(scanned: DataFrame, least: int = 10) -> DataFrame:
    """(id, end, pos, n): the clip position with most records; ties go to the one nearest to the breakpoint."""
    spots = F.filter(F.array(F.when(F.col("clip.left") >= least, F.col("pos0")), F.when(F.col("clip.right") >= least, F.col("end0"))), lambda p: p.isNotNull())
    g = scanned.select("id", "end", "e_p", F.explode(spots).alias("pos")).groupBy("id", "end", "pos", "e_p").agg(F.count("*").alias("n"))
    return g.groupBy("id", "end").agg(F.max_by("pos", F.struct("n", -F.abs(F.col("pos") - F.col("e_p")), -F.col("pos"))).alias("pos"), F.max("n").alias("n"))


def reciprocal_partner(junctions: DataFrame, near: int) -> DataFrame:
    """(id, partner): the first junction of the file with the complementary orientation near both ends."""
    from ..functions.contigs import COMPLEMENT, flipped
    from ..joins import band_join

    a = junctions.select(*[F.col(c).alias(f"x_{c}") for c in ("id", "ca", "pa", "cb", "pb")], flipped(F.col("orientation"), COMPLEMENT).alias("x_o"))
    b = junctions.select(*[F.col(c).alias(f"y_{c}") for c in ("id", "ca", "pa", "cb", "pb")], F.col("orientation").alias("y_o"))
    x = band_join(a, b, [("x_ca", "y_ca"), ("x_cb", "y_cb"), ("x_o", "y_o")], [("x_pa", "y_pa", near), ("x_pb", "y_pb", near)]).where("x_id <> y_id")
    return x.groupBy(F.col("x_id").alias("id")).agg(F.min("y_id").alias("partner"))
