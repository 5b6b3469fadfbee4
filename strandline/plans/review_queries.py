"""Driver queries of records, junction ends, comparisons and test design, with their DuckDB twins.

Line items are seen as aligned records with CIGAR, flag, tags and mates; the twins compute from the columns what the
library reads out of those texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import contigs as C
from ..operators import events, junctions, reads
from ..operators import text as T
from ..sources import sinks
from . import views as V
from .views import table as t

#: Contigs of the view, as a header names them.
_LENGTH = {"chr1": 500_000, "chr2": 400_000, "chr3": 300_000}


def records(spark: SparkSession, d: str) -> DataFrame:
    """Records of 8 to 57 aligned bases and a clip of 0 to 14, paired by line number within an order."""
    li = t(spark, d, "lineitem")
    own = li.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).cast("long").alias("file_ord"),
        F.concat(F.lit("q"), F.col("l_orderkey").cast("string")).alias("qname"),
        _flag().cast("int").alias("flag"),
        F.concat(F.lit("chr"), (F.col("l_orderkey") % 3 + 1).cast("string")).alias("contig"),
        (F.col("l_orderkey") + F.col("l_linenumber")).cast("long").alias("pos0"),
        (F.col("l_linenumber") * 10).cast("int").alias("mapq"),
        F.concat((F.floor("l_quantity") + 7).cast("long").cast("string"), F.lit("M"), F.when(_clip() > 0, F.concat(_clip().cast("string"), F.lit("S"))).otherwise("")).alias("cigar"),
        F.when(_flag().bitwiseAND(F.lit(8)) == 0, F.concat(F.lit("chr"), (F.col("l_partkey") % 3 + 1).cast("string"))).alias("mate_contig"),
        (F.col("l_orderkey") + F.col("l_suppkey") % 1500 - 700).cast("long").alias("mate_pos0"),
        F.when(F.col("l_partkey") % 11 == 0, F.create_map(F.lit("SA"), F.concat(F.lit("chr"), (F.col("l_suppkey") % 3 + 1).cast("string"), F.lit(","), (F.col("l_orderkey") + 200).cast("string"), F.lit(",+,40M,"), (F.col("l_linenumber") * 12).cast("string"), F.lit(",0;")))).otherwise(F.create_map().cast("map<string,string>")).alias("tags"),
    )
    return own.withColumn("end0", F.col("pos0") + F.regexp_extract("cigar", r"^(\d+)M", 1).cast("long"))


def _clip():
    return (F.col("l_suppkey") % 15).cast("long")


def _flag():
    """Paired; proper, unmapped mate, strands, mate number, duplicate and supplementary from the columns."""
    p, s, n = F.col("l_partkey"), F.col("l_suppkey"), F.col("l_linenumber")
    bit = lambda c, b: F.when(c, b).otherwise(0)
    return F.lit(1) + bit(p % 4 == 0, 2) + bit(s % 13 == 0, 8) + bit(n % 2 == 0, 16) + bit(p % 2 == 0, 32) + F.when(n % 2 == 1, 64).otherwise(128) + bit(s % 17 == 0, 1024) + bit(p % 19 == 0, 2048)


RECORDS = """rec AS (SELECT CAST(l_orderkey*10+l_linenumber AS BIGINT) AS file_ord, 'q' || l_orderkey AS qname,
 CAST(1 + CASE WHEN l_partkey % 4 = 0 THEN 2 ELSE 0 END + CASE WHEN l_suppkey % 13 = 0 THEN 8 ELSE 0 END + CASE WHEN l_linenumber % 2 = 0 THEN 16 ELSE 0 END + CASE WHEN l_partkey % 2 = 0 THEN 32 ELSE 0 END
  + CASE WHEN l_linenumber % 2 = 1 THEN 64 ELSE 128 END + CASE WHEN l_suppkey % 17 = 0 THEN 1024 ELSE 0 END + CASE WHEN l_partkey % 19 = 0 THEN 2048 ELSE 0 END AS BIGINT) AS flag,
 'chr' || (l_orderkey % 3 + 1) AS contig, CAST(l_orderkey + l_linenumber AS BIGINT) AS pos0, CAST(l_linenumber * 10 AS BIGINT) AS mapq, CAST(floor(l_quantity) + 7 AS BIGINT) AS m, CAST(l_suppkey % 15 AS BIGINT) AS clip,
 CASE WHEN l_suppkey % 13 <> 0 THEN 'chr' || (l_partkey % 3 + 1) END AS mate_contig, CAST(l_orderkey + l_suppkey % 1500 - 700 AS BIGINT) AS mate_pos0,
 CASE WHEN l_partkey % 11 = 0 THEN 'chr' || (l_suppkey % 3 + 1) END AS sa_chrom, CAST(l_orderkey + 200 AS BIGINT) AS sa_pos, CAST(l_linenumber * 12 AS BIGINT) AS sa_mapq, l_orderkey, l_linenumber FROM lineitem),
 r AS (SELECT *, pos0 + m AS end0, (flag & 2048) > 0 AS supp, (flag & 1024) > 0 AS dup, (flag & 16) > 0 AS rev, (flag & 32) > 0 AS mrev, (flag & 2) > 0 AS proper, (flag & 8) > 0 AS mate_un FROM rec)"""


def contigs(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(n, k, i) for i, (n, k) in enumerate(_LENGTH.items())], "name string, length bigint, ord bigint")


def q_flag_statistics(spark: SparkSession, d: str) -> DataFrame:
    return reads.flag_statistics(records(spark, d), ["contig"]).withColumn("duplicate_fraction", F.round("duplicate_fraction", 9))


SQL_FLAGS = V.with_(RECORDS) + (
    "SELECT contig, count(*) AS total, count(*) FILTER (NOT supp) AS primary_reads, 0::BIGINT AS secondary, count(*) FILTER (supp) AS supplementary, count(*) FILTER (dup) AS duplicates, count(*) AS mapped, "
    "count(*) FILTER (NOT supp) AS paired, count(*) FILTER (NOT supp AND proper) AS proper, count(*) FILTER (NOT supp AND NOT mate_un) AS both_mapped, count(*) FILTER (NOT supp AND mate_un) AS singletons, "
    "count(*) FILTER (NOT supp AND NOT mate_un AND mate_contig <> contig) AS mate_other_contig, round(CAST(count(*) FILTER (NOT supp AND dup) AS DOUBLE) / count(*) FILTER (NOT supp), 9) AS duplicate_fraction FROM r GROUP BY 1"
)


def q_far_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Mates of one name lie on other contigs here by their line, so that names of two lines have both."""
    moved = records(spark, d).withColumn("contig", F.concat(F.lit("chr"), (F.col("file_ord") % 3 + 1).cast("string")))
    return reads.far_pairs(moved)


SQL_FAR = V.with_(RECORDS, "n AS (SELECT qname, max(CASE WHEN l_linenumber % 2 = 1 THEN 'chr' || (file_ord % 3 + 1) END) AS c1, max(CASE WHEN l_linenumber % 2 = 0 THEN 'chr' || (file_ord % 3 + 1) END) AS c2, max(CASE WHEN l_linenumber % 2 = 1 THEN mapq END) AS m1, max(CASE WHEN l_linenumber % 2 = 0 THEN mapq END) AS m2 FROM r WHERE NOT supp GROUP BY 1)") + (
    "SELECT count(*) FILTER (c1 <> c2) AS far, count(*) FILTER (c1 <> c2 AND least(m1, m2) >= 20) AS good FROM n"
)


def q_realigned(spark: SparkSession, d: str) -> DataFrame:
    """The first lines of each order against the same ones moved, requalified or lost by its key."""
    li = records(spark, d).where(F.col("file_ord") % 10 == 1)
    one = li.withColumn("qname", F.concat_ws(":", "qname", "cigar", F.coalesce("mate_contig", F.lit("")), F.col("mate_pos0").cast("string"), F.col("flag").cast("string"))).dropDuplicates(["qname"])
    key = F.floor(F.col("file_ord") / 10)
    two = one.withColumns({"pos0": F.when(key % 7 == 0, F.col("pos0") + 5).otherwise(F.col("pos0")), "mapq": F.when(key % 5 == 0, 0).otherwise(F.col("mapq"))}).where(key % 11 != 0)
    return reads.realigned(one, two).groupBy("state").agg(F.count("*").alias("n"))


SQL_REALIGNED = V.with_(RECORDS) + (
    "SELECT CASE WHEN l_orderkey % 11 = 0 THEN 'only one' WHEN l_orderkey % 7 = 0 AND l_orderkey % 5 = 0 THEN 'moved,mapq' WHEN l_orderkey % 7 = 0 THEN 'moved' WHEN l_orderkey % 5 = 0 THEN 'mapq' ELSE 'same' END AS state, count(*) AS n FROM (SELECT DISTINCT l_orderkey, m, clip, mate_contig, mate_pos0, flag, supp FROM r WHERE l_linenumber = 1) WHERE NOT supp GROUP BY 1"
)


def q_point_depth(spark: SparkSession, d: str) -> DataFrame:
    sites = V.loci(spark, d).select(F.concat(F.lit("chr"), (F.col("locus") % 3 + 1).cast("string")).alias("contig"), F.col("centre").alias("pos0"))
    return reads.non_duplicate_depth(reads.prepared(records(spark, d)), sites).select("contig", "pos0", "depth")


SQL_POINT = V.with_(RECORDS, V.LOCI, "s AS (SELECT 'chr' || (locus % 3 + 1) AS contig, centre AS pos0 FROM loci)") + (
    "SELECT s.contig, s.pos0, count(r.pos0) AS depth FROM s LEFT JOIN r ON r.contig = s.contig AND NOT supp AND NOT dup AND r.pos0 <= s.pos0 AND r.end0 > s.pos0 GROUP BY 1, 2"
)


def q_region_errors(spark: SparkSession, d: str) -> DataFrame:
    """Regions with bounds as text: some no numbers, negative, reversed, empty, on unknown contigs or past the end."""
    o, k = t(spark, d, "orders"), F.col("o_orderkey")
    start = F.when(k % 13 == 0, "x1").when(k % 11 == 0, "-5").otherwise(k.cast("string"))
    stop = F.when(k % 7 == 0, k.cast("string")).when(k % 5 == 0, F.lit("3")).otherwise((k + 900_000).cast("string"))
    name = F.when(k % 3 == 0, "1").when(k % 17 == 0, "chrZ").otherwise("chr2")
    x = reads.checked_regions(o.select(k.alias("id"), name.alias("contig"), start.alias("start"), stop.alias("end")), contigs(spark))
    return x.select("id", "name", "stop", "error")


SQL_REGIONS = """WITH g AS (SELECT o_orderkey AS id, o_orderkey AS k, CASE WHEN o_orderkey % 3 = 0 THEN 'chr1' WHEN o_orderkey % 17 = 0 THEN NULL ELSE 'chr2' END AS name, CASE WHEN o_orderkey % 3 = 0 THEN 500000 ELSE 400000 END AS n,
 CASE WHEN o_orderkey % 7 = 0 THEN o_orderkey WHEN o_orderkey % 5 = 0 THEN 3 ELSE o_orderkey + 900000 END AS b, CASE WHEN o_orderkey % 13 = 0 THEN NULL WHEN o_orderkey % 11 = 0 THEN -5 ELSE o_orderkey END AS a FROM orders),
 e AS (SELECT *, CASE WHEN a IS NULL THEN 'not an integer' WHEN a < 0 THEN 'negative' WHEN a > b THEN 'start after end' WHEN a = b THEN 'zero width' WHEN name IS NULL THEN 'unknown contig' WHEN a >= n THEN 'past the end' END AS error FROM g)
 SELECT id, name, CAST(CASE WHEN error IS NULL THEN least(b, n) ELSE b END AS BIGINT) AS stop, error FROM e"""


def q_locus_layers(spark: SparkSession, d: str) -> DataFrame:
    """Three layers of the summary over loci, with the quality gate; depth is not applicable here."""
    loci = V.loci(spark, d).select("locus", F.concat(F.lit("chr"), (F.col("locus") / 100 % 4 + 1).cast("int").cast("string")).alias("l_contig"), "centre")
    x = reads.subthreshold(reads.summary(reads.prepared(records(spark, d)), loci, 100, 20, ("discordant", "clip", "split")), 100)
    return x.select("locus", "n_reads", "n_low", "discordant", "clips", "clip_max", "split", "s_discordant", "s_clip", "s_split", "score", "strength", "signal", (F.col("absence").isNotNull()).alias("said"))


_NEAR = "r.contig = l.l_contig AND r.pos0 < l.centre + 100 AND r.end0 > greatest(0, l.centre - 100)"
SQL_LAYERS = V.with_(
    RECORDS, V.LOCI,
    "l AS (SELECT locus, 'chr' || ((locus // 100) % 4 + 1) AS l_contig, centre FROM loci)",
    f"x AS (SELECT l.locus, r.*, mapq >= 20 AS ok, sa_chrom <> contig AND sa_mapq >= 20 AS far FROM l JOIN r ON {_NEAR})",
    "a AS (SELECT locus, count(*) FILTER (NOT supp) AS n_reads, count(*) FILTER (NOT supp AND NOT ok) AS n_low, count(*) FILTER (NOT supp AND ok AND NOT mate_un AND mate_contig <> contig) AS discordant, count(*) FILTER (ok AND clip >= 10) AS clips, count(*) FILTER (NOT supp AND ok AND far) AS split, count(*) AS seen FROM x GROUP BY 1)",
    "c AS (SELECT locus, max(k) AS clip_max FROM (SELECT locus, end0, count(*) AS k FROM x WHERE ok AND clip >= 10 GROUP BY 1, 2) GROUP BY 1)",
    "b AS (SELECT l.locus, coalesce(n_reads, 0) AS n_reads, coalesce(n_low, 0) AS n_low, a.* EXCLUDE (locus, n_reads, n_low, clips), nullif(clips, 0) AS clips, clip_max, n_reads - n_low AS total FROM l LEFT JOIN a USING (locus) LEFT JOIN c USING (locus))",
    "f AS (SELECT * REPLACE (CASE WHEN n_reads > 0 THEN discordant END AS discordant, CASE WHEN n_reads > 0 THEN split END AS split), CASE WHEN total > 0 THEN CAST(discordant AS DOUBLE)/total WHEN n_low > 0 THEN 0.0 END AS fd, CASE WHEN total > 0 THEN CAST(split AS DOUBLE)/total WHEN n_low > 0 THEN 0.0 END AS fs FROM b)",
    "s AS (SELECT *, CASE WHEN fd IS NULL THEN NULL WHEN fd >= 0.5 THEN 25.0 WHEN fd >= 0.2 THEN 15.0 WHEN fd > 0 AND discordant >= 2 THEN 7.5 ELSE 0.0 END AS s_discordant, CASE WHEN seen > 0 THEN CASE WHEN clip_max >= 10 THEN 25.0 WHEN clip_max >= 3 THEN 15.0 ELSE 0.0 END END AS s_clip, CASE WHEN fs IS NULL THEN NULL WHEN fs >= 0.3 THEN 25.0 WHEN fs >= 0.1 THEN 15.0 WHEN fs > 0 AND split >= 2 THEN 7.5 ELSE 0.0 END AS s_split FROM f)",
    "j AS (SELECT *, (s_discordant IS NOT NULL)::INT + (s_clip IS NOT NULL)::INT + (s_split IS NOT NULL)::INT AS judged, (coalesce(s_discordant,0) > 0)::INT + (coalesce(s_clip,0) > 0)::INT + (coalesce(s_split,0) > 0)::INT AS hit FROM s)",
    "k AS (SELECT *, CASE WHEN judged > 0 THEN round(CAST((coalesce(s_discordant,0)+coalesce(s_clip,0)+coalesce(s_split,0)) * 100.0 AS DOUBLE) / (25 * judged), 1) END AS total_score, CAST(n_low AS DOUBLE)/nullif(n_reads, 0) > 0.4 AS gated FROM j)",
) + (
    "SELECT locus, n_reads, n_low, discordant, clips, clip_max, split, CAST(s_discordant AS DOUBLE) AS s_discordant, CAST(s_clip AS DOUBLE) AS s_clip, CAST(s_split AS DOUBLE) AS s_split, CASE WHEN NOT coalesce(gated, false) THEN total_score END AS score, "
    "CASE WHEN total_score IS NULL THEN 'NOT ASSESSABLE' WHEN gated THEN 'QUALITY-LIMITED' WHEN total_score >= 70 THEN 'strong' WHEN total_score >= 40 THEN 'moderate' WHEN total_score > 0 THEN 'weak' ELSE 'none' END AS strength, hit || '/' || judged AS signal, "
    "coalesce(NOT coalesce(gated, false) AND total_score = 0 AND n_reads > 0, false) AS said FROM k"
)


def joined_ends(spark: SparkSession, d: str) -> DataFrame:
    """Junctions between places 250 bases apart or on two contigs, at every 50th order."""
    o = t(spark, d, "orders").where(F.col("o_orderkey") % 50 == 0)
    c = lambda k: F.concat(F.lit("chr"), (k % 3 + 1).cast("string"))
    return o.select(F.col("o_orderkey").cast("long").alias("id"), c(F.col("o_orderkey")).alias("ca"), (F.col("o_orderkey") + 1).cast("long").alias("pa"), c(F.col("o_custkey")).alias("cb"), (F.col("o_orderkey") + 251).cast("long").alias("pb"))


_ENDS = "jn AS (SELECT CAST(o_orderkey AS BIGINT) AS id, 'chr' || (o_orderkey % 3 + 1) AS ca, CAST(o_orderkey AS BIGINT) AS pa, 'chr' || (o_custkey % 3 + 1) AS cb, CAST(o_orderkey + 250 AS BIGINT) AS pb FROM orders WHERE o_orderkey % 50 = 0), en AS (SELECT id, 'A' AS \"end\", ca AS e_c, pa AS e_p, cb AS p_c, pb AS p_p FROM jn UNION ALL SELECT id, 'B', cb, pb, ca, pa FROM jn)"
_SEEN = [
    RECORDS, _ENDS,
    'w AS (SELECT en.*, r.*, e_c = p_c AS intra, mapq < 20 AS low, sa_chrom = p_c AND (abs(sa_pos - 1 - p_p) <= 100 OR abs(sa_pos + 38 - p_p) <= 100) AS near_sa FROM en JOIN r ON r.contig = e_c AND r.pos0 < e_p + 100 AND r.end0 > greatest(0, e_p - 100) WHERE NOT dup)',
    "u AS (SELECT *, NOT intra OR abs((pos0+end0-1)//2 - e_p) - abs((pos0+end0-1)//2 - p_p) < abs((2*sa_pos+37)//2 - e_p) - abs((2*sa_pos+37)//2 - p_p) AS s_mine, NOT intra OR abs(pos0 - e_p) - abs(pos0 - p_p) < abs(mate_pos0 - e_p) - abs(mate_pos0 - p_p) AS p_mine, "
    "CASE WHEN coalesce(near_sa, false) THEN 'split_partner' WHEN sa_chrom IS NOT NULL THEN 'split_other' END AS ks, "
    "CASE WHEN supp THEN NULL WHEN mate_un THEN 'mate_unmapped' WHEN mate_contig = p_c AND abs(mate_pos0 - p_p) <= 100 AND NOT (intra AND proper) THEN 'pair_partner' WHEN mate_contig <> contig THEN 'pair_other_chrom' WHEN proper THEN NULL WHEN rev = mrev THEN 'pair_orientation' WHEN CASE WHEN pos0 <= mate_pos0 THEN rev ELSE NOT rev END THEN 'pair_orientation' ELSE 'pair_insert_size' END AS kp FROM w)",
    "v AS (SELECT *, CASE WHEN ks = 'split_other' AND kp = 'pair_partner' THEN kp WHEN ks IS NOT NULL THEN ks WHEN kp IS NOT NULL THEN kp WHEN clip >= 10 THEN 'clipped' WHEN low THEN 'ambiguous' END AS kind, coalesce(ks = 'split_partner' AND s_mine AND NOT low AND sa_mapq >= 20, false) AS is_split, coalesce(kp = 'pair_partner' AND p_mine AND NOT low, false) AS is_pair FROM u)",
]


def q_end_kinds(spark: SparkSession, d: str) -> DataFrame:
    x = junctions.end_counts(junctions.review(records(spark, d), joined_ends(spark, d), 100))
    return x.select("id", "end", "primary_reads", "low_mapq_reads", "normal_reads", *[F.element_at("by_kind", F.lit(k)).alias(k) for k in junctions.KINDS])


SQL_END_KINDS = V.with_(*_SEEN) + "SELECT id, \"end\", count(*) FILTER (NOT supp) AS primary_reads, count(*) FILTER (NOT supp AND low) AS low_mapq_reads, count(*) FILTER (kind IS NULL) AS normal_reads, " + ", ".join(f"count(*) FILTER (kind = '{k}') AS {k}" for k in junctions.KINDS) + ' FROM v GROUP BY 1, 2'


def q_end_view(spark: SparkSession, d: str) -> DataFrame:
    """How many records of an end a drawing of three shows, and how many of them join the ends."""
    x = junctions.view(junctions.review(records(spark, d), joined_ends(spark, d), 100), 3)
    return x.groupBy("id", "end").agg(F.count("*").alias("shown"), F.count_if(F.col("kind").isin("split_partner", "pair_partner")).alias("joining"))


SQL_END_VIEW = V.with_(*_SEEN) + "SELECT id, \"end\", least(3, count(*)) AS shown, least(3, count(*) FILTER (kind IN ('split_partner', 'pair_partner'))) AS joining FROM v WHERE kind IS NOT NULL GROUP BY 1, 2"


def q_both_end_support(spark: SparkSession, d: str) -> DataFrame:
    return junctions.support(junctions.review(records(spark, d), joined_ends(spark, d), 100))


_PIECE = "CASE WHEN abs({1} - {2}) <= abs({0} - {2}) THEN '3' ELSE '5' END"
_S_MINE = _PIECE.format("pos0", "end0 - 1", "e_p"), _PIECE.format("sa_pos - 1", "sa_pos + 38", "p_p")
_P_SIDES = "CASE WHEN rev THEN '5' ELSE '3' END", "CASE WHEN mrev THEN '5' ELSE '3' END"
SQL_SUPPORT = V.with_(
    *_SEEN,
    f"""y AS (SELECT id, "end", qname, 'pair' AS kind, CASE WHEN "end" = 'A' THEN {_P_SIDES[0]} || 'to' || {_P_SIDES[1]} ELSE {_P_SIDES[1]} || 'to' || {_P_SIDES[0]} END AS o FROM v WHERE is_pair
 UNION ALL SELECT id, "end", qname, 'split', CASE WHEN "end" = 'A' THEN {_S_MINE[0]} || 'to' || {_S_MINE[1]} ELSE {_S_MINE[1]} || 'to' || {_S_MINE[0]} END FROM v WHERE is_split)""",
    """z AS (SELECT id, kind, qname, min(struct_pack(e := "end", o := o)).o AS orientation, count(*) FILTER ("end" = 'A') AS a, count(*) FILTER ("end" = 'B') AS b FROM y GROUP BY 1, 2, 3)""",
) + "SELECT id, orientation, count(*) FILTER (kind = 'pair') AS pairs, count(*) FILTER (kind = 'split') AS splits, count(DISTINCT qname) AS fragments FROM z WHERE kind = 'split' OR (a > 0 AND b > 0) GROUP BY 1, 2"


def q_evidence_tags(spark: SparkSession, d: str) -> DataFrame:
    """Records coloured and labelled by their mate's contig, as lines of SAM, counted by label."""
    own = records(spark, d).withColumns({"tlen": F.lit(0), "seq": F.lit("*"), "qual": F.lit("*")})
    far = F.col("mate_contig") != F.col("contig")
    tagged = sinks.tagged(own, F.when(far, "200,0,0").otherwise("0,0,200"), F.when(far, F.concat(F.lit("mate on "), "mate_contig")).when(F.col("mate_contig").isNull(), "no mate").otherwise("near"))
    x = sinks.sam_lines(tagged).withColumn("label", F.regexp_extract("value", "XG:Z:([^\t]*)", 1))
    return x.groupBy("label").agg(F.count("*").alias("n"), F.count_if(F.col("value").contains("YC:Z:200,0,0")).alias("red"), F.sum(F.size(F.split("value", "\t"))).cast("long").alias("fields"))


SQL_TAGS = V.with_(RECORDS) + (
    "SELECT CASE WHEN mate_contig <> contig THEN 'mate on ' || mate_contig WHEN mate_contig IS NULL THEN 'no mate' ELSE 'near' END AS label, count(*) AS n, count(*) FILTER (mate_contig <> contig) AS red, CAST(sum(13 + (sa_chrom IS NOT NULL)::INT) AS BIGINT) AS fields FROM r GROUP BY 1"
)


def q_region_slice(spark: SparkSession, d: str) -> DataFrame:
    regions = V.loci(spark, d).select(F.concat(F.lit("chr"), (F.col("locus") % 3 + 1).cast("string")).alias("contig"), F.col("centre").alias("pos"))
    return sinks.region_slice(records(spark, d), regions, 30).groupBy("contig").agg(F.count("*").alias("n"), F.sum("file_ord").alias("checksum"))


SQL_SLICE = V.with_(RECORDS, V.LOCI, "s AS (SELECT 'chr' || (locus % 3 + 1) AS contig, centre AS pos FROM loci)") + (
    "SELECT contig, count(*) AS n, CAST(sum(file_ord) AS BIGINT) AS checksum FROM r WHERE file_ord IN (SELECT file_ord FROM r x JOIN s ON s.contig = x.contig AND x.pos0 < s.pos + 30 AND x.end0 > greatest(0, s.pos - 30)) GROUP BY 1"
)


def q_layers_of(spark: SparkSession, d: str) -> DataFrame:
    aligners = F.array(*[F.lit(a) for a in ("bwa-mem", "bowtie2", "minimap2")])
    x = t(spark, d, "customer").select("c_custkey", reads.layers_of(F.when(F.col("c_nationkey") % 2 == 0, "illumina").when(F.col("c_nationkey") % 5 == 0, "ont_nanopore"), F.get(aligners, (F.col("c_custkey") % 4).cast("int")), F.col("c_custkey") % 3 == 0).alias("l"))
    return x.select("c_custkey", F.array_join("l", "+").alias("layers"))


SQL_LAYERS_OF = "SELECT c_custkey, 'clip+depth' || CASE WHEN c_custkey % 3 = 0 THEN '+discordant' ELSE '' END || CASE WHEN c_custkey % 4 IN (0, 2) OR (c_nationkey % 2 = 1 AND c_nationkey % 5 = 0) THEN '+split' ELSE '' END AS layers FROM customer"


def q_genome_order(spark: SparkSession, d: str) -> DataFrame:
    j = V.junctions(spark, d)
    names = F.array(*[F.lit(n) for n in ("chr2", "chr10", "chrX", "chrM", "chr1")])
    pick = lambda k: F.get(names, (k % 5).cast("int"))
    x = j.select("id", C.genome_order(pick(F.col("id")), F.col("pos1"), pick(F.col("pos2")), F.col("pos2"), F.col("orientation")).alias("g"))
    return x.select("id", "g.*")


SQL_ORDER = V.with_(
    V.JUNCTIONS,
    "n AS (SELECT id, ['chr2','chr10','chrX','chrM','chr1'][1 + id % 5] AS c1, [2,10,23,25,1][1 + id % 5] AS r1, pos1, ['chr2','chr10','chrX','chrM','chr1'][1 + pos2 % 5] AS c2, [2,10,23,25,1][1 + pos2 % 5] AS r2, pos2, orientation AS o FROM junctions)",
    "m AS (SELECT *, r1 > r2 OR (r1 = r2 AND pos1 > pos2) AS swap FROM n)",
) + "SELECT id, CASE WHEN swap THEN c2 ELSE c1 END AS ca, CASE WHEN swap THEN pos2 ELSE pos1 END AS pa, CASE WHEN swap THEN c1 ELSE c2 END AS cb, CASE WHEN swap THEN pos1 ELSE pos2 END AS pb, CASE WHEN swap THEN CASE o WHEN '3to5' THEN '5to3' WHEN '5to3' THEN '3to5' ELSE o END ELSE o END AS orientation FROM m"


def q_contig_statistics(spark: SparkSession, d: str) -> DataFrame:
    """Every 9th line counts as unmapped at its mate's place, every 27th as placed nowhere."""
    k = F.col("file_ord") % 27
    own = records(spark, d).withColumns({"flag": F.when(k % 9 == 0, F.col("flag") + 4).otherwise(F.col("flag")), "contig": F.when(k != 0, F.col("contig"))})
    return reads.contig_statistics(own, contigs(spark))


SQL_CONTIGS = V.with_(RECORDS, "n AS (SELECT CASE WHEN file_ord % 27 = 0 THEN '*' ELSE contig END AS name, count(*) FILTER (file_ord % 9 <> 0) AS mapped, count(*) FILTER (file_ord % 9 = 0) AS unmapped FROM r GROUP BY 1)") + (
    "SELECT c.name, c.length, coalesce(mapped, 0) AS mapped, coalesce(unmapped, 0) AS unmapped FROM (VALUES ('chr1', 500000::BIGINT), ('chr2', 400000), ('chr3', 300000), ('*', 0)) c(name, length) LEFT JOIN n USING (name)"
)


def q_summary_rows(spark: SparkSession, d: str) -> DataFrame:
    j = V.junctions(spark, d)
    place = lambda c, p, w: F.struct(F.col(c).alias("chromosome"), F.col(p).alias("start"), (F.col(p) + w).alias("end"))
    genes = F.when(F.col("id") % 3 == 0, F.array(F.lit("G1"), F.lit("G2"))).when(F.col("id") % 3 == 1, F.array().cast("array<string>"))
    cautions = F.when(F.col("id") % 4 == 0, F.array(F.lit("low"), F.lit("far")))
    x = events.summary_row(F.col("id"), F.col("orientation"), F.array(place("chrom1", "pos1", 0), place("chrom2", "pos2", F.col("id") % 2)), F.col("callset"), F.coalesce("pe", F.lit(0)), F.coalesce("sr", F.lit(0)), F.coalesce("pe", F.lit(0)) + F.coalesce("sr", F.lit(0)), genes, cautions)
    return j.select("id", x.alias("line"))


_N = "format('{{:,}}', {0})"
_WORDS = "CASE WHEN coalesce({0}, 0) = 1 THEN '1 {1}' ELSE coalesce({0}, 0) || ' {1}s' END"
SQL_ROWS = V.with_(V.JUNCTIONS) + (
    f"SELECT id, id || '. ' || orientation || ' ' || chrom1 || ':' || {_N.format('pos1')} || ' ↔ ' || chrom2 || ':' || {_N.format('pos2')} || CASE WHEN id % 2 = 1 THEN '–' || {_N.format('pos2 + 1')} ELSE '' END || ' - ' || callset || '; ' || "
    f"{_WORDS.format('pe', 'read pair')} || ', ' || {_WORDS.format('sr', 'split read')} || ' (' || {_WORDS.format('(pe + sr)', 'read')} || '); ' || CASE id % 3 WHEN 0 THEN 'breaks G1, G2' WHEN 1 THEN 'no gene at the breakpoints' ELSE 'genes not looked up (no local gene table)' END || CASE WHEN id % 4 = 0 THEN '; cautions: low; far' ELSE '' END AS line FROM junctions"
)


def q_report_flags(spark: SparkSession, d: str) -> DataFrame:
    """Reports written from orders: phrases, claims of a gene's function, and sizes that positions support or not."""
    o, k = t(spark, d, "orders"), F.col("o_orderkey")
    a, b = k * 100, k * 100 + F.floor(F.col("o_totalprice") % 5000).cast("long")
    said = F.concat(F.lit("It spans "), F.format_number(F.when(k % 2 == 0, b - a).otherwise(b - a + 4000), 0), F.lit(" bp"), F.when(k % 3 == 0, ", and the gene has a known function").when(k % 5 == 0, ", as the Ground Truth has it").otherwise(""))
    flags = T.unlooked_claims(said, F.when(k % 6 == 0, F.array(F.lit("gene_at_locus"))).otherwise(F.array(F.lit("depth"))), ["ground truth"])
    return o.select("o_orderkey", F.array_join(flags, ",").alias("flags"), F.size(T.unsupported_sizes(said, F.array(a, b))).cast("long").alias("sizes"))


SQL_FLAGGED = """WITH x AS (SELECT o_orderkey AS k, CAST(floor(o_totalprice % 5000) AS BIGINT) AS w FROM orders), y AS (SELECT k, w, CAST(CASE WHEN k % 2 = 0 THEN w ELSE w + 4000 END AS DOUBLE) AS s FROM x)
SELECT k AS o_orderkey, CASE WHEN k % 3 = 0 THEN CASE WHEN k % 6 = 0 THEN '' ELSE 'gene function' END WHEN k % 5 = 0 THEN 'provenance' ELSE '' END AS flags, CAST(CASE WHEN w > 0 AND abs(w - s) <= greatest(2.0, 0.02 * s) THEN 0 ELSE 1 END AS BIGINT) AS sizes FROM y"""


def q_handles(spark: SparkSession, d: str) -> DataFrame:
    c = t(spark, d, "customer").select("c_custkey", F.struct(F.concat(F.lit("/data/"), "c_name").alias("path"), F.col("c_nationkey").alias("n")).alias("r"))
    return T.without_paths(c, "r", ["path"]).select("c_custkey", "r.n", "r.path_handle")


SQL_HANDLES = "SELECT c_custkey, c_nationkey AS n, substr(sha256('/data/' || c_name), 1, 12) AS path_handle FROM customer"


QUERIES = {
    "q_contig_statistics": (q_contig_statistics, SQL_CONTIGS),
    "q_summary_rows": (q_summary_rows, SQL_ROWS),
    "q_report_flags": (q_report_flags, SQL_FLAGGED),
    "q_handles": (q_handles, SQL_HANDLES),
    "q_flag_statistics": (q_flag_statistics, SQL_FLAGS),
    "q_far_pairs": (q_far_pairs, SQL_FAR),
    "q_realigned": (q_realigned, SQL_REALIGNED),
    "q_point_depth": (q_point_depth, SQL_POINT),
    "q_region_errors": (q_region_errors, SQL_REGIONS),
    "q_locus_layers": (q_locus_layers, SQL_LAYERS),
    "q_end_kinds": (q_end_kinds, SQL_END_KINDS),
    "q_end_view": (q_end_view, SQL_END_VIEW),
    "q_both_end_support": (q_both_end_support, SQL_SUPPORT),
    "q_evidence_tags": (q_evidence_tags, SQL_TAGS),
    "q_region_slice": (q_region_slice, SQL_SLICE),
    "q_layers_of": (q_layers_of, SQL_LAYERS_OF),
    "q_genome_order": (q_genome_order, SQL_ORDER),
}
