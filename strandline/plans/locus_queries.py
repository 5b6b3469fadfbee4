"""Driver queries of the locus operators, with their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import rules as R
from ..joins import band_join, interval_join, nearest
from ..operators import locus as L
from . import views as V

H = V.HALF


def at(spark: SparkSession, d: str) -> DataFrame:
    return L.reads_at(V.reads(spark, d), V.loci(spark, d), ("contig", "l_contig"), H)


_BASE = [V.READS, V.LOCI, V.OVERLAPS]


def q_locus_stats(spark: SparkSession, d: str) -> DataFrame:
    return L.statistics(at(spark, d), H, 20)


_INSIDE = f"least(end0, centre+{H}) - greatest(pos0, centre-{H})"
SQL_STATS = V.with_(*_BASE) + (
    f"SELECT locus, count(*) AS n_reads, CAST(sum({_INSIDE}) AS BIGINT) AS covered, CAST(sum({_INSIDE}) AS DOUBLE) / {2 * H} AS mean_depth, CAST(sum(mapq) AS DOUBLE) / count(*) AS mean_mapq, "
    "CAST(count(*) FILTER (mapq < 20) AS DOUBLE) / count(*) AS low_fraction, count(*) FILTER (strand = 0) AS forward, count(*) FILTER (strand <> 0) AS reverse FROM seen_at GROUP BY 1"
)


def other() -> Column:
    return F.col("mate_contig") == "O"


def q_discordance(spark: SparkSession, d: str) -> DataFrame:
    return L.discordance(at(spark, d), 20, other())


SQL_DISCORDANCE = V.with_(*_BASE) + (
    "SELECT locus, count(*) FILTER (mapq >= 20) AS total, count(*) FILTER (mapq >= 20 AND mate_contig = 'O') AS discordant, count(*) FILTER (mapq < 20) AS below_mapq, "
    "CASE WHEN count(*) FILTER (mapq >= 20) > 0 THEN CAST(count(*) FILTER (mapq >= 20 AND mate_contig = 'O') AS DOUBLE) / count(*) FILTER (mapq >= 20) WHEN count(*) FILTER (mapq < 20) > 0 THEN 0.0 END AS fraction FROM seen_at GROUP BY 1"
)


def q_partner_distribution(spark: SparkSession, d: str) -> DataFrame:
    p = L.partners(at(spark, d), F.col("mapq") >= 20, F.concat(F.lit("c"), (F.col("supp") % 4).cast("string")))
    g = p.groupBy("locus").agg(F.count("*").alias("kinds"), F.max(F.when(F.col("rank") == 1, F.struct("partner", "n", "share"))).alias("t"), F.array_join(F.array_sort(F.collect_list(F.struct("rank", F.concat_ws(":", "partner", F.col("n"))))).getField("col2"), ",").alias("partners"))
    return g.select("locus", "kinds", "partners", L.partner_sentence(F.col("t.partner"), F.col("t.n"), F.col("t.share"), F.col("kinds")).alias("sentence"))


SQL_PARTNERS = V.with_(
    *_BASE,
    "p AS (SELECT locus, 'c' || (supp % 4) AS partner, count(*) AS n FROM seen_at WHERE mapq >= 20 GROUP BY 1, 2)",
    "k AS (SELECT *, CAST(n AS DOUBLE) / sum(n) OVER (PARTITION BY locus) AS share, row_number() OVER (PARTITION BY locus ORDER BY n DESC, partner) AS rk, count(*) OVER (PARTITION BY locus) AS kinds FROM p)",
) + (
    "SELECT locus, any_value(kinds) AS kinds, string_agg(partner || ':' || n, ',' ORDER BY rk) AS partners, max(CASE WHEN rk = 1 THEN CASE WHEN kinds = 1 THEN CASE WHEN n = 1 THEN 'single read to ' || partner ELSE 'all ' || n || ' reads to ' || partner END "
    "WHEN n >= 3 AND share >= 0.6 THEN 'predominantly ' || partner || ' (' || n || ' reads)' ELSE 'scattered' END END) AS sentence FROM k GROUP BY 1"
)


def left() -> Column:
    return F.col("rid") % 3 == 0


def q_pileup_consensus(spark: SparkSession, d: str) -> DataFrame:
    """Reads of every third id are clipped on the left (at pos0), the others on the right (at end0)."""
    side, pos = F.when(left(), "left").otherwise("right"), F.when(left(), F.col("pos0")).otherwise(F.col("end0"))
    return L.pile(at(spark, d), side, pos, F.col("rid"))


SQL_PILE = V.with_(*_BASE, "s AS (SELECT locus, CASE WHEN rid % 3 = 0 THEN 'left' ELSE 'right' END AS side, CASE WHEN rid % 3 = 0 THEN pos0 ELSE end0 END AS pos, rid FROM seen_at)", "g AS (SELECT locus, side, pos, count(*) AS n, min(rid) AS tie FROM s GROUP BY 1, 2, 3)") + (
    "SELECT locus, side, CAST(sum(n) AS BIGINT) AS n_side, max(CASE WHEN rk = 1 THEN pos END) AS consensus, max(n) AS n_consensus FROM (SELECT *, row_number() OVER (PARTITION BY locus, side ORDER BY n DESC, tie) AS rk FROM g) GROUP BY 1, 2"
)

W0 = 16


def bins(spark: SparkSession, d: str) -> DataFrame:
    return L.depth_bins(V.reads(spark, d), V.loci(spark, d), ("contig", "l_contig"), H, W0)


_BINS = f"""b AS (SELECT locus, l_contig, centre, CAST(k AS BIGINT) AS bin, CAST(centre-{H}+k*{W0} AS BIGINT) AS bin_start, CAST(least(centre-{H}+(k+1)*{W0}, centre+{H}) AS BIGINT) AS bin_end FROM loci, range(0, {-(-2 * H // W0)}) t(k)),
 c AS (SELECT b.locus, b.bin, sum(least(o.end0, bin_end) - greatest(o.pos0, bin_start)) AS covered FROM b JOIN seen_at o ON o.locus = b.locus AND o.pos0 < b.bin_end AND o.end0 > b.bin_start GROUP BY 1, 2),
 d AS (SELECT b.locus, b.centre, b.bin, bin_start, bin_end, CAST(coalesce(covered, 0) AS BIGINT) AS covered FROM b LEFT JOIN c ON b.locus = c.locus AND b.bin = c.bin)"""


def q_depth_bins(spark: SparkSession, d: str) -> DataFrame:
    return bins(spark, d).select("locus", "bin", "bin_start", "bin_end", "covered")


SQL_BINS = V.with_(*_BASE, _BINS) + "SELECT locus, bin, bin_start, bin_end, covered FROM d"


def q_depth_dip_focus(spark: SparkSession, d: str) -> DataFrame:
    o = L.depth_dip(bins(spark, d), 20)
    return o.select("locus", "n_bins", F.round("min_depth", 6).alias("min_depth"), F.round("ratio", 4).alias("ratio"), "dip", "distance", "at_focus", "likely_deletion")


_DIP = f"""e AS (SELECT *, CAST(covered AS DOUBLE) / (bin_end-bin_start) AS depth FROM d), m AS (SELECT locus, any_value(centre) AS centre, count(*) AS n_bins, min(depth) AS min_depth, sum(depth)/count(*) AS mean_depth FROM e GROUP BY 1),
 f AS (SELECT locus, (bin_start+bin_end)//2 AS dip FROM e QUALIFY row_number() OVER (PARTITION BY locus ORDER BY depth, bin) = 1), dd AS (SELECT m.*, dip, abs(dip-centre) AS distance, CASE WHEN mean_depth > 0 THEN min_depth/mean_depth END AS ratio FROM m JOIN f USING (locus))"""
SQL_DIP = V.with_(*_BASE, _BINS, _DIP) + "SELECT locus, n_bins, round(min_depth, 6) AS min_depth, round(ratio, 4) AS ratio, dip, distance, distance <= 20 AS at_focus, ratio < 0.7 AS likely_deletion FROM dd"


def supp() -> Column:
    return F.col("supp") % 5 == 0


def clip() -> Column:
    return F.col("rid") % 7 == 0


def evidence(spark: SparkSession, d: str) -> DataFrame:
    """All layers of a locus in one aggregate over one join, with scores, total and words."""
    good = F.col("mapq") >= 20
    parts = {"n": F.count("*"), "total": F.count_if(good), "discordant": F.count_if(good & other()), "split": F.count_if(good & supp()), "low": F.count_if(F.col("mapq") < 20)}
    # Counts by position first, so that the highest pile of clips comes out of the same join as the sums.
    piles = at(spark, d).groupBy("locus", "pos0").agg(*[v.alias(k) for k, v in parts.items()], F.count_if(clip()).alias("k"))
    x = piles.groupBy("locus").agg(*[F.sum(k).cast("long").alias(k) for k in parts], F.max("k").alias("clip_max"))
    need = R.minimum_support(F.lit(H))
    x = x.withColumns(
        {
            "s_discordant": R.ladder("discordant", L.fraction(F.col("discordant"), F.col("total"), F.col("low")), F.col("discordant"), need),
            "s_clip": R.ladder("clip", F.col("clip_max").cast("double")),
            "s_split": R.ladder("split", L.fraction(F.col("split"), F.col("total"), F.col("low")), F.col("split"), need),
        }
    )
    return x.withColumn("score", F.round(R.normalised([F.col("s_discordant"), F.col("s_clip"), F.col("s_split")]), 4))


_LADDER = {
    "discordant": "CASE WHEN fd IS NULL THEN NULL WHEN fd >= 0.5 THEN 25.0 WHEN fd >= 0.2 THEN 15.0 WHEN fd > 0 AND discordant >= 2 THEN 7.5 ELSE 0.0 END",
    "clip": "CASE WHEN clip_max >= 10 THEN 25.0 WHEN clip_max >= 3 THEN 15.0 ELSE 0.0 END",
    "split": "CASE WHEN fs IS NULL THEN NULL WHEN fs >= 0.3 THEN 25.0 WHEN fs >= 0.1 THEN 15.0 WHEN fs > 0 AND split >= 2 THEN 7.5 ELSE 0.0 END",
}
_EVIDENCE = [
    *_BASE,
    "ea AS (SELECT locus, count(*) AS n, count(*) FILTER (mapq>=20) AS total, count(*) FILTER (mapq>=20 AND mate_contig='O') AS discordant, count(*) FILTER (mapq>=20 AND supp%5=0) AS split, count(*) FILTER (mapq<20) AS low FROM seen_at GROUP BY 1)",
    "ec AS (SELECT locus, max(k) AS clip_max FROM (SELECT locus, pos0, count(*) AS k FROM seen_at WHERE rid % 7 = 0 GROUP BY 1, 2) GROUP BY 1)",
    "ex AS (SELECT ea.*, coalesce(clip_max, 0) AS clip_max, CASE WHEN total > 0 THEN CAST(discordant AS DOUBLE)/total WHEN low > 0 THEN 0.0 END AS fd, CASE WHEN total > 0 THEN CAST(split AS DOUBLE)/total WHEN low > 0 THEN 0.0 END AS fs FROM ea LEFT JOIN ec USING (locus))",
    f"es AS (SELECT *, CAST({_LADDER['discordant']} AS DOUBLE) AS s_discordant, CAST({_LADDER['clip']} AS DOUBLE) AS s_clip, CAST({_LADDER['split']} AS DOUBLE) AS s_split FROM ex)",
    "et AS (SELECT *, round((coalesce(s_discordant,0)+coalesce(s_clip,0)+coalesce(s_split,0))*100.0/(CASE WHEN s_discordant IS NULL THEN 0 ELSE 25 END + 25 + CASE WHEN s_split IS NULL THEN 0 ELSE 25 END), 4) AS score FROM es)",
]


def q_locus_evidence(spark: SparkSession, d: str) -> DataFrame:
    x = evidence(spark, d)
    return x.select("locus", "n", "discordant", "split", "clip_max", "s_discordant", "s_clip", "s_split", "score", R.band(F.col("score"), F.col("low") / F.col("n")).alias("strength"))


SQL_EVIDENCE = V.with_(*_EVIDENCE) + (
    "SELECT locus, n, discordant, split, clip_max, s_discordant, s_clip, s_split, score, CASE WHEN score IS NULL THEN 'NOT ASSESSABLE' WHEN CAST(low AS DOUBLE)/n > 0.4 THEN 'QUALITY-LIMITED' WHEN score >= 70 THEN 'strong' WHEN score >= 40 THEN 'moderate' WHEN score > 0 THEN 'weak' ELSE 'none' END AS strength FROM et"
)


def q_attainable_ceiling(spark: SparkSession, d: str) -> DataFrame:
    x = evidence(spark, d)
    top = R.ceiling({"discordant": F.col("s_discordant"), "clip": F.col("s_clip"), "split": F.col("s_split")})
    return x.select("locus", "score", F.round(top, 4).alias("ceiling"), R.band(F.round(top, 4)).alias("reachable"))


_CEIL = "round((coalesce(s_discordant,0)+25+CASE WHEN s_split IS NULL THEN 0 ELSE 25 END)*100.0/(CASE WHEN s_discordant IS NULL THEN 0 ELSE 25 END + 25 + CASE WHEN s_split IS NULL THEN 0 ELSE 25 END), 4)"
SQL_CEILING = V.with_(*_EVIDENCE, f"ce AS (SELECT locus, score, {_CEIL} AS ceiling FROM et)") + (
    "SELECT locus, score, ceiling, CASE WHEN ceiling >= 70 THEN 'strong' WHEN ceiling >= 40 THEN 'moderate' WHEN ceiling > 0 THEN 'weak' ELSE 'none' END AS reachable FROM ce"
)


def q_reciprocal_verdict(spark: SparkSession, d: str) -> DataFrame:
    """Ends of a junction: a locus and the one 100 after it."""
    g = at(spark, d).groupBy("locus").agg(F.count_if((F.col("mapq") >= 20) & other()).alias("n"), F.count_if(supp() & other()).alias("back"))
    b = g.select((F.col("locus") - 100).alias("locus"), F.col("n").alias("there"), F.col("back").alias("points"))
    x = g.join(b, "locus")
    return x.select("locus", F.col("n").alias("here"), "there", F.col("points").alias("back"), R.reciprocal(F.col("n"), F.col("there"), F.col("points")).alias("verdict"))


SQL_RECIPROCAL = V.with_(*_BASE, "g AS (SELECT locus, count(*) FILTER (mapq>=20 AND mate_contig='O') AS n, count(*) FILTER (supp%5=0 AND mate_contig='O') AS back FROM seen_at GROUP BY 1)") + (
    "SELECT a.locus, a.n AS here, b.n AS there, b.back, CASE WHEN a.n>=5 AND b.n>=5 AND b.back>=3 THEN 'RECIPROCAL' WHEN a.n>=5 AND b.n>=2 THEN 'ASYMMETRIC' WHEN a.n>=2 AND b.n>=2 THEN 'PARTIAL' WHEN a.n>=2 OR b.n>=2 THEN 'ONE-SIDED' ELSE 'INSUFFICIENT' END AS verdict FROM g a JOIN g b ON b.locus = a.locus + 100"
)


def q_end_support(spark: SparkSession, d: str) -> DataFrame:
    """Per pair of neighbouring loci: names seen at both ends, at one only, and distinct names of any kind."""
    n = at(spark, d).where("mapq >= 20").groupBy("locus", "supp").agg(F.min("rid").alias("rid"))
    a = n.select("locus", F.col("supp").alias("name"), F.lit(1).alias("a"))
    b = n.select((F.col("locus") - 100).alias("locus"), F.col("supp").alias("name"), F.lit(1).alias("b"))
    u = a.join(b, ["locus", "name"], "full_outer")
    return u.groupBy("locus").agg(F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("pairs"), F.count_if(F.col("a").isNull() | F.col("b").isNull()).alias("one_sided"), F.countDistinct("name").alias("fragments"))


SQL_END = V.with_(*_BASE, "n AS (SELECT DISTINCT locus, supp AS name FROM seen_at WHERE mapq >= 20)", "u AS (SELECT coalesce(a.locus, b.locus) AS locus, coalesce(a.name, b.name) AS name, a.name AS an, b.name AS bn FROM n a FULL JOIN (SELECT locus-100 AS locus, name FROM n) b ON a.locus=b.locus AND a.name=b.name)") + (
    "SELECT locus, count(*) FILTER (an IS NOT NULL AND bn IS NOT NULL) AS pairs, count(*) FILTER (an IS NULL OR bn IS NULL) AS one_sided, count(DISTINCT name) AS fragments FROM u GROUP BY 1"
)


def points(spark: SparkSession, d: str) -> DataFrame:
    return V.reads(spark, d).select("rid", F.col("supp").alias("k"), (F.col("pos0") % 20000).alias("p"))


def q_mask_antijoin(spark: SparkSession, d: str) -> DataFrame:
    """Reads whose start lies in no interval of a size above 40 (the mask), counted by contig."""
    mask = V.intervals(spark, d).where("g_size > 40")
    r = V.reads(spark, d).select("rid", "contig", "pos0")
    kept = interval_join(r, mask.withColumn("one", F.lit(1)), [], (F.col("pos0"), F.col("pos0") + 1), (F.col("g_start"), F.col("g_end")), 256, "left_anti", (1, None))
    return kept.groupBy("contig").agg(F.count("*").alias("n"), F.sum("pos0").cast("long").alias("checksum"))


SQL_MASK = V.with_(V.READS, V.INTERVALS) + "SELECT contig, count(*) AS n, CAST(sum(pos0) AS BIGINT) AS checksum FROM reads r WHERE NOT EXISTS (SELECT 1 FROM intervals i WHERE g_size > 40 AND r.pos0 >= g_start AND r.pos0 < g_end) GROUP BY 1"


def q_interval_stab(spark: SparkSession, d: str) -> DataFrame:
    lo = V.loci(spark, d)
    x = interval_join(lo, V.intervals(spark, d), [], (F.col("centre"), F.col("centre") + 1), (F.col("g_start"), F.col("g_end") + 1), 256, longest=(1, None))
    return x.select("locus", "gene", (F.col("centre") - F.col("g_start")).alias("offset"))


SQL_STAB = V.with_(V.LOCI, V.INTERVALS) + "SELECT locus, gene, centre - g_start AS offset FROM loci JOIN intervals ON centre >= g_start AND centre <= g_end"


def q_interval_overlap(spark: SparkSession, d: str) -> DataFrame:
    lo = V.loci(spark, d)
    x = interval_join(lo, V.intervals(spark, d), [], (F.col("centre") - 200, F.col("centre") + 200), (F.col("g_start"), F.col("g_end")), 512, longest=(600, None))
    return x.groupBy("locus").agg(F.count("*").alias("genes"), F.sum("g_size").cast("long").alias("bases"), F.min("gene").alias("first"))


SQL_OVERLAP = V.with_(V.LOCI, V.INTERVALS) + "SELECT locus, count(*) AS genes, CAST(sum(g_size) AS BIGINT) AS bases, min(gene) AS first FROM loci JOIN intervals ON g_start < centre+200 AND g_end > centre-200 AND g_end > g_start GROUP BY 1"


def q_nearest_each_side(spark: SparkSession, d: str) -> DataFrame:
    return _each_side(V.loci(spark, d), V.intervals(spark, d).where("gene % 7 = 0"))


def q_nearest_each_side_whole(spark: SparkSession, d: str) -> DataFrame:
    return _each_side(V.loci(spark, d), V.intervals(spark, d))


def _each_side(lo: DataFrame, g: DataFrame) -> DataFrame:
    left = nearest(lo, "locus", g, [], F.col("centre"), F.col("g_end"), "left", 500, [F.col("g_start"), F.col("gene")], ["gene"])
    right = nearest(lo, "locus", g, [], F.col("centre"), F.col("g_start"), "right", 500, [F.col("g_start"), F.col("gene")], ["gene"])
    a = left.select("locus", F.col("gene").alias("left_gene"), F.col("distance").alias("left_distance"))
    b = right.select("locus", F.col("gene").alias("right_gene"), F.col("distance").alias("right_distance"))
    return lo.select("locus").join(a, "locus", "left").join(b, "locus", "left")


SQL_NEAREST = V.with_(V.LOCI, V.INTERVALS, "g AS (SELECT * FROM intervals WHERE gene % 7 = 0)") + (
    "SELECT locus, a.gene AS left_gene, a.dist AS left_distance, b.gene AS right_gene, b.dist AS right_distance FROM loci l "
    "LEFT JOIN (SELECT locus, gene, centre-g_end AS dist FROM loci JOIN g ON g_end < centre AND g_end >= centre-500 QUALIFY row_number() OVER (PARTITION BY locus ORDER BY centre-g_end, g_start, gene) = 1) a USING (locus) "
    "LEFT JOIN (SELECT locus, gene, g_start-centre AS dist FROM loci JOIN g ON g_start > centre AND g_start <= centre+500 QUALIFY row_number() OVER (PARTITION BY locus ORDER BY g_start-centre, g_start, gene) = 1) b USING (locus)"
)


SQL_NEAREST_WHOLE = SQL_NEAREST.replace(" WHERE gene % 7 = 0", "")


def q_band_of_position(spark: SparkSession, d: str) -> DataFrame:
    """Band of a position: start < position <= end; the bands are the parts' gaps of width 10 in their order."""
    bands = V.intervals(spark, d).select(F.col("g_start").alias("s"), (F.col("g_start") + 10).alias("e"), F.concat(F.lit("q"), F.col("gene").cast("string")).alias("band"), F.substring("g_type", 1, 5).alias("stain"))
    lo = V.loci(spark, d)
    x = interval_join(lo, bands, [], (F.col("centre") - 1, F.col("centre")), (F.col("s"), F.col("e")), 256, longest=(1, None))
    return x.select("locus", "band", "stain")


SQL_BAND = V.with_(V.LOCI, V.INTERVALS) + "SELECT locus, 'q' || gene AS band, substr(g_type, 1, 5) AS stain FROM loci JOIN intervals ON g_start < centre AND centre <= g_start + 10"


def q_canonical_choice(spark: SparkSession, d: str) -> DataFrame:
    """Of each brand the part of greatest size, then price, then least key, as the canonical transcript is chosen."""
    p = V.table(spark, d, "part")
    return p.groupBy("p_brand").agg(F.max_by("p_partkey", F.struct("p_size", "p_retailprice", -F.col("p_partkey"))).cast("long").alias("canonical"), F.count("*").alias("n"))


SQL_CANONICAL = "SELECT p_brand, CAST(first(p_partkey ORDER BY p_size DESC, p_retailprice DESC, p_partkey) AS BIGINT) AS canonical, count(*) AS n FROM part GROUP BY 1"


def q_segment_counts(spark: SparkSession, d: str) -> DataFrame:
    lo = V.loci(spark, d)
    x = interval_join(lo, V.intervals(spark, d), [], (F.col("centre") - 300, F.col("centre") + 300), (F.col("g_start"), F.col("g_end")), 512, longest=(600, None))
    coding = F.col("g_type").startswith("PROMO")
    first = F.array_join(F.transform(F.slice(F.array_sort(F.collect_list(F.struct((~coding).alias("x"), "g_start", "gene"))), 1, 5), lambda s: s["gene"].cast("string")), ",")
    return x.groupBy("locus").agg(F.count("*").alias("total"), F.count_if(coding).alias("coding"), F.count_if(F.col("g_size") > 25).alias("large"), first.alias("first_five"))


SQL_SEGMENT = V.with_(V.LOCI, V.INTERVALS, "s AS (SELECT locus, i.*, row_number() OVER (PARTITION BY locus ORDER BY NOT starts_with(g_type,'PROMO'), g_start, gene) AS rk FROM loci JOIN intervals i ON g_start < centre+300 AND g_end > centre-300 AND g_end > g_start)") + (
    "SELECT locus, count(*) AS total, count(*) FILTER (starts_with(g_type,'PROMO')) AS coding, count(*) FILTER (g_size > 25) AS large, string_agg(CAST(gene AS VARCHAR), ',' ORDER BY rk) FILTER (rk <= 5) AS first_five FROM s GROUP BY 1"
)


def q_band_join_points(spark: SparkSession, d: str) -> DataFrame:
    """Loci within 250 of each other on one contig, each unordered pair once."""
    lo = V.loci(spark, d).select("locus", "l_contig", "centre")
    other = lo.select(F.col("locus").alias("o"), F.col("l_contig").alias("o_contig"), F.col("centre").alias("o_centre"))
    x = band_join(lo, other, [("l_contig", "o_contig")], [("centre", "o_centre", 350)]).where("locus < o")
    return x.select("locus", "o", (F.col("o_centre") - F.col("centre")).alias("gap"))


SQL_POINTS = V.with_(V.LOCI) + "SELECT a.locus, b.locus AS o, b.centre - a.centre AS gap FROM loci a JOIN loci b ON a.l_contig = b.l_contig AND a.locus < b.locus AND b.centre - a.centre <= 350"

QUERIES = {
    "q_locus_evidence": (q_locus_evidence, SQL_EVIDENCE),
    "q_locus_stats": (q_locus_stats, SQL_STATS),
    "q_discordance": (q_discordance, SQL_DISCORDANCE),
    "q_partner_distribution": (q_partner_distribution, SQL_PARTNERS),
    "q_pileup_consensus": (q_pileup_consensus, SQL_PILE),
    "q_depth_bins": (q_depth_bins, SQL_BINS),
    "q_depth_dip_focus": (q_depth_dip_focus, SQL_DIP),
    "q_attainable_ceiling": (q_attainable_ceiling, SQL_CEILING),
    "q_reciprocal_verdict": (q_reciprocal_verdict, SQL_RECIPROCAL),
    "q_end_support": (q_end_support, SQL_END),
    "q_mask_antijoin": (q_mask_antijoin, SQL_MASK),
    "q_interval_stab": (q_interval_stab, SQL_STAB),
    "q_interval_overlap": (q_interval_overlap, SQL_OVERLAP),
    "q_nearest_each_side": (q_nearest_each_side, SQL_NEAREST),
    "q_nearest_each_side_whole": (q_nearest_each_side_whole, SQL_NEAREST_WHOLE),
    "q_band_of_position": (q_band_of_position, SQL_BAND),
    "q_canonical_choice": (q_canonical_choice, SQL_CANONICAL),
    "q_segment_counts": (q_segment_counts, SQL_SEGMENT),
    "q_band_join_points": (q_band_join_points, SQL_POINTS),
}
