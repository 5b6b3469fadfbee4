"""Driver queries of the call set operators, with their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.alignments import short_id
from ..operators import callsets as C
from ..operators.events import event_support, ranked, rearrangements, with_cautions
from . import views as V

NEED_PE, NEED_SR = 3, 10


def steps() -> C.Steps:
    pe, sr = F.coalesce("pe", F.lit(0)), F.coalesce("sr", F.lit(0))
    return [
        ("PASS", F.col("pass")),
        ("PE", pe >= NEED_PE),
        ("SR", sr >= NEED_SR),
        ("PRIMARY", F.col("chrom1").isin("1-URGENT", "2-HIGH", "3-MEDIUM")),
        ("UNMASKED", (F.col("pos1") % 100000) >= 20000),
    ]


_P = ["coalesce(pass, false)", f"coalesce(pe, 0) >= {NEED_PE}", f"coalesce(sr, 0) >= {NEED_SR}", "chrom1 IN ('1-URGENT', '2-HIGH', '3-MEDIUM')", "pos1 % 100000 >= 20000"]
_NAMES = ["PASS", "PE", "SR", "PRIMARY", "UNMASKED"]
_ALL = " AND ".join(_P)


def q_filter_funnel(spark: SparkSession, d: str) -> DataFrame:
    return C.funnel(V.junctions(spark, d), steps())


SQL_FUNNEL = V.with_(V.JUNCTIONS) + " UNION ALL ".join(
    f"SELECT CAST({i} AS BIGINT) AS ord, '{n}' AS step, count(*) FILTER ({' AND '.join(_P[: i + 1])}) AS survivors, count(*) FILTER (NOT ({_P[i]})) AS removed_alone, "
    f"count(*) FILTER ({' AND '.join([*_P[:i], f'NOT ({_P[i]})'])}) AS removed_here FROM junctions"
    for i, n in enumerate(_NAMES)
)


def exclude_template(spark: SparkSession, d: str) -> DataFrame:
    """A mask in the form of ``text_formats.mask``: intervals from 3 to 25,000 long on six contigs, and two whole contigs."""
    names = F.array(*[F.lit(x) for x in ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "F", "O")])
    g, size = F.col("gene"), F.col("g_size")
    contig = F.when(g == 1, "5-LOW").when(g == 2, "P").otherwise(F.get(names, (g % 6).cast("int")))
    return V.intervals(spark, d).select(contig.alias("contig"), (g * 700).alias("start"), (g * 700 + F.floor(size * size * size / 5) + 3).alias("end"), (g <= 2).alias("is_whole"))


def q_mask_both_ends(spark: SparkSession, d: str) -> DataFrame:
    """The funnel whose last step is the mask, at either end, over intervals and whole contigs."""
    calls = C.masked(V.junctions(spark, d), exclude_template(spark, d))
    return C.funnel(calls, [*steps()[:2], C.mask_step()])


_TEMPLATE = """template AS (SELECT CASE gene WHEN 1 THEN '5-LOW' WHEN 2 THEN 'P' ELSE ['1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED', 'F', 'O'][gene % 6 + 1] END AS contig, gene * 700 AS s, gene * 700 + g_size * g_size * g_size // 5 + 3 AS e, gene <= 2 AS whole FROM intervals)"""
_FREE = "NOT EXISTS (SELECT 1 FROM template WHERE (contig = chrom1 AND (whole OR (s <= pos1 AND pos1 < e))) OR (contig = chrom2 AND (whole OR (s <= pos2 AND pos2 < e))))"
_M = [*_P[:2], "free"]
SQL_MASK_BOTH = V.with_(V.JUNCTIONS, V.INTERVALS, _TEMPLATE, f"own AS (SELECT *, {_FREE} AS free FROM junctions)") + " UNION ALL ".join(
    f"SELECT CAST({i} AS BIGINT) AS ord, '{n}' AS step, count(*) FILTER ({' AND '.join(_M[: i + 1])}) AS survivors, count(*) FILTER (NOT ({_M[i]})) AS removed_alone, "
    f"count(*) FILTER ({' AND '.join([*_M[:i], f'NOT ({_M[i]})'])}) AS removed_here FROM own"
    for i, n in enumerate(["PASS", "PE", "exclude_masked"])
)


def q_page_candidates(spark: SparkSession, d: str) -> DataFrame:
    p = C.page(V.junctions(spark, d), [F.col("id")], 20, 50, F.col("pass") & (F.coalesce("pe", F.lit(0)) >= NEED_PE))
    return p.select("id", "chrom1", "pos1", "pe", "total_in_set", "total_matching", "truncated")


SQL_PAGE = (
    V.with_(V.JUNCTIONS)
    + f"""SELECT id, chrom1, pos1, pe, (SELECT count(*) FROM junctions) AS total_in_set, (SELECT count(*) FROM junctions WHERE pass AND coalesce(pe,0) >= {NEED_PE}) AS total_matching,
 (SELECT count(*) FROM junctions WHERE pass AND coalesce(pe,0) >= {NEED_PE}) > 70 AS truncated FROM junctions WHERE pass AND coalesce(pe,0) >= {NEED_PE} ORDER BY id LIMIT 50 OFFSET 20"""
)


def sets(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    j = V.junctions(spark, d)
    return j.where("callset = 'A'"), j.where("callset = 'B'")


def q_band_match_all_pairs(spark: SparkSession, d: str) -> DataFrame:
    a, b = sets(spark, d)
    return C.recurrence(a, b, V.TOL1, V.TOL2).select("a_id", "b_id", (F.col("a_orientation") == F.col("b_orientation")).alias("same_orientation"))


_PAIRS = f"FROM {V.binned("WHERE callset = 'A'")} a JOIN (SELECT *, pos1 // {V.TOL1} AS bin FROM junctions WHERE callset = 'B') b ON a.bin = b.bin AND {V.BANDS_ON}"
SQL_PAIRS = V.with_(V.JUNCTIONS) + f"SELECT a.id AS a_id, b.id AS b_id, a.orientation = b.orientation AS same_orientation {_PAIRS}"


def q_recurrent_vs_unique(spark: SparkSession, d: str) -> DataFrame:
    a, b = sets(spark, d)
    hits = C.recurrence(a, b, V.TOL1, V.TOL2).select(F.col("a_id").alias("id")).distinct().withColumn("recurrent", F.lit(True))
    return a.join(hits, "id", "left").select("chrom1", F.coalesce("recurrent", F.lit(False)).alias("recurrent")).groupBy("chrom1", "recurrent").agg(F.count("*").alias("n"))


SQL_RECURRENT = (
    V.with_(V.JUNCTIONS, f"hits AS (SELECT DISTINCT a.id {_PAIRS})")
    + "SELECT chrom1, id IN (SELECT id FROM hits) AS recurrent, count(*) AS n FROM junctions WHERE callset = 'A' GROUP BY 1, 2"
)


def q_first_match_asymmetry(spark: SparkSession, d: str) -> DataFrame:
    a, b = sets(spark, d)
    one = C.first_match(a, b, V.TOL1, V.TOL2).agg(F.count("*").alias("matched"), F.countDistinct("b_id").alias("partners")).withColumn("direction", F.lit("A->B"))
    two = C.first_match(b, a, V.TOL1, V.TOL2).agg(F.count("*").alias("matched"), F.countDistinct("b_id").alias("partners")).withColumn("direction", F.lit("B->A"))
    return one.unionByName(two).select("direction", "matched", "partners")


SQL_FIRST = (
    V.with_(V.JUNCTIONS, f"p AS (SELECT a.id AS a_id, b.id AS b_id {_PAIRS})")
    + "SELECT 'A->B' AS direction, count(*) AS matched, count(DISTINCT b) AS partners FROM (SELECT a_id, min(b_id) AS b FROM p GROUP BY 1) "
    + "UNION ALL SELECT 'B->A', count(*), count(DISTINCT b) FROM (SELECT b_id, min(a_id) AS b FROM p GROUP BY 1)"
)


def q_dedup_components(spark: SparkSession, d: str) -> DataFrame:
    m = C.merge(V.junctions(spark, d), V.TOL1, V.TOL2)
    return m.select("id", "component", "n_merged", "pe", "sr", "orientation")


_SELF = f"""edges AS (SELECT a.id AS x, b.id AS y FROM {V.binned()} a JOIN (SELECT *, pos1 // {V.TOL1} AS bin FROM junctions) b ON a.bin = b.bin AND {V.BANDS_ON}
 AND a.orientation = b.orientation AND a.id <> b.id)"""
_REACH = "reach(node, root) AS (SELECT id, id FROM junctions UNION SELECT e.y, r.root FROM reach r JOIN edges e ON e.x = r.node WHERE r.root < e.y)"
SQL_DEDUP = (
    "WITH RECURSIVE "
    + ", ".join([V.JUNCTIONS, _SELF, _REACH])
    + """, comp AS (SELECT node AS id, min(root) AS component FROM reach GROUP BY 1),
 own AS (SELECT j.*, c.component, count(*) OVER (PARTITION BY c.component) AS n_merged, row_number() OVER (PARTITION BY c.component ORDER BY coalesce(pass,false) DESC,
 coalesce(pe,0)+coalesce(sr,0) DESC, coalesce(sr,0) DESC, j.id) AS rn FROM junctions j JOIN comp c USING (id))
 SELECT id, component, n_merged, pe, sr, orientation FROM own WHERE rn = 1"""
)


def q_mate_pairing(spark: SparkSession, d: str) -> DataFrame:
    """Record k names 2k's half as its mate: ids 4m+1 and 4m+2 name each other, others name none."""
    j = V.junctions(spark, d)
    mate = F.when(F.col("id") % 4 == 1, F.col("id") + 1).when(F.col("id") % 4 == 2, F.col("id") - 1)
    return C.mate_pairs(j, mate).select("id", "mate", "pe", "sr")


SQL_MATES = (
    V.with_(V.JUNCTIONS, "m AS (SELECT *, CASE WHEN id % 4 = 1 THEN id+1 WHEN id % 4 = 2 THEN id-1 END AS mate FROM junctions)")
    + "SELECT a.id, b.id AS mate, greatest(a.pe, b.pe) AS pe, greatest(a.sr, b.sr) AS sr FROM m a LEFT JOIN m b ON a.mate = b.id AND b.mate = a.id WHERE b.id IS NULL OR a.id < b.id"
)


def q_truth_match_closest(spark: SparkSession, d: str) -> DataFrame:
    a, b = sets(spark, d)
    return C.closest_truth(b, a.where("id % 5 = 0"), V.TOL1, V.TOL2).select("t_id", "c_id", "distance")


SQL_TRUTH = (
    V.with_(V.JUNCTIONS, f"p AS (SELECT a.id AS t_id, b.id AS c_id, abs(a.pos1-b.pos1)+abs(a.pos2-b.pos2) AS distance {_PAIRS} WHERE a.id % 5 = 0)")
    + "SELECT t_id, c_id, distance FROM (SELECT *, row_number() OVER (PARTITION BY t_id ORDER BY distance, c_id) AS rn FROM p) WHERE rn = 1"
)


def q_truth_match_closest_whole(spark: SparkSession, d: str) -> DataFrame:
    a, b = sets(spark, d)
    return C.closest_truth(b, a, V.TOL1, V.TOL2).select("t_id", "c_id", "distance")


SQL_TRUTH_WHOLE = SQL_TRUTH.replace(" WHERE a.id % 5 = 0", "")


def q_threshold_grid(spark: SparkSession, d: str) -> DataFrame:
    return C.grid(V.junctions(spark, d), "callset", [1, 3, 5, 7], [0, 6, 15])


SQL_GRID = V.with_(V.JUNCTIONS) + (
    "SELECT callset, CAST(p AS BIGINT) AS min_pe, CAST(s AS BIGINT) AS min_sr, count(*) FILTER (coalesce(pe,0) >= p AND coalesce(sr,0) >= s) AS survivors FROM junctions, unnest([1,3,5,7]) x(p), unnest([0,6,15]) y(s) GROUP BY 1, 2, 3"
)


def q_loss_attribution(spark: SparkSession, d: str) -> DataFrame:
    j = V.junctions(spark, d)
    failed = C.removed_by(steps())
    out = j.select("callset", F.coalesce(C.first_loss(steps()), F.lit("survives")).alias("lost_at"), F.array_join(failed, "+").alias("all_reasons"))
    return out.groupBy("callset", "lost_at", "all_reasons").agg(F.count("*").alias("n"))


SQL_LOSS = V.with_(V.JUNCTIONS) + (
    "SELECT callset, CASE " + " ".join(f"WHEN NOT ({p}) THEN '{n}'" for p, n in zip(_P, _NAMES, strict=True)) + " ELSE 'survives' END AS lost_at, "
    + "concat_ws('+', " + ", ".join(f"CASE WHEN NOT ({p}) THEN '{n}' END" for p, n in zip(_P, _NAMES, strict=True)) + ") AS all_reasons, count(*) AS n FROM junctions GROUP BY 1, 2, 3"
)


def q_sensitivity_rollup(spark: SparkSession, d: str) -> DataFrame:
    a, b = sets(spark, d)
    found = C.recurrence(a, b, V.TOL1, V.TOL2).select(F.col("a_id").alias("id")).distinct().withColumn("found", F.lit(1))
    t = a.join(found, "id", "left").select("chrom2", "orientation", F.coalesce("found", F.lit(0)).alias("found"))
    r = t.rollup("chrom2", "orientation").agg(F.count("*").alias("n"), F.sum("found").cast("long").alias("found"))
    return r.select(F.coalesce("chrom2", F.lit("all")).alias("chrom2"), F.coalesce("orientation", F.lit("all")).alias("orientation"), "n", "found")


SQL_ROLLUP = (
    V.with_(V.JUNCTIONS, f"hits AS (SELECT DISTINCT a.id {_PAIRS})", "t AS (SELECT chrom2, orientation, CASE WHEN id IN (SELECT id FROM hits) THEN 1 ELSE 0 END AS found FROM junctions WHERE callset = 'A')")
    + "SELECT coalesce(chrom2,'all') AS chrom2, coalesce(orientation,'all') AS orientation, count(*) AS n, CAST(sum(found) AS BIGINT) AS found FROM t GROUP BY ROLLUP(chrom2, orientation)"
)


def q_precision_antijoin(spark: SparkSession, d: str) -> DataFrame:
    a, b = sets(spark, d)
    kept = C.keep(a, steps()).select("id", "chrom1", "chrom2")
    background = C.keep(b, steps()).select("chrom1", "chrom2").distinct()
    only = kept.join(background, ["chrom1", "chrom2"], "left_anti").groupBy("chrom1").agg(F.count("*").alias("n")).withColumn("side", F.lit("not in background"))
    both = kept.join(background, ["chrom1", "chrom2"], "left_semi").groupBy("chrom1").agg(F.count("*").alias("n")).withColumn("side", F.lit("in background"))
    return only.unionByName(both).select("side", "chrom1", "n")


SQL_PRECISION = (
    V.with_(V.JUNCTIONS, f"k AS (SELECT * FROM junctions WHERE {_ALL})", "bg AS (SELECT DISTINCT chrom1, chrom2 FROM k WHERE callset = 'B')")
    + "SELECT CASE WHEN (chrom1, chrom2) IN (SELECT (chrom1, chrom2) FROM bg) THEN 'in background' ELSE 'not in background' END AS side, chrom1, count(*) AS n FROM k WHERE callset = 'A' GROUP BY 1, 2"
)


def q_hash_ids(spark: SparkSession, d: str) -> DataFrame:
    j = V.junctions(spark, d)
    key = F.concat_ws("|", "chrom1", "pos1", "chrom2", "pos2", "orientation")
    return j.select("id", short_id("CAND_", key, 12).alias("candidate"), short_id("CSET_", F.col("callset"), 8).alias("cset"), F.conv(F.substring(F.sha2(key.cast("binary"), 256), 1, 8), 16, 10).cast("long").bitwiseAND(F.lit(0x7FFFFFFF)).alias("seed"))


SQL_HASH = V.with_(V.JUNCTIONS, "k AS (SELECT *, sha256(concat_ws('|', chrom1, pos1, chrom2, pos2, orientation)) AS h FROM junctions)") + (
    "SELECT id, 'CAND_' || substr(h, 1, 12) AS candidate, 'CSET_' || substr(sha256(callset), 1, 8) AS cset, CAST(('0x' || substr(h, 1, 8)) AS BIGINT) & 2147483647 AS seed FROM k"
)


def q_group_rearrangements(spark: SparkSession, d: str) -> DataFrame:
    j = V.junctions(spark, d).select("id", F.col("chrom1").alias("ca"), F.col("pos1").alias("pa"), F.col("chrom2").alias("cb"), F.col("pos2").alias("pb"), "orientation", "pe", "sr")
    g = rearrangements(j, near=1500, far=40000)
    return g.select("event", "n_junctions", "pattern", "span_a", "span_b")


_GROUP_EDGES = """gedges AS (SELECT a.id AS x, b.id AS y FROM (SELECT *, unnest([pos1 // 40000 - 1, pos1 // 40000, pos1 // 40000 + 1]) AS bin FROM junctions) a
 JOIN (SELECT *, pos1 // 40000 AS bin FROM junctions) b ON a.bin = b.bin AND a.chrom1 = b.chrom1 AND a.chrom2 = b.chrom2 AND a.id <> b.id
 AND ((abs(a.pos1-b.pos1) <= 1500 AND abs(a.pos2-b.pos2) <= 40000) OR (abs(a.pos1-b.pos1) <= 40000 AND abs(a.pos2-b.pos2) <= 1500)))"""
_EVENTS = (
    "WITH RECURSIVE "
    + ", ".join([V.JUNCTIONS, _GROUP_EDGES, "reach(node, root) AS (SELECT id, id FROM junctions UNION SELECT e.y, r.root FROM reach r JOIN gedges e ON e.x = r.node WHERE r.root < e.y)"])
    + """, comp AS (SELECT node AS id, min(root) AS event FROM reach GROUP BY 1), own AS (SELECT j.*, c.event FROM junctions j JOIN comp c USING (id)),
 grp AS (SELECT event, count(*) AS n_junctions, count(DISTINCT orientation) AS kinds, max(pos1)-min(pos1) AS span_a, max(pos2)-min(pos2) AS span_b,
 bool_or(orientation = '3to5') AS q35, bool_or(orientation = '5to3') AS q53, bool_or(orientation = '3to3') AS q33, bool_or(orientation = '5to5') AS q55 FROM own GROUP BY 1)"""
)
_PATTERN = "CASE WHEN n_junctions = 1 THEN 'single' WHEN n_junctions > 2 THEN 'complex' WHEN kinds = 1 THEN 'same direction' WHEN (q35 AND q53) OR (q33 AND q55) THEN 'reciprocal' ELSE 'other' END"
SQL_GROUPS = _EVENTS + f"SELECT event, n_junctions, {_PATTERN} AS pattern, span_a, span_b FROM grp"



def _events(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    j = V.junctions(spark, d).select("id", F.col("chrom1").alias("ca"), F.col("pos1").alias("pa"), F.col("chrom2").alias("cb"), F.col("pos2").alias("pb"), "orientation", "pe", "sr", "pass")
    return j, rearrangements(j, near=1500, far=40000)


def q_rank_events(spark: SparkSession, d: str) -> DataFrame:
    j, g = _events(spark, d)
    support = event_support(j, g, F.coalesce("pe", F.lit(0)), F.coalesce("sr", F.lit(0)))
    return ranked(support, [F.col("fragments").desc(), F.col("caller").desc(), F.col("event")], 100).select("rank", "event", "fragments", "caller")


SQL_RANK = (
    _EVENTS
    + """, best AS (SELECT event, orientation, max(coalesce(pe,0)) AS f FROM own GROUP BY 1, 2), s AS (SELECT event, CAST(sum(f) AS BIGINT) AS fragments FROM best GROUP BY 1),
 k AS (SELECT event, CAST(sum(coalesce(pe,0)+coalesce(sr,0)) AS BIGINT) AS caller FROM own GROUP BY 1)
 SELECT row_number() OVER (ORDER BY fragments DESC, caller DESC, event) AS rank, event, fragments, caller FROM s JOIN k USING (event) QUALIFY rank <= 100"""
)


def q_event_cautions(spark: SparkSession, d: str) -> DataFrame:
    j, g = _events(spark, d)
    facts = j.join(g.select("event", F.explode("members").alias("id")), "id").groupBy("event").agg(
        F.count_if(F.coalesce("pe", F.lit(0)) == 0).alias("zero"), F.count_if(~F.coalesce("pass", F.lit(False))).alias("failed"), F.count("*").alias("n"), F.max(F.coalesce("sr", F.lit(0))).alias("sr")
    )
    texts: list[tuple[Column, Column]] = [
        (F.col("zero") > 0, F.format_string("%d junction(s) without read support", F.col("zero"))),
        (F.col("failed") * 5 >= F.col("n"), F.format_string("%d of %d junctions fail the caller's filter", F.col("failed"), F.col("n"))),
        (F.col("sr") == 0, F.lit("no split reads")),
        (F.col("n") > 2, F.lit("more than two junctions")),
    ]
    return with_cautions(facts, texts).select("event", F.array_join("cautions", "; ").alias("cautions"), F.size("cautions").cast("long").alias("n_cautions"))


SQL_CAUTIONS = (
    _EVENTS
    + """, f AS (SELECT event, count(*) FILTER (coalesce(pe,0)=0) AS zero, count(*) FILTER (NOT coalesce(pass,false)) AS failed, count(*) AS n, max(coalesce(sr,0)) AS sr FROM own GROUP BY 1),
 c AS (SELECT event, list_filter([CASE WHEN zero > 0 THEN zero || ' junction(s) without read support' END, CASE WHEN failed*5 >= n THEN failed || ' of ' || n || ' junctions fail the caller''s filter' END,
 CASE WHEN sr = 0 THEN 'no split reads' END, CASE WHEN n > 2 THEN 'more than two junctions' END], lambda x: x IS NOT NULL) AS l FROM f)
 SELECT event, array_to_string(l, '; ') AS cautions, len(l) AS n_cautions FROM c"""
)

QUERIES = {
    "q_filter_funnel": (q_filter_funnel, SQL_FUNNEL),
    "q_mask_both_ends": (q_mask_both_ends, SQL_MASK_BOTH),
    "q_page_candidates": (q_page_candidates, SQL_PAGE),
    "q_band_match_all_pairs": (q_band_match_all_pairs, SQL_PAIRS),
    "q_recurrent_vs_unique": (q_recurrent_vs_unique, SQL_RECURRENT),
    "q_first_match_asymmetry": (q_first_match_asymmetry, SQL_FIRST),
    "q_dedup_components": (q_dedup_components, SQL_DEDUP),
    "q_mate_pairing": (q_mate_pairing, SQL_MATES),
    "q_truth_match_closest": (q_truth_match_closest, SQL_TRUTH),
    "q_truth_match_closest_whole": (q_truth_match_closest_whole, SQL_TRUTH_WHOLE),
    "q_threshold_grid": (q_threshold_grid, SQL_GRID),
    "q_loss_attribution": (q_loss_attribution, SQL_LOSS),
    "q_sensitivity_rollup": (q_sensitivity_rollup, SQL_ROLLUP),
    "q_precision_antijoin": (q_precision_antijoin, SQL_PRECISION),
    "q_hash_ids": (q_hash_ids, SQL_HASH),
    "q_group_rearrangements": (q_group_rearrangements, SQL_GROUPS),
    "q_rank_events": (q_rank_events, SQL_RANK),
    "q_event_cautions": (q_event_cautions, SQL_CAUTIONS),
}
