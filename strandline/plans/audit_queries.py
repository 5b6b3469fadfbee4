"""Driver queries of comparisons, tallies, values in JSON and test design, with their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import contigs as C
from ..operators import audit, design, reads, values
from . import views as V
from .review_queries import RECORDS, records
from .views import table as t


_MODES = ("AIR", "MAIL", "RAIL", "SHIP", "TRUCK")


def lines(spark: SparkSession, d: str) -> DataFrame:
    """Line items with a kind of shipment by their part."""
    return t(spark, d, "lineitem").withColumn("l_shipmode", F.get(F.array(*[F.lit(m) for m in _MODES]), (F.col("l_partkey") % 5).cast("int")))


#: The same in SQL, in place of the table.
LINES = f"(SELECT *, {list(_MODES)}[1 + l_partkey % 5] AS l_shipmode FROM lineitem) lineitem"


def q_expected_got(spark: SparkSession, d: str) -> DataFrame:
    o = t(spark, d, "orders")
    want = o.where(F.col("o_orderkey") % 3 != 0).select("o_orderkey", F.lit("status").alias("metric"), F.col("o_orderstatus").alias("v"))
    got = o.where(F.col("o_orderkey") % 5 != 0).select("o_orderkey", F.lit("status").alias("metric"), F.when(F.col("o_custkey") % 4 != 0, F.col("o_orderstatus")).alias("v"))
    return audit.compared(want, got, ["o_orderkey", "metric"], "v").groupBy("metric", "verdict").agg(F.count("*").alias("n"), F.count("expected").alias("wanted"), F.count("got").alias("had"))


SQL_EXPECTED = """WITH a AS (SELECT o_orderkey AS k, o_orderstatus AS v FROM orders WHERE o_orderkey % 3 <> 0), b AS (SELECT o_orderkey AS k, CASE WHEN o_custkey % 4 <> 0 THEN o_orderstatus END AS v FROM orders WHERE o_orderkey % 5 <> 0)
SELECT 'status' AS metric, CASE WHEN a.k IS NOT NULL AND b.k IS NOT NULL AND a.v IS NOT DISTINCT FROM b.v THEN 'MATCH' ELSE 'DIFFERS' END AS verdict, count(*) AS n, count(a.v) AS wanted, count(b.v) AS had FROM a FULL JOIN b ON a.k = b.k GROUP BY 2"""


def q_first_of_each(spark: SparkSession, d: str) -> DataFrame:
    li = lines(spark, d).select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("line"), F.col("l_shipmode").alias("mode"))
    x = audit.first_of_each(["k"], li.where("line % 3 = 1"), li.where("line % 3 = 2"), li)
    return x.groupBy("mode").agg(F.count("*").alias("n"), F.sum("line").cast("long").alias("lines"))


SQL_FIRST = f"WITH x AS (SELECT l_orderkey AS k, l_linenumber AS line, l_shipmode AS mode, CASE l_linenumber % 3 WHEN 1 THEN 0 WHEN 2 THEN 1 ELSE 2 END AS f FROM {LINES}), y AS (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY k ORDER BY f, line, mode) = 1) SELECT mode, count(*) AS n, CAST(sum(line) AS BIGINT) AS lines FROM y GROUP BY 1"


def q_gate_fractions(spark: SparkSession, d: str) -> DataFrame:
    r = V.reads(spark, d)
    good = F.col("mapq") >= 20
    return audit.gates(r, ["contig"], [("mapped well", good, F.lit(True), 0.8), ("forward", F.col("strand") == 0, good, 0.5), ("none", good, F.col("mapq") > 1000, 0.1)])


SQL_GATES = V.with_(V.READS) + " UNION ALL ".join(
    f"SELECT contig, '{n}' AS gate, count(*) FILTER (({a}) AND ({c})) AS part, count(*) FILTER ({a}) AS whole, CAST(count(*) FILTER (({a}) AND ({c})) AS DOUBLE) / nullif(count(*) FILTER ({a}), 0) AS fraction, CAST(count(*) FILTER (({a}) AND ({c})) AS DOUBLE) / nullif(count(*) FILTER ({a}), 0) >= {g} AS passed FROM reads GROUP BY 1"
    for n, c, a, g in (("mapped well", "mapq >= 20", "true", 0.8), ("forward", "strand = 0", "mapq >= 20", 0.5), ("none", "mapq >= 20", "mapq > 1000", 0.1))
)


def q_agreement(spark: SparkSession, d: str) -> DataFrame:
    p = t(spark, d, "part")
    one = p.select("p_partkey", (F.col("p_size") % 3).alias("v"))
    two = p.where(F.col("p_partkey") % 2 == 0).select("p_partkey", F.when(F.col("p_size") % 7 != 0, F.col("p_size") % 3).alias("v"))
    x = audit.agreement(one, two, "p_partkey", "v")
    return x.select("n", "agree", F.size("disagree").cast("long").alias("differ"), F.array_join(F.transform(F.slice("disagree", 1, 5), lambda v: v.cast("string")), ",").alias("first"))


SQL_AGREEMENT = "WITH x AS (SELECT p_partkey AS k, p_size % 7 <> 0 AS same FROM part WHERE p_partkey % 2 = 0) SELECT count(*) AS n, count(*) FILTER (same) AS agree, count(*) FILTER (NOT same) AS differ, array_to_string(list_sort(list(k) FILTER (NOT same))[1:5], ',') AS first FROM x"


def q_run_tallies(spark: SparkSession, d: str) -> DataFrame:
    """Orders as runs: clerks' first letters of numbers as models, priorities as conditions; odd models are the local ones."""
    o = t(spark, d, "orders").withColumns({"model": F.concat(F.lit("m"), (F.col("o_custkey") % 5).cast("string")), "condition": F.col("o_orderpriority")})
    return audit.tallies(o, ["model", "condition"], {"passed": F.col("o_orderstatus") == "F", "open": F.col("o_orderstatus") == "O"}, F.col("o_custkey") % 5 % 2 == 1, "local models")


SQL_TALLIES = """WITH x AS (SELECT 'm' || (o_custkey % 5) AS model, o_orderpriority AS condition, o_orderstatus AS s, o_custkey % 5 % 2 = 1 AS l FROM orders)
SELECT model, condition, count(*) AS n, count(*) FILTER (s = 'F') AS passed, count(*) FILTER (s = 'O') AS open FROM x GROUP BY 1, 2 UNION ALL SELECT 'local models', condition, count(*), count(*) FILTER (s = 'F'), count(*) FILTER (s = 'O') FROM x WHERE l GROUP BY 2"""


def q_merge_groups(spark: SparkSession, d: str) -> DataFrame:
    return audit.compositions(lines(spark, d), "l_orderkey", "l_shipmode")


SQL_MERGE = f"SELECT kinds, count(*) AS groups FROM (SELECT l_orderkey, string_agg(DISTINCT l_shipmode, '+' ORDER BY l_shipmode) AS kinds FROM {LINES} GROUP BY 1) GROUP BY 1"


def q_preferred_run(spark: SparkSession, d: str) -> DataFrame:
    o = t(spark, d, "orders")
    x = audit.preferred(o, ["o_custkey"], F.col("o_orderpriority") == "1-URGENT", [F.col("o_orderkey")])
    return x.select("o_custkey", "o_orderkey", "o_orderpriority")


SQL_PREFERRED = "SELECT o_custkey, o_orderkey, o_orderpriority FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY (o_orderpriority = '1-URGENT') DESC, o_orderkey) = 1"


def q_claimed_calls(spark: SparkSession, d: str) -> DataFrame:
    """Claims of a tool, alone or at a contig, that no call of the run backs."""
    li = lines(spark, d)
    calls = li.where(F.col("l_linenumber") > 1).select(F.col("l_orderkey").alias("run"), F.col("l_shipmode").alias("tool"), F.array(F.col("l_returnflag"), F.when(F.col("l_partkey") % 2 == 0, F.col("l_linestatus"))).alias("contigs"))
    claims = li.where(F.col("l_linenumber") == 1).select(F.col("l_orderkey").alias("run"), F.when(F.col("l_partkey") % 3 == 0, F.col("l_shipmode")).otherwise(F.concat("l_shipmode", F.lit("@"), "l_returnflag")).alias("check"))
    return audit.unmatched_claims(claims, calls).groupBy("check").agg(F.count("*").alias("n"))


SQL_CLAIMS = f"""WITH k AS (SELECT DISTINCT l_orderkey AS run, unnest([l_shipmode, l_shipmode || '@' || l_returnflag, CASE WHEN l_partkey % 2 = 0 THEN l_shipmode || '@' || l_linestatus END]) AS c FROM {LINES} WHERE l_linenumber > 1),
 m AS (SELECT l_orderkey AS run, CASE WHEN l_partkey % 3 = 0 THEN l_shipmode ELSE l_shipmode || '@' || l_returnflag END AS c FROM {LINES} WHERE l_linenumber = 1)
SELECT m.c AS "check", count(*) AS n FROM m LEFT JOIN k ON k.run = m.run AND k.c = m.c WHERE k.c IS NULL GROUP BY 1"""


def q_event_truth(spark: SparkSession, d: str) -> DataFrame:
    """Junctions of one call set that have an end near each end of a junction of the other."""
    j = V.junctions(spark, d)
    ends = lambda x, k: x.select(F.col("id").alias(k), F.explode(F.array(F.struct(F.col("chrom1").alias("contig"), F.col("pos1").alias("pos")), F.struct(F.col("chrom2").alias("contig"), F.col("pos2").alias("pos")))).alias("e")).select(k, "e.contig", "e.pos")
    found = audit.found_truths(ends(j.where("callset = 'A'"), "truth"), ends(j.where("callset = 'B'"), "event"), 5000)
    return found.groupBy((F.col("truth") % 4).alias("kind")).agg(F.count("*").alias("n"), F.sum("event").alias("events"))


SQL_TRUTH = V.with_(V.JUNCTIONS) + (
    "SELECT a.id % 4 AS kind, count(*) AS n, CAST(sum(b.id) AS BIGINT) AS events FROM junctions a JOIN junctions b ON a.callset = 'A' AND b.callset = 'B' AND a.chrom1 = b.chrom1 AND a.chrom2 = b.chrom2 AND abs(a.pos1 - b.pos1) <= 5000 AND abs(a.pos2 - b.pos2) <= 5000 GROUP BY 1"
)


def q_pooled_adjudication(spark: SparkSession, d: str) -> DataFrame:
    li = lines(spark, d)
    x = audit.adjudicated(li, ["l_returnflag"], "l_shipmode", ["AIR", "MAIL", "SHIP"], F.col("l_linenumber") * 10 >= 20)
    return x.select("l_returnflag", "counted", "genuine", "false_positive", "fp_rate", F.array_join("categories", ",").alias("categories"))


SQL_POOLED = f"""WITH c AS (SELECT l_returnflag, l_shipmode, count(*) AS n FROM {LINES} WHERE l_linenumber * 10 >= 20 GROUP BY 1, 2), g AS (SELECT l_returnflag, CAST(sum(n) AS BIGINT) AS counted, CAST(coalesce(sum(n) FILTER (l_shipmode IN ('AIR', 'MAIL', 'SHIP')), 0) AS BIGINT) AS genuine, string_agg(l_shipmode || ':' || n, ',' ORDER BY l_shipmode || ':' || n) AS categories FROM c GROUP BY 1)
SELECT *, counted - genuine AS false_positive, CAST(counted - genuine AS DOUBLE) / counted AS fp_rate FROM g"""


def q_mode_share(spark: SparkSession, d: str) -> DataFrame:
    return audit.mode(lines(spark, d).withColumn("q", F.floor("l_quantity").cast("long")), ["l_shipmode"], "q")


SQL_MODE = f"WITH c AS (SELECT l_shipmode, CAST(floor(l_quantity) AS BIGINT) AS q, count(*) AS k FROM {LINES} GROUP BY 1, 2) SELECT l_shipmode, CAST(sum(k) AS BIGINT) AS n, arg_min(q, struct_pack(a := -k, b := q)) AS mode, CAST(max(k) AS DOUBLE) / sum(k) AS share, min(q) AS least, max(q) AS most FROM c GROUP BY 1"


def q_strongest_missed(spark: SparkSession, d: str) -> DataFrame:
    j = V.junctions(spark, d).select("id", "chrom1", "pos1", "pe", "pass")
    return audit.strongest_missed(j, F.coalesce("pass", F.lit(False)), F.coalesce("pe", F.lit(0)), "id").select("id", "chrom1", "pos1", "pe")


SQL_MISSED = V.with_(V.JUNCTIONS) + "SELECT id, chrom1, pos1, pe FROM junctions WHERE NOT coalesce(pass, false) ORDER BY coalesce(pe, 0) DESC, id LIMIT 1"


def q_summary_last(spark: SparkSession, d: str) -> DataFrame:
    x = audit.last_core_call(lines(spark, d), "l_orderkey", "l_linenumber", "l_shipmode", ["AIR", "MAIL", "RAIL", "SHIP"], "SHIP")
    return x.groupBy("valid").agg(F.count("*").alias("n"), F.sum("l_orderkey").cast("long").alias("runs"))


SQL_LAST = f"WITH g AS (SELECT l_orderkey, max(l_linenumber) FILTER (l_shipmode = 'SHIP') AS s, max(l_linenumber) FILTER (l_shipmode IN ('AIR', 'MAIL', 'RAIL')) AS c FROM {LINES} GROUP BY 1) SELECT s IS NOT NULL AND (c IS NULL OR c < s) AS valid, count(*) AS n, CAST(sum(l_orderkey) AS BIGINT) AS runs FROM g GROUP BY 1"


def q_table_digest(spark: SparkSession, d: str) -> DataFrame:
    return audit.table_digest(t(spark, d, "nation"), "n_nationkey", ["n_name", "n_regionkey"], ["n_regionkey"])


SQL_DIGEST = "SELECT n_regionkey, md5(string_agg(n_name || chr(9) || n_regionkey, chr(10) ORDER BY n_nationkey)) AS md5 FROM nation GROUP BY 1"


def q_commitment(spark: SparkSession, d: str) -> DataFrame:
    c = t(spark, d, "customer")
    key = audit.commitment(F.concat(F.lit("salt"), F.col("c_custkey").cast("string")), {"segment": F.col("c_mktsegment"), "nation": F.col("c_nationkey")})
    return c.select("c_custkey", key.alias("sha"))


SQL_COMMITMENT = """SELECT c_custkey, sha256('salt' || c_custkey || '{"nation":"' || c_nationkey || '","segment":"' || c_mktsegment || '"}') AS sha FROM customer"""


def q_run_names(spark: SparkSession, d: str) -> DataFrame:
    c = t(spark, d, "customer")
    tail = F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("_r"), (F.col("c_custkey") % 4).cast("string"))).otherwise("")
    name = F.concat(F.lit("/x/m.1-"), F.col("c_nationkey").cast("string"), F.when(F.col("c_custkey") % 7 == 0, "_").otherwise("__"), F.lower("c_mktsegment"), F.lit("__run"), F.col("c_custkey").cast("string"), tail, F.lit(".json"))
    return c.select("c_custkey", audit.run_name(name).alias("r")).select("c_custkey", "r.*")


SQL_RUN_NAMES = """SELECT c_custkey, CASE WHEN c_custkey % 7 <> 0 THEN 'm.1-' || c_nationkey END AS model, CASE WHEN c_custkey % 7 <> 0 THEN lower(c_mktsegment) END AS condition, CAST(CASE WHEN c_custkey % 7 <> 0 THEN c_custkey END AS INTEGER) AS run,
 CAST(CASE WHEN c_custkey % 7 <> 0 AND c_custkey % 3 = 0 THEN c_custkey % 4 END AS INTEGER) AS replacement FROM customer"""


def q_visible_rows(spark: SparkSession, d: str) -> DataFrame:
    rows = lines(spark, d).withColumn("label", F.col("l_shipmode"))
    labels = lines(spark, d).select(F.col("l_shipmode").alias("label")).distinct().where("label <> 'RAIL'").withColumn("kind", F.when(F.col("label").isin("AIR", "MAIL"), "public").otherwise("private"))
    return audit.visible(rows, labels, False).groupBy("label").agg(F.count("*").alias("n"))


SQL_VISIBLE = f"SELECT l_shipmode AS label, count(*) AS n FROM {LINES} WHERE l_shipmode IN ('AIR', 'MAIL') GROUP BY 1"


def q_background_reads(spark: SparkSession, d: str) -> DataFrame:
    """Records that background measurements use: mapped, first of their alignments, no duplicates, of good quality."""
    r = records(spark, d)
    keep = reads.A.lacks(F.col("flag"), reads.A.NOT_PRIMARY | reads.A.DUPLICATE | reads.A.QC_FAIL) & (F.col("mapq") >= 20)
    return r.where(keep).groupBy("contig").agg(F.count("*").alias("n"), F.sum("pos0").alias("positions"))


SQL_BACKGROUND = V.with_(RECORDS) + "SELECT contig, count(*) AS n, CAST(sum(pos0) AS BIGINT) AS positions FROM r WHERE NOT supp AND NOT dup AND mapq >= 20 GROUP BY 1"


#: Values that look like JSON inside: colons, quotes, braces, brackets and backslashes.
_AWKWARD = [":b", 'say "9": {', "[1, 2]", "a\\b", "}{", ""]


def q_json_walk(spark: SparkSession, d: str) -> DataFrame:
    """Strings and numbers at any depth of a JSON made of an order, among values with colons, quotes and braces."""
    o = t(spark, d, "orders")
    odd = F.get(F.array(*[F.lit(x) for x in _AWKWARD]), (F.col("o_orderkey") % len(_AWKWARD)).cast("int"))
    body = F.to_json(F.struct("o_orderkey", F.struct(F.col("o_orderstatus").alias("s1"), F.array(F.struct(F.floor("o_totalprice").cast("long").alias("p2"), odd.alias("t")), F.struct(F.col("o_orderkey").alias("p2"), F.lit("x").alias("t"))).alias("list")).alias("in3"), F.lit(True).alias("flag")))
    x = o.select("o_orderkey", values.json_strings(body).alias("s"), values.json_numbers(body).alias("n"))
    return x.select("o_orderkey", F.array_join("s", "|").alias("strings"), F.size("n").cast("long").alias("n"), F.aggregate("n", F.lit(0.0), lambda a, b: a + b).cast("long").alias("total"))


_ODD_SQL = "[" + ", ".join("'" + x + "'" for x in _AWKWARD) + f"][o_orderkey % {len(_AWKWARD)} + 1]"
SQL_WALK = f"""SELECT o_orderkey, o_orderstatus || '|' || {_ODD_SQL} || '|x' AS strings, CAST(CASE WHEN floor(o_totalprice) = o_orderkey THEN 1 ELSE 2 END AS BIGINT) AS n, CAST(CASE WHEN floor(o_totalprice) = o_orderkey THEN o_orderkey ELSE o_orderkey + floor(o_totalprice) END AS BIGINT) AS total FROM orders"""


def q_json_leaves(spark: SparkSession, d: str) -> DataFrame:
    """Every leaf of the JSON of an order and its lines, with its path, by walking variants."""
    o = t(spark, d, "orders")
    odd = F.get(F.array(*[F.lit(x) for x in _AWKWARD]), (F.col("o_orderkey") % len(_AWKWARD)).cast("int"))
    li = t(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct(F.col("l_linenumber").cast("long").alias("line"), F.struct(F.col("l_returnflag").alias("flag"), F.col("l_partkey").cast("long").alias("part")).alias("of")))).alias("lines"))
    body = F.to_json(F.struct(F.col("o_orderstatus").alias("status"), odd.alias("note"), F.struct((F.col("o_custkey") % 2 == 0).alias("even"), "lines").alias("inner")))
    rows = o.join(li, F.col("o_orderkey") == F.col("l_orderkey")).select("o_orderkey", body.alias("j"))
    return values.json_leaves(rows, "j").select("o_orderkey", "path", "name", "kind", "value")


SQL_LEAVES = f"""WITH li AS (SELECT l_orderkey, list({{'line': CAST(l_linenumber AS BIGINT), 'of': {{'flag': l_returnflag, 'part': CAST(l_partkey AS BIGINT)}}}} ORDER BY l_linenumber, l_returnflag, l_partkey) AS lines FROM lineitem GROUP BY 1),
 j AS (SELECT o_orderkey, CAST(to_json({{'status': o_orderstatus, 'note': {_ODD_SQL}, 'inner': {{'even': o_custkey % 2 = 0, 'lines': lines}}}}) AS JSON) AS j FROM orders JOIN li ON l_orderkey = o_orderkey)
SELECT o_orderkey, w.fullkey AS path, CASE WHEN w.key ~ '^[0-9]+$' THEN 'lines' ELSE w.key END AS name, CASE w.type WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' ELSE 'number' END AS kind, w.atom ->> '$' AS value
 FROM j, json_tree(j.j) w WHERE w.type NOT IN ('OBJECT', 'ARRAY')"""


def q_shrunk(spark: SparkSession, d: str) -> DataFrame:
    """Results of orders within 90 characters: their lines are counted, and what is still too long keeps only its note."""
    li = lines(spark, d).groupBy("l_orderkey").agg(F.array_sort(F.collect_list("l_linenumber")).alias("windows"))
    o = t(spark, d, "orders").join(li, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    x = o.select("o_orderkey", F.struct(F.col("o_orderpriority").alias("note"), "windows", F.repeat(F.lit("z"), (F.col("o_custkey") % 60).cast("int")).alias("detail")).alias("r"))
    return values.shrunk(x, "r", ["note"], {"windows": "bins omitted; see summary"}, 90).select("o_orderkey", "shrunk")


_W = """'{"note":"' || o_orderpriority || '"' || CASE WHEN n IS NULL THEN '' ELSE ',"windows":"<' || n || ' bins omitted; see summary>"' END || ',"detail":"' || repeat('z', CAST(o_custkey % 60 AS INT)) || '"}'"""
_REST = """substr('{' || CASE WHEN n IS NULL THEN '' ELSE '"windows":"<' || n || ' bins omitted; see summary>",' END || '"detail":"' || repeat('z', CAST(o_custkey % 60 AS INT)) || '"}', 1, 45)"""
SQL_SHRUNK = f"""WITH x AS (SELECT orders.*, n FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey)
SELECT o_orderkey, CASE WHEN length({_W}) <= 90 THEN {_W} ELSE '{{"note":"' || o_orderpriority || '","_truncated_fields":"' || replace({_REST}, '"', '\\"') || '"}}' END AS shrunk FROM x"""


def q_number_source(spark: SparkSession, d: str) -> DataFrame:
    o = t(spark, d, "orders")
    k, p = (F.col("o_orderkey") % 50).cast("double"), (F.col("o_custkey") % 40 + 60).cast("double")
    number = F.when(F.col("o_orderkey") % 5 == 0, F.lit(7777.0)).when(F.col("o_orderkey") % 5 == 1, F.lit(8888.0)).when(F.col("o_orderkey") % 5 == 2, k + p).when(F.col("o_orderkey") % 5 == 3, p - k).otherwise(F.lit(123456.0))
    x = values.number_source(number, F.lit("what of 7777?"), F.lit("line 8888, 88881 and 17777"), F.array(k, p))
    return o.select("o_orderkey", x.alias("source")).groupBy((F.col("o_orderkey") % 5).alias("kind"), "source").agg(F.count("*").alias("n"))


SQL_SOURCE = """WITH x AS (SELECT o_orderkey % 5 AS kind, CAST(o_orderkey % 50 AS DOUBLE) AS k, CAST(o_custkey % 40 + 60 AS DOUBLE) AS p FROM orders), v AS (SELECT *, CASE kind WHEN 2 THEN k + p WHEN 3 THEN p - k END AS num FROM x),
 s AS (SELECT kind, CASE kind WHEN 0 THEN 'question' WHEN 1 THEN 'returned text' WHEN 4 THEN 'none' ELSE CASE WHEN least(abs(2*k-num), abs(k+p-num), abs(2*p-num)) <= 0.011 THEN 'sum' WHEN least(abs(num), abs(p-k-num), abs(k-p-num)) <= 0.011 THEN 'difference' END END AS source FROM v)
SELECT kind, source, count(*) AS n FROM s GROUP BY 1, 2"""


def _sequences(spark: SparkSession, d: str) -> DataFrame:
    """Sequences of bases spelled by parts' names: each letter stands for a base."""
    p = t(spark, d, "part")
    seq = F.translate(F.regexp_replace(F.lower("p_name"), "[^a-z]", ""), "abcdefghijklmnopqrstuvwxyz", "ACGTACGTACGTACGTACGTACGTAC")
    return p.select("p_partkey", seq.alias("seq"))


_SEQ = "sq AS (SELECT p_partkey, translate(regexp_replace(lower(p_name), '[^a-z]', '', 'g'), 'abcdefghijklmnopqrstuvwxyz', 'ACGTACGTACGTACGTACGTACGTAC') AS seq FROM part)"
_TILES = "tl AS (SELECT p_partkey, o AS \"offset\", substr(seq, CAST(o AS INT) + 1, 10) AS own FROM sq, range(0, 400, 5) r(o) WHERE o + 10 <= length(seq))"
_BOTH = "bt AS (SELECT p_partkey, \"offset\", '+' AS strand, own AS tile FROM tl UNION ALL SELECT p_partkey, \"offset\", '-', reverse(translate(own, 'ACGT', 'TGCA')) FROM tl)"


def q_tiles(spark: SparkSession, d: str) -> DataFrame:
    x = design.tiled(_sequences(spark, d), "seq", 10, 5)
    return x.groupBy("p_partkey").agg(F.count("*").alias("n"), F.min("tile").alias("least"), F.max("offset").cast("long").alias("last"))


SQL_TILES = V.with_(_SEQ, _TILES, _BOTH) + 'SELECT p_partkey, count(*) AS n, min(tile) AS least, CAST(max("offset") AS BIGINT) AS last FROM bt GROUP BY 1'


def q_mappability(spark: SparkSession, d: str) -> DataFrame:
    """Tiles count as placed right where no other part has the same tile."""
    x = design.tiled(_sequences(spark, d), "seq", 10, 5)
    once = x.groupBy("tile").agg(F.countDistinct("p_partkey").alias("parts"))
    return design.mappability(x.join(once, "tile"), ["p_partkey"], F.col("parts") == 1)


SQL_MAPPABILITY = V.with_(_SEQ, _TILES, _BOTH, "on_ AS (SELECT tile, count(DISTINCT p_partkey) AS parts FROM bt GROUP BY 1)") + (
    "SELECT p_partkey, count(*) AS tiles, count(*) FILTER (parts = 1) AS correct, CAST(count(*) FILTER (parts = 1) AS DOUBLE) / count(*) AS mappability FROM bt JOIN on_ USING (tile) GROUP BY 1"
)


def q_grid_candidates(spark: SparkSession, d: str) -> DataFrame:
    n = t(spark, d, "nation").select(F.col("n_regionkey").cast("string").alias("contig"), F.lit(30_000).cast("long").alias("length")).distinct()
    masks = V.intervals(spark, d).select((F.col("gene") % 5).cast("string").alias("contig"), F.col("g_start").alias("start"), F.col("g_end").alias("end"))
    x = design.unmasked(design.grid(n, 150, 40), masks)
    return x.groupBy("contig").agg(F.count("*").alias("n"), F.sum("pos").alias("positions"))


SQL_GRID = V.with_(V.INTERVALS, "c AS (SELECT CAST(n_regionkey AS VARCHAR) AS contig, p AS pos FROM (SELECT DISTINCT n_regionkey FROM nation), range(40, 29960, 150) r(p))") + (
    "SELECT contig, count(*) AS n, CAST(sum(pos) AS BIGINT) AS positions FROM c WHERE NOT EXISTS (SELECT 1 FROM intervals WHERE CAST(gene % 5 AS VARCHAR) = contig AND g_start < pos + 40 AND g_end > pos - 40 AND g_end > g_start) GROUP BY 1"
)


def q_genome_positions(spark: SparkSession, d: str) -> DataFrame:
    contigs = t(spark, d, "nation").select(F.col("n_name").alias("contig"), (F.col("n_nationkey") * 1000 + 500).cast("long").alias("length"), F.col("n_nationkey").alias("ord"))
    offsets = t(spark, d, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_orderkey") * 17 % 312_500).cast("long").alias("offset"))
    return design.genome_positions(offsets, contigs).select("id", "contig", "pos")


SQL_POSITIONS = "WITH c AS (SELECT n_name AS contig, CAST(sum(n_nationkey*1000+500) OVER (ORDER BY n_nationkey) AS BIGINT) AS stop, n_nationkey*1000+500 AS n FROM nation), o AS (SELECT o_orderkey AS id, o_orderkey * 17 % 312500 AS x FROM orders) SELECT id, contig, CAST(x - (stop - n) AS BIGINT) AS pos FROM o JOIN c ON x < stop AND x >= stop - n"


def q_dose_table(spark: SparkSession, d: str) -> DataFrame:
    p = t(spark, d, "part").select("p_partkey", F.col("p_size").cast("double").alias("depth"))
    x = design.expected_pairs(p, F.col("depth"), F.lit(400.0), F.lit(150.0), F.lit(0.5))
    return x.select("p_partkey", *[F.round(c, 9).alias(c) for c in ("fragments", "spanning", "both_clear")])


SQL_DOSE = "SELECT p_partkey, round(p_size / 300.0::DOUBLE, 9) AS fragments, round(p_size / 300.0::DOUBLE * 200, 9) AS spanning, round(p_size / 300.0::DOUBLE * 50, 9) AS both_clear FROM part"


def q_expected_reads(spark: SparkSession, d: str) -> DataFrame:
    r = t(spark, d, "region").select("r_regionkey", F.round(design.reads_per_spanning_fragment(400.0, 60.0, 150), 9).alias("reads"))
    return r


SQL_EXPECTED_READS = "WITH x AS (SELECT CAST(i AS DOUBLE) AS x, exp(-pow((i - 400.0) / 60.0, 2) / 2) * i AS w FROM range(150, 761) r(i)) SELECT r_regionkey, round((SELECT sum(w * least(2.0, 300.0 / x)) / sum(w) FROM x), 9) AS reads FROM region"


def q_local_score(spark: SparkSession, d: str) -> DataFrame:
    """Matches of neighbouring bases of a part's sequence with the ones two places on."""
    s = _sequences(spark, d).withColumn("c", F.filter(F.split("seq", ""), lambda x: x != ""))
    same = F.filter(F.zip_with("c", F.slice(F.col("c"), F.lit(3), F.size("c")), lambda a, b: a == b), lambda x: x.isNotNull())
    return s.select("p_partkey", design.local_score(same).alias("x")).select("p_partkey", F.col("x.run").alias("run"), F.col("x.score").alias("score"))


SQL_LOCAL = V.with_(
    _SEQ,
    "ch AS (SELECT p_partkey, i, substr(seq, i, 1) = substr(seq, i + 2, 1) AS m FROM (SELECT *, unnest(range(1, length(seq) - 1)) AS i FROM sq))",
    "rn AS (SELECT *, sum(CASE WHEN m THEN 0 ELSE 1 END) OVER (PARTITION BY p_partkey ORDER BY i) AS g, sum(CASE WHEN m THEN 1 ELSE -3 END) OVER (PARTITION BY p_partkey ORDER BY i) AS s FROM ch)",
    "mn AS (SELECT *, s - least(0, min(s) OVER (PARTITION BY p_partkey ORDER BY i)) AS v FROM rn)",
    "ru AS (SELECT p_partkey, max(n) AS run FROM (SELECT p_partkey, g, count(*) FILTER (m) AS n FROM rn GROUP BY 1, 2) GROUP BY 1)",
    "sc AS (SELECT p_partkey, max(v) AS score FROM mn GROUP BY 1)",
) + "SELECT sq.p_partkey, CAST(coalesce(run, 0) AS INTEGER) AS run, CAST(coalesce(score, 0) AS INTEGER) AS score FROM sq LEFT JOIN ru USING (p_partkey) LEFT JOIN sc USING (p_partkey)"


def q_demultiplexed(spark: SparkSession, d: str) -> DataFrame:
    x = records(spark, d).withColumn("qname", F.concat(F.lit("lib"), (F.col("file_ord") % 4).cast("string"), F.lit("_"), "qname"))
    return design.by_prefix(x).groupBy("library").agg(F.count("*").alias("n"))


SQL_DEMULTIPLEX = V.with_(RECORDS) + "SELECT 'lib' || (file_ord % 4) AS library, count(*) AS n FROM r GROUP BY 1"


def q_inject_arithmetic(spark: SparkSession, d: str) -> DataFrame:
    """Half of the names of urgent orders give way to copies of the others' first lines; the counts must add up."""
    r = V.reads(spark, d)
    gone = design.half_removed(r.where("contig = 'A'"), 7)
    added = r.where("contig = 'N' and mapq = 10")
    x = design.arithmetic(r, gone, added, r.join(gone, "qname", "left_anti").unionByName(added))
    n = r.where("contig = 'A'").agg(F.countDistinct("qname").alias("names"))
    return x.crossJoin(n).crossJoin(gone.agg(F.count("*").alias("taken"))).select("before", "added", "holds", "names", "taken", (F.col("before") - F.col("removed") + F.col("added") == F.col("after")).alias("sum"))


SQL_ARITHMETIC = V.with_(V.READS) + "SELECT count(*) AS before, count(*) FILTER (contig = 'N' AND mapq = 10) AS added, true AS holds, count(DISTINCT CASE WHEN contig = 'A' THEN qname END) AS names, count(DISTINCT CASE WHEN contig = 'A' THEN qname END) // 2 AS taken, true AS sum FROM reads"


def q_spaced_draw(spark: SparkSession, d: str) -> DataFrame:
    """A draw of parts at least 3,000 bases apart: how close the nearest two are, and whether any other would still fit."""
    p = V.intervals(spark, d).select(F.col("gene").alias("id"), (F.col("gene") % 5).cast("string").alias("contig"), F.col("g_start").alias("pos"))
    x = design.spaced_draw(p, 3000, 11)
    from pyspark.sql import Window as W

    gaps = x.withColumn("gap", F.col("pos") - F.lag("pos").over(W.partitionBy("contig").orderBy("pos")))
    near = p.join(x.select(F.col("contig").alias("c"), F.col("pos").alias("q")), (F.col("contig") == F.col("c")) & (F.abs(F.col("pos") - F.col("q")) <= 3000), "left_anti")
    return gaps.agg((F.coalesce(F.min("gap"), F.lit(9999)) > 3000).alias("spaced")).crossJoin(near.agg((F.count("*") == 0).alias("full")))


SQL_DRAW = "SELECT true AS spaced, true AS \"full\""


def q_same_count(spark: SparkSession, d: str) -> DataFrame:
    """Split reads of loci counted by the library and again by an enumeration of their segments: both must agree."""
    loci = V.loci(spark, d).select("locus", F.concat(F.lit("chr"), (F.col("locus") / 100 % 3 + 1).cast("int").cast("string")).alias("l_contig"), "centre")
    own = reads.prepared(records(spark, d))
    one = reads.split_reads(own, loci, 100, 20).select("locus", F.coalesce("split", F.lit(0)).alias("split"))
    e = reads.at(own.where("is_primary and mapq >= 20"), loci, 100).select("locus", "file_ord", "contig", F.explode("sa").alias("s"))
    two = e.where((F.col("s.mapq") >= 20) & (C.primary(F.col("s.chrom")) != C.primary(F.col("contig")))).groupBy("locus").agg(F.count("*").alias("again"))
    x = one.join(two, "locus", "left").withColumn("again", F.coalesce("again", F.lit(0)))
    return x.agg(F.count("*").alias("loci"), F.count_if(F.col("split") == F.col("again")).alias("equal"), F.sum("split").cast("long").alias("split"))


SQL_SAME = V.with_(
    RECORDS, V.LOCI, "l AS (SELECT locus, 'chr' || ((locus // 100) % 3 + 1) AS l_contig, centre FROM loci)",
    "x AS (SELECT l.locus, count(r.qname) AS n FROM l LEFT JOIN r ON r.contig = l.l_contig AND r.pos0 < l.centre + 100 AND r.end0 > greatest(0, l.centre - 100) AND NOT supp AND mapq >= 20 AND sa_chrom <> contig AND sa_mapq >= 20 GROUP BY 1)",
) + "SELECT count(*) AS loci, count(*) AS equal, CAST(sum(n) AS BIGINT) AS split FROM x"


QUERIES = {
    "q_expected_got": (q_expected_got, SQL_EXPECTED),
    "q_first_of_each": (q_first_of_each, SQL_FIRST),
    "q_gate_fractions": (q_gate_fractions, SQL_GATES),
    "q_agreement": (q_agreement, SQL_AGREEMENT),
    "q_run_tallies": (q_run_tallies, SQL_TALLIES),
    "q_merge_groups": (q_merge_groups, SQL_MERGE),
    "q_preferred_run": (q_preferred_run, SQL_PREFERRED),
    "q_claimed_calls": (q_claimed_calls, SQL_CLAIMS),
    "q_event_truth": (q_event_truth, SQL_TRUTH),
    "q_pooled_adjudication": (q_pooled_adjudication, SQL_POOLED),
    "q_mode_share": (q_mode_share, SQL_MODE),
    "q_strongest_missed": (q_strongest_missed, SQL_MISSED),
    "q_summary_last": (q_summary_last, SQL_LAST),
    "q_table_digest": (q_table_digest, SQL_DIGEST),
    "q_commitment": (q_commitment, SQL_COMMITMENT),
    "q_run_names": (q_run_names, SQL_RUN_NAMES),
    "q_visible_rows": (q_visible_rows, SQL_VISIBLE),
    "q_background_reads": (q_background_reads, SQL_BACKGROUND),
    "q_json_walk": (q_json_walk, SQL_WALK),
    "q_json_leaves": (q_json_leaves, SQL_LEAVES),
    "q_shrunk": (q_shrunk, SQL_SHRUNK),
    "q_number_source": (q_number_source, SQL_SOURCE),
    "q_tiles": (q_tiles, SQL_TILES),
    "q_mappability": (q_mappability, SQL_MAPPABILITY),
    "q_grid_candidates": (q_grid_candidates, SQL_GRID),
    "q_genome_positions": (q_genome_positions, SQL_POSITIONS),
    "q_dose_table": (q_dose_table, SQL_DOSE),
    "q_expected_reads": (q_expected_reads, SQL_EXPECTED_READS),
    "q_local_score": (q_local_score, SQL_LOCAL),
    "q_demultiplexed": (q_demultiplexed, SQL_DEMULTIPLEX),
    "q_inject_arithmetic": (q_inject_arithmetic, SQL_ARITHMETIC),
    "q_spaced_draw": (q_spaced_draw, SQL_DRAW),
    "q_same_count": (q_same_count, SQL_SAME),
}
