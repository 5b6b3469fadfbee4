"""Driver queries of the statistics, sequence, text, trace and event-time operators, with their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import statistics as S
from ..functions.alignments import blocks, breakend, clips, operations, overlap, reference_length, requantised, reverse_complement, segments
from ..functions.contigs import contig_class, flipped, primary
from ..operators import analysis as A
from ..operators import terms as M
from ..operators import text as T
from ..operators import trace as R
from ..session import spread
from ..streaming import sessions as Y
from ..streaming import windows as X
from . import views as V

t = V.table


def q_histogram(spark: SparkSession, d: str) -> DataFrame:
    return A.histogram(V.reads(spark, d), ["contig"], F.col("end0") - F.col("pos0"), 5)


SQL_HISTOGRAM = V.with_(V.READS) + "SELECT contig, CAST(floor((end0-pos0)/5.0) AS BIGINT) AS bucket, count(*) AS n FROM reads GROUP BY 1, 2"


def q_class_crosstab(spark: SparkSession, d: str) -> DataFrame:
    return A.crosstab(V.reads(spark, d), "contig", "mate_contig", ["F", "O"])


SQL_CROSSTAB = V.with_(V.READS) + "SELECT contig, count(*) FILTER (mate_contig='F') AS \"n_F\", count(*) FILTER (mate_contig='O') AS \"n_O\" FROM reads GROUP BY 1"


def q_spread_median_mad(spark: SparkSession, d: str) -> DataFrame:
    x = A.spread(t(spark, d, "orders"), "o_orderpriority", "o_totalprice", 300000.0)
    return x.select("o_orderpriority", "n", *[F.round(c, 3).alias(c) for c in ("mean", "sd", "median", "mad")], F.round("above", 6).alias("above"))


SQL_SPREAD = """WITH o AS (SELECT o_orderpriority, o_totalprice AS v, median(o_totalprice) OVER (PARTITION BY o_orderpriority) AS m FROM orders)
SELECT o_orderpriority, count(*) AS n, round(avg(v), 3) AS mean, round(stddev_pop(v), 3) AS sd, round(any_value(m), 3) AS median, round(median(abs(v-m)), 3) AS mad, round(CAST(count(*) FILTER (v > 300000) AS DOUBLE)/count(*), 6) AS above FROM o GROUP BY 1"""


def q_index_quantiles(spark: SparkSession, d: str) -> DataFrame:
    return A.index_quantiles(t(spark, d, "orders"), "o_orderstatus", "o_totalprice", [0.0, 0.25, 0.5, 0.9, 1.0])


SQL_QUANTILES = """WITH s AS (SELECT o_orderstatus, o_totalprice AS value, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice) - 1 AS i, count(*) OVER (PARTITION BY o_orderstatus) AS n FROM orders)
SELECT o_orderstatus, CAST(q AS DOUBLE) AS q, value FROM s, unnest([0.0, 0.25, 0.5, 0.9, 1.0]) u(q) WHERE i = floor(q*(n-1))"""


def q_singletons_recurrent(spark: SparkSession, d: str) -> DataFrame:
    return A.recurrence_counts(V.reads(spark, d).withColumn("len", F.col("end0") - F.col("pos0")), "contig", ["supp", "len"])


SQL_SINGLETONS = V.with_(V.READS, "g AS (SELECT contig, supp, end0-pos0 AS len, count(*) AS n FROM reads GROUP BY 1, 2, 3)") + "SELECT contig, count(*) FILTER (n=1) AS singletons, count(*) FILTER (n>1) AS recurrent, CAST(coalesce(sum(n) FILTER (n>1), 0) AS BIGINT) AS recurrent_rows FROM g GROUP BY 1"


def q_majority_vote(spark: SparkSession, d: str) -> DataFrame:
    return A.vote(V.reads(spark, d), ["supp"], "contig")


SQL_VOTE = V.with_(V.READS, "g AS (SELECT supp, contig, count(*) AS n FROM reads GROUP BY 1, 2)") + "SELECT supp, arg_max(contig, (n, contig)) AS winner, max(n) AS votes, CAST(sum(n) AS BIGINT) AS total, CAST(max(n) AS DOUBLE)/sum(n) AS share FROM g GROUP BY 1"


def q_counterfactual_tally(spark: SparkSession, d: str) -> DataFrame:
    """Orders before and after partners on R are set aside: some partner, and none but R."""
    o = V.reads(spark, d).groupBy("qname").agg(F.collect_set("contig").alias("p"))
    return o.agg(F.count("*").alias("n"), F.count_if(F.exists("p", lambda c: c != "R")).alias("still"), F.count_if(F.forall("p", lambda c: c == "R")).alias("lost"), F.count_if(F.size("p") > F.size(F.array_remove("p", "R"))).alias("touched"))


SQL_COUNTER = V.with_(V.READS, "o AS (SELECT qname, bool_or(contig <> 'R') AS still, bool_or(contig = 'R') AS touched FROM reads GROUP BY 1)") + "SELECT count(*) AS n, count(*) FILTER (still) AS still, count(*) FILTER (NOT still) AS lost, count(*) FILTER (touched) AS touched FROM o"


def q_spanning_groups(spark: SparkSession, d: str) -> DataFrame:
    r = V.reads(spark, d).withColumns({"qname": F.col("supp"), "pos0": F.col("pos0") % 1000, "end0": F.col("pos0") % 1000 + (F.col("end0") - F.col("pos0"))})
    return A.spanning(r.where("mapq = 70"), F.lit(500)).select("qname", "first", "last", "n")


SQL_SPANNING = V.with_(V.READS) + "SELECT supp AS qname, min(pos0 % 1000) AS first, max(pos0 % 1000 + (end0-pos0)) AS last, count(*) AS n FROM reads WHERE mapq = 70 GROUP BY 1 HAVING min(pos0 % 1000) < 500 AND max(pos0 % 1000 + (end0-pos0)) > 500"


def q_remove_inject(spark: SparkSession, d: str) -> DataFrame:
    r = V.reads(spark, d)
    names = r.where("contig = 'N' and mapq = 10").select("qname").distinct()
    added = r.where("qname % 100 = 7").withColumns({"rid": -F.col("rid"), "qname": -F.col("qname")})
    out = A.remove_and_inject(r, names, added)
    return out.groupBy("contig").agg(F.count("*").alias("n"), F.countDistinct("qname").alias("names"), F.sum("rid").cast("long").alias("checksum"))


SQL_INJECT = V.with_(V.READS, "u AS (SELECT contig, qname, rid FROM reads WHERE qname NOT IN (SELECT qname FROM reads WHERE contig='N' AND mapq=10) UNION ALL SELECT contig, -qname, -rid FROM reads WHERE qname % 100 = 7)") + "SELECT contig, count(*) AS n, count(DISTINCT qname) AS names, CAST(sum(rid) AS BIGINT) AS checksum FROM u GROUP BY 1"


def q_set_diff(spark: SparkSession, d: str) -> DataFrame:
    o = t(spark, d, "orders")
    a = o.where("o_orderkey % 3 <> 0").select("o_orderkey", F.col("o_orderstatus").alias("v"))
    b = o.where("o_orderkey % 5 <> 0").select("o_orderkey", F.when(F.col("o_custkey") % 4 == 0, F.lit(None)).otherwise(F.col("o_orderstatus")).alias("v"))
    return A.set_difference(a, b, "o_orderkey", "v").groupBy("state").agg(F.count("*").alias("n"))


SQL_SETDIFF = """WITH a AS (SELECT o_orderkey AS k, o_orderstatus AS v FROM orders WHERE o_orderkey % 3 <> 0), b AS (SELECT o_orderkey AS k, CASE WHEN o_custkey % 4 = 0 THEN NULL ELSE o_orderstatus END AS v FROM orders WHERE o_orderkey % 5 <> 0)
SELECT CASE WHEN b.k IS NULL THEN 'only left' WHEN a.k IS NULL THEN 'only right' WHEN a.v IS NOT DISTINCT FROM b.v THEN 'same' ELSE 'changed' END AS state, count(*) AS n FROM a FULL JOIN b ON a.k = b.k GROUP BY 1"""


def q_pearson_guarded(spark: SparkSession, d: str) -> DataFrame:
    g = A.guarded_pearson(t(spark, d, "lineitem"), "l_suppkey", "l_quantity", "l_extendedprice")
    return g.select(F.col("l_suppkey").cast("long").alias("l_suppkey"), "n", F.round("r", 6).alias("r"))


SQL_PEARSON = "SELECT CAST(l_suppkey AS BIGINT) AS l_suppkey, count(*) AS n, CASE WHEN count(*) >= 3 AND var_pop(l_quantity) > 0 AND var_pop(l_extendedprice) > 0 THEN round(corr(l_quantity, l_extendedprice), 6) END AS r FROM lineitem GROUP BY 1"


def q_subset_sums(spark: SparkSession, d: str) -> DataFrame:
    g = V.reads(spark, d).groupBy(F.concat("contig", "mate_contig", F.col("strand").cast("string")).alias("c")).agg(F.count("*").alias("n"), F.sum("mapq").cast("long").alias("q"))
    return A.subset_sums(g, "c", ["n", "q"], [30000, 1200000])


SQL_SUBSETS = V.with_(V.READS, "g AS (SELECT contig || mate_contig || strand AS c, count(*) AS n, sum(mapq) AS q FROM reads GROUP BY 1)", "b AS (SELECT *, row_number() OVER (ORDER BY c) - 1 AS bit FROM g)") + (
    "SELECT string_agg(c, '+' ORDER BY c) AS subset, CAST(sum(n) AS BIGINT) AS n, CAST(sum(q) AS BIGINT) AS q FROM range(1, (SELECT CAST(pow(2, count(*)) AS BIGINT) FROM b)) m(mask) JOIN b ON (mask >> CAST(bit AS BIGINT)) & 1 = 1 GROUP BY mask HAVING sum(n) <= 30000 AND sum(q) <= 1200000"
)


def q_subset_matches(spark: SparkSession, d: str) -> DataFrame:
    """Which of 36 classes (supplier and month, modulo 6) add up to the totals of the first and the third, counted and summed."""
    r = V.reads(spark, d)
    g = r.groupBy(F.concat(F.lit("c"), F.lpad((F.col("supp") % 6 * 6 + F.col("qname") % 6).cast("string"), 2, "0")).alias("c")).agg(F.count("*").alias("n"), F.sum("pos0").cast("long").alias("q"))
    goal = g.where(F.col("c").isin("c00", "c02")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("q"), F.lit(0)).alias("q")).first()
    found = A.subset_matches(g, "c", ["n", "q"], [goal["n"], goal["q"]])
    return found.agg(F.count("*").alias("n_subsets"), F.max(F.col("subset") == "c00+c02").alias("has_own"), F.min("q").alias("least"), F.max("q").alias("most"))


SQL_MATCHES = V.with_(V.READS, "g AS (SELECT 'c' || lpad(CAST(supp % 6 * 6 + qname % 6 AS VARCHAR), 2, '0') AS c, count(*) AS n, sum(pos0) AS q FROM reads GROUP BY 1)").rstrip() + """, r AS (SELECT *, row_number() OVER (ORDER BY c) - 1 AS k, count(*) OVER () // 2 AS h FROM g),
 goal AS (SELECT sum(n) AS n, sum(q) AS q FROM g WHERE c IN ('c00', 'c02')),
 a AS (SELECT id, coalesce(sum(n), 0) AS n, coalesce(sum(q), 0) AS q, string_agg(c, '+' ORDER BY c) AS s FROM range((SELECT CAST(pow(2, max(h)) AS BIGINT) FROM r)) m(id) LEFT JOIN r ON k < h AND (id >> CAST(k AS INT)) & 1 = 1 GROUP BY 1),
 b AS (SELECT id, coalesce(sum(n), 0) AS n, coalesce(sum(q), 0) AS q, string_agg(c, '+' ORDER BY c) AS s FROM range((SELECT CAST(pow(2, max(k - h) + 1) AS BIGINT) FROM r)) m(id) LEFT JOIN r ON k >= h AND (id >> CAST(k - h AS INT)) & 1 = 1 GROUP BY 1)
 SELECT count(*) AS n_subsets, bool_or(concat_ws('+', w.s, b.s) = 'c00+c02') AS has_own, CAST(min(w.q + b.q) AS BIGINT) AS least, CAST(max(w.q + b.q) AS BIGINT) AS most FROM (SELECT a.*, goal.n - a.n AS wn, goal.q - a.q AS wq FROM a, goal) w JOIN b ON b.n = w.wn AND b.q = w.wq"""


def q_mask_word_list(spark: SparkSession, d: str) -> DataFrame:
    """Documents masked by the 1,000 most frequent words of four letters or more, in one pass."""
    x = spread(t(spark, d, "documents").select("doc_id", "text"))
    return x.select("doc_id", F.md5(M.masked(F.col("text"), M.frequent_words(x, "text", 4, 1000)).cast("binary")).alias("digest"))


SQL_MASK_WORDS = r"""WITH tok AS (SELECT doc_id, unnest(parts) AS w, generate_subscripts(parts, 1) AS i FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[A-Za-z0-9]+|[^A-Za-z0-9]+') AS parts FROM documents)),
 top AS (SELECT w, row_number() OVER (ORDER BY count(*) DESC, w) - 1 AS k FROM tok WHERE regexp_full_match(w, '[a-z]{4,}') GROUP BY 1 ORDER BY k LIMIT 1000),
 m AS (SELECT doc_id, string_agg(CASE WHEN k IS NULL THEN tok.w ELSE '[W' || (k % 10) || ']' END, '' ORDER BY i) AS r FROM tok LEFT JOIN top ON top.w = translate(tok.w, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') GROUP BY 1)
 SELECT d.doc_id, CASE WHEN text IS NULL THEN NULL ELSE md5(coalesce(r, '')) END AS digest FROM documents d LEFT JOIN m USING (doc_id)"""


def q_common_substring(spark: SparkSession, d: str) -> DataFrame:
    """Length of the longest text that the names of neighbouring parts share."""
    p = t(spark, d, "part").select("p_partkey", "p_name", (F.col("p_partkey") + 1).alias("k"))
    q = p.select(F.col("p_partkey").alias("k"), F.col("p_name").alias("other"))
    return p.join(q, "k").select("p_partkey", F.char_length(S.longest_common("p_name", "other")).cast("long").alias("n"))


SQL_COMMON = """WITH x AS (SELECT a.p_partkey, a.p_name AS s, b.p_name AS o FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1),
 c AS (SELECT p_partkey, o, s, unnest(range(1, length(s) + 1)) AS i FROM x),
 e AS (SELECT p_partkey, o, s, i, unnest(range(1, length(s) - i + 2)) AS n FROM c)
 SELECT x.p_partkey, coalesce(m, 0) AS n FROM x LEFT JOIN (SELECT p_partkey, max(n) AS m FROM e WHERE contains(o, substr(s, i, n)) GROUP BY 1) USING (p_partkey)"""


def q_even_thinning(spark: SparkSession, d: str) -> DataFrame:
    return _thinned(V.reads(spark, d).where("supp < 8"))


def q_even_thinning_whole(spark: SparkSession, d: str) -> DataFrame:
    return _thinned(V.reads(spark, d))


def _thinned(r: DataFrame) -> DataFrame:
    k = A.even_thinning(r, "supp", [F.col("pos0"), F.col("rid")], F.col("mapq") == 70, 40)
    return k.groupBy("supp").agg(F.count("*").alias("kept"), F.max("n_before").alias("n_before"), F.count_if(F.col("mapq") == 70).alias("priority"), F.sum("rid").cast("long").alias("checksum"))


SQL_THINNING = V.with_(
    V.READS,
    "x AS (SELECT *, mapq = 70 AS p, count(*) OVER (PARTITION BY supp) AS n_before, row_number() OVER (PARTITION BY supp, mapq=70 ORDER BY pos0, rid) - 1 AS i, count(*) OVER (PARTITION BY supp, mapq=70) AS n, greatest(0, 40 - count(*) FILTER (mapq=70) OVER (PARTITION BY supp)) AS room FROM reads WHERE supp < 8)",
) + "SELECT supp, count(*) AS kept, max(n_before) AS n_before, count(*) FILTER (p) AS priority, CAST(sum(rid) AS BIGINT) AS checksum FROM x WHERE CASE WHEN p THEN i < 40 ELSE room > 0 AND (n <= room OR (i*room)//n > CASE WHEN i = 0 THEN -1 ELSE ((i-1)*room)//n END) END GROUP BY 1"


SQL_THINNING_WHOLE = SQL_THINNING.replace(" WHERE supp < 8", "")


def q_entropy_bigrams(spark: SparkSession, d: str) -> DataFrame:
    return A.pair_entropy(spread(t(spark, d, "documents").select("doc_id", "text")), "doc_id", "text").select("doc_id", "n_pairs", F.round("entropy", 6).alias("entropy"))


_CHARS = "c AS (SELECT doc_id, unnest(string_split(text, '')) AS ch, generate_subscripts(string_split(text, ''), 1) AS i FROM documents WHERE length(text) > 0)"
SQL_ENTROPY = f"WITH {_CHARS}, p AS (SELECT doc_id, ch || lead(ch) OVER (PARTITION BY doc_id ORDER BY i) AS pair FROM c), g AS (SELECT doc_id, pair, count(*) AS n FROM p WHERE pair IS NOT NULL GROUP BY 1, 2), s AS (SELECT doc_id, CAST(sum(n) AS BIGINT) AS n_pairs, sum(n*log2(n)) AS w FROM g GROUP BY 1) SELECT doc_id, n_pairs, round(log2(n_pairs) - w/n_pairs, 6) AS entropy FROM s"


def q_longest_run(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "documents").select("doc_id", A.longest_run(F.col("text")).alias("run"))


SQL_RUN = f"WITH {_CHARS}, b AS (SELECT doc_id, i, CASE WHEN ch = lag(ch) OVER (PARTITION BY doc_id ORDER BY i) THEN 0 ELSE 1 END AS s FROM c), g AS (SELECT doc_id, i, sum(s) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM b), n AS (SELECT doc_id, k, count(*) AS n FROM g GROUP BY 1, 2), m AS (SELECT doc_id, max(n) AS run FROM n GROUP BY 1) SELECT d.doc_id, coalesce(run, 0) AS run FROM documents d LEFT JOIN m USING (doc_id)"


def q_longest_dinuc(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "documents").select("doc_id", A.longest_pair_run(F.col("text")).alias("repeats"))


SQL_DINUC = f"""WITH {_CHARS}, e AS (SELECT doc_id, i, ch, lag(ch, 1) OVER w AS c1, lag(ch, 2) OVER w AS c2 FROM c WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
 f AS (SELECT doc_id, i, CASE WHEN c1 IS NOT NULL AND ch <> c1 THEN 1 ELSE 0 END AS ok, CASE WHEN c2 IS NOT NULL AND ch = c2 AND ch <> c1 THEN 0 ELSE 1 END AS s FROM e),
 g AS (SELECT doc_id, i, ok, s, sum(s) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM f), n AS (SELECT doc_id, k, min(i) AS a, max(i) AS b, max(ok) AS ok FROM g GROUP BY 1, 2),
 m AS (SELECT doc_id, max(CASE WHEN ok = 1 THEN (b - a + 2) // 2 ELSE 0 END) AS repeats FROM n GROUP BY 1) SELECT d.doc_id, coalesce(repeats, 0) AS repeats FROM documents d LEFT JOIN m USING (doc_id)"""

TERMS = [("the", "T1"), ("of the", "T2"), ("que", "Q"), ("nicht", "N")]


def q_redact_terms(spark: SparkSession, d: str) -> DataFrame:
    x = spread(t(spark, d, "documents").select("doc_id", "text")).select("doc_id", "text", T.redacted(F.col("text"), TERMS).alias("r"))
    return x.select("doc_id", (F.regexp_count("r", F.lit(r"\[T1\]"))).cast("long").alias("t1"), F.regexp_count("r", F.lit(r"\[T2\]")).cast("long").alias("t2"), F.md5(F.col("r").cast("binary")).alias("digest"))


_W = "[^A-Za-z0-9]"
#: RE2 has no lookbehind; a boundary is kept by capturing it, twice, since neighbours share one.
_R = "text"
for _t, _l in (("of[ _-]the", "T2"), ("nicht", "N"), ("the", "T1"), ("que", "Q")):
    for _ in range(2):
        _R = f"regexp_replace({_R}, '(?i)(^|{_W}){_t}($|{_W})', '\\1[{_l}]\\2', 'g')"
SQL_REDACT = f"WITH r AS (SELECT doc_id, {_R} AS r FROM documents) SELECT doc_id, CAST(len(regexp_extract_all(r, '\\[T1\\]')) AS BIGINT) AS t1, CAST(len(regexp_extract_all(r, '\\[T2\\]')) AS BIGINT) AS t2, md5(r) AS digest FROM r"


def q_secret_findings(spark: SparkSession, d: str) -> DataFrame:
    return T.findings(spread(t(spark, d, "documents").select("doc_id", "text")), "doc_id", "text").groupBy("doc_id", "rule").agg(F.count("*").alias("n"), F.min("found").alias("first"))


SQL_FINDINGS = " UNION ALL ".join(
    f"SELECT doc_id, '{n}' AS rule, count(*) AS n, min(found) AS first FROM (SELECT doc_id, unnest(regexp_extract_all(text, '{p}')) AS found FROM documents) GROUP BY 1" for n, p in T.RULES
)


def q_text_numbers_supported(spark: SparkSession, d: str) -> DataFrame:
    """Numbers in a sentence written from an order, and how many of them its values support: a value and a percentage."""
    o = t(spark, d, "orders").select("o_orderkey", (F.col("o_orderkey") % 7).alias("k"), F.floor("o_totalprice").cast("long").alias("p"))
    text = F.format_string("saw %d of %d (25%%), tool v1.2x", "k", "p")
    x = o.select("o_orderkey", "k", F.explode(T.numbers(text)).alias("v"))
    ok = T.supported(F.col("v"), F.array(F.col("k").cast("double"), F.lit(0.25)))
    return x.groupBy("o_orderkey").agg(F.count("*").alias("n"), F.count_if(ok).alias("supported"), F.sum("v").cast("long").alias("total"))


SQL_NUMBERS = "SELECT o_orderkey, 3::BIGINT AS n, 2::BIGINT AS supported, CAST(o_orderkey % 7 + floor(o_totalprice) + 25 AS BIGINT) AS total FROM orders"


def q_quote_verbatim(spark: SparkSession, d: str) -> DataFrame:
    """Whether the first twelve characters of a turn come verbatim in the turn before, and the number of its lines."""
    c = t(spark, d, "conversations")
    prev = c.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("before"))
    x = c.join(prev, ["conv_id", "turn"], "left")
    return x.select("conv_id", "turn", F.coalesce(F.contains("before", F.substring("text", 1, 12)), F.lit(False)).alias("quoted"), F.size(F.split("text", "\n")).cast("long").alias("n_lines"))


SQL_QUOTE = "SELECT c.conv_id, c.turn, coalesce(contains(p.text, substr(c.text, 1, 12)), false) AS quoted, len(string_split(c.text, chr(10))) AS n_lines FROM conversations c LEFT JOIN conversations p ON p.conv_id = c.conv_id AND p.turn + 1 = c.turn"


def q_quote_verbatim_whole(spark: SparkSession, d: str) -> DataFrame:
    """Whether the whole of a turn comes verbatim in the turn before, and the number of its lines."""
    c = t(spark, d, "conversations")
    prev = c.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("before"))
    x = c.join(prev, ["conv_id", "turn"], "left")
    return x.select("conv_id", "turn", F.coalesce(F.contains("before", "text"), F.lit(False)).alias("quoted"), F.size(F.split("text", "\n")).cast("long").alias("n_lines"))


SQL_QUOTE_WHOLE = SQL_QUOTE.replace("substr(c.text, 1, 12)", "c.text")


def q_sentence_polarity(spark: SparkSession, d: str) -> DataFrame:
    s = t(spark, d, "conversations").select("conv_id", "turn", F.explode(F.split("text", "\n")).alias("s"))
    return R.polarity(s, ["conv_id"], "s", " en ", "que", "est").groupBy("conv_id", "polarity").agg(F.count("*").alias("n"))


_LAST = "CASE WHEN instr(b, '{0}') > 0 THEN length(b) - instr(reverse(b), reverse('{0}')) - length('{0}') + 2 ELSE 0 END"
SQL_POLARITY = f"""WITH s AS (SELECT conv_id, lower(unnest(string_split(text, chr(10)))) AS s FROM conversations), k AS (SELECT conv_id, substr(s, 1, instr(s, ' en ') - 1) AS b FROM s WHERE instr(s, ' en ') > 0),
 p AS (SELECT conv_id, {_LAST.format("que")} AS p, {_LAST.format("est")} AS n FROM k) SELECT conv_id, CASE WHEN p = 0 AND n = 0 THEN 'none' WHEN p > n THEN 'positive' ELSE 'negative' END AS polarity, count(*) AS n FROM p GROUP BY 1, 2"""


def q_trace_composed_values(spark: SparkSession, d: str) -> DataFrame:
    """Words of user turns that an earlier assistant turn of the conversation had used, by conversation."""
    w = t(spark, d, "conversations").select("conv_id", "turn", "role", F.explode(F.array_distinct(F.filter(F.split("text", r"[ \n]+"), lambda x: F.char_length(x) >= 6))).alias("value"))
    c = R.composed(w.where("role = 'user'"), w.where("role = 'assistant'"), "conv_id", "turn", "value")
    return c.groupBy("conv_id").agg(F.count("*").alias("n"), F.count_if("known").alias("known"))


SQL_COMPOSED = r"""WITH w AS (SELECT DISTINCT conv_id, turn, role, unnest(regexp_split_to_array(text, '[ \n]+')) AS v FROM conversations), f AS (SELECT conv_id, v, min(turn) AS first FROM w WHERE role = 'assistant' AND length(v) >= 6 GROUP BY 1, 2)
SELECT w.conv_id, count(*) AS n, count(*) FILTER (coalesce(f.first < w.turn, false)) AS known FROM w LEFT JOIN f USING (conv_id, v) WHERE role = 'user' AND length(v) >= 6 GROUP BY 1"""


def q_cost_by_model(spark: SparkSession, d: str) -> DataFrame:
    calls = t(spark, d, "events").select(F.col("event_type").alias("model"), F.floor("value").cast("long").alias("tokens"))
    prices = spark.createDataFrame([("click", 0.25), ("view", 0.5), ("purchase", 2.0)], "model string, price double")
    return R.cost(calls, prices, "model", "tokens")


SQL_COST = """WITH p(model, price) AS (VALUES ('click', 0.25::DOUBLE), ('view', 0.5), ('purchase', 2.0)), c AS (SELECT event_type AS model, CAST(floor(value) AS BIGINT) AS tokens FROM events)
SELECT c.model, count(*) AS n, CAST(sum(tokens) AS BIGINT) AS tokens, CASE WHEN count(price) = count(*) THEN sum(tokens*price) END AS cost FROM c LEFT JOIN p USING (model) GROUP BY 1"""


def q_phase_durations(spark: SparkSession, d: str) -> DataFrame:
    x = R.durations(t(spark, d, "events"), "user_id", "ts")
    return x.groupBy("event_type").agg(F.count("seconds").alias("n"), F.round(F.sum("seconds"), 2).alias("seconds"), F.count_if(F.col("seconds").isNull()).alias("open"))


SQL_PHASES = """WITH x AS (SELECT event_type, (epoch_us(lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) - epoch_us(ts)) / 1000000.0 AS s FROM events)
SELECT event_type, count(s) AS n, round(sum(s), 2) AS seconds, count(*) FILTER (s IS NULL) AS open FROM x GROUP BY 1"""


def q_universal_check(spark: SparkSession, d: str) -> DataFrame:
    return R.universal(t(spark, d, "events"), "user_id", F.col("value") < 60).select("user_id", "n", "all_hold")


SQL_UNIVERSAL = "SELECT user_id, count(*) AS n, bool_and(coalesce(value < 60, false)) AS all_hold FROM events GROUP BY 1"

def _aggs() -> list[Column]:
    return [F.count("*").alias("n"), F.sum(F.floor("value")).cast("long").alias("total")]


def q_tumbling(spark: SparkSession, d: str) -> DataFrame:
    return X.tumbling(t(spark, d, "events"), "ts", ["event_type"], "1 hour", _aggs())


SQL_TUMBLING = "SELECT time_bucket(INTERVAL 1 hour, ts) AS window_start, time_bucket(INTERVAL 1 hour, ts) + INTERVAL 1 hour AS window_end, event_type, count(*) AS n, CAST(sum(floor(value)) AS BIGINT) AS total FROM events GROUP BY 1, 2, 3"


def q_sliding(spark: SparkSession, d: str) -> DataFrame:
    return X.tumbling(t(spark, d, "events"), "ts", [], "1 hour", _aggs(), "15 minutes")


SQL_SLIDING = "WITH w AS (SELECT time_bucket(INTERVAL 15 minute, ts) - k * INTERVAL 15 minute AS window_start, value FROM events, range(0, 4) r(k)) SELECT window_start, window_start + INTERVAL 1 hour AS window_end, count(*) AS n, CAST(sum(floor(value)) AS BIGINT) AS total FROM w GROUP BY 1, 2"


def q_session(spark: SparkSession, d: str) -> DataFrame:
    return X.sessions(t(spark, d, "events"), "ts", ["user_id"], "6 hours", _aggs())


SQL_SESSION = """WITH a AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL 6 hour THEN 0 ELSE 1 END AS s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), b AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM a)
SELECT min(ts) AS session_start, max(ts) + INTERVAL 6 hour AS session_end, user_id, count(*) AS n, CAST(sum(floor(value)) AS BIGINT) AS total FROM b GROUP BY user_id, k"""


def q_stream_counters(spark: SparkSession, d: str) -> DataFrame:
    return X.counters(t(spark, d, "events"), F.col("event_type"))


SQL_COUNTERS = "SELECT event_type AS key, count(*) AS n FROM events GROUP BY 1"


def q_provenance_state(spark: SparkSession, d: str) -> DataFrame:
    e = t(spark, d, "events")
    calls = e.select((F.col("user_id") % 10).alias("session"), F.substring("event_type", 1, 1).alias("chrom"), F.floor("value").cast("long").alias("pos"), F.struct("ts", "event_id").alias("ord"), F.col("event_type").alias("label"))
    return X.provenance(calls)


SQL_PROVENANCE = "SELECT user_id % 10 AS session, substr(event_type, 1, 1) AS chrom, CAST(floor(value) AS BIGINT) AS pos, arg_min(event_type, (ts, event_id)) AS first_label, count(*) AS n FROM events GROUP BY 1, 2, 3"


def q_provenance_range(spark: SparkSession, d: str) -> DataFrame:
    """Every third event asks where its position, or else the range around it, was recorded before by its user."""
    e = t(spark, d, "events")
    at, asks = F.floor("value").cast("long"), F.col("event_id") % 3 == 0
    calls = e.select(
        F.col("user_id").cast("string").alias("session"),
        F.col("event_id").cast("long").alias("ord"),
        F.substring("event_type", 1, 1).alias("chrom"),
        F.when(F.col("event_id") % 6 != 0, at).alias("pos"),
        F.when(asks, at - 4).alias("start"),
        F.when(asks, at + 4).alias("end"),
        F.when(~asks, F.concat(F.col("event_type"), F.lit("#"), F.col("event_id"))).alias("label"),
    )
    return Y.answered(calls)


SQL_PROVENANCE_RANGE = """WITH e AS (SELECT CAST(user_id AS VARCHAR) AS session, event_id AS ord, substr(event_type, 1, 1) AS chrom, CAST(floor(value) AS BIGINT) AS p, event_type || '#' || event_id AS label FROM events),
 q AS (SELECT * FROM e WHERE ord % 3 = 0), r AS (SELECT * FROM e WHERE ord % 3 <> 0),
 x AS (SELECT q.session, q.ord, r.p, min(r.ord) AS turn, arg_max(r.label, r.ord) AS label, any_value(q.p) AS own FROM q JOIN r ON r.session = q.session AND r.chrom = q.chrom AND r.ord < q.ord AND r.p BETWEEN q.p - 4 AND q.p + 4 GROUP BY 1, 2, 3),
 b AS (SELECT session, ord, arg_min({'at': p, 'label': label}, CASE WHEN p = own AND ord % 6 <> 0 THEN -1 ELSE turn END) AS m FROM x GROUP BY 1, 2)
 SELECT q.session, q.ord, CASE WHEN m IS NULL THEN 'caller_supplied' ELSE 'candidate_set' END AS source, m.at AS at, m.label AS label FROM q LEFT JOIN b USING (session, ord)"""


def q_position_mentions(spark: SparkSession, d: str) -> DataFrame:
    """Mb and grouped mentions written from orders, found again, and matched to their own position by the interval."""
    o = t(spark, d, "orders").select("o_orderkey", F.floor("o_totalprice").cast("long").alias("p"))
    text = F.concat(F.lit("at "), F.format_string("%.3f", F.col("p") / 1000.0), F.lit(" kb; read "), F.format_string("%,d", "p"), F.lit("."))
    m = o.select("o_orderkey", "p", F.explode(T.mentions(text)).alias("m"))
    return m.groupBy("o_orderkey").agg(F.count("*").alias("mentions"), F.count_if(F.col("p").between(F.col("m.lo") - 0.5, F.col("m.hi") + 0.5)).alias("matched"))


SQL_MENTIONS = "SELECT o_orderkey, CASE WHEN floor(o_totalprice) >= 1000 THEN 2 ELSE 1 END::BIGINT AS mentions, CASE WHEN floor(o_totalprice) >= 1000 THEN 2 ELSE 1 END::BIGINT AS matched FROM orders"


def q_alignment_fields(spark: SparkSession, d: str) -> DataFrame:
    """CIGARs, SA tags and ALTs written from line items, parsed by the expressions."""
    li = t(spark, d, "lineitem").withColumns({"q": F.floor("l_quantity").cast("long"), "n": F.col("l_linenumber").cast("long")})
    cigar = F.concat(F.col("n").cast("string"), F.lit("S"), F.col("q").cast("string"), F.lit("M"), F.col("n").cast("string"), F.lit("D"), F.lit("7M5H"))
    sa = F.concat(F.lit("chr"), F.col("n").cast("string"), F.lit(","), F.col("l_orderkey").cast("string"), F.lit(",+,30M70S,"), F.col("q").cast("string"), F.lit(",0;bad,1,+;"))
    alt = F.concat(F.lit("N["), F.lit("chr"), F.col("n").cast("string"), F.lit(":"), F.col("l_orderkey").cast("string"), F.lit("["))
    # Columns of their own, so that each text is read once.
    li, ops, seg = li.withColumns({"ops": operations(cigar), "seg": segments(sa)}), F.col("ops"), F.col("seg")
    x = li.select("l_orderkey", "n", reference_length(ops).alias("ref_len"), clips(ops, "SH").alias("c"), overlap(blocks(F.col("l_orderkey"), ops), F.col("l_orderkey") + 5, F.col("l_orderkey") + 30).alias("inside"), F.size(seg).alias("segs"), F.get(seg, F.lit(0)).alias("s"), breakend(alt).alias("b"))
    return x.select(F.col("l_orderkey").cast("long").alias("l_orderkey"), "n", "ref_len", F.col("c.left").alias("clip_left"), F.col("c.right").alias("clip_right"), "inside", F.col("segs").cast("long").alias("segs"), F.col("s.pos").alias("sa_pos"), F.col("s.mapq").cast("long").alias("sa_mapq"), F.col("b.chrom").alias("alt_chrom"), F.col("b.pos").alias("alt_pos"), F.col("b.orientation").alias("orientation"), flipped(F.col("b.orientation")).alias("flipped"))


SQL_ALIGN = """WITH x AS (SELECT CAST(l_orderkey AS BIGINT) AS k, CAST(l_linenumber AS BIGINT) AS n, CAST(floor(l_quantity) AS BIGINT) AS q FROM lineitem)
SELECT k AS l_orderkey, n, q+n+7 AS ref_len, n AS clip_left, 5::BIGINT AS clip_right, greatest(0, least(q, 30) - 5) + greatest(0, least(q+n+7, 30) - greatest(q+n, 5)) AS inside, 1::BIGINT AS segs, k AS sa_pos, q AS sa_mapq, 'chr' || n AS alt_chrom, k AS alt_pos, '3to5' AS orientation, '5to3' AS flipped FROM x"""


def q_contig_names(spark: SparkSession, d: str) -> DataFrame:
    names = F.array(*[F.lit(x) for x in ("chr1", "chr1_KI270706v1_random", "chrX", "chrUn_KI270302v1", "HLA-A*01:01", "chrM", "hs37d5", "chr6_GL000250v2_alt")])
    x = V.reads(spark, d).select(F.get(names, (F.col("rid") % 8).cast("int")).alias("name"))
    return x.groupBy(primary(F.col("name")).alias("primary"), contig_class(F.col("name")).alias("class")).agg(F.count("*").alias("n"))


SQL_NAMES = V.with_(
    V.READS,
    "m(i, p, c) AS (VALUES (0, 'chr1', 'primary'), (1, 'chr1', 'random'), (2, 'chrX', 'primary'), (3, 'chrUn_KI270302v1', 'unplaced'), (4, 'HLA-A*01:01', 'hla'), (5, 'chrM', 'mitochondrial'), (6, 'hs37d5', 'decoy'), (7, 'chr6', 'alt'))",
) + 'SELECT p AS "primary", c AS class, count(*) AS n FROM reads JOIN m ON rid % 8 = i GROUP BY 1, 2'


def q_sequence_helpers(spark: SparkSession, d: str) -> DataFrame:
    p = t(spark, d, "part")
    seq = F.translate(F.upper("p_name"), "BDEFHIJKLMNOPQRSUVWXYZ _#0123456789", "ACGTACGTACGTACGTACGTACGTACGTACGTACG")
    return p.select(F.col("p_partkey").cast("long").alias("p_partkey"), reverse_complement(seq).alias("rc"), requantised(F.col("p_size"), [2, 12, 23, 37]).cast("long").alias("bin"))


SQL_SEQ = """WITH s AS (SELECT p_partkey, p_size, translate(upper(p_name), 'BDEFHIJKLMNOPQRSUVWXYZ _#0123456789', 'ACGTACGTACGTACGTACGTACGTACGTACGTACG') AS q FROM part)
SELECT CAST(p_partkey AS BIGINT) AS p_partkey, reverse(translate(q, 'ACGTN', 'TGCAN')) AS rc, CAST(arg_min(b, (abs(p_size-b), b)) AS BIGINT) AS bin FROM s, unnest([2, 12, 23, 37]) u(b) GROUP BY p_partkey, q"""


def q_fisher(spark: SparkSession, d: str) -> DataFrame:
    g = V.reads(spark, d).groupBy("supp").agg(*[F.count_if(c).alias(n) for n, c in (("a", (F.col("strand") == 0) & (F.col("mate_contig") == "O")), ("b", (F.col("strand") == 0) & (F.col("mate_contig") == "F")), ("c", (F.col("strand") == 1) & (F.col("mate_contig") == "O")), ("d", (F.col("strand") == 1) & (F.col("mate_contig") == "F")))])
    return g.select("supp", F.round(S.fisher("a", "b", "c", "d"), 6).alias("p"), F.round(S.binomial(F.col("a"), F.col("a") + F.col("b"), F.lit(0.5)), 6).alias("cdf"))


def q_smith_waterman(spark: SparkSession, d: str) -> DataFrame:
    p = t(spark, d, "part").select("p_partkey", "p_name", (F.col("p_partkey") + 1).alias("k"))
    q = p.select(F.col("p_partkey").alias("k"), F.col("p_name").alias("other"))
    return p.join(q, "k").select("p_partkey", S.smith_waterman("p_name", "other").alias("score"))


def q_exploded_partner_reads(spark: SparkSession, d: str) -> DataFrame:
    """Per fragment: distinct partners of its segments of enough quality, and entries; malformed qualities pass."""
    r = V.reads(spark, d).withColumn("sa", F.concat_ws(",", F.concat(F.lit("c"), F.col("supp") % 6), F.col("pos0"), F.lit("+"), F.lit("10M"), F.when(F.col("rid") % 11 == 0, F.lit("x")).otherwise(F.col("mapq").cast("string"))))
    e = r.select("qname", F.explode(F.filter(segments(F.col("sa"), 2), lambda s: F.coalesce(s["mapq"] >= 20, F.lit(True)))).alias("s"))
    return e.groupBy("qname").agg(F.count("*").alias("entries"), F.countDistinct("s.chrom").alias("partners"))


SQL_EXPLODED = V.with_(V.READS) + "SELECT qname, count(*) AS entries, count(DISTINCT supp % 6) AS partners FROM reads WHERE rid % 11 = 0 OR mapq >= 20 GROUP BY 1"


def q_classify_locus(spark: SparkSession, d: str) -> DataFrame:
    p = t(spark, d, "part")
    c = F.when(F.col("p_size") < 10, "low_mappability").when(F.col("p_retailprice") % 7 < 2, "repeat_adjacent").when(F.col("p_size") > 20, "clean_unique").otherwise("unclassified")
    rank = {"low_mappability": 3, "repeat_adjacent": 2, "unclassified": 1, "clean_unique": 0}
    r = F.coalesce(*[F.when(c == k, F.lit(v)) for k, v in rank.items()])
    worst = p.select("p_brand", r.alias("r")).groupBy("p_brand").agg(F.max("r").alias("worst"), F.count_if(F.col("r") == 0).alias("clean"))
    return worst.select("p_brand", F.col("worst").cast("long").alias("worst"), "clean")


SQL_CLASSIFY = "WITH c AS (SELECT p_brand, CASE WHEN p_size < 10 THEN 3 WHEN p_retailprice % 7 < 2 THEN 2 WHEN p_size > 20 THEN 0 ELSE 1 END AS r FROM part) SELECT p_brand, CAST(max(r) AS BIGINT) AS worst, count(*) FILTER (r = 0) AS clean FROM c GROUP BY 1"

QUERIES = {
    "q_histogram": (q_histogram, SQL_HISTOGRAM),
    "q_class_crosstab": (q_class_crosstab, SQL_CROSSTAB),
    "q_spread_median_mad": (q_spread_median_mad, SQL_SPREAD),
    "q_index_quantiles": (q_index_quantiles, SQL_QUANTILES),
    "q_singletons_recurrent": (q_singletons_recurrent, SQL_SINGLETONS),
    "q_majority_vote": (q_majority_vote, SQL_VOTE),
    "q_counterfactual_tally": (q_counterfactual_tally, SQL_COUNTER),
    "q_spanning_groups": (q_spanning_groups, SQL_SPANNING),
    "q_remove_inject": (q_remove_inject, SQL_INJECT),
    "q_set_diff": (q_set_diff, SQL_SETDIFF),
    "q_pearson_guarded": (q_pearson_guarded, SQL_PEARSON),
    "q_subset_sums": (q_subset_sums, SQL_SUBSETS),
    "q_subset_matches": (q_subset_matches, SQL_MATCHES),
    "q_mask_word_list": (q_mask_word_list, SQL_MASK_WORDS),
    "q_common_substring": (q_common_substring, SQL_COMMON),
    "q_even_thinning": (q_even_thinning, SQL_THINNING),
    "q_even_thinning_whole": (q_even_thinning_whole, SQL_THINNING_WHOLE),
    "q_entropy_bigrams": (q_entropy_bigrams, SQL_ENTROPY),
    "q_longest_run": (q_longest_run, SQL_RUN),
    "q_longest_dinuc": (q_longest_dinuc, SQL_DINUC),
    "q_redact_terms": (q_redact_terms, SQL_REDACT),
    "q_secret_findings": (q_secret_findings, SQL_FINDINGS),
    "q_text_numbers_supported": (q_text_numbers_supported, SQL_NUMBERS),
    "q_quote_verbatim": (q_quote_verbatim, SQL_QUOTE),
    "q_quote_verbatim_whole": (q_quote_verbatim_whole, SQL_QUOTE_WHOLE),
    "q_sentence_polarity": (q_sentence_polarity, SQL_POLARITY),
    "q_trace_composed_values": (q_trace_composed_values, SQL_COMPOSED),
    "q_cost_by_model": (q_cost_by_model, SQL_COST),
    "q_phase_durations": (q_phase_durations, SQL_PHASES),
    "q_universal_check": (q_universal_check, SQL_UNIVERSAL),
    "q_tumbling": (q_tumbling, SQL_TUMBLING),
    "q_sliding": (q_sliding, SQL_SLIDING),
    "q_session": (q_session, SQL_SESSION),
    "q_stream_counters": (q_stream_counters, SQL_COUNTERS),
    "q_provenance_state": (q_provenance_state, SQL_PROVENANCE),
    "q_provenance_range": (q_provenance_range, SQL_PROVENANCE_RANGE),
    "q_position_mentions": (q_position_mentions, SQL_MENTIONS),
    "q_alignment_fields": (q_alignment_fields, SQL_ALIGN),
    "q_contig_names": (q_contig_names, SQL_NAMES),
    "q_sequence_helpers": (q_sequence_helpers, SQL_SEQ),
    "q_exploded_partner_reads": (q_exploded_partner_reads, SQL_EXPLODED),
    "q_classify_locus": (q_classify_locus, SQL_CLASSIFY),
    "q_fisher": (q_fisher, ""),
    "q_smith_waterman": (q_smith_waterman, ""),
}
