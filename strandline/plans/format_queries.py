"""Driver queries of the readers: the driver's tables are written as files of each format to the shared folder and read again."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..graph import shared_folder
from ..sources import containers, sinks
from ..sources import text_formats as X
from . import views as V
from .review_queries import RECORDS, contigs, records
from .views import table as t


def put(rows: DataFrame, value: Column) -> str:
    """Path of a folder of text files, a line for each row."""
    path = f"{shared_folder(rows.sparkSession)}/formats-{uuid.uuid4().hex[:12]}"
    rows.select(value.cast("string").alias("value")).write.text(path)
    return path


def tabs(*parts: Column | str) -> Column:
    return F.concat_ws("\t", *[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def q_read_sam(spark: SparkSession, d: str) -> DataFrame:
    own = records(spark, d).withColumns({"tlen": F.lit(0), "seq": F.lit("*"), "qual": F.lit("*")})
    path = f"{shared_folder(spark)}/formats-{uuid.uuid4().hex[:12]}"
    sinks.write_sam(own, contigs(spark), path)
    x = X.sam(spark, path)
    return x.groupBy("contig").agg(
        F.count("*").alias("n"), F.sum("pos0").alias("starts"), F.sum("end0").alias("ends"), F.sum("flag").alias("flags"), F.count("mate_contig").alias("mates"),
        F.count_if(F.map_contains_key("tags", "SA")).alias("split"), F.min(F.element_at("tags", F.lit("SA"))).alias("first_sa"),
    )


SQL_SAM = V.with_(RECORDS) + (
    "SELECT contig, count(*) AS n, CAST(sum(pos0) AS BIGINT) AS starts, CAST(sum(end0) AS BIGINT) AS ends, CAST(sum(flag) AS BIGINT) AS flags, count(mate_contig) AS mates, count(sa_chrom) AS split, min(sa_chrom || ',' || sa_pos || ',+,40M,' || sa_mapq || ',0;') AS first_sa FROM r GROUP BY 1"
)


def q_read_header(spark: SparkSession, d: str) -> DataFrame:
    n = t(spark, d, "nation")
    lines = F.explode(F.array(tabs("@SQ", F.concat(F.lit("SN:"), "n_name"), F.concat(F.lit("LN:"), F.col("n_nationkey") * 1000)), tabs("@RG", F.concat(F.lit("ID:g"), "n_nationkey"), F.concat(F.lit("SM:a:"), "n_regionkey")), tabs("@CO", "none")))
    h = X.header_records(spark, put(n.select(lines.alias("v")), F.col("v")))
    return h.select("kind", F.coalesce(h.fields["SN"], h.fields["ID"]).alias("name"), h.fields["LN"].cast("long").alias("length"), h.fields["SM"].alias("sample"))


SQL_HEADER = "SELECT 'SQ' AS kind, n_name AS name, CAST(n_nationkey * 1000 AS BIGINT) AS length, NULL AS sample FROM nation UNION ALL SELECT 'RG', 'g' || n_nationkey, NULL, 'a:' || n_regionkey FROM nation"


def q_read_vcf(spark: SparkSession, d: str) -> DataFrame:
    """Junctions as breakends that name their partner in INFO, or in ALT, or by END on the same chromosome."""
    j, k = V.junctions(spark, d), F.col("id") % 3
    alt = F.when(k == 1, F.concat(F.lit("N["), "chrom2", F.lit(":"), F.col("pos2").cast("string"), F.lit("["))).otherwise("<SV>")
    info = F.when(k == 0, F.concat(F.lit("SVTYPE=BND;CHR2="), "chrom2", F.lit(";POS2="), F.col("pos2").cast("string"), F.lit(";CT="), "orientation")).when(k == 1, "SVTYPE=BND;PRECISE").otherwise(F.concat(F.lit("SVTYPE=DEL;END="), F.col("pos2").cast("string"), F.lit(";X=a=b")))
    line = tabs(F.col("chrom1"), F.col("pos1"), F.concat(F.lit("J"), "id"), "N", alt, ".", F.when(F.coalesce("pass", F.lit(False)), "PASS").otherwise("LowQual"), F.concat(info, F.lit(";PE="), F.coalesce(F.col("pe"), F.lit(0)).cast("string"), F.lit(";PE=9")))
    x = X.junction_rows(X.vcf(spark, put(j, line)))
    return x.select(F.substring("caller_id", 2, 20).cast("long").alias("id"), "chrom1", "pos1", "chrom2", "pos2", "svtype", "filter", "pe", "precise")


SQL_VCF = V.with_(V.JUNCTIONS) + (
    "SELECT id, chrom1, pos1, CASE WHEN id % 3 = 2 THEN chrom1 ELSE chrom2 END AS chrom2, pos2, CASE WHEN id % 3 = 2 THEN 'DEL' ELSE 'BND' END AS svtype, CASE WHEN coalesce(pass, false) THEN 'PASS' ELSE 'LowQual' END AS filter, coalesce(pe, 0) AS pe, CASE WHEN id % 3 = 1 THEN true END AS precise FROM junctions"
)


def q_read_mask(spark: SparkSession, d: str) -> DataFrame:
    p = t(spark, d, "part")
    line = F.when(F.col("p_partkey") % 10 == 0, F.concat(F.lit("# "), "p_name")).when(F.col("p_partkey") % 10 == 1, F.concat(F.lit("c"), F.col("p_partkey").cast("string"))).otherwise(F.concat_ws(" ", F.concat(F.lit("c"), (F.col("p_partkey") % 7).cast("string")), F.col("p_partkey").cast("string"), (F.col("p_partkey") + F.col("p_size")).cast("string")))
    return X.mask(spark, put(p, line)).groupBy("is_whole").agg(F.count("*").alias("n"), F.sum(F.col("end") - F.col("start")).alias("bases"), F.countDistinct("contig").alias("contigs"))


SQL_MASK = "SELECT p_partkey % 10 = 1 AS is_whole, count(*) AS n, CAST(sum(CASE WHEN p_partkey % 10 <> 1 THEN p_size END) AS BIGINT) AS bases, count(DISTINCT CASE WHEN p_partkey % 10 = 1 THEN 'c' || p_partkey ELSE 'c' || p_partkey % 7 END) AS contigs FROM part WHERE p_partkey % 10 <> 0 GROUP BY 1"


def q_read_gtf(spark: SparkSession, d: str) -> DataFrame:
    p = t(spark, d, "part")
    attributes = F.concat(F.lit('gene_id "g'), F.col("p_partkey").cast("string"), F.lit('"; gene_name "a"; gene_name "'), "p_brand", F.lit('"; tag "basic"; tag "'), "p_type", F.lit('";'))
    x = X.gtf(spark, put(p, tabs("c1", "src", F.when(F.col("p_size") % 2 == 0, "gene").otherwise("exon"), F.col("p_partkey"), F.col("p_partkey") + F.col("p_size"), ".", "+", ".", attributes)))
    return x.groupBy("feature").agg(F.count("*").alias("n"), F.sum(F.col("end") - F.col("start")).alias("length"), F.min(x.attributes["gene_name"]).alias("name"), F.max(F.element_at("tags", -1)).alias("tag"))


SQL_GTF = "SELECT CASE WHEN p_size % 2 = 0 THEN 'gene' ELSE 'exon' END AS feature, count(*) AS n, CAST(sum(p_size) AS BIGINT) AS length, min(p_brand) AS name, max(p_type) AS tag FROM part GROUP BY 1"


def q_read_fastq(spark: SparkSession, d: str) -> DataFrame:
    c = t(spark, d, "customer").select(F.concat(F.lit("r"), F.col("c_custkey").cast("string")).alias("name"), F.repeat(F.lit("ACGT"), (F.col("c_custkey") % 9 + 1).cast("int")).alias("seq"), F.repeat(F.lit("@+#I"), (F.col("c_custkey") % 9 + 1).cast("int")).alias("qual"))
    path = f"{shared_folder(spark)}/formats-{uuid.uuid4().hex[:12]}"
    sinks.write_fastq(c, path, F.lit(1))
    return X.fastq(spark, path).select(F.substring("name", 2, 20).cast("long").alias("c_custkey"), F.char_length("seq").cast("long").alias("bases"), "qual")


SQL_FASTQ = "SELECT c_custkey, CAST(4 * (c_custkey % 9 + 1) AS BIGINT) AS bases, repeat('@+#I', CAST(c_custkey % 9 + 1 AS INT)) AS qual FROM customer"


def q_read_fasta(spark: SparkSession, d: str) -> DataFrame:
    """One sequence a nation, on one or two lines, and the bases of a region that crosses tiles."""
    n = t(spark, d, "nation").select("n_name", F.repeat(F.lit("ACGGT"), (F.col("n_nationkey") + 5).cast("int")).alias("s"))
    tiles = X.fasta(spark, put(n, F.concat(F.lit(">"), "n_name", F.lit(" note\n"), F.substring(F.col("s"), F.lit(1), F.lit(17)), F.lit("\n"), F.substring(F.col("s"), F.lit(18), F.char_length("s")))), 8)
    regions = n.select(F.col("n_name").alias("contig"), F.lit(6).cast("long").alias("start"), F.lit(19).cast("long").alias("end"))
    whole = tiles.groupBy("contig").agg(F.count("*").alias("tiles"), F.sum(F.char_length("seq")).cast("long").alias("bases"))
    return X.sequences(tiles, regions, 8).join(whole, "contig").select("contig", "seq", "tiles", "bases")


SQL_FASTA = "SELECT n_name AS contig, substr(repeat('ACGGT', CAST(n_nationkey + 5 AS INT)), 7, 13) AS seq, CAST(ceil(5 * (n_nationkey + 5) / 8.0) AS BIGINT) AS tiles, CAST(5 * (n_nationkey + 5) AS BIGINT) AS bases FROM nation"


def q_read_log(spark: SparkSession, d: str) -> DataFrame:
    """Phases of a run for each nation, some seconds apart, between lines of other kinds."""
    n = t(spark, d, "nation").orderBy("n_nationkey").coalesce(1)
    stamp = F.date_format(F.timestamp_seconds(F.lit(1_700_000_000) + F.col("n_nationkey") * F.col("n_nationkey") * 10), "yyyy-MMM-dd HH:mm:ss")
    x = X.log_figures(spark, put(n, F.concat(F.lit("["), stamp, F.lit("] phase "), "n_name", F.lit("\nother line"))))
    return x.select(F.expr("substring(phase, 7)").alias("n_name"), "seconds")


SQL_LOG = "SELECT n_name, CAST(CASE WHEN n_nationkey < (SELECT max(n_nationkey) FROM nation) THEN (2 * n_nationkey + 1) * 10 END AS BIGINT) AS seconds FROM nation"


def q_read_bands(spark: SparkSession, d: str) -> DataFrame:
    p = t(spark, d, "part")
    x = X.cytobands(spark, put(p, tabs(F.concat(F.lit("chr"), F.col("p_partkey") % 5), F.col("p_partkey") * 100, F.col("p_partkey") * 100 + F.col("p_size"), F.concat(F.lit("q"), F.col("p_size")), F.when(F.col("p_size") % 3 == 0, "gpos").otherwise("gneg"))))
    return x.groupBy("contig", "stain").agg(F.count("*").alias("n"), F.sum(F.col("end") - F.col("start0")).alias("bases"), F.max("band").alias("last"))


SQL_READ_BANDS = "SELECT 'chr' || p_partkey % 5 AS contig, CASE WHEN p_size % 3 = 0 THEN 'gpos' ELSE 'gneg' END AS stain, count(*) AS n, CAST(sum(p_size) AS BIGINT) AS bases, max('q' || p_size) AS last FROM part GROUP BY 1, 2"


def q_read_genes(spark: SparkSession, d: str) -> DataFrame:
    """Genes with their exons, the symbols' numbers and disorders, from three tables of one folder each."""
    p = t(spark, d, "part")
    name = F.concat(F.lit("G"), F.col("p_partkey") % 100)
    g = X.genes(spark, put(p, tabs("chr1", F.col("p_partkey"), F.col("p_partkey") + F.col("p_size"), "+", name, F.concat(F.lit("E"), F.col("p_partkey")), "protein_coding", "T1", F.concat_ws(",", F.col("p_partkey"), F.col("p_partkey") + 2, F.lit("")), F.concat_ws(",", F.col("p_partkey") + 1, F.col("p_partkey") + 3, F.lit("")))))
    m = X.mim_genes(spark, put(p.where("p_partkey <= 100").coalesce(1), tabs(F.col("p_partkey") + 600_000, F.when(F.col("p_partkey") % 4 == 0, "phenotype").otherwise("gene"), "1", name)))
    o = X.disorders(spark, put(p, tabs("1", name, "-", F.concat(F.when(F.col("p_size") % 2 == 0, "OMIM:").otherwise("OTHER:"), F.col("p_size") % 3))))
    own = g.groupBy("name").agg(F.count("*").alias("genes"), F.sum(F.size("exons")).cast("long").alias("exons"))
    x = own.join(m, own["name"] == m["symbol"], "left").drop("symbol").join(o, own["name"] == o["symbol"], "left")
    return x.select("name", "genes", "exons", F.col("mim").cast("long").alias("mim"), F.array_join("diseases", ",").alias("diseases"))


SQL_GENES = """WITH g AS (SELECT 'G' || p_partkey % 100 AS name, count(*) AS genes, CAST(2 * count(*) AS BIGINT) AS exons FROM part GROUP BY 1), m AS (SELECT 'G' || p_partkey % 100 AS name, CAST(p_partkey + 600000 AS BIGINT) AS mim FROM part WHERE p_partkey <= 100 AND p_partkey % 4 <> 0),
 o AS (SELECT 'G' || p_partkey % 100 AS name, string_agg(DISTINCT 'OMIM:' || p_size % 3, ',' ORDER BY 'OMIM:' || p_size % 3) AS diseases FROM part WHERE p_size % 2 = 0 GROUP BY 1) SELECT g.name, genes, exons, mim, diseases FROM g LEFT JOIN m USING (name) LEFT JOIN o USING (name)"""


def q_read_containers(spark: SparkSession, d: str) -> DataFrame:
    """Files of pages, some with a zero byte, as their bytes would come from a folder."""
    p = t(spark, d, "pages")
    content = F.when(F.col("page_id") % 5 == 0, F.concat(F.lit("bin\0"), "html")).otherwise(F.col("html")).cast("binary")
    x = containers.texts(p.select(F.col("page_id").cast("string").alias("path"), content.alias("content")))
    return x.select(F.col("path").cast("long").alias("page_id"), F.char_length("text").cast("long").alias("chars"))


SQL_CONTAINERS = "SELECT page_id, CASE WHEN page_id % 5 <> 0 THEN length(coalesce(html, '')) END AS chars FROM pages"


QUERIES = {
    "q_read_sam": (q_read_sam, SQL_SAM),
    "q_read_header": (q_read_header, SQL_HEADER),
    "q_read_vcf": (q_read_vcf, SQL_VCF),
    "q_read_mask": (q_read_mask, SQL_MASK),
    "q_read_gtf": (q_read_gtf, SQL_GTF),
    "q_read_fastq": (q_read_fastq, SQL_FASTQ),
    "q_read_fasta": (q_read_fasta, SQL_FASTA),
    "q_read_log": (q_read_log, SQL_LOG),
    "q_read_bands": (q_read_bands, SQL_READ_BANDS),
    "q_read_genes": (q_read_genes, SQL_GENES),
    "q_read_containers": (q_read_containers, SQL_CONTAINERS),
}
