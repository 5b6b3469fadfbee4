"""Text and binary readers, and the call set chain from a VCF to survivors."""

from __future__ import annotations

import gzip
import struct

from pyspark.sql import functions as F

from strandline.functions.alignments import breakend
from strandline.operators import callsets as C
from strandline.sources import bam
from strandline.sources import text_formats as T

HEAD = "##fileformat=VCFv4.2\n##INFO=<ID=PE,Number=1>\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\n"


def write(tmp_path, name, text):
    p = tmp_path / name
    p.write_text(text)
    return str(p)


def test_partner_convention_and_funnel(spark, tmp_path):
    rows = [
        "chr2\t3000000\tB1\tN\t<BND>\t.\tPASS\tPRECISE;SVTYPE=BND;CHR2=chr1;POS2=1000000;CT=3to5;PE=9;SR=4",
        "chr17\t5000000\tB2\tN\t<BND>\t.\tLowQual\tIMPRECISE;SVTYPE=BND;CHR2=chr1;POS2=2000000;PE=2;SR=0",
        "chr1\t7000000\tD1\tN\t<DEL>\t.\tPASS\tSVTYPE=DEL;END=7005000;PE=15;SR=6",
    ]
    r = T.vcf(spark, write(tmp_path, "a.vcf", HEAD + "\n".join(rows) + "\n"))
    c = T.convention(r).first()
    assert (c.convention, c.with_chr2_pos2) == ("chr2_pos2", 2)
    j = T.junction_rows(r)
    assert {(x.svtype, x["filter"]) for x in j.collect()} == {("BND", "PASS"), ("BND", "LowQual"), ("DEL", "PASS")}
    steps = [("PASS", F.col("filter") == "PASS"), ("PE", F.col("pe") >= 3), ("SR", F.col("sr") >= 1)]
    assert [x.survivors for x in C.funnel(j, steps).orderBy("ord").collect()] == [2, 2, 2]
    assert j.where("svtype = 'DEL'").first().pos2 == 7005000
    assert [r.key for r in T.declared_info(spark, str(tmp_path / "a.vcf")).collect()] == ["PE"]


def test_mates_make_one_junction_and_absent_support_is_null(spark, tmp_path):
    rows = ["chr2\t3000000\tm1\tN\tN[chr1:1000000[\t.\tPASS\tSVTYPE=BND;MATEID=m2", "chr1\t1000000\tm2\tN\t]chr2:3000000]N\t.\tPASS\tSVTYPE=BND;MATEID=m1;PE=4"]
    j = T.junction_rows(T.vcf(spark, write(tmp_path, "m.vcf", HEAD + "\n".join(rows) + "\n")))
    one = C.mate_pairs(j.withColumnRenamed("caller_id", "id"), F.col("mate_id")).collect()
    assert len(one) == 1 and one[0].pe == 4 and one[0].sr is None and (one[0].chrom1, one[0].chrom2) == ("chr2", "chr1")


def test_breakend_forms(spark):
    forms = {"N[chr1:5[": "3to5", "N]chr1:5]": "3to3", "[chr1:5[N": "5to5", "]chr1:5]N": "5to3", "<DEL>": None}
    d = spark.createDataFrame([(k,) for k in forms], "alt string").select("alt", breakend(F.col("alt")).alias("b"))
    assert {r.alt: r.b.orientation for r in d.collect()} == forms


def test_merging(spark):
    rows = [(1, "chr1", 1000, "chr2", 5000, "3to5", 3, 0, False), (2, "chr1", 1300, "chr2", 5200, "3to5", 9, 5, True), (3, "chr1", 1400, "chr2", 5400, "3to5", 4, 1, False), (4, "chr1", 90000, "chr2", 5000, "3to5", 1, 1, True), (5, "chr1", 1000, "chr2", 5000, "5to3", 1, 1, True)]
    d = spark.createDataFrame(rows, "id bigint, chrom1 string, pos1 bigint, chrom2 string, pos2 bigint, orientation string, pe bigint, sr bigint, pass boolean")
    got = {r.id: (r.n_merged, r.pe, r.sr) for r in C.merge(d, 500, 500).collect()}
    assert got == {2: (3, 9, 5), 4: (1, 1, 1), 5: (1, 1, 1)}
    assert C.merge(d, 0, 0).count() == 5


def test_tables(spark, tmp_path):
    m = T.mask(spark, write(tmp_path, "mask.tsv", "chr1\t0\t10000\ttelomere\nchrUn_X\n")).orderBy("is_whole").collect()
    assert [(r.contig, r.start, r.end, r.is_whole) for r in m] == [("chr1", 0, 10000, False), ("chrUn_X", None, None, True)]
    path = tmp_path / "genes.tsv.gz"
    path.write_bytes(gzip.compress(b"#h\nchr1\t100\t500\t+\tGENE_A\tG1\tprotein_coding\tT1\t100,400\t200,500\n"))
    g = T.genes(spark, str(path)).first()
    assert [(e.s, e.e) for e in g.exons] == [(100, 200), (400, 500)]
    d = T.disorders(spark, write(tmp_path, "d.txt", "#x\n1\tGENE_A\ta\tOMIM:2\n1\tGENE_A\ta\tORPHA:1\n1\tGENE_A\ta\tOTHER:1\n")).first()
    assert d.diseases == ["OMIM:2", "ORPHA:1"]
    f = T.fastq(spark, write(tmp_path, "r.fq", "@a/1\nACGT\n+\n@III\n@b\nGG\n+\nII\n")).collect()
    assert {(r.name, r.seq) for r in f} >= {("b", "GG")}
    x = T.gtf(spark, write(tmp_path, "x.gtf", 'chr1\tH\ttranscript\t1\t9\t.\t+\t.\tgene_id "G"; tag "basic"; tag "canon";\n')).first()
    assert x.attributes == {"gene_id": "G"} and x.tags == ["basic", "canon"]


def make_bam() -> bytes:
    name = b"chr1\0"
    head = b"BAM\1" + struct.pack("<i", 0) + struct.pack("<i", 1) + struct.pack("<i", len(name)) + name + struct.pack("<i", 1000)
    qname, cigar, seq = b"q1\0", struct.pack("<2I", (3 << 4) | 4, (5 << 4) | 0), bytes([0x12, 0x48, 0x12, 0x48])
    body = struct.pack("<iiBBHHHiiii", 0, 99, len(qname), 60, 0, 2, 0x1, 8, 0, 149, 50) + qname + cigar + seq + bytes([30] * 8) + b"NMC\1" + b"SAZchr2,5,+,3M,60,0;\0"
    return gzip.compress(head) + gzip.compress(struct.pack("<i", len(body)) + body)


def test_bam(spark, tmp_path):
    p = tmp_path / "x.bam"
    p.write_bytes(make_bam())
    spark.dataSource.register(bam.BamSource)
    r = spark.read.format("strandline_bam").load(str(p)).first()
    assert (r.qname, r.contig, r.pos0, r.cigar, r.seq, r.mate_pos0) == ("q1", "chr1", 99, "3S5M", "ACGTACGT", 149)
    assert r.tags == {"NM": "1", "SA": "chr2,5,+,3M,60,0;"} and r.qual == "?" * 8
    b = bam.from_binary_files(spark.read.format("binaryFile").load(str(p))).first()
    assert (b.qname, b.cigar) == ("q1", "3S5M")


def test_sam(spark, tmp_path):
    text = "@SQ\tSN:chr1\tLN:1000\nq1\t1\tchr1\t100\t60\t3S5M\t=\t150\t50\tACGTACGT\tIIIIIIII\tNM:i:1\tSA:Z:chr2,5,+,3M,60,0;\n"
    p = write(tmp_path, "x.sam", text)
    r = T.sam(spark, p).first()
    assert (r.pos0, r.end0, r.mate_contig, r.tags["NM"]) == (99, 104, "chr1", "1")
    assert T.sam_contigs(spark, p).first().length == 1000
