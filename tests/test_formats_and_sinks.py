"""Readers keep whole records and fields, sinks give back what they were given, and analysis keeps every class."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from strandline.functions import contigs as C
from strandline.operators import analysis, design, values
from strandline.operators import reads as R
from strandline.sources import sinks
from strandline.sources import text_formats as X


def put(path, text):
    path.write_text(text)
    return str(path)


def test_fastq_lines_of_any_beginning(spark, tmp_path):
    p = put(tmp_path / "a.fq", "@r1/1 x\nACGT\n+\n@III\n@r2\nGG\n+r2\n@@\n@r3\nT\n+\n+\n@cut\nA\n")
    assert [tuple(r) for r in X.fastq(spark, p).orderBy("name").collect()] == [("r1", "ACGT", "@III"), ("r2", "GG", "@@"), ("r3", "T", "+")]


def test_fastq_over_many_splits(spark, tmp_path):
    want = [(f"r{i}", "ACGT" * (i % 5 + 1), "@+IJ" * (i % 5 + 1)) for i in range(400)]
    p = put(tmp_path / "b.fq", "".join(f"@{n}\n{s}\n+\n{q}\n" for n, s, q in want))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        assert sorted(tuple(r) for r in X.fastq(spark, p).collect()) == sorted(want)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_fasta_tiles_and_regions(spark, tmp_path):
    one, two = "ACGTN" * 30, "TTGCA" * 7
    fold = lambda s, n: "\n".join(s[i : i + n] for i in range(0, len(s), n))
    p = put(tmp_path / "a.fa", f">c1 first\n{fold(one, 60)}\n>c2\n{fold(two, 11)}\n")
    tiles = X.fasta(spark, p, 64)
    assert {(r.contig, r.tile): r.seq for r in tiles.collect()} == {(c, k): s[64 * k : 64 * k + 64] for c, s in (("c1", one), ("c2", two)) for k in range(-(-len(s) // 64))}
    regions = spark.createDataFrame([("c1", 60, 70), ("c1", 0, 150), ("c2", 3, 9), ("c9", 0, 5)], "contig string, start bigint, end bigint")
    got = {(r.contig, r.start): r.seq for r in X.sequences(tiles, regions, 64).collect()}
    assert got == {("c1", 60): one[60:70], ("c1", 0): one, ("c2", 3): two[3:9], ("c9", 0): None}
    runs = sorted(tuple(r) for r in design.n_runs(tiles.where("contig = 'c1'"), 64).collect())
    assert runs == [("c1", i, i + 1) for i in range(4, 150, 5)]


def test_tags_and_info_keep_first_and_whole_values(spark, tmp_path):
    long = "z" * 1_200_000
    tags = "\t".join(f"{chr(65 + i // 36)}{'0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ'[i % 36]}:i:{i}" for i in range(900))
    p = put(tmp_path / "a.sam", f"@SQ\tSN:c1\tLN:9\n@RG\tID:g\tSM:a:b\n@PG\tID:p\tID:q\nq\t0\tc1\t1\t60\t4M\t*\t0\t0\tACGT\tIIII\tXA:Z:a:b\tXA:Z:second\tXL:Z:{long}\t{tags}\n")
    r = X.sam(spark, p).first()
    assert r.tags["XA"] == "a:b" and len(r.tags["XL"]) == len(long) and len(r.tags) == 900
    assert {(h.kind, h.fields.get("SM"), h.fields.get("ID")) for h in X.header_records(spark, p).collect()} == {("SQ", None, None), ("RG", "a:b", "g"), ("PG", None, "p")}
    p = put(tmp_path / "a.vcf", "##fileformat=x\nc1\t5\t.\tA\tT\t.\tPASS\tK=a=b=c;FLAG;K=two;E=\n")
    assert X.vcf(spark, p).first().info == {"K": "a=b=c", "FLAG": "true", "E": ""}


def test_logs(spark, tmp_path):
    p = put(tmp_path / "a.log", f"[2024-Jan-02 03:04:05] {'phase ' * 300}\nother\n[2024-Jan-02 03:05:05] two\n\tElapsed (wall clock) time (h:mm:ss or m:ss): 1:02:03\n\tMaximum resident set size (kbytes): 1186000\n")
    rows = X.log_figures(spark, p).orderBy("began").collect()
    assert len(rows[0].phase) == 1799 and [r.seconds for r in rows] == [60, None]
    assert X.resource_use(spark, p).first()[1:] == (3723.0, 1186000)


def test_subset_sums_keeps_every_class(spark):
    rows = [(f"c{i:02d}", 1, i) for i in range(18)]
    x = analysis.subset_sums(spark.createDataFrame(rows, "c string, n int, q int"), "c", ["n", "q"], [2, 99])
    got = {r.subset for r in x.collect()}
    assert len(got) == 18 + 18 * 17 // 2 and "c00+c17" in got and "c17" in got
    with pytest.raises(ValueError):
        analysis.subset_sums(spark.createDataFrame(rows, "c string, n int, q int"), "c", ["n"], [2], most=17)


def test_summary_gate_and_layers_without_reads(spark):
    schema = "file_ord bigint, qname string, flag int, contig string, pos0 bigint, mapq int, cigar string, mate_contig string, mate_pos0 bigint, tags map<string,string>"
    rows = [(i, f"g{i}", 1, "chr1", 1000 + i, 60 if i < 10 else 5, "100M", "chr2" if i < 5 else "chr1", 500, {}) for i in range(20)]
    rows += [(50 + i, f"h{i}", 1, "chr1", 50_000 + i, 60, "100M", "chr2", 500, {}) for i in range(2)]
    d = spark.createDataFrame(rows, schema).withColumn("end0", F.col("pos0") + 100)
    loci = spark.createDataFrame([(1, "chr1", 1050), (2, "chr1", 9_000_000), (3, "chr1", 50_050)], "locus bigint, l_contig string, centre bigint")
    out = {r.locus: r for r in R.subthreshold(R.summary(R.prepared(d), loci, 500)).collect()}
    assert (out[1].strength, out[1].score) == ("QUALITY-LIMITED", None) and out[1].raw > 0 and out[1].low_fraction == 0.5
    assert (out[2].strength, out[2].score, out[2].signal) == ("NOT ASSESSABLE", None, "0/0")
    assert (out[2].s_discordant, out[2].s_clip, out[2].s_split, out[2].s_depth) == (None, None, None, None)
    assert out[3].strength in ("weak", "moderate", "strong") and out[3].absence is None


def test_subthreshold_names_what_is_there(spark):
    schema = "file_ord bigint, qname string, flag int, contig string, pos0 bigint, mapq int, cigar string, mate_contig string, mate_pos0 bigint, tags map<string,string>"
    rows = [(i, f"g{i}", 3, "chr1", 10 * i, 60, "100M", "chr1", 500, {}) for i in range(1000)]
    rows += [(9000, "d", 1, "chr1", 3000, 60, "90M12S", "chr2", 500, {})]
    d = spark.createDataFrame(rows, schema).withColumn("end0", F.col("pos0") + 100)
    loci = spark.createDataFrame([(1, "chr1", 3050), (2, "chr1", 4500)], "locus bigint, l_contig string, centre bigint")
    out = {r.locus: r for r in R.subthreshold(R.summary(R.prepared(d), loci, 500, applicable=("discordant", "clip", "split"))).collect()}
    assert out[1].score == 0.0 and "1 discordant pair(s), below the 3-read minimum" in out[1].absence and "1 soft-clipped read(s)" in out[1].absence
    assert out[2].absence.startswith("No discordant pairs")


def test_resolve(spark):
    heads = spark.createDataFrame([("chr1", 9), ("2", 8), ("HLA-A*01", 7)], "name string, length bigint")
    asked = spark.createDataFrame([("1",), ("chr1",), ("chr2",), ("HLA-A*01",), ("chrZ",), (None,)], "c string")
    assert {r.c: r.name for r in C.resolve(asked, "c", heads).collect()} == {"1": "chr1", "chr1": "chr1", "chr2": "2", "HLA-A*01": "HLA-A*01", "chrZ": None, None: None}


def test_sam_round_trip(spark, tmp_path):
    p = put(tmp_path / "in.sam", "@SQ\tSN:c2\tLN:99\n@SQ\tSN:c1\tLN:99\nb\t16\tc1\t5\t60\t4M\t=\t9\t4\tACGT\tIIII\tNM:i:1\nz\t4\tc2\t7\t0\t4M\t*\t0\t0\tACGT\tIIII\na\t0\tc1\t2\t9\t4M\tc2\t3\t0\tACGT\tIIII\tXG:Z:old\n")
    own = X.sam(spark, p)
    tagged = sinks.tagged(own, F.when(F.col("flag") == 0, "1,2,3"), F.when(F.col("flag") == 0, "new"))
    out = str(tmp_path / "out")
    sinks.write_sam(tagged, X.sam_contigs(spark, p), out)
    import glob

    text = "".join(open(f).read() for f in sorted(glob.glob(f"{out}/part-*"))).splitlines()
    assert [t.split("\t")[0] for t in text] == ["@SQ", "@SQ", "z", "a", "b"] and text[3].endswith("XG:Z:new\tYC:Z:1,2,3") and text[4].endswith("NM:i:1")


def test_sinks_round_trip(spark, tmp_path):
    cases = spark.createDataFrame([("k1", [1, 2], None), ("k2", None, "t")], "id string, at array<bigint>, note string")
    sinks.save_cases(cases, f"{tmp_path}/cases")
    assert sorted(map(tuple, sinks.load_cases(spark, f"{tmp_path}/cases", "id string, at array<bigint>, note string").collect())) == [("k1", [1, 2], None), ("k2", None, "t")]
    with pytest.raises(Exception, match="(?i)exist"):
        sinks.save_cases(cases, f"{tmp_path}/cases")
    sinks.write_record(cases, f"{tmp_path}/record")
    with pytest.raises(Exception, match="(?i)exist"):
        sinks.write_record(cases, f"{tmp_path}/record")
    calls = spark.createDataFrame([(1, "depth", "{}", "r1", 1), (1, "depth", "{}", "r2", 2), (2, "split", "{}", "r3", 3)], "id int, tool string, parameters string, result string, at int")
    sinks.append_calls(calls.where("at < 2"), f"{tmp_path}/log")
    sinks.append_calls(calls.where("at >= 2"), f"{tmp_path}/log")
    ids = spark.createDataFrame([(1,), (7,)], "id int")
    assert [(r.id, r.tool, r.result) for r in sinks.call(spark, f"{tmp_path}/log", ids).collect()] == [(1, "depth", "r2")]
    p = put(tmp_path / "src.txt", "abc")
    sinks.write_table(cases.select("id"), f"{tmp_path}/table", p)
    assert spark.read.json(f"{tmp_path}/table.provenance").first().sha256 == "ba7816bf8f01cfea414140de5dae2223b00361a396177a9cb410ff61f20015ad"
    fq = spark.createDataFrame([("n", "ACG", None)], "name string, seq string, qual string")
    sinks.write_fastq(fq, f"{tmp_path}/fq", F.lit(2))
    assert [tuple(r) for r in X.fastq(spark, f"{tmp_path}/fq").collect()] == [("n", "ACG", "III")]


def test_json_values(spark):
    d = spark.createDataFrame([('{"a1": -2.5, "b": ["x 9", {"c": 3e2, "d": true}], "e": "say \\\\"7\\\\", ok"}'.replace("\\\\", "\\"),)], "j string")
    r = d.select(values.json_strings(F.col("j")).alias("s"), values.json_numbers(F.col("j")).alias("n")).first()
    assert r.s == ["x 9", 'say "7", ok'] and r.n == [-2.5, 300.0]


def test_spaced_draw_is_the_draw_one_by_one(spark):
    import random

    rnd = random.Random(2)
    rows = [(i, rnd.choice("ab"), rnd.randint(0, 5000)) for i in range(300)]
    d = spark.createDataFrame(rows, "id bigint, contig string, pos bigint")
    order = [r.id for r in d.orderBy(F.xxhash64("id", F.lit(5)), "id").collect()]
    taken = {}
    at = {i: (c, p) for i, c, p in rows}
    for i in order:
        if all(at[j][0] != at[i][0] or abs(at[j][1] - at[i][1]) > 100 for j in taken):
            taken[i] = True
    assert {r.id for r in design.spaced_draw(d, 100, 5).collect()} == set(taken)
