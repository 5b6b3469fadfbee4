"""Planted records at one locus, and what each layer must count of them."""

from __future__ import annotations

import pytest

from strandline.operators import junctions as J
from strandline.operators import locus as L
from strandline.operators import reads as R

COLUMNS = "file_ord bigint, qname string, flag int, contig string, pos0 bigint, mapq int, cigar string, mate_contig string, mate_pos0 bigint, tags map<string,string>"


def frame(spark, rows):
    from pyspark.sql import functions as F

    from strandline.functions.alignments import operations, reference_length

    full = [(i, f"r{i}" if r[0] is None else r[0], *r[1:]) for i, r in enumerate(rows)]
    d = spark.createDataFrame(full, COLUMNS)
    return d.withColumn("end0", F.col("pos0") + reference_length(operations(F.col("cigar"))))


def loci(spark, *centres, contig="chr1"):
    return spark.createDataFrame([(c, contig, c) for c in centres], "locus bigint, l_contig string, centre bigint")


@pytest.fixture(scope="module")
def basic(spark):
    rows = [(None, 0x3, "chr1", 1000 + 50 * i, 60, "100M", "chr1", 1200, {}) for i in range(20)]
    rows += [(None, 0x1, "chr1", 1490 + 2 * i, 55, "100M", "chr8", 47_000_000, {}) for i in range(5)]
    rows += [(None, 0x1, "chr1", 1490, 50, "15S85M", "chr1", 1600, {}) for _ in range(3)]
    return R.prepared(frame(spark, rows)).cache()


def test_statistics(spark, basic):
    r = R.statistics(basic, loci(spark, 1500), 500).first()
    assert (r.n_reads, round(r.mean_depth, 2), round(r.mean_mapq, 2), r.low_fraction, r.forward) == (28, 2.71, 58.04, 0.0, 28)


def test_discordance_and_partners(spark, basic):
    r = R.discordance(basic, loci(spark, 1500), 500).first()
    assert r.discordant == 5 and r.partners == ["chr8:5"] and r.assessable


def test_clips(spark, basic):
    r = R.clip_piles(basic, loci(spark, 1490), 100).first()
    assert (r.total, r.consensus, r.max_at, r.left, r.right, r.side) == (3, 1490, 3, 3, 0, "left")


def test_empty_window_is_not_zero(spark, basic):
    r = R.discordance(basic, loci(spark, 900_000), 500).first()
    assert r.fraction is None and r.assessable is False
    assert R.statistics(basic, loci(spark, 900_000), 500).first().n_reads == 0


def test_all_reads_below_the_floor_give_zero(spark):
    low = R.prepared(frame(spark, [(None, 0x1, "chr1", 1000, 5, "100M", "chr8", 5, {})]))
    r = R.discordance(low, loci(spark, 1050), 100).first()
    assert r.fraction == 0.0 and r.below_mapq == 1


def test_depth_drop_out(spark):
    starts = [20 * i for i in range(50)] + [2000 + 20 * i for i in range(50)]
    reads = R.prepared(frame(spark, [(None, 0, "chr1", s, 60, "100M", None, None, {}) for s in starts]))
    full = R.depth(reads, loci(spark, 500), 500, 200)
    r = L.depth_dip(full, 1000).first()
    assert r.n_bins == 5 and r.ratio >= 0.5
    wide = R.depth(reads, loci(spark, 1500), 1500, 200)
    r = L.depth_dip(wide, 1000).first()
    assert r.n_bins == 15 and r.min_depth == 0 and r.likely_deletion
    assert all(b.covered == 0 for b in wide.collect() if 1200 <= b.bin_start and b.bin_end <= 2000)


def test_deletion_in_a_cigar_is_not_covered(spark):
    reads = R.prepared(frame(spark, [(None, 0, "chr1", 100, 60, "5M2D5M", None, None, {})]))
    bins = {b.bin_start: b.covered for b in R.depth(reads, loci(spark, 106), 6, 2).collect()}
    assert bins == {100: 2, 102: 2, 104: 1, 106: 1, 108: 2, 110: 2}


@pytest.fixture(scope="module")
def translocation(spark):
    at = 1_050_000
    rows = [(None, 0x3, "chr1", at - 20_000 + 50 * i, 60, "100M", "chr1", at, {}) for i in range(200)]
    rows += [(f"d{i}", 0x1, "chr1", at + 250 + 5 * i, 60, "100M", "chr8", 47_000_000, {}) for i in range(15)]
    rows += [(f"d{i}", 0x1, "chr8", 47_000_000 + 5 * i, 60, "100M", "chr1", at + 250, {}) for i in range(15)]
    rows += [(f"s{i}", 0x0, "chr1", at + 2 * i, 60, "70M30S", None, None, {"SA": f"chr8,{47_000_000 + 20 * i},+,30M70S,60,0;"}) for i in range(8)]
    rows += [(None, 0x0, "chr1", at - 50 + 3 * i, 60, "15S85M", None, None, {}) for i in range(5)]
    return R.prepared(frame(spark, rows)).cache()


def test_summary(spark, translocation):
    r = R.summary(translocation, loci(spark, 1_050_000), 500).first()
    assert r.discordant == 15 and r.partners == ["chr8:15"]
    assert r.split == 8 and r.split_partners == ["chr8"]
    assert (r.s_discordant, r.s_split) == (25.0, 25.0)
    assert r.strength in ("moderate", "strong") and {t.name: t.value for t in r.thresholds}["min_mapq"] == 20.0


def test_naming_of_alternates_is_not_discordance(spark):
    reads = R.prepared(frame(spark, [(None, 0x1, "chr1", 1000, 60, "100M", "chr1_KI270706v1_random", 5, {})]))
    assert R.discordance(reads, loci(spark, 1050), 100).first().discordant == 0


def test_pileup(spark):
    from pyspark.sql import functions as F

    d = frame(spark, [(None, 0, "chr1", 100, 60, "2S4M1D3M", None, None, {}), (None, 0x400, "chr1", 100, 60, "9M", None, None, {})])
    d = d.withColumns({"seq": F.lit("TTACGTGGG"), "qual": F.lit("IIIIIIIII")})
    sites = spark.createDataFrame([("chr1", p) for p in (100, 103, 104, 105)], "contig string, pos0 bigint")
    got = {(r.pos0, r.base): r.n for r in R.pileup(d, sites).collect()}
    assert got == {(100, "A"): 1, (103, "T"): 1, (105, "G"): 1}


def test_clamp(spark):
    contigs = spark.createDataFrame([("chr1", 1000)], "name string, length bigint")
    x = spark.createDataFrame([(1, "chr1", 10), (2, "chrZ", 10), (3, "chr1", 5000), (4, "chr1", -1)], "locus bigint, l_contig string, centre bigint")
    got = {r.locus: (r.error, r.start, r.end) for r in R.clamp(x, contigs, 100).collect()}
    assert got[1] == (None, 0, 110) and got[2][0] == "invalid_region" and got[3][0] == "out_of_range" and got[4][0] == "bad_parameter"


def test_junction_support(spark):
    a, b = 1_000_000, 5_000_000
    rows = []
    for i in range(6):
        rows.append((f"p{i}", 0x1 | 0x20, "chr1", a - 300 + i, 60, "100M", "chr4", b + 200 + i, {}))
        rows.append((f"p{i}", 0x1 | 0x10, "chr4", b + 200 + i, 60, "100M", "chr1", a - 300 + i, {}))
    rows.append(("one", 0x1 | 0x20, "chr1", a - 250, 60, "100M", "chr4", b + 210, {}))
    for i in range(3):
        rows.append((f"s{i}", 0x0, "chr1", a - 60, 60, "60M40S", None, None, {"SA": f"chr4,{b + 1},+,60S40M,60,0;"}))
    rows.append(("low", 0x1 | 0x20, "chr1", a - 200, 5, "100M", "chr4", b + 200, {}))
    j = spark.createDataFrame([(1, "chr1", a, "chr4", b)], "id bigint, ca string, pa bigint, cb string, pb bigint")
    s = J.scan(frame(spark, rows), j).cache()
    got = {r.orientation: (r.pairs, r.splits, r.fragments) for r in J.support(s).collect()}
    assert got == {"3to5": (6, 3, 9)}
    assert J.one_sided(s).first().n == 1
    assert {(r.end, r.kind): r.n for r in J.kinds(s).collect()}[("A", "low_mapq")] == 1
    swapped = spark.createDataFrame([(1, "chr4", b, "chr1", a)], "id bigint, ca string, pa bigint, cb string, pb bigint")
    got = {r.orientation: (r.pairs, r.splits, r.fragments) for r in J.support(J.scan(frame(spark, rows), swapped)).collect()}
    assert got == {"5to3": (6, 3, 9)}
