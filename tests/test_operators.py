"""Joins against brute force, ladders, statistics, text checks, streams."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from strandline import rules
from strandline.functions import statistics as S
from strandline.functions.contigs import flipped, primary, rank
from strandline.graph import components
from strandline.joins import band_join, interval_join, nearest
from strandline.operators import analysis as A
from strandline.operators import events as E
from strandline.operators import genes as G
from strandline.operators import text as T
from strandline.streaming import windows as X


@pytest.mark.parametrize("tol", [0, 3, 17])
def test_band_join(spark, tol):
    rnd = random.Random(tol)
    a = [(i, rnd.choice("xy"), rnd.randint(-50, 50), rnd.randint(0, 50)) for i in range(80)]
    b = [(i, rnd.choice("xy"), rnd.randint(-50, 50), rnd.randint(0, 50)) for i in range(80)]
    l = spark.createDataFrame(a, "i int, k string, p bigint, q bigint")
    r = spark.createDataFrame(b, "j int, m string, s bigint, t bigint")
    got = sorted((x.i, x.j) for x in band_join(l, r, [("k", "m")], [("p", "s", tol), ("q", "t", 10)]).collect())
    assert got == sorted((x[0], y[0]) for x in a for y in b if x[1] == y[1] and abs(x[2] - y[2]) <= tol and abs(x[3] - y[3]) <= 10)


@pytest.mark.parametrize("width", [1, 7, 64])
def test_interval_join(spark, width):
    rnd = random.Random(width)
    a = [(i, s := rnd.randint(-40, 100), s + rnd.randint(1, 30)) for i in range(60)]
    b = [(i, s := rnd.randint(-40, 100), s + rnd.randint(0, 30)) for i in range(60)]
    l, r = spark.createDataFrame(a, "i int, s bigint, e bigint"), spark.createDataFrame(b, "j int, u bigint, v bigint")
    spans = (F.col("s"), F.col("e")), (F.col("u"), F.col("v"))
    want = [(x[0], y[0]) for x in a for y in b if y[2] > y[1] and x[1] < y[2] and x[2] > y[1]]
    assert sorted((x.i, x.j) for x in interval_join(l, r, [], *spans, width).collect()) == sorted(want)
    assert {x.i for x in interval_join(l, r, [], *spans, width, "left_semi").collect()} == {i for i, _ in want}
    assert {x.i for x in interval_join(l, r, [], *spans, width, "left_anti").collect()} == {x[0] for x in a} - {i for i, _ in want}


def test_nearest(spark):
    p = spark.createDataFrame([(1, 100), (2, 5)], "point int, pos bigint")
    t = spark.createDataFrame([("a", 50, 90), ("b", 60, 90), ("c", 120, 130)], "name string, start bigint, end bigint")
    got = [(r.point, r.name, r.distance) for r in nearest(p, "point", t, [], F.col("pos"), F.col("end"), "left", 1000, [F.col("start")], ["name"]).collect()]
    assert got == [(1, "a", 10)]


def test_components(spark):
    rnd = random.Random(5)
    edges = [(rnd.randint(0, 120), rnd.randint(0, 120)) for _ in range(90)] + [(i, i + 1) for i in range(200, 260)] + [(500, k) for k in range(501, 560)] + [(7, 7)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {x: find(x) for x in parent}


def test_minimum_support_and_tiers(spark):
    d = spark.createDataFrame([(n, n / 100.0) for n in (1, 2, 3)], "n int, f double")
    s = {r.n: r.s for r in d.select("n", rules.ladder("discordant", F.col("f"), F.col("n"), rules.minimum_support(F.lit(500))).alias("s")).collect()}
    assert s == {1: 0.0, 2: 0.0, 3: 7.5}


def test_reciprocal_is_total_and_consistent(spark):
    g = spark.range(16).select(F.col("id").alias("a")).crossJoin(spark.range(16).select(F.col("id").alias("b"))).crossJoin(spark.range(8).select(F.col("id").alias("c")))
    rows = g.select("a", "b", "c", rules.reciprocal(F.col("a"), F.col("b"), F.col("c")).alias("v")).collect()
    assert len(rows) == 16 * 16 * 8 and all(r.v for r in rows)
    assert all((r.v == "RECIPROCAL") == (r.a >= 5 and r.b >= 5 and r.c >= 3) for r in rows)


def test_ceiling_never_below_score(spark):
    d = spark.createDataFrame([(7.5, 0.0, 15.0, 25.0), (None, 25.0, None, 0.0), (25.0, 25.0, 25.0, 0.0)], "a double, b double, c double, e double")
    parts = {"discordant": F.col("a"), "clip": F.col("b"), "split": F.col("c")}
    for r in d.select(rules.normalised(list(parts.values())).alias("s"), rules.ceiling(parts).alias("t")).collect():
        assert r.t >= r.s


def test_names(spark):
    d = spark.createDataFrame([("chr1_KI270706v1_random",), ("chrX",), ("22",), ("MT",), ("foo",)], "n string")
    got = {r.n: (r.p, r.k) for r in d.select("n", primary(F.col("n")).alias("p"), rank(F.col("n")).alias("k")).collect()}
    assert got["chr1_KI270706v1_random"][0] == "chr1" and got["chrX"][1] == 23 and got["22"][1] == 22 and got["MT"][1] == 25 and got["foo"][1] == 1000 + sum(map(ord, "foo"))
    assert spark.range(1).select(flipped(F.lit("3to5")).alias("f"), flipped(F.lit(None).cast("string")).alias("g")).first() == ("5to3", None)


def test_rearrangements(spark):
    rows = [(1, "4", 1000, "19", 5000, "3to5"), (2, "4", 1400, "19", 900000, "5to3"), (3, "4", 90_000_000, "19", 5000, "3to5"), (4, "7", 10, "7", 90, "3to5"), (5, "7", 12, "7", 95, "3to5")]
    d = spark.createDataFrame(rows, "id bigint, ca string, pa bigint, cb string, pb bigint, orientation string")
    got = {r.event: (r.members, r.pattern, r.span_b) for r in E.rearrangements(d).collect()}
    assert got[1] == ([1, 2], "reciprocal", 895000) and set(got) == {1, 3, 4, 5}


def test_gene_positions(spark):
    genes = spark.createDataFrame([(0, "1", 100, 900, "+", "GENE_A", "G1", "protein_coding", "T1", [(100, 200), (400, 500), (800, 900)]), (1, "1", 100, 900, "-", "GENE_B", "G2", "lncRNA", "T2", [(100, 200), (400, 500), (800, 900)])], "ord int, chrom string, start bigint, end bigint, strand string, name string, gene_id string, type string, transcript_id string, exons array<struct<s:bigint,e:bigint>>")
    points = spark.createDataFrame([(1, "1", 300), (2, "1", 850), (3, "1", 950)], "point int, contig string, pos bigint")
    got = {(r.point, r.name): r["where"] for r in G.at(points, genes).collect()}
    assert got == {(1, "GENE_A"): "intron 1 of 2", (1, "GENE_B"): "intron 2 of 2", (2, "GENE_A"): "exon 3 of 3", (2, "GENE_B"): "exon 1 of 3"}
    assert {(r.point, r.side, r.distance) for r in G.neighbours(points, genes).collect()} == {(3, "left", 50)}
    line = G.bed12(genes.where("name = 'GENE_A'")).first().value.split("\t")
    assert line[10] == "101,101,101" and line[11] == "0,300,700"


def test_statistics():
    assert S.fisher_exact(8, 2, 1, 5) == pytest.approx(0.0349650, abs=1e-6)
    assert S.binomial_cdf(3, 10, 0.5) == pytest.approx(sum(math.comb(10, i) for i in range(4)) / 1024)
    assert S.local_alignment("ACGTACGT", "TTACGTACGTTT") == 16
    assert S.local_alignment("", "A") == 0

    def slow(x, y, m=2, mm=-3, o=-5, e=-2):
        h = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
        best = 0
        for i in range(1, len(x) + 1):
            for j in range(1, len(y) + 1):
                gaps = [h[i - k][j] + o + (k - 1) * e for k in range(1, i + 1)] + [h[i][j - k] + o + (k - 1) * e for k in range(1, j + 1)]
                h[i][j] = max(0, h[i - 1][j - 1] + (m if x[i - 1] == y[j - 1] else mm), *gaps)
                best = max(best, h[i][j])
        return best

    rnd = random.Random(1)
    for _ in range(60):
        x, y = ("".join(rnd.choice("ACGT") for _ in range(rnd.randint(1, 14))) for _ in range(2))
        assert S.local_alignment(x, y) == slow(x, y)


def test_text(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert one(T.numbers(F.lit("read 12 of 3.5 in v1.2x and chr20"))) == [12.0, 3.5]
    assert one(T.redacted(F.lit("Ann-Lee and ann lee, Annlee"), [("ann lee", "NAME")])) == "[NAME] and [NAME], Annlee"
    assert one(T.scrubbed(F.lit("see /home/ann/x.bam and /data/run/y.vcf"))) == "see ~/x.bam and y.vcf"
    assert one(T.call_shape(F.lit('{"name": "f", "arguments": {}}'))) and not one(T.call_shape(F.lit("plain")))
    assert [(m.raw, m.lo, m.hi) for m in one(T.mentions(F.lit("1,234,567 or 1.5 Mb")))] == [("1,234,567", 1234567.0, 1234567.0), ("1.5 Mb", 1450000.0, 1550000.0)]
    assert one(T.sentences(F.lit("One. Two?\nThree"))) == ["One.", "Two?", "Three"]
    assert one(A.longest_run(F.lit("aabbbb c"))) == 4 and one(A.longest_run(F.lit(None).cast("string"))) == 0
    assert one(A.longest_pair_run(F.lit("xababab"))) == 3
    assert not one(T.checksum_valid(F.lit("123")))

    def made(first, yy, mm, dd):
        head = [int(c) for c in f"{first}{yy:02}{mm:02}{dd:02}123"]
        tail = sum(d * w for d, w in zip(head, [1, 2, 3, 4, 5, 6, 7, 8, 9, 1], strict=True)) % 11
        if tail == 10:
            tail = sum(d * w for d, w in zip(head, [3, 4, 5, 6, 7, 8, 9, 1, 2, 3], strict=True)) % 11 % 10
        return "".join(map(str, [*head, tail]))

    for first, yy, mm, dd, fine in ((3, 85, 6, 15, True), (5, 1, 1, 1, True), (1, 69, 1, 1, False), (2, 70, 1, 1, True), (7, 1, 1, 1, False), (3, 85, 13, 1, False), (3, 85, 0, 1, False), (4, 85, 6, 32, False)):
        assert one(T.identifier_valid(F.lit(made(first, yy, mm, dd)))) is fine
    assert one(T.identifier_valid(F.lit("38506151230"))) is (made(3, 85, 6, 15) == "38506151230")


def test_streams(spark, tmp_path):
    src = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    stream = spark.readStream.schema(src.schema).parquet("/root/testdata/sf0.001/", pathGlobFilter="events.parquet")
    q = X.counters(stream, F.col("event_type")).writeStream.outputMode("complete").format("memory").queryName("counted").start()
    q.processAllAvailable()
    q.stop()
    assert {(r.key, r.n) for r in spark.table("counted").collect()} == {(r.key, r.n) for r in X.counters(src, F.col("event_type")).collect()}
    w = X.tumbling(stream, "ts", ["event_type"], "1 hour", [F.count("*").alias("n")]).writeStream.outputMode("append").format("memory").queryName("windowed").start()
    w.processAllAvailable()
    w.stop()
    src = src.withColumn("ts", F.col("ts").cast("timestamp"))
    batch = {(r.window_start, r.event_type, r.n) for r in X.tumbling(src, "ts", ["event_type"], "1 hour", [F.count("*").alias("n")]).collect()}
    assert {(r.window_start, r.event_type, r.n) for r in spark.table("windowed").collect()} <= batch
    lines = tmp_path / "in"
    lines.mkdir()
    (lines / "a.txt").write_text("hello Ann Lee\n")
    r = X.redact_lines(spark.readStream.text(str(lines)), [("ann lee", "NAME")]).writeStream.format("memory").queryName("lines").start()
    r.processAllAvailable()
    r.stop()
    assert spark.table("lines").first().value == "hello [NAME]"
    with pytest.raises(ValueError):
        X.redact_lines(spark.readStream.text(str(lines)), [])
