"""Expressions that work on batches or read each text once agree with their plain forms."""

from __future__ import annotations

import collections
import math
import random

from pyspark.sql import functions as F

from strandline.functions import statistics as S
from strandline.operators import analysis, locus


def test_alignments_of_many_pairs():
    rng = random.Random(5)
    text = lambda: "".join(rng.choice("acg\U0001f600") for _ in range(rng.choice((0, 1, 3, 12, 40))))
    x, y = [text() for _ in range(300)], [text() for _ in range(300)]
    want = [S.local_alignment(a, b) for a, b in zip(x, y, strict=True)]
    assert S.local_alignments(x, y) == S.local_alignments(x, y, cells=100) == want


def test_pair_entropy_in_numpy(spark):
    texts = [None, "", "a", "ab", "aaaa", "banana", "\U0001f600é\U0001f600é"]
    df = analysis.pair_entropy(spark.createDataFrame(list(enumerate(texts)), "i int, t string"), "i", "t")
    assert "ArrowEvalPython" in df._jdf.queryExecution().executedPlan().toString()
    want = {}
    for i, s in enumerate(texts):
        if s and len(s) > 1:
            n = collections.Counter(zip(s, s[1:], strict=False))
            want[i] = (len(s) - 1, -sum(v / (len(s) - 1) * math.log2(v / (len(s) - 1)) for v in n.values()))
    got = {r[0]: (r[1], r[2]) for r in df.collect()}
    assert got.keys() == want.keys()
    assert all(got[i][0] == want[i][0] and abs(got[i][1] - want[i][1]) < 1e-9 for i in want)


def test_pile_ties_go_to_the_least_position(spark):
    """Equal counts and equal least ids: whatever the order of rows, the least position is the consensus."""
    rows = [(1, 7, "right", p) for p in (30, 10, 20)]
    for some in (rows, rows[::-1], rows[1:] + rows[:1]):
        at = spark.createDataFrame(some, "locus int, rid bigint, side string, pos bigint").coalesce(1)
        assert [tuple(r) for r in locus.pile(at, F.col("side"), F.col("pos"), F.col("rid")).collect()] == [(1, "right", 3, 10, 1)]
        # The same rows in another order of ids than of positions.
        assert locus.pile(at.union(at), F.col("side"), F.col("pos"), F.col("rid")).first()["consensus"] == 10


def test_shared_bins_meet_reads_once(spark, monkeypatch):
    """Loci 200 bases apart share bins of 200: each read meets a span once, and all loci count it."""
    met, join = [], locus.interval_join
    monkeypatch.setattr(locus, "interval_join", lambda *a, **k: met.append(join(*a, **k)) or met[-1])
    loci = spark.range(20).select(F.col("id").alias("locus"), F.lit("c").alias("l_contig"), (F.col("id") * 200 + 5000).alias("centre"))
    reads = spark.createDataFrame([("c", 5010, 5060)], "contig string, pos0 bigint, end0 bigint")
    bins = locus.depth_bins(reads, loci, ("contig", "l_contig"), 2000, 200).where("covered > 0")
    assert {(r.bin_start, r.covered) for r in bins.collect()} == {(5000, 50)} and bins.count() == 11
    assert met[0].count() == 1


def test_breakends_match_their_pattern_once(spark):
    from strandline.functions.alignments import breakend

    forms = ["N[chr1:5[", "]chr2:7]AC", ".]3:9].", "[chrX:1[n", "N]chr1:5[", "A", "N[chr1[", "[a:1:2[", None, "N[c:99999999999999999999[", "\tN[c:1["]
    df = spark.createDataFrame(list(enumerate(forms)), "i int, a string").select("i", breakend(F.col("a")).alias("b"))
    assert "regexp_extract" not in df._jdf.queryExecution().optimizedPlan().toString()
    got = {r.i: tuple(r.b) for r in df.collect() if any(v is not None for v in r.b)}
    assert got == {0: ("chr1", 5, "3to5"), 1: ("chr2", 7, "5to3"), 2: ("3", 9, "3to3"), 3: ("chrX", 1, "5to5"), 4: ("chr1", 5, "3to3"), 9: ("c", None, "3to5")}
