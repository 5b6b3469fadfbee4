"""Interval joins over spans of all lengths, and masks at both ends, against brute force."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from strandline.joins import ANY_LENGTH, LEVELS, _dealt, interval_join, level_of
from strandline.operators import callsets

SPANS = [("s", "e"), ("p", "q")]


def spans(seed, n, off):
    rnd = random.Random(seed)
    out = [(off + i, rnd.choice("xy"), a := rnd.randint(-5000, 200_000), a + rnd.choice([0, 1, 1, 3, 50, 256, 257, 3000, 40_000, 10**6])) for i in range(n)]
    return [*out, (off + n, "x", 100 + off, 200_000_100 + off)]


@pytest.mark.parametrize("longest", [(ANY_LENGTH, None), (None, None), (ANY_LENGTH, ANY_LENGTH), (None, ANY_LENGTH)])
def test_pairs_come_once_whatever_the_lengths(spark, longest):
    a, b = spans(1, 200, 0), spans(2, 150, 1000)
    left, right = spark.createDataFrame(a, "i long, c string, s long, e long"), spark.createDataFrame(b, "j long, d string, p long, q long")
    want = sorted((x[0], y[0]) for x in a for y in b if x[1] == y[1] and x[2] < y[3] and x[3] > y[2] and x[2] < x[3] and y[2] < y[3])
    args = (left, right, [("c", "d")], (F.col("s"), F.col("e")), (F.col("p"), F.col("q")), 256)
    out = interval_join(*args, longest=longest)
    assert out.columns == [*left.columns, *right.columns] and sorted((r.i, r.j) for r in out.collect()) == want
    semi = {r.i for r in interval_join(*args, "left_semi", longest).collect()}
    assert semi == {i for i, _ in want} and {r.i for r in interval_join(*args, "left_anti", longest).collect()} == {x[0] for x in a} - semi


def test_rows_of_one_interval_are_bounded(spark):
    one = spark.createDataFrame([(0, 200_000_000), (17, 18), (5, 300)], "s long, e long")
    for guest in (0, 1):
        n = _dealt(one, "s", "e", 256, guest, F.lit((1 << LEVELS) - 1)).groupBy("s").count().collect()
        assert max(r["count"] for r in n) <= 2 * (LEVELS + 1)
    assert [r[0] for r in one.select(level_of(F.col("e") - F.col("s"), 256)).collect()] == [7, 0, 1]


def test_empty_sides(spark):
    some = spark.createDataFrame([(1, 5)], "s long, e long")
    none = some.limit(0).toDF("p", "q")
    args = ([], (F.col("s"), F.col("e")), (F.col("p"), F.col("q")), 8)
    assert interval_join(some, none, *args, longest=(None, None)).count() == 0
    assert interval_join(some, none, *args, "left_anti", (None, None)).count() == 1


def test_masks_at_either_end_and_whole_contigs(spark):
    calls = spark.createDataFrame([(1, "a", 10, "b", 5), (2, "a", 20, "c", 5), (3, "b", 1, "w", 7), (4, "b", 99, "a", 9), (5, None, None, "b", 2)], "id long, chrom1 string, pos1 long, chrom2 string, pos2 long")
    mask = spark.createDataFrame([("a", 10, 20, False), ("w", None, None, True), ("b", 5, 6, False), ("zz", 0, 10**9, False)], "contig string, start long, end long, is_whole boolean")
    got = {r.id: (r.masked1, r.masked2, r.masked) for r in callsets.masked(calls, mask).collect()}
    assert got == {1: (True, True, True), 2: (False, False, False), 3: (False, True, True), 4: (False, False, False), 5: (False, False, False)}
    out = callsets.funnel(callsets.masked(calls, mask), [callsets.mask_step()]).first()
    assert (out.survivors, out.removed_alone) == (3, 2)
