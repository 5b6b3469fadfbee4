"""Order statistics and thinning of groups that hold most of all rows, against sorting."""

from __future__ import annotations

import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from strandline.operators import analysis, selection


def rows(seed, n=4000):
    """Nine tenths of the rows in one group, with ties, far values, nulls and NaN."""
    rnd = random.Random(seed)
    value = lambda: rnd.choice([rnd.random(), rnd.randint(-5, 5) * 1.0, rnd.gauss(0, 1e6), 1e300 * rnd.random(), -1.7e308, 1.7e308, 5e-324, 0.0, None, math.nan])
    return [("hot" if rnd.random() < 0.9 else rnd.choice(["a", "b", None]), value()) for _ in range(n)] + [("one", 3.0), ("none", None)]


@pytest.mark.parametrize("most", [0, 1 << 16])
def test_quantiles_of_a_hot_group(spark, monkeypatch, most):
    monkeypatch.setattr(selection, "SORTED", most)
    monkeypatch.setattr(selection, "BINS", 128)
    data = rows(most)
    at = [0.0, 0.25, 0.5, 0.9, 1.0]
    got = {(r.g, r.q): r.value for r in analysis.index_quantiles(spark.createDataFrame(data, "g string, v double"), "g", "v", at).collect()}
    want = {}
    for g in {g for g, _ in data}:
        v = sorted(x for k, x in data if k == g and x is not None and not math.isnan(x))
        want |= {(g, q): v[int(q * (len(v) - 1))] for q in at if v}
    assert got == want


def test_longs_beyond_doubles(spark, monkeypatch):
    monkeypatch.setattr(selection, "SORTED", 0)
    values = [(1 << 60) + i for i in range(50)] + [-(1 << 62), (1 << 62)]
    df = spark.createDataFrame([(1, v) for v in values], "g int, v long")
    got = selection.at_ranks(df, "g", "v", [F.lit(k) for k in (0, 1, 25, 51)]).collect()
    assert {r.turn: r.value for r in got} == {i: sorted(values)[k] for i, k in enumerate((0, 1, 25, 51))}


def test_spread_equals_statistics(spark, monkeypatch):
    monkeypatch.setattr(selection, "SORTED", 10)
    rnd = random.Random(2)
    data = [(rnd.choice("xxxxy"), rnd.randint(0, 300)) for _ in range(1500)]
    for r in analysis.spread(spark.createDataFrame(data, "g string, v long"), "g", "v", 200.0).collect():
        v = [x for g, x in data if g == r.g]
        med = statistics.median(v)
        assert (r.n, r.median, r.mad) == (len(v), med, statistics.median([abs(x - med) for x in v])) and math.isclose(r.sd, statistics.pstdev(v)) and math.isclose(r.above, sum(x > 200 for x in v) / len(v))
    assert analysis.spread(spark.createDataFrame([], "g string, v long"), "g", "v", 1.0).count() == 0


def thinned(data, cap):
    out = []
    for g in {r[0] for r in data}:
        own = sorted((r for r in data if r[0] == g), key=lambda r: r[1])
        first, rest = [r for r in own if r[2]], [r for r in own if not r[2]]
        room = max(0, cap - len(first))
        kept = rest if len(rest) <= room else [r for i, r in enumerate(rest) if room and (i == 0 or i * room // len(rest) > (i - 1) * room // len(rest))]
        out += [(*r, len(own)) for r in first[:cap] + kept]
    return sorted(out, key=str)


def test_thinning_of_a_hot_group(spark):
    rnd = random.Random(3)
    data = [("hot" if rnd.random() < 0.9 else rnd.choice(["a", "b", None]), i, rnd.random() < 0.02) for i in range(3000)]
    df = spark.createDataFrame(data, "g string, pos long, p boolean")
    for cap in (0, 7, 40, 100, 5000):
        out = analysis.even_thinning(df, "g", [F.col("pos")], F.col("p"), cap)
        assert sorted(((r.g, r.pos, r.p, r.n_before) for r in out.collect()), key=str) == thinned(data, cap)
    cells = selection.ranked(df, ["g"], [F.col("pos")])
    hot = [r["rank"] for r in cells.where("g = 'hot'").orderBy("pos").collect()]
    assert hot == list(range(len(hot)))
    dealt = df.repartitionByRange(4, "g", "pos").groupBy(F.spark_partition_id()).count().collect()
    assert max(r["count"] for r in dealt) < 0.5 * len(data)
