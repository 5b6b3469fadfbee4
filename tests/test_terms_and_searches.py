"""Masking by automaton, longest common substrings and subset searches against plainer ways."""

from __future__ import annotations

import itertools
import random
import time

import pytest
from pyspark.sql import functions as F

from strandline.functions import statistics
from strandline.operators import analysis, terms, text


def test_masking_equals_one_expression_for_each_term(spark):
    rnd = random.Random(6)
    own = sorted({(" ".join("".join(rnd.choices("abC", k=rnd.randint(1, 3))) for _ in range(rnd.randint(1, 3))).replace(" ", rnd.choice(" -_")), rnd.choice("XYZ")) for _ in range(40)})
    texts = ["".join(rnd.choices(["a", "b", "c", "ab", "C", " ", "-", "_", ". ", "é"], k=rnd.randint(0, 60))) for _ in range(300)] + ["", None]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "id long, x string")
    # Labels hold no letter of a term, so that the chain of expressions does not look into them.
    got = df.select(terms.masked(F.col("x"), own).alias("new"), text.redacted(F.col("x"), own).alias("old")).collect()
    assert len(own) >= terms.MANY and all(r.new == r.old for r in got)
    assert df.select(terms.masked(F.col("x"), [("a", "X")]).alias("r")).count() == len(texts)


def test_time_hardly_grows_with_the_list():
    rnd = random.Random(7)
    words = ["".join(rnd.choices("abcdefghij", k=8)) for _ in range(6000)]
    body = " ".join(rnd.choices(words, k=40_000))

    def took(n):
        a = terms.automaton(tuple((w, "T") for w in words[:n]))
        began = time.perf_counter()
        terms.masked_text(body, a)
        return time.perf_counter() - began

    took(5)
    assert took(5000) < 20 * took(5) + 0.5


def test_too_many_terms(spark, monkeypatch):
    monkeypatch.setattr(terms, "MOST_TERMS", 3)
    with pytest.raises(ValueError):
        terms.masked(F.lit("x"), [(str(i), "X") for i in range(4)])


def test_common_substring_equals_brute_force(spark):
    rnd = random.Random(8)
    pairs = [("".join(rnd.choices("ab日", k=rnd.randint(0, 14))), "".join(rnd.choices("ab日", k=rnd.randint(0, 14)))) for _ in range(400)]
    for x, y in pairs:
        subs = [y[i:j] for j in range(len(y) + 1) for i in range(j) if y[i:j] in x]
        assert statistics.common_substring(x, y) == max(subs, key=len, default="")
    df = spark.createDataFrame([(*p,) for p in pairs[:20]] + [(None, "a"), ("abc", None)], "x string, y string")
    assert [r.c for r in df.select(statistics.longest_common("x", "y").alias("c")).collect()] == [statistics.common_substring(x or "", y or "") for x, y in [*pairs[:20], (None, "a"), ("abc", None)]]
    long = "".join(rnd.choices("ACGT", k=50_000))
    assert len(statistics.common_substring(long, "x" + long[20_000:45_000] + "y")) == 25_000


def test_subsets_equal_trying_all(spark):
    rnd = random.Random(9)
    own = [(f"k{i:02}", rnd.randint(0, 9), rnd.choice([None, rnd.randint(-5, 9)])) for i in range(11)]
    df = spark.createDataFrame(own, "name string, a long, b long")
    for goals in ((20, 9), (0, 0), (10**9, 1)):
        want = sorted("+".join(r[0] for r in s) for k in range(12) for s in itertools.combinations(own, k) if sum(r[1] for r in s) == goals[0] and sum(r[2] or 0 for r in s) == goals[1])
        assert sorted(r.subset for r in analysis.subset_matches(df, "name", ["a", "b"], list(goals)).collect()) == want
    assert [r.subset for r in analysis.subset_matches(df.limit(0), "name", ["a"], [0]).collect()] == [""]


def test_thirty_six_classes(spark):
    own = [(f"k{i:02}", 3**i) for i in range(36)]
    df = spark.createDataFrame(own, "name string, a long")
    chosen = [0, 5, 17, 18, 35]
    found = analysis.subset_matches(df, "name", ["a"], [sum(3**i for i in chosen)]).collect()
    assert [r.subset for r in found] == ["+".join(f"k{i:02}" for i in chosen)]
    with pytest.raises(ValueError):
        analysis.subset_matches(df, "name", ["a"], [1], most=35)
