"""Leaves of JSON texts against Python's parser."""

from __future__ import annotations

import json
import random

from pyspark.sql import functions as F

from strandline.operators import values


def leaves(v, path="$", name=None):
    if isinstance(v, dict):
        return [x for k, w in v.items() for x in leaves(w, f"{path}.{k}", k)]
    if isinstance(v, list):
        return [x for i, w in enumerate(v) for x in leaves(w, f"{path}[{i}]", name)]
    kind = "null" if v is None else "boolean" if isinstance(v, bool) else "string" if isinstance(v, str) else "number"
    return [(path, name, kind, None if v is None else json.dumps(v) if not isinstance(v, str) else v)]


def made(rnd, depth):
    kind = rnd.random()
    if depth == 0 or kind < 0.4:
        return rnd.choice([None, True, False, 7, -12, 3.5, "", ":b", 'say "9": {', "[1]", "\\", "\\\\\"", "a,\n\tb", "é日\U0001f600", "}", "{\"k\": 1}", "/"])
    if kind < 0.7:
        return [made(rnd, depth - 1) for _ in range(rnd.randint(0, 3))]
    return {f"k{i}": made(rnd, depth - 1) for i in range(rnd.randint(0, 3))}


def strings(v):
    return [x[3] for x in leaves(v) if x[2] == "string"]


def test_leaves_and_strings_equal_a_parser(spark):
    rnd = random.Random(4)
    texts = [made(rnd, d % 7) for d in range(300)] + [["a", ":b"], {"a": ":", "b:": ["c", ": d", {"e": "f:"}]}]
    rows = [(i, json.dumps(v, ensure_ascii=bool(i % 2), indent=1 if i % 5 == 0 else None)) for i, v in enumerate(texts)]
    df = spark.createDataFrame(rows, "id long, j string")
    got = {}
    for r in values.json_leaves(df, "j").collect():
        got.setdefault(r.id, []).append((r.path, r.name, r.kind, r.value))
    assert {i: sorted(x, key=str) for i, x in got.items()} == {i: sorted(leaves(v), key=str) for i, v in enumerate(texts) if leaves(v)}
    flat = {r.id: r.s for r in df.select("id", values.json_strings(F.col("j")).alias("s")).collect()}
    assert flat == {i: strings(v) for i, v in enumerate(texts)}


def test_deep_empty_broken_and_clashing(spark):
    deep = "[" * 30 + '{"x": ":"}' + "]" * 30
    rows = [(1, deep, "p"), (2, "{}", "p"), (3, None, "p"), (4, "{broken", "p"), (5, "[[], {}]", "p"), (6, '"top"', "p"), (7, '{"a": 1, "a": 2}', "p")]
    df = spark.createDataFrame(rows, "id long, value string, path string")
    got = sorted((r.id, r.path, r.name, r.kind, r.value) for r in values.json_leaves(df, "value").collect())
    assert got == [(1, "$" + "[0]" * 30 + ".x", "x", "string", ":"), (6, "$", None, "string", "top")]
    assert values.json_leaves(df.limit(0), "value").count() == 0
