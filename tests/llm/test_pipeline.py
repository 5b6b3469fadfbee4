"""The pipeline's stages against the operators' own results, and on awkward tables."""

from __future__ import annotations

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from strandline.llm import bpe, mixing, neardup, quality, secrets

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


def test_stage_list():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "neardup", "secrets", "mixing", "bpe"]


def test_stages_on_the_same_input(spark, docs):
    scores = {r.doc_id for r in quality.score(docs, quality.fit_tables(spark, DATA)).where("score >= 0.7").collect()}
    kept = quality.stage_quality(spark, docs, DATA)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == scores
    near = {r.doc_id for r in neardup.near_duplicates(docs).where("kept").collect()}
    assert {r.doc_id for r in neardup.stage_neardup(spark, docs, DATA).collect()} == near
    clean = {r.doc_id: r for r in secrets.stage_secrets(spark, docs, DATA).collect()}
    spans = {r.doc_id: r for r in secrets.scan(docs).collect()}
    for i, r in clean.items():
        text = spans[i].text
        for s in reversed(spans[i].spans):
            assert text[s.start : s.end] not in r.text or s.end - s.start < 6
        assert (r.text == text) == (not spans[i].spans) and (not spans[i].spans or r.n_chars == len(r.text))
    plan = {r.doc_id: (r.taken, r["size"]) for r in mixing.mix(docs).collect()}
    times = {}
    for r in mixing.stage_mixing(spark, docs, DATA).collect():
        times[r.doc_id] = times.get(r.doc_id, 0) + 1
    assert times == {i: n for i, (t, s) in plan.items() if (n := (int(t / s + 0.5) if s else 1))}
    ids = bpe.stage_bpe(spark, docs, DATA).collect()
    assert len(ids) == docs.count() and all(len(r.ids) == r.n_tokens for r in ids)


def test_run(spark):
    out = corpus_pipeline.run(spark, DATA)
    assert out.columns == ["doc_id", "source", "n_tokens", "ids"] and out.count() > 0


def test_stages_on_awkward_rows(spark):
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (3, "a b c password = hunter2hunter2", "en", None, 31), (3, "a b c password = hunter2hunter2", "en", None, 31)]
    d = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").withColumn("score", F.lit(1))
    for name, stage in corpus_pipeline.STAGES[1:]:
        out = stage(spark, d, DATA)
        assert out.count() >= 1, name
        assert stage(spark, d.limit(0), DATA).count() == 0, name
    assert all("hunter2" not in (r.text or "") for r in secrets.stage_secrets(spark, d, DATA).collect())


def test_neardup_stage_decides_by_row(spark):
    long = lambda name, last: " ".join(f"{name}{i}" for i in range(60)) + f" {last}"
    rows = [
        (None, long("n", "x"), "one"),
        (None, long("n", "y"), "one"),
        (None, long("n", "x"), "one"),
        (None, long("z", "x"), "two"),
        (7, long("z", "y"), "two"),
        (8, long("r", "x"), "three"),
        (8, long("r", "x"), "three"),
        (8, long("r", "x"), "three, other row"),
        (8, long("r", "y"), "three"),
        (9, long("s", "x"), "four"),
        (9, long("r", "z"), "three"),
        (None, "", "empty"),
        (None, None, "null"),
        (4, None, "null"),
        (4, None, "null"),
    ]
    d = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    got = neardup.stage_neardup(spark, d, DATA).collect()
    words = sorted((r.text[0], r.doc_id or 0) for r in got if r.text)
    assert words == [("n", 0), ("r", 8), ("s", 9), ("z", 7)]
    assert sorted((r.source, r.doc_id or 0) for r in got if not r.text) == [("empty", 0), ("null", 0), ("null", 4), ("null", 4)]
    group = [r.component_id for r in neardup.near_duplicates(d.where("source = 'two'")).collect()]
    assert group == [7, 7]
