"""Collocations, periodic runs and line dedup against brute force, on both sides of each bound, and on awkward rows."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.llm import bloom, collocations, linededup, runs
from strandline.llm.queries import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string, lang string, kept string, runs string, rank string, n string"


def documents():
    return duckdb.sql(f"select doc_id, text, lang from '{DATA}/documents.parquet'").fetchall()


def frame(spark, rows):
    """Rows (doc_id, text, lang) with further columns whose names the operators use."""
    return spark.createDataFrame([(*r, "clash", "clash", "clash", "clash") for r in rows], SCHEMA)


@pytest.fixture(scope="module")
def odd(spark):
    line = "A line of more than forty characters, with ÄÖ and a Tail"
    rows = [(i, f"  {line}\t\nshort {i}\n{line.lower()}" if i % 2 else line + "\n\n" + line, "en") for i in range(6)]
    rows += [(None, line, None), (None, line, None), (9, None, "en"), (10, "", None), (11, " \n\t\n", "de"), (3, line, "en"), (12, "la " * 50_000, "fr"), (13, "x\n" * 30_000, None)]
    rows += [(14, "é" * 39, "en"), (15, "日" * 40, "en")] * 6
    return frame(spark, rows), rows


# 11


def scored(rows, least=10, first=2000):
    """All of the contract, phrase by phrase."""
    f, total = Counter(), Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(w)
            for k in (1, 2, 3):
                f.update((lang, *w[i : i + k]) for i in range(len(w) - k + 1))
    own = {p: n for p, n in f.items() if len(p) > 2 and n >= least}
    out = []
    for (lang, *w), a in own.items():
        longer = [own.get(p, 0) for p in own if len(p) > len(w) + 1 and p[0] == lang and any(p[i : i + len(w)] == tuple(w) for i in range(1, len(p)))]
        if any(100 * n >= 50 * a for n in longer):
            continue
        cuts = [(1_000_000 * a * a // (f[lang, *w[:k]] * f[lang, *w[k:]]), k) for k in range(1, len(w))]
        s, k = min(cuts)
        out.append((lang, s, a, " ".join(w), f[lang, *w[:k]], f[lang, *w[k:]], total[lang]))
    ranked = []
    for lang in {x[0] for x in out}:
        best = sorted((x for x in out if x[0] == lang), key=lambda x: (-x[1], -x[2], x[3].encode()))[:first]
        ranked += [(lang, i + 1, p, a, left, right, n, s) for i, (_, s, a, p, left, right, n) in enumerate(best)]
    return sorted(ranked)


def small_language(seed, docs=40):
    rnd = random.Random(seed)
    some = ["aa", "Bb", "cc", "dd", "é", "日本", "x-y", "aa,", "bb.", "\t", "cc\n"]
    return [(i, " ".join(rnd.choices(some, weights=[9, 7, 5, 3, 2, 2, 1, 2, 2, 1, 1], k=rnd.randint(0, 60))), rnd.choice(["en", "en", "fr", None, ""])) for i in range(docs)] + [(99, None, "en"), (99, "aa bb " * 200, "en")]


@pytest.mark.parametrize(("head", "head_pairs"), [(1000, 1000), (5, 1000), (1000, 4), (6, 5), (0, 0)])
def test_phrases_equal_brute_force_on_both_sides_of_the_bounds(spark, head, head_pairs):
    rows = small_language(head + head_pairs)
    out = collocations.collocations(frame(spark, rows), head=head, head_pairs=head_pairs).collect()
    assert sorted(map(tuple, out)) == scored(rows) and len(out) > 20


def test_cut_to_first_and_dense_tiles(spark, monkeypatch):
    monkeypatch.setattr(collocations, "TILE", 4)
    rows = small_language(3, 120)
    out = collocations.collocations(frame(spark, rows), first=7).collect()
    assert sorted(map(tuple, out)) == scored(rows, first=7)


def test_cells_by_tile():
    rnd = np.random.default_rng(1)
    left, right = (rnd.zipf(1.3, 300_000) % 5000 for _ in range(2))
    a, b, n = collocations.cells(left, right, 5000)
    want = Counter(zip(left.tolist(), right.tolist(), strict=True))
    assert Counter(dict(zip(zip(a.tolist(), b.tolist(), strict=True), n.tolist(), strict=True))) == want and len(a) == len(want)


def test_wide_products(spark):
    n = 2_000_000_000
    row = spark.range(1).select(collocations.ratio(F.lit(n), F.lit(n + 7), F.lit(n + 1)).alias("s")).first()
    assert row.s == 1_000_000 * n * n // ((n + 7) * (n + 1))


def test_collocations_awkward(spark, odd):
    df, rows = odd
    assert sorted(map(tuple, collocations.collocations(df).collect())) == scored(rows)
    assert collocations.collocations(df.limit(0)).count() == 0 and collocations.collocations(df.where("text is null")).count() == 0


# 12


def brute_runs(w):
    out = []
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            n = j - i + q
            if n >= max(6, 4 * q) and not any(all(w[i + k] == w[i + k + p] for k in range(n - p)) for p in range(1, q)):
                out.append((i, n, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def test_runs_equal_brute_force():
    rnd = random.Random(5)
    for turn in range(400):
        texts = []
        for _ in range(rnd.randint(0, 4)):
            w = []
            for _ in range(rnd.randint(0, 6)):
                block = [rnd.choice("abcdefgh") for _ in range(rnd.choice([1, 2, 3, 5, 9]))]
                w += [block[k % len(block)] for k in range(rnd.randint(1, 7 * len(block)))] + [rnd.choice("abxyz") for _ in range(rnd.randint(0, 9))]
            texts.append(w)
        if turn % 40 == 0:
            block = [str(rnd.randint(0, 30)) for _ in range(70)]
            texts.append([block[k % 70] for k in range(rnd.randint(200, 420))] + [str(rnd.randint(0, 30)) for _ in range(50)])
        for w, (words, found) in zip(texts, runs.found_in([" ".join(w).encode() for w in texts]), strict=True):
            assert [x.decode() for x in words] == w and found == brute_runs(w)


def test_splitting_keeps_whole_runs_only():
    words = np.array([0, 1, 0, 1, 0, 1, 0, 1, 2, 0, 3, 0, 0])
    at, segment = runs.surviving(words, np.zeros(13, dtype=np.int64))
    assert at.tolist() == list(range(8)) and set(segment) == {0}
    assert not len(runs.surviving(np.arange(50), np.zeros(50, dtype=np.int64))[0])


def wanted_runs(doc_id, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(w), zlib.crc32(str(doc_id).encode())
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = brute_runs(w)
    best = min(found, key=lambda r: (-r[1], r[0], r[2])) if found else None
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    four = (best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(found), *four, sha("".join("%d,%d,%d\n" % r for r in found)), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


def test_runs_query(spark):
    rows = QUERIES["op12_runs"](spark, DATA).collect()
    want = {r[0]: r for r in (wanted_runs(i, t) for i, t, _ in documents() if len(t or "") < 6000)}
    got = {r.doc_id: tuple(r) for r in rows if r.doc_id in want}
    assert len(rows) == len(documents()) and got == want and sum(r.n_runs > 0 for r in rows) > 5


def test_runs_awkward(spark, odd):
    df, rows = odd
    out = runs.find_runs(df)
    assert out.columns == [*[c for c in df.columns if c != "runs"], "collapsed"] or set(out.columns) == {*df.columns, "collapsed"}
    out = out.collect()
    assert len(out) == len(rows)
    long = next(r for r in out if r.doc_id == 12)
    assert [tuple(x) for x in long.runs] == [(0, 50_000, 1)] and bytes(long.collapsed) == b"la"
    assert all(not r.runs and not r.collapsed for r in out if r.text is None or not r.text.strip())
    assert runs.find_runs(df.limit(0)).count() == 0
    turned = {r.doc_id: r.text for r in runs.with_turns(df).collect()}
    assert turned[9] is None and turned[10] == "" and len(turned) == len({r[0] for r in rows})


# 13


def wanted_lines(rows, least_chars=40, least_docs=5):
    def key(line):
        return re.sub("[A-Z]", lambda m: m[0].lower(), line.strip("\x20\x09\x0a\x0b\x0c\x0d"))

    docs, largest = Counter(), {}
    for i, text, *_ in rows:
        for k in {key(x) for x in (text or "").split("\n")}:
            docs[k] += 1
            largest[k] = max(largest.get(k, -(1 << 63)), -(1 << 63) if i is None else i)
    out = []
    for i, text, *_ in rows:
        lines = (text or "").split("\n")
        own = -(1 << 63) if i is None else i
        kept = [x for x in lines if len(key(x)) < least_chars or docs[key(x)] < least_docs or largest[key(x)] == own]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


@pytest.mark.parametrize("most_keys", [200_000, 0])
@pytest.mark.parametrize("filter_bytes", [1 << 20, 1])
def test_lines_equal_brute_force_with_and_without_broadcast_and_with_a_full_filter(spark, odd, most_keys, filter_bytes):
    df, rows = odd
    out = linededup.drop_repeated_lines(df.repartition(5), most_keys=most_keys, filter_bytes=filter_bytes).collect()
    got = sorted(((r.doc_id, r.n_lines, r.n_dropped, bytes(r.kept).decode()) for r in out), key=str)
    assert got == wanted_lines(rows) and sum(r[2] for r in got) > 5
    assert linededup.drop_repeated_lines(df.limit(0), most_keys=most_keys).count() == 0


def test_lines_query(spark):
    got = sorted(tuple(r) for r in QUERIES["op13_lines"](spark, DATA).collect())
    want = [(i, n, k, hashlib.sha256(t.encode()).hexdigest()) for i, n, k, t in wanted_lines(documents())]
    assert got == sorted(want)


def test_filter_never_misses():
    rnd = np.random.default_rng(2)
    h = rnd.integers(0, 1 << 63, 5000, dtype=np.uint64)
    shape = bloom.Shape.of(5000, 1 << 20)
    import pandas as pd

    parts = [bloom.sent(shape, h[:3000], h[:0]), bloom.sent(shape, h[2000:4000], h[4500:])]
    slices = [bloom.twice_seen(shape)(own) for _, own in pd.concat(parts).groupby("slice")]
    known = bloom.Filter(shape, ((int(r["slice"].iloc[0]), r["bits"].iloc[0]) for r in slices))
    has = known.has(h)
    assert has[2000:3000].all() and has[4500:].all() and has[:2000].mean() < 0.1 and has[3000:4500].mean() < 0.1


@pytest.mark.parametrize("name", ["op11_collocations", "op13_lines"])
def test_sql(spark, name):
    c = duckdb.connect()
    c.sql(f"create view documents as select * from '{DATA}/documents.parquet'")
    got = QUERIES[name](spark, DATA)
    want = c.sql(ORACLE_SQL[name])
    columns = sorted(got.columns)
    assert sorted(want.columns) == columns
    assert sorted(map(tuple, got.select(*columns).collect())) == sorted(want.select(*columns).fetchall())
