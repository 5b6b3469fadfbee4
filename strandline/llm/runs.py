"""Periodic runs of words, found by splitting at words that are too rare to join one.

A run is a stretch of words with smallest period q and at least ``max(6, 4 * q)`` words that no neighbour extends. Every
word of a run so comes at least four times in it. That gives, for each text on its own:

1. Splitting. A word that comes fewer than four times within its segment can be in no run, and cuts the segment there. What
   is left is counted again, segment by segment, until nothing more is cut. Whole batches of texts are cut together, by
   sorting (segment, word) once a round; prose is gone after a few rounds.
2. Lags. In a segment that survives, words equal to the one q places on make stretches, for each lag q up to a quarter of
   its length. A run needs 3q equal neighbours in a row, so of long lags only every q-th place is looked at: three hits in a
   row are a candidate, which is then measured to both ends. All lags of n words so take about n log n looks.

Rows stay where they are: no shuffle, and a worker holds a few megabytes of text, or one long text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, small_batches, table

LEAST_WORDS = 6
LEAST_TURNS = 4
#: Lags up to this are looked at in all places.
SHORT = 48


def surviving(words: np.ndarray, segment: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions that splitting leaves, and their segments, renumbered. ``words``: numbers from 0; ``segment``: the text each
    belongs to, rising."""
    at = np.arange(len(words))
    kinds = int(words.max()) + 1 if len(words) else 1
    while len(at):
        _, kind, count = np.unique(segment * kinds + words[at], return_inverse=True, return_counts=True)
        keep = count[kind] >= LEAST_TURNS
        rest = np.flatnonzero(keep)
        # A segment begins where the one before ended, or where a word between them has gone.
        new = np.ones(len(rest), dtype=bool)
        new[1:] = (np.diff(rest) > 1) | (np.diff(segment[rest]) > 0)
        number = np.cumsum(new) - 1
        long = np.bincount(number, minlength=1)[number] >= LEAST_WORDS
        if keep.all() and long.all():
            break
        at, segment = at[rest[long]], number[long]
    return at, segment


def reach(x: np.ndarray, i: int, q: int, step: int) -> int:
    """How many places from i on, in the direction of ``step``, equal the place q on."""
    n, size = 0, 64
    while True:
        if step > 0:
            a, b = i + n, min(i + n + size, len(x) - q)
        else:
            a, b = max(0, i - n - size + 1), i - n + 1
        if a >= b:
            return n
        other = x[a:b] != x[a + q : b + q]
        if step < 0:
            other = other[::-1]
        k = int(other.argmax())
        if other[k]:
            return n + k
        n += b - a
        size *= 2


def runs_of(x: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of each run of a sequence, by start, then period."""
    n = len(x)
    found: dict[tuple[int, int], int] = {}
    for q in range(1, n // LEAST_TURNS + 1):
        if q <= SHORT:
            same = np.concatenate([[False], x[q:] == x[:-q], [False]])
            edge = np.flatnonzero(same[1:] != same[:-1])
            spans = zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True)
        else:
            y = x[::q]
            same = y[1:] == y[:-1]
            spans = measured(x, q, np.flatnonzero(same[2:] & same[1:-1] & same[:-2]))
        for a, b in spans:
            # Of two periods of one stretch the smaller divides the other, and lags rise.
            if b - a + q >= max(LEAST_WORDS, LEAST_TURNS * q):
                found.setdefault((a, b - a + q), q)
    return sorted((a, length, q) for (a, length), q in found.items())


def measured(x: np.ndarray, q: int, hits: np.ndarray) -> Iterator[tuple[int, int]]:
    """Stretches of places that equal the one q on, around the places ``hits * q``, each once."""
    end = -1
    for h in hits.tolist():
        i = h * q
        if i >= end:
            end = i + reach(x, i, q, 1)
            yield i - reach(x, i - 1, q, -1), end


def found_in(texts: list[bytes]) -> list[tuple[list[bytes], list[tuple[int, int, int]]]]:
    """Words and runs of each text."""
    split = [t.split() for t in texts]
    vocabulary: dict[bytes, int] = {}
    number = vocabulary.setdefault
    words = np.array([number(w, len(vocabulary)) for s in split for w in s], dtype=np.int64)
    size = np.array([len(s) for s in split], dtype=np.int64)
    first = np.cumsum(size) - size
    at, segment = surviving(words, np.repeat(np.arange(len(split)), size))
    out: list[tuple[list[bytes], list[tuple[int, int, int]]]] = [(s, []) for s in split]
    cut = np.flatnonzero(np.diff(segment, prepend=-1)) if len(at) else []
    for part in np.split(at, cut[1:]) if len(at) else []:
        doc = int(np.searchsorted(first + size, part[0], side="right"))
        out[doc][1].extend((int(part[0] - first[doc]) + a, n, q) for a, n, q in runs_of(words[part]))
    for _, own in out:
        own.sort(key=lambda r: (r[0], r[2]))
    return out


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """Words without those that a run holds after its first turn."""
    mark = np.zeros(len(words) + 1, dtype=np.int64)
    for start, length, period in runs:
        mark[start + period] += 1
        mark[start + length] -= 1
    gone = np.cumsum(mark)[:-1] > 0
    return [w for w, g in zip(words, gone.tolist(), strict=True) if not g]


def periodic(text: Column) -> Column:
    """Struct (runs, collapsed) of each text."""

    @F.pandas_udf("runs array<struct<start: long, length: long, period: long>>, collapsed binary")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for own in batches:
            runs, texts = [], []
            for _, some in slices(own, own):
                for words, found in found_in(some):
                    runs.append([dict(zip(("start", "length", "period"), r, strict=True)) for r in found])
                    texts.append(b" ".join(collapsed(words, found) if found else words))
            yield pd.DataFrame({"runs": pd.Series(runs, dtype=object), "collapsed": pd.Series(texts, dtype=object)})

    return of(text)


def find_runs(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with runs (array of start, length, period, in words from 0, by start, then period) and collapsed (binary: the
    words that stay, joined by one space) of each text; columns of these names are replaced.

    A null text has no words and no runs; so has an empty one, and ``collapsed`` is then empty. Rows are judged one by one, so
    repeated rows get equal results, and an empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    found = docs.withColumn("_found", periodic(F.coalesce(F.col(text).cast("binary"), F.lit(b""))))
    return found.withColumns({"runs": F.col("_found.runs"), "collapsed": F.col("_found.collapsed")}).drop("_found")


def with_turns(docs: DataFrame) -> DataFrame:
    """doc_id and text of the registered query: every tenth document, by crc32 h of the id, repeats a stretch of itself to its
    end. From word a = g % n on (g = h // 10), its p = 1 + (n - a) // (3 + g % 8) words come again and again. Other texts, those
    without words and those of a null id stay."""
    blank = F.translate("text", "\t\n\x0b\x0c\r", "     ")
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.when(h % 10 == 0, F.array_remove(F.split(blank, " "), ""))
    split = docs.select("doc_id", "text", words.alias("words"), F.floor(h / 10).alias("g")).withColumn("n", F.size("words"))
    split = split.withColumn("a", F.when(F.col("n") > 0, F.pmod("g", "n")).cast("int"))
    split = split.withColumn("p", (1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8))).cast("int"))
    turns = F.flatten(F.array_repeat(F.slice("words", F.col("a") + 1, F.col("p")), F.ceil((F.col("n") - F.col("a")) / F.col("p")).cast("int")))
    edited = F.array_join(F.slice(F.concat(F.slice("words", F.lit(1), F.col("a")), turns), F.lit(1), F.col("n")), " ")
    return split.select("doc_id", F.when(F.col("n") > 0, edited).otherwise(F.col("text")).alias("text"))


def op12_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_runs, the longest run's start, length, period and exponent_milli, runs_sha256, collapsed_sha256 of every
    document as ``with_turns`` has it."""
    found = find_runs(with_turns(table(spark, sf_dir, "documents"))).select("doc_id", "runs", "collapsed")
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    each = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    lines = F.concat(F.array_join(each, "\n"), F.when(F.size("runs") > 0, "\n").otherwise(""))
    best = found.withColumn("best", longest)
    return best.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("best.start")).alias("start"),
        F.col("best.length").alias("length"),
        (-F.col("best.period")).alias("period"),
        F.expr("1000 * best.length div -best.period").alias("exponent_milli"),
        F.sha2(lines.cast("binary"), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
