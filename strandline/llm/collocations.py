"""Phrase collocations: exact counts of frequent phrases of 2 and 3 words by direct-address tiling, then scores.

Texts are cut into pieces at punctuation and line ends and into words at blanks, each language on its own. A phrase that
comes ``least`` times has only parts that do, so counting goes by length:

1. Words are counted, and the frequent ones ranked by frequency. The first ``head`` of them have a direct address, their rank.
2. Pairs of ranks fall into tiles of ``TILE`` x ``TILE`` cells. A task holds its pairs until there are ``HELD`` of them; tiles
   with many are counted densely with bincount, the pairs of all others as one sorted coordinate list. Frequent words are the
   first ranks, so the first tiles take most pairs. Sums over tasks give the frequent pairs.
3. Frequent pairs are ranked in turn, and a phrase of 3 words is the cell of a pair's rank and a word's. It is counted the
   same way wherever both of its pairs are frequent.

Ranks go to the tasks by broadcast; their number has a bound (``head``, ``head_pairs``). Words and pairs beyond it count too:
a Bloom filter names them in the tasks, and phrases that need one are counted by their words. The filter only saves work, and
has a bound of its own; sums over tasks decide.

What leaves a task is summed in the task, so the hottest phrase is a row for each ``HELD`` words.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import bloom
from .common import Scratch, hash_words, mix64, slices, small_batches, table

LEAST = 10
PERCENT = 50
FIRST = 2000
NO_LANG = "und"
#: Words and pairs with a direct address, over all languages.
HEAD = 1 << 18
HEAD_PAIRS = 1 << 20
FILTER_BYTES = 32 << 20
#: Ranks on each side of a tile, and the part of a tile's cells that a task's phrases must number for it to be dense.
TILE = 1024
DENSE = 8
#: Words that a task holds before it counts them as phrases, distinct words that it holds, and rows that it sends at once.
HELD = 1_000_000
HELD_WORDS = 300_000
SENT_ROWS = 100_000
_K = np.uint64(0x9E3779B97F4A7C15)
#: Lower case; piece ends as full stops, which no word holds; tabs as blanks.
_TABLE = bytes(ord(".") if c in b".,;:!?\n\x0b\x0c\r" else ord(" ") if c == 9 else c + 32 if 65 <= c <= 90 else c for c in range(256))


def words_of(texts: list[bytes]) -> list[bytes]:
    """Words of texts in order, with a full stop wherever a piece ends."""
    return b".".join([t.translate(_TABLE) for t in texts]).replace(b".", b" . ").split()


def by_lang(rows: pd.DataFrame) -> Iterator[tuple[str, list[bytes]]]:
    """Words of a batch, language by language, a few megabytes at a time."""
    for lang, own in rows.groupby("lang", sort=False):
        for _, texts in slices(own["text"], own["text"]):
            yield lang, words_of(texts)


def counted_words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(lang, word, n) of a task; a null word has the number of all words."""
    held: dict[str, Counter] = {}
    for rows in batches:
        for lang, words in by_lang(rows):
            held.setdefault(lang, Counter()).update(words)
        if sum(map(len, held.values())) >= HELD_WORDS:
            yield from word_rows(held)
            held = {}
    yield from word_rows(held)


def word_rows(held: dict[str, Counter]) -> Iterator[pd.DataFrame]:
    for lang, c in held.items():
        c.pop(b".", None)
        yield pd.DataFrame({"lang": lang, "word": [None], "n": [c.total()]})
        words, n = list(c), list(c.values())
        for i in range(0, len(words), SENT_ROWS):
            yield pd.DataFrame({"lang": lang, "word": words[i : i + SENT_ROWS], "n": n[i : i + SENT_ROWS]})


@dataclass
class Head:
    """The direct addresses of words or pairs, by language, and the filter of the frequent ones beyond them."""

    ranks: dict = field(default_factory=dict)
    rest: bloom.Filter | None = None


def lang_hash(lang: str) -> np.uint64:
    return hash_words([b"\n" + lang.encode()])[0]


def pair_hash(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of phrases from the hashes of their parts."""
    return mix64(a * _K + mix64(b))


class Pieces:
    """Words of one language as ranks: -1 has no direct address but may be frequent, -2 is neither."""

    def __init__(self, lang: str, words: list[bytes], head: Head) -> None:
        get = head.ranks.get(lang, {}).get
        self.words, self.rank = words, np.array([get(w, -2) for w in words], dtype=np.int64)
        self.hashes: np.ndarray | None = None
        if head.rest is not None:
            own = np.flatnonzero(self.rank < 0)
            own = own[[words[i] != b"." for i in own]] if len(own) else own
            # The language is part of the hash, so that a word frequent in one is not taken for frequent in all.
            self.hashes = hash_words(words) ^ lang_hash(lang)
            self.rank[own[head.rest.has(self.hashes[own])]] = -1


def cells(left: np.ndarray, right: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs of ranks and their counts: dense tiles by bincount, the others as a sorted coordinate list."""
    across = width // TILE + 1
    tile = (left // TILE) * across + right // TILE
    many = np.flatnonzero(np.bincount(tile) * DENSE >= TILE * TILE)
    rest = np.ones(len(tile), dtype=bool)
    out = []
    for t in many.tolist():
        own = tile == t
        rest &= ~own
        n = np.bincount(left[own] % TILE * TILE + right[own] % TILE, minlength=TILE * TILE)
        cell = np.flatnonzero(n)
        out.append((t // across * TILE + cell // TILE, t % across * TILE + cell % TILE, n[cell]))
    coordinates, n = np.unique(left[rest] << 32 | right[rest], return_counts=True)
    out.append((coordinates >> 32, coordinates & 0xFFFFFFFF, n))
    a, b, n = (np.concatenate(x) for x in zip(*out, strict=True))
    return a, b, n


COUNTED = "lang string, left long, right long, phrase binary, n long"


class Counts:
    """What a task has counted of phrases: ranks by language until there are ``HELD``, and phrases by their words."""

    def __init__(self, width: int) -> None:
        self.width, self.n = width, 0
        self.ranks: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        self.phrases: dict[str, Counter] = {}

    def add(self, lang: str, left: np.ndarray, right: np.ndarray, phrases: list[bytes]) -> Iterator[pd.DataFrame]:
        self.ranks.setdefault(lang, []).append((left.astype(np.uint32), right.astype(np.uint32)))
        if phrases:
            self.phrases.setdefault(lang, Counter()).update(phrases)
        self.n += len(left) + len(phrases)
        if self.n >= HELD:
            yield from self.rows()

    def rows(self) -> Iterator[pd.DataFrame]:
        for lang, parts in self.ranks.items():
            left, right = (np.concatenate([p[k] for p in parts]).astype(np.int64) for k in (0, 1))
            if len(left):
                a, b, n = cells(left, right, self.width)
                for i in range(0, len(n), SENT_ROWS):
                    own = slice(i, i + SENT_ROWS)
                    yield pd.DataFrame({"lang": lang, "left": a[own], "right": b[own], "phrase": None, "n": n[own]})
        for lang, c in self.phrases.items():
            phrases, n = list(c), list(c.values())
            for i in range(0, len(n), SENT_ROWS):
                yield pd.DataFrame({"lang": lang, "left": None, "right": None, "phrase": phrases[i : i + SENT_ROWS], "n": n[i : i + SENT_ROWS]})
        self.ranks, self.phrases, self.n = {}, {}, 0


def counted_pairs(shared):
    """Counts of pairs of frequent words of a task."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        head = shared.value
        counts = Counts(HEAD)
        for rows in batches:
            for lang, words in by_lang(rows):
                p = Pieces(lang, words, head)
                a, b = p.rank[:-1], p.rank[1:]
                direct = (a >= 0) & (b >= 0)
                other = np.flatnonzero((a >= -1) & (b >= -1) & ~direct) if head.rest is not None else ()
                yield from counts.add(lang, a[direct], b[direct], [b" ".join(words[i : i + 2]) for i in other])
        yield from counts.rows()

    return work


def counted_triples(shared, shared_pairs):
    """Counts of phrases of 3 words whose pairs are both frequent, of a task."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        head, pairs = shared.value, shared_pairs.value
        counts = Counts(HEAD)
        for rows in batches:
            for lang, words in by_lang(rows):
                p = Pieces(lang, words, head)
                known, of = pairs.ranks.get(lang, (np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)))
                key = np.where((p.rank[:-1] >= 0) & (p.rank[1:] >= 0), p.rank[:-1] << 32 | p.rank[1:], -1)
                at = np.searchsorted(known, key)
                hit = at < len(known)
                hit[hit] = known[at[hit]] == key[hit]
                rank = np.full(len(key), -2, dtype=np.int64)
                rank[hit] = of[at[hit]]
                if pairs.rest is not None:
                    hashes = p.hashes if p.hashes is not None else hash_words(words) ^ lang_hash(lang)
                    own = np.flatnonzero(~hit & (p.rank[:-1] >= -1) & (p.rank[1:] >= -1))
                    rank[own[pairs.rest.has(pair_hash(hashes[own], hashes[own + 1]))]] = -1
                a, b, last = rank[:-1], rank[1:], p.rank[2:]
                direct = (a >= 0) & (b >= -1) & (last >= 0)
                other = np.flatnonzero((a >= -1) & (b >= -1) & ~direct) if pairs.rest is not None else ()
                yield from counts.add(lang, a[direct], last[direct], [b" ".join(words[i : i + 3]) for i in other])
        yield from counts.rows()

    return work


def filter_of(shape: bloom.Shape, hashes):
    """Map side of a filter of given rows, each of which counts as seen more than once."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            if len(rows):
                yield bloom.sent(shape, np.zeros(0, dtype=np.uint64), np.unique(hashes(rows)))

    return work


def word_hashes(rows: pd.DataFrame) -> np.ndarray:
    langs = {x: lang_hash(x) for x in set(rows["lang"])}
    return hash_words(list(rows["word"])) ^ np.array([langs[x] for x in rows["lang"]], dtype=np.uint64)


def pair_hashes(rows: pd.DataFrame) -> np.ndarray:
    return pair_hash(*(word_hashes(rows.rename(columns={c: "word"})) for c in ("w1", "w2")))


def frequent_head(counts: DataFrame, most: int) -> int:
    """The least count of which at most ``most`` rows have so many: a histogram of counts, 16 steps to each doubling, decides."""
    step = F.floor(16 * F.log2("n"))
    held, least = 0, None
    for r in counts.groupBy(step.alias("step")).agg(F.count("*").alias("k"), F.min("n").alias("least")).orderBy(F.desc("step")).collect():
        held += r["k"]
        if held > most:
            break
        least = r["least"]
    return least if least is not None else 1 << 62


def rest_filter(rest: DataFrame, hashes, filter_bytes: int) -> bloom.Filter | None:
    """Filter of the frequent rows that have no direct address, if there are any."""
    n = rest.count()
    if not n:
        return None
    shape = bloom.Shape.of(n, filter_bytes)
    sent = rest.mapInPandas(filter_of(shape, hashes), bloom.SENT)
    return bloom.gathered(shape, sent.groupBy("slice").applyInPandas(bloom.twice_seen(shape), "slice long, bits binary"))


def summed(counted: DataFrame, least: int) -> DataFrame:
    """Sums over tasks. Tasks have summed their own, so rows are dealt out before Spark aggregates, not after."""
    key = ["lang", "left", "right", "phrase"]
    return counted.repartition(*key).groupBy(*key).agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def phrase_counts(docs: DataFrame, least: int = LEAST, head: int = HEAD, head_pairs: int = HEAD_PAIRS, filter_bytes: int = FILTER_BYTES) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Written tables of frequent words (lang, word, n; a null word has the number of all words of a language), pairs (lang, w1,
    w2, n) and triples (lang, w1, w2, w3, n); words are binary. ``docs``: text and lang; other columns are left out."""
    spark = docs.sparkSession
    small_batches(spark, 1024)
    scratch = Scratch(spark, "collocations")
    rows = docs.select(F.coalesce("lang", F.lit(NO_LANG)).alias("lang"), F.col("text").cast("binary").alias("text")).where("text is not null")
    words = rows.mapInPandas(counted_words, "lang string, word binary, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    words = scratch.keep(words.where(F.col("word").isNull() | (F.col("n") >= least)))
    known = words.where("word is not null")
    bound = frequent_head(known, head)
    first = known.where(F.col("n") >= bound).toArrow().to_pandas().sort_values(["n", "word"], ascending=[False, True])
    vocabulary = {lang: list(own["word"]) for lang, own in first.groupby("lang")}
    ranks = {lang: {w: i for i, w in enumerate(own)} for lang, own in vocabulary.items()}
    shared = spark.sparkContext.broadcast(Head(ranks, rest_filter(known.where(F.col("n") < bound), word_hashes, filter_bytes)))
    spelled = spark.sparkContext.broadcast(vocabulary)

    found = summed(rows.mapInPandas(counted_pairs(shared), COUNTED), least)
    pairs = scratch.keep(found.mapInPandas(pair_words(spelled), "lang string, left long, right long, w1 binary, w2 binary, n long"))
    scratch.free_shuffles()
    bound = frequent_head(pairs, head_pairs)
    direct = (F.col("n") >= bound) & F.col("left").isNotNull()
    top = pairs.where(direct).select("lang", "left", "right", "n").toArrow().to_pandas().sort_values(["n", "left", "right"], ascending=[False, True, True])
    ranks, by_rank = {}, {}
    for lang, own in top.groupby("lang"):
        key = own["left"].to_numpy(dtype=np.int64) << 32 | own["right"].to_numpy(dtype=np.int64)
        order = np.argsort(key)
        ranks[lang], by_rank[lang] = (key[order], order.astype(np.int64)), key
    shared_pairs = spark.sparkContext.broadcast(Head(ranks, rest_filter(pairs.where(~direct), pair_hashes, filter_bytes)))
    spelled_pairs = spark.sparkContext.broadcast(by_rank)
    found = summed(rows.mapInPandas(counted_triples(shared, shared_pairs), COUNTED), least)
    triples = scratch.keep(found.mapInPandas(triple_words(spelled, spelled_pairs), "lang string, w1 binary, w2 binary, w3 binary, n long"))
    scratch.free_shuffles()
    return words, pairs.select("lang", "w1", "w2", "n"), triples


def pair_words(spelled):
    """Words of counted pairs."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        v = spelled.value
        for rows in batches:
            if len(rows):
                both = [x.split(b" ") if x is not None else (v[g][int(a)], v[g][int(b)]) for g, a, b, x in zip(rows["lang"], rows["left"], rows["right"], rows["phrase"], strict=True)]
                yield rows.drop(columns="phrase").assign(left=rows["left"].astype("Int64"), right=rows["right"].astype("Int64"), w1=[x[0] for x in both], w2=[x[1] for x in both])

    return work


def triple_words(spelled, spelled_pairs):
    """Words of counted triples."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        v, pairs = spelled.value, spelled_pairs.value
        for rows in batches:
            if len(rows):
                out = []
                for g, a, b, x in zip(rows["lang"], rows["left"], rows["right"], rows["phrase"], strict=True):
                    if x is None:
                        key = int(pairs[g][int(a)])
                        out.append((v[g][key >> 32], v[g][key & 0xFFFFFFFF], v[g][int(b)]))
                    else:
                        out.append(tuple(x.split(b" ")))
                yield rows[["lang", "n"]].assign(**{f"w{k + 1}": [w[k] for w in out] for k in range(3)})

    return work


def ratio(a: Column, left: Column, right: Column) -> Column:
    """floor(1000000 * a * a / (left * right)) on whole numbers of up to 38 digits."""
    wide = lambda c: c.cast("decimal(16,0)")
    return F.call_function("div", wide(a) * wide(a) * F.lit(1_000_000).cast("decimal(7,0)"), wide(left) * wide(right))


def collocations(docs: DataFrame, least: int = LEAST, percent: int = PERCENT, first: int = FIRST, **sizes: int) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the ``first`` phrases of each language by score, then a, both falling, then phrase.

    A candidate is a phrase of 2 or 3 words that comes a >= ``least`` times, counted within pieces, overlaps included. Its score
    is the least over its cuts into two parts that come l and r times. A pair within a triple that has at least ``percent`` of
    its count goes. n is the number of all words of the language.

    A null lang is ``und``, a null or empty text has no words, each row counts also where rows repeat, and an empty table, or one
    without frequent phrases, gives no rows. Counts must be below 10 ** 16. ``sizes``: see ``phrase_counts``.
    """
    words, pairs, triples = phrase_counts(docs, least, **sizes)
    part = lambda name, n: words.where("word is not null").select("lang", F.col("word").alias(name), F.col("n").alias(n))
    whole = pairs.withColumnRenamed("n", "a")
    longer = triples.select("lang", "n", F.explode(F.array(F.struct("w1", "w2"), F.struct(F.col("w2").alias("w1"), F.col("w3").alias("w2")))).alias("p"))
    longer = longer.select("lang", "p.w1", "p.w2", "n").groupBy("lang", "w1", "w2").agg(F.max("n").alias("longer"))
    two = whole.join(longer, ["lang", "w1", "w2"], "left").where(F.col("longer").isNull() | (100 * F.col("longer") < percent * F.col("a")))
    two = two.join(part("w1", "l"), ["lang", "w1"]).join(part("w2", "r"), ["lang", "w2"])
    two = two.select("lang", F.concat_ws(" ", F.col("w1").cast("string"), F.col("w2").cast("string")).alias("phrase"), "a", "l", "r", ratio(F.col("a"), F.col("l"), F.col("r")).alias("score"))
    three = triples.withColumnRenamed("n", "a").join(part("w1", "l1"), ["lang", "w1"]).join(part("w3", "r2"), ["lang", "w3"])
    three = three.join(pairs.select("lang", F.col("w1").alias("w2"), F.col("w2").alias("w3"), F.col("n").alias("r1")), ["lang", "w2", "w3"])
    three = three.join(pairs.select("lang", "w1", "w2", F.col("n").alias("l2")), ["lang", "w1", "w2"])
    cut = lambda k: F.struct(ratio(F.col("a"), F.col(f"l{k}"), F.col(f"r{k}")).alias("score"), F.lit(k).alias("k"), F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r"))
    three = three.withColumn("cut", F.least(cut(1), cut(2)))
    three = three.select("lang", F.concat_ws(" ", *[F.col(f"w{k}").cast("string") for k in (1, 2, 3)]).alias("phrase"), "a", "cut.l", "cut.r", "cut.score")
    every = two.unionByName(three)
    # The first of each share of a language, then of its share of shares, then of the language: no task sorts more than a few
    # shares' first.
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    shares = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    best = every.withColumn("share", F.pmod(F.xxhash64("phrase"), F.lit(shares)))
    for share in (F.col("share"), F.col("share") % max(2, math.isqrt(shares)), F.lit(0)):
        best = best.withColumn("share", share)
        best = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "share").orderBy(*order)).cast("long")).where(F.col("rank") <= first)
    totals = words.where("word is null").select("lang", "n")
    return best.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of each language's first phrases over all documents."""
    return collocations(table(spark, sf_dir, "documents").select("lang", "text"))
