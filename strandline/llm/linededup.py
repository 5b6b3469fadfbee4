"""Line deduplication with two Bloom filters, exact by a second look at the few lines that they suspect.

A line's key is the line stripped of blanks at both ends, in lower case (A-Z). Keys of at least ``least_chars`` code points
that stand in at least ``least_docs`` documents lose their lines in all documents but the one of the largest doc_id.

1. Filters. Every map task hashes its keys and sends each distinct hash once to the slice of the two filters that it falls
   in: hashes met by one document so far, and by several. A hash that the first filter already has goes into the second.
2. Suspects. The second filter goes to all tasks, and only keys that it holds leave their task: 16 bytes of BLAKE2 for the
   key, the number of documents and the largest doc_id, summed in the task first, so a very common line is a row a task.
   Their sums settle which keys repeat, exactly, whatever the filters let through.
3. Removal. Repeated keys are broadcast if there are at most ``most_keys`` of them, and no text moves. Beyond that, the
   suspected lines of each document meet them by a join, which AQE can split at a hot key, and only documents that hold
   such lines move.

The filter is sized by the input up to ``filter_bytes``; above that it suspects more keys than repeat and step 2 carries
more rows, up to all distinct keys of each task, 32 bytes each.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bloom
from .common import Scratch, slices, small_batches, table

LEAST_CHARS = 40
LEAST_DOCS = 5
FILTER_BYTES = 64 << 20
MOST_KEYS = 200_000
_BLANKS = b" \t\n\x0b\x0c\r"
#: Distinct keys that a task holds before it sends them.
HELD = 400_000
#: Stands for a null doc_id, below every other.
NO_ID = -(1 << 63)


def keys_of(text: bytes | None, least_chars: int) -> tuple[list[bytes], list[bytes | None]]:
    """Lines of a text and their keys; None for keys that are too short."""
    lines = (text or b"").split(b"\n")
    keys: list[bytes | None] = []
    for line in lines:
        k = line.strip(_BLANKS) if len(line) >= least_chars else b""
        long = len(k) >= least_chars and (k.isascii() or len(k.decode("utf-8", "replace")) >= least_chars)
        keys.append(k.lower() if long else None)
    return lines, keys


def hashes_of(keys: list[bytes]) -> np.ndarray:
    return np.array([xxhash.xxh3_64_intdigest(k) for k in keys], dtype=np.uint64)


def digest(key: bytes) -> bytes:
    return hashlib.blake2b(key, digest_size=16).digest()


def numbers(ids: pd.Series) -> list[int]:
    """doc_ids, which come as text since pandas makes floats of integers with nulls."""
    return [NO_ID if i is None else int(i) for i in ids]


def seen(shape: bloom.Shape, least_chars: int):
    """Map side of step 1."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[np.ndarray] = []
        n = 0
        for rows in batches:
            for text in rows["text"]:
                own = {k for k in keys_of(text, least_chars)[1] if k is not None}
                if own:
                    held.append(hashes_of(list(own)))
                    n += len(own)
            if n >= HELD:
                yield both(shape, held)
                held, n = [], 0
        if n:
            yield both(shape, held)

    return work


def both(shape: bloom.Shape, held: list[np.ndarray]) -> pd.DataFrame:
    h, count = np.unique(np.concatenate(held), return_counts=True)
    return bloom.sent(shape, h[count == 1], h[count > 1])


def suspects(shared, least_chars: int):
    """Keys that the second filter holds: (key, docs, largest), summed over the task."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = shared.value
        held: dict[bytes, list[int]] = {}
        for rows in batches:
            for ids, texts in slices(numbers(rows["doc_id"]), rows["text"]):
                for i, own in zip(ids, suspected(texts, known, least_chars), strict=True):
                    for d in {d for d in own if d is not None}:
                        if (x := held.get(d)) is None:
                            held[d] = [1, i]
                        else:
                            x[0] += 1
                            x[1] = max(x[1], i)
                if len(held) >= HELD:
                    yield sums(held)
                    held = {}
        if held:
            yield sums(held)

    return work


def sums(held: dict[bytes, list[int]]) -> pd.DataFrame:
    return pd.DataFrame({"key": list(held), "docs": [n for n, _ in held.values()], "largest": [i for _, i in held.values()]})


def suspected(texts: list[bytes], known: bloom.Filter, least_chars: int) -> Iterator[list[bytes | None]]:
    """For each text the digests of its lines' keys, None where the filter doesn't hold the key; one probe for all texts."""
    keys = [keys_of(t, least_chars)[1] for t in texts]
    flat = [k for own in keys for k in own if k is not None]
    hit = iter(known.has(hashes_of(flat)).tolist() if flat else [])
    for own in keys:
        yield [digest(k) if k is not None and next(hit) else None for k in own]


def without(text: bytes, digests: list[bytes | None], gone: set[bytes]) -> tuple[int, int, bytes]:
    """n_lines, n_dropped and the text that stays."""
    lines = text.split(b"\n")
    kept = [x for x, d in zip(lines, digests, strict=True) if d is None or d not in gone]
    return len(lines), len(lines) - len(kept), b"\n".join(kept)


KEPT = ["n_lines", "n_dropped", "kept"]


def removed_in_place(shared, repeated, least_chars: int):
    """Step 3 with the repeated keys at hand: a dictionary from key to the largest doc_id."""

    @F.pandas_udf("n_lines long, n_dropped long, kept binary")
    def of(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        known, largest = shared.value, repeated.value
        for own_ids, own_texts in batches:
            out = []
            for ids, texts in slices(numbers(own_ids), own_texts):
                for i, t, own in zip(ids, texts, suspected(texts, known, least_chars), strict=True):
                    gone = {d for d in own if d is not None and largest.get(d, i) != i}
                    out.append(without(t, own, gone) if gone else (len(own), 0, t))
            yield pd.DataFrame(out, columns=KEPT)

    return of


def own_suspects(shared, least_chars: int):
    """The distinct suspected keys of each text: array of binary."""

    @F.pandas_udf("array<binary>")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for own in batches:
            yield pd.Series([sorted({d for d in x if d is not None}) for _, texts in slices(own, own) for x in suspected(texts, shared.value, least_chars)], dtype=object)

    return of


def removed_by_list(least_chars: int):
    """Step 3 for documents that come with the keys that they lose."""

    @F.pandas_udf("n_lines long, n_dropped long, kept binary")
    def of(texts: pd.Series, lost: pd.Series) -> pd.DataFrame:
        out = []
        for t, own in zip(texts, lost, strict=True):
            t, gone = t or b"", set(own) if own is not None else set()
            out.append(without(t, [digest(k) if k is not None and gone else None for k in keys_of(t, least_chars)[1]], gone))
        return pd.DataFrame(out, columns=KEPT)

    return of


def drop_repeated_lines(
    docs: DataFrame, least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS, filter_bytes: int = FILTER_BYTES, most_keys: int = MOST_KEYS
) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept (binary) for each row of ``docs`` (doc_id, a whole number, and text; others are left
    out).

    A null or empty text has one empty line. Each row counts as a document of its own, also where rows repeat; all rows of
    the largest doc_id keep a repeated key's lines, wherever and however often they stand in it. A null doc_id counts below
    all others. Where no line is left, ``kept`` is empty. An empty table gives no rows.
    """
    spark = docs.sparkSession
    small_batches(spark)
    scratch = Scratch(spark, "lines")
    rows = docs.select(F.col("doc_id").cast("long").cast("string").alias("doc_id"), F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text"))
    # Lines long enough to count, at most: what the filters are sized by.
    expected = int(rows.agg(F.sum(F.floor(F.octet_length("text") / (least_chars + 1)))).first()[0] or 0)
    shape = bloom.Shape.of(max(1, expected // 3), filter_bytes)
    twice = rows.select("text").mapInPandas(seen(shape, least_chars), bloom.SENT).groupBy("slice").applyInPandas(bloom.twice_seen(shape), "slice long, bits binary")
    known = spark.sparkContext.broadcast(bloom.gathered(shape, twice))
    found = rows.mapInPandas(suspects(known, least_chars), "key binary, docs long, largest long")
    found = found.groupBy("key").agg(F.sum("docs").alias("docs"), F.max("largest").alias("largest"))
    repeated = scratch.keep(found.where(F.col("docs") >= least_docs).select("key", "largest"))
    if repeated.count() <= most_keys:
        largest = spark.sparkContext.broadcast({bytes(r["key"]): r["largest"] for r in repeated.toLocalIterator()})
        out = rows.select("doc_id", removed_in_place(known, largest, least_chars)("doc_id", "text").alias("x"))
    else:
        out = removed_by_join(rows, repeated, known, least_chars)
    return out.select(F.col("doc_id").cast("long").alias("doc_id"), *[f"x.{c}" for c in KEPT])


def removed_by_join(rows: DataFrame, repeated: DataFrame, known, least_chars: int) -> DataFrame:
    """Step 3 without a broadcast. Rows are known by doc_id and a hash of the text: rows alike in both lose the same lines."""
    marked = rows.withColumns({"th": F.sha2("text", 256), "own": own_suspects(known, least_chars)(F.col("text"))})
    each = marked.where(F.size("own") > 0).select("doc_id", "th", F.explode("own").alias("key"))
    lost = each.join(repeated, "key").where(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)) != F.col("largest"))
    lost = lost.groupBy("doc_id", "th").agg(F.collect_set("key").alias("lost"))
    same = F.col("m.doc_id").eqNullSafe(F.col("l.doc_id")) & (F.col("m.th") == F.col("l.th"))
    hit = marked.where(F.size("own") > 0).select("doc_id", "th", "text").alias("m").join(lost.alias("l"), same, "left").select("m.doc_id", "m.text", "l.lost")
    rest = marked.where(F.size("own") == 0).select("doc_id", "text", F.lit(None).cast("array<binary>").alias("lost"))
    return hit.unionAll(rest).select("doc_id", removed_by_list(least_chars)("text", "lost").alias("x"))


def op13_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256 of every document."""
    out = drop_repeated_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))
