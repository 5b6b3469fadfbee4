"""Substring deduplication by fixed-block anchors, exact for windows of 50 words.

A window of 50 consecutive words holds a whole block of 25 words that begins at a multiple of 25, whatever its offset.
So blocks at multiples of 25 are the index, and every rolling run of 25 words of every document probes it:

1. Anchors. Hashes of blocks and of rolling runs meet by hash. A hash is an anchor if some document has it as a block and a
   document with a larger id has it as a run.
2. Extension. In each document, the windows that hold an anchor run are hashed whole and meet by that hash. A window is a
   repeat if the least doc_id among equal windows is smaller than its own. Joined windows are the maximal exact repeats.
3. Removal. Words that a repeat covers go.

Everything grows in proportion to the input: no pairs of documents are made, so a passage that thousands share costs
thousands of rows. Runs and positions travel packed, one row for each map batch and hash bucket: 4 bytes of hash (the
bucket holds further bits; a false anchor only costs an extension) and about 2 bytes of document and position. Windows meet
by 64 bits and the bucket's. Shuffle files of a step are released before the next.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, hash_words, mix64, slices, small_batches, table

WINDOW = 50
ANCHOR = WINDOW // 2
_BASE = np.uint64(0x9E3779B97F4A7C15)
FLUSH = 1_500_000


def rolling(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of ``size`` consecutive words."""
    n = max(0, len(words) - size + 1)
    out = np.zeros(n, dtype=np.uint64)
    for k in range(size):
        out *= _BASE
        out += words[k : k + n]
    return mix64(out)


def planes(x: np.ndarray) -> bytes:
    """Bytes of an array, lowest bytes of all first: small numbers become runs of zeros, which the shuffle compresses."""
    return np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.itemsize).T.tobytes()


def unplanes(b: bytes, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(b, dtype=np.uint8).reshape(size, -1).T).view(kind).ravel()


def pack(doc: np.ndarray, check: np.ndarray, pos: np.ndarray, hashes: np.ndarray | None = None) -> dict[str, bytes]:
    """Columns of one packed row from arrays in which each document's positions rise; where they fall, a repeated row begins."""
    new = np.ones(len(doc), dtype=bool)
    new[1:] = (doc[1:] != doc[:-1]) | (check[1:] != check[:-1]) | (pos[1:] < pos[:-1])
    first = np.flatnonzero(new)
    gap = np.diff(pos, prepend=0).astype(np.int64)
    gap[first] = pos[first]
    counts = np.diff(np.append(first, len(doc))).astype(np.uint32)
    out = {"docs": planes(np.diff(doc[first], prepend=0)), "checks": check[first].astype(np.uint16).tobytes(), "counts": planes(counts), "gaps": planes(gap.astype(np.uint32))}
    return out if hashes is None else out | {"hashes": hashes.tobytes()}


def unpack(docs: bytes, checks: bytes, counts: bytes, gaps: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, check, position) of every entry of a packed row."""
    n = unplanes(counts, np.uint32).astype(np.int64)
    step = unplanes(gaps, np.uint32).astype(np.int64)
    total = np.cumsum(step)
    first = np.cumsum(n) - n
    pos = total - np.repeat(total[first] - step[first], n)
    return np.repeat(np.cumsum(unplanes(docs, np.int64)), n), np.repeat(np.frombuffer(checks, dtype=np.uint16), n), pos


PACKED = "docs binary, checks binary, counts binary, gaps binary"
_FIELDS = ("docs", "checks", "counts", "gaps")


def check_of(text: bytes) -> int:
    """16 bits of a text's hash, which tell rows of one doc_id apart."""
    return xxhash.xxh3_64_intdigest(text) & 0xFFFF


def routed(key: np.ndarray, doc: np.ndarray, check: np.ndarray, pos: np.ndarray, hashes: np.ndarray | None, name: str) -> pd.DataFrame:
    """One packed row for each value of ``key``; inside, entries keep their order."""
    columns = [name, *_FIELDS, *(["hashes"] if hashes is not None else [])]
    if not len(key):
        return pd.DataFrame(columns=columns)
    order = np.argsort(key, kind="stable")
    key = key[order]
    cut = np.flatnonzero(np.diff(key, prepend=key[0] - 1))
    rows = []
    for a, b in zip(cut, np.append(cut[1:], len(key)), strict=True):
        own = order[a:b]
        rows.append({name: int(key[a])} | pack(doc[own], check[own], pos[own], None if hashes is None else hashes[own]))
    return pd.DataFrame(rows, columns=columns)


def group_of(doc: np.ndarray, groups: int) -> np.ndarray:
    return (mix64(doc.astype(np.uint64)) % np.uint64(groups)).astype(np.int64)


class Buffer:
    """Collects entries and gives packed rows by hash bucket whenever it holds ``FLUSH``."""

    def __init__(self, buckets: int, width: type) -> None:
        self.buckets, self.width, self.parts, self.n = np.uint64(buckets), width, [], 0

    def add(self, hashes: np.ndarray, doc: int, check: int, pos: np.ndarray) -> None:
        if len(pos):
            self.parts.append((hashes, doc, check, pos))
            self.n += len(pos)

    def flush(self) -> pd.DataFrame:
        h = np.concatenate([p[0] for p in self.parts])
        n = [len(p[3]) for p in self.parts]
        doc = np.repeat(np.array([p[1] for p in self.parts], dtype=np.int64), n)
        check = np.repeat(np.array([p[2] for p in self.parts], dtype=np.uint16), n)
        pos = np.concatenate([p[3] for p in self.parts]).astype(np.int64)
        self.parts, self.n = [], 0
        bucket = ((h >> np.uint64(40)) % self.buckets).astype(np.int64)
        kept = mix64(h + np.uint64(1)).astype(self.width)
        return routed(bucket, doc, check, pos, kept, "bucket")


def anchors_of(buckets: int):
    """Map side of step 1: every rolling run of 25 words of documents that have a window."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        buffer = Buffer(buckets, np.uint32)
        for rows in batches:
            for ids, texts in slices(rows["doc_id"], rows["text"]):
                split = [t.split() for t in texts]
                words = hash_words([w for s in split for w in s])
                runs = rolling(words, ANCHOR)
                at = 0
                for i, t, s in zip(ids, texts, split, strict=True):
                    if len(s) >= WINDOW:
                        n = len(s) - ANCHOR + 1
                        buffer.add(runs[at : at + n], int(i), check_of(t), np.arange(n))
                    at += len(s)
                if buffer.n >= FLUSH:
                    yield buffer.flush()
        if buffer.n:
            yield buffer.flush()

    return work


def gathered(rows: pd.DataFrame, width: type) -> tuple[np.ndarray, ...]:
    """hashes, document, check, position of all packed rows of a bucket."""
    parts = [(np.frombuffer(r.hashes, dtype=width), *unpack(r.docs, r.checks, r.counts, r.gaps)) for r in rows.itertuples()]
    return tuple(np.concatenate([p[k] for p in parts]) for k in range(4))


def by_hash(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the entries by hash, and where each hash begins in it."""
    order = np.argsort(hashes, kind="stable")
    s = hashes[order]
    start = np.flatnonzero(np.append(True, s[1:] != s[:-1])) if len(s) else np.zeros(0, dtype=np.int64)
    return order, start


def back(doc: np.ndarray, check: np.ndarray, pos: np.ndarray, groups: int) -> pd.DataFrame:
    """Entries packed by the group of their document, in order of document and position."""
    order = np.lexsort((pos, check, doc))
    doc, check, pos = doc[order], check[order], pos[order]
    return routed(group_of(doc, groups), doc, check, pos, None, "grp")


def anchored(groups: int):
    """Reduce side of step 1: runs whose hash a smaller document has as a block, and those blocks."""

    def work(rows: pd.DataFrame) -> pd.DataFrame:
        h, doc, check, pos = gathered(rows, np.uint32)
        order, start = by_hash(h)
        d, block = doc[order], pos[order] % ANCHOR == 0
        size = np.diff(np.append(start, len(d)))
        least = np.minimum.reduceat(np.where(block, d, np.iinfo(np.int64).max), start)
        most = np.maximum.reduceat(d, start)
        least, most = np.repeat(least, size), np.repeat(most, size)
        hit = (least < d) | (block & (d < most))
        own = order[hit]
        return back(doc[own], check[own], pos[own], groups)

    return work


def windows_of(buckets: int):
    """Map side of step 2: whole windows that hold an anchor, hashed."""

    def work(docs: pd.DataFrame, hits: pd.DataFrame) -> pd.DataFrame:
        where = positions(hits)
        buffer = Buffer(buckets, np.uint64)
        for i, t in zip(docs["doc_id"], docs["text"], strict=True):
            if pd.isna(i) or t is None or (q := where.get((int(i), check_of(t)))) is None:
                continue
            words = hash_words(t.split())
            n = len(words) - WINDOW + 1
            mark = np.zeros(n + WINDOW + 1, dtype=np.int64)
            np.add.at(mark, np.maximum(q - (WINDOW - ANCHOR), 0), 1)
            np.add.at(mark, q + 1, -1)
            p = np.flatnonzero(np.cumsum(mark)[:n])
            buffer.add(rolling(words, WINDOW)[p], int(i), check_of(t), p)
        return buffer.flush() if buffer.n else pd.DataFrame(columns=["bucket", *_FIELDS, "hashes"])

    return work


def repeated(groups: int):
    """Reduce side of step 2: windows that also start in a document with a smaller id."""

    def work(rows: pd.DataFrame) -> pd.DataFrame:
        h, doc, check, pos = gathered(rows, np.uint64)
        order, start = by_hash(h)
        d = doc[order]
        least = np.repeat(np.minimum.reduceat(d, start), np.diff(np.append(start, len(d))))
        own = order[d > least]
        return back(doc[own], check[own], pos[own], groups)

    return work


def positions(rows: pd.DataFrame) -> dict[tuple[int, int], np.ndarray]:
    """Positions by (document, check), from the packed rows of a group."""
    found: dict[tuple[int, int], list[np.ndarray]] = {}
    for r in rows.itertuples():
        doc, check, pos = unpack(r.docs, r.checks, r.counts, r.gaps)
        if not len(doc):
            continue
        cut = np.flatnonzero(np.append(True, (doc[1:] != doc[:-1]) | (check[1:] != check[:-1])))
        for a, b in zip(cut, np.append(cut[1:], len(doc)), strict=True):
            found.setdefault((int(doc[a]), int(check[a])), []).append(pos[a:b])
    return {k: np.concatenate(v) for k, v in found.items()}


def remove(docs: pd.DataFrame, repeats: pd.DataFrame) -> pd.DataFrame:
    """Step 3: doc_id, n_words, n_removed and the kept words of each document of a group, joined by one space."""
    where = positions(repeats)
    out = []
    for i, t in zip(docs["doc_id"], docs["text"], strict=True):
        words = t.split() if t is not None else []
        kept = words
        if not pd.isna(i) and t is not None and (p := where.get((int(i), check_of(t)))) is not None:
            mark = np.zeros(len(words) + 1, dtype=np.int64)
            np.add.at(mark, p, 1)
            np.add.at(mark, p + WINDOW, -1)
            gone = np.cumsum(mark)[: len(words)] > 0
            kept = [w for w, g in zip(words, gone, strict=True) if not g]
        out.append((i, len(words), len(words) - len(kept), b" ".join(kept)))
    return pd.DataFrame(out, columns=["doc_id", "n_words", "n_removed", "kept"])


def digest(docs: pd.DataFrame, repeats: pd.DataFrame) -> pd.DataFrame:
    out = remove(docs, repeats)
    out["kept_sha256"] = [hashlib.sha256(k).hexdigest() for k in out["kept"]]
    return out.drop(columns="kept")


def dedup(docs: DataFrame, digests: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed and kept (binary; or, with ``digests``, kept_sha256) for each row of ``docs``.

    ``docs`` needs doc_id (a whole number) and text; further columns are left out. Null texts have no words. Rows of null
    doc_id lose nothing and take nothing. Rows with one doc_id do not take words from each other. Documents of fewer than
    50 words stay whole. Words are judged on the input, so a repeat of a removed passage goes as well.
    """
    spark = docs.sparkSession
    small_batches(spark, 1024)
    scratch = Scratch(spark, "substrings")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    size = rows.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets, groups = max(parts, size // 16_000_000 + 1), max(parts, size // 8_000_000 + 1)

    # The same group as group_of: a splitmix64 finaliser, so that the two sides agree, computed where the row is.
    @F.pandas_udf("long")
    def group(ids: pd.Series) -> pd.Series:
        return pd.Series(group_of(ids.to_numpy(dtype=np.int64), groups))

    runs = rows.where("doc_id is not null and text is not null").mapInPandas(anchors_of(buckets), f"bucket long, {PACKED}, hashes binary")
    hits = scratch.keep(runs.groupBy("bucket").applyInPandas(anchored(groups), f"grp long, {PACKED}"))
    del runs
    scratch.free_shuffles()
    # From here ids go through Python as text, since pandas makes floats of integers with nulls.
    grouped = rows.select("text", F.when(F.col("doc_id").isNull(), F.lit(0)).otherwise(group(F.coalesce("doc_id", F.lit(0)))).alias("grp"), F.col("doc_id").cast("string").alias("doc_id"))
    whole = grouped.where(F.octet_length("text") >= 2 * WINDOW - 1).groupBy("grp").cogroup(hits.groupBy("grp")).applyInPandas(windows_of(buckets), f"bucket long, {PACKED}, hashes binary")
    repeats = scratch.keep(whole.groupBy("bucket").applyInPandas(repeated(groups), f"grp long, {PACKED}"))
    scratch.drop(hits)
    del whole, hits
    scratch.free_shuffles()
    last, kind = (digest, "kept_sha256 string") if digests else (remove, "kept binary")
    out = grouped.groupBy("grp").cogroup(repeats.groupBy("grp")).applyInPandas(last, f"doc_id string, n_words long, n_removed long, {kind}")
    return out.withColumn("doc_id", F.col("doc_id").cast("long"))


def op4_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every document; nulls, empty texts and repeated rows as for ``dedup``."""
    return dedup(table(spark, sf_dir, "documents").select("doc_id", "text"), digests=True)
