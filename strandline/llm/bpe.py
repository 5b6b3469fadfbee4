"""Byte-level BPE encoding and decoding with a two-tier lookup.

A text is cut into pre-tokens by the tokenizer's pattern. Tier one resolves a whole pre-token that is in the vocabulary by
a minimal perfect hash. Tier two encodes the others by merging pairs in rank order, with a heap of candidate pairs over a
doubly linked list of bytes.

Frequent segments are remembered per worker in a dictionary of bounded size. A segment is what stands between two cuts
that the pattern always makes: before a U+0020 that a character other than white space follows. Cutting there needs no
regular expression, and a segment's ids do not depend on what surrounds it, so remembering changes no result.
"""

from __future__ import annotations

import base64
import heapq
import math
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import regex
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, table

VOCABULARY = "byte_bpe_multi_50k.tiktoken"


class MinimalPerfectHash:
    """Hash and displace: under its seed a bucket's keys fall into free slots; there are as many slots as keys.

    A bucket of one key stores a free slot itself, as a negative seed.
    """

    def __init__(self, keys: list[bytes], load: float = 2.0) -> None:
        self.n = max(1, len(keys))
        self.buckets = max(1, math.ceil(len(keys) / load))
        groups: list[list[tuple[int, int]]] = [[] for _ in range(self.buckets)]
        for i, k in enumerate(keys):
            h = xxhash.xxh3_64_intdigest(k)
            groups[h % self.buckets].append((h, i))
        self.seeds = [0] * self.buckets
        self.order = [0] * self.n
        free = bytearray(b"\1") * self.n
        sizes = sorted(range(self.buckets), key=lambda g: -len(groups[g]))
        for g in sizes:
            if len(own := groups[g]) < 2:
                break
            seed, slots = 0, [0] * len(own)
            while True:
                seed += 1
                slots = [self.displaced(h, seed) for h, _ in own]
                if all(free[s] for s in slots) and len(set(slots)) == len(slots):
                    break
            self.seeds[g] = seed
            for (_, i), s in zip(own, slots, strict=True):
                free[s] = 0
                self.order[s] = i
        left = iter([s for s in range(self.n) if free[s]])
        for g in sizes:
            if len(groups[g]) == 1:
                s = next(left)
                self.seeds[g], self.order[s] = -1 - s, groups[g][0][1]

    def displaced(self, h: int, seed: int) -> int:
        return ((h ^ (seed * 0x9E3779B97F4A7C15)) * 0xD6E8FEB86659FD93 >> 32 & 0xFFFFFFFF) % self.n

    def slot(self, key: bytes) -> int:
        """The slot of a key; any slot for what is not a key."""
        h = xxhash.xxh3_64_intdigest(key)
        seed = self.seeds[h % self.buckets]
        return -1 - seed if seed < 0 else self.displaced(h, seed)


def token_table(rank_file: str) -> list[tuple[bytes, int]]:
    """(token, rank) of a rank file in the tiktoken format: base64 of the token's bytes, blank, rank."""
    with open(rank_file, "rb") as f:
        return [(base64.b64decode(t), int(r)) for t, r in (line.split() for line in f if line.strip())]


class Decoder:
    """Ids to bytes: all tokens' bytes in one array, and where each id's bytes start."""

    def __init__(self, rank_file: str) -> None:
        bytes_of = {r: t for t, r in token_table(rank_file)}
        tokens = [bytes_of.get(i, b"") for i in range(max(bytes_of, default=-1) + 1)]
        self.flat = np.frombuffer(b"".join(tokens), dtype=np.uint8)
        self.start = np.concatenate([[0], np.cumsum([len(t) for t in tokens])]).astype(np.int64)

    def decode(self, ids: np.ndarray) -> bytes:
        """Bytes of ids, gathered without a loop over ids. An id that the file does not have, but lies below its highest, has none."""
        ids = np.asarray(ids, dtype=np.int64)
        if not len(ids):
            return b""
        first = self.start[ids]
        size = self.start[ids + 1] - first
        shift = np.repeat(first - (np.cumsum(size) - size), size)
        return self.flat[shift + np.arange(len(shift))].tobytes()


class Memo:
    """A dictionary in two generations, each of at most ``most`` entries: entries used lately survive when one is full."""

    def __init__(self, most: int) -> None:
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.most = most

    def get(self, key: str) -> bytes | None:
        if (x := self.new.get(key)) is None and (x := self.old.get(key)) is not None:
            self.put(key, x)
        return x

    def put(self, key: str, value: bytes) -> None:
        if len(self.new) >= self.most:
            self.old, self.new = self.new, {}
        if len(key) <= 64:
            self.new[key] = value


class Tokenizer:
    """Encoder and decoder over a rank file in the tiktoken format (base64 of the token's bytes, blank, rank)."""

    def __init__(self, rank_file: str, pattern: str, segments: int = 100_000, pieces: int = 300_000) -> None:
        pairs = token_table(rank_file)
        self.ranks = dict(pairs)
        self.hash = MinimalPerfectHash([t for t, _ in pairs])
        self.slots = [pairs[i] for i in self.hash.order]
        self.pieces = regex.compile(pattern).findall
        self.single = [self.ranks[bytes([x])] for x in range(256)]
        self.pairs = {}
        for t, r in pairs:
            for k in range(1, len(t)):
                if (a := self.ranks.get(t[:k])) is not None and (b := self.ranks.get(t[k:])) is not None:
                    self.pairs[(a << 32) + b] = r
        self.cache, self.known = Memo(segments), Memo(pieces)

    def whole(self, piece: bytes) -> int | None:
        """Tier one: the id of a piece that is a token."""
        key, rank = self.slots[self.hash.slot(piece)]
        return rank if key == piece else None

    def merged(self, piece: bytes) -> list[int]:
        """Tier two: merge the adjacent pair of the lowest rank, leftmost first, until no pair is a token.

        A heap entry is rank * 2**32 + position. It is stale, and skipped, if the tokens at its position no longer
        form that rank; a token and its rank determine each other, so the comparison is exact.
        """
        pairs, single = self.pairs, self.single
        ids = [single[x] for x in piece]
        n = len(ids)
        heap = [(r << 32) + i for i in range(n - 1) if (r := pairs.get((ids[i] << 32) + ids[i + 1])) is not None]
        if not heap:
            return ids
        heapq.heapify(heap)
        pop, push, get = heapq.heappop, heapq.heappush, pairs.get
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while heap:
            top = pop(heap)
            i, rank = top & 0xFFFFFFFF, top >> 32
            j = after[i]
            if j >= n or ids[i] < 0 or get((ids[i] << 32) + ids[j]) != rank:
                continue
            ids[i], ids[j] = rank, -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (r := get((rank << 32) + ids[k])) is not None:
                    push(heap, (r << 32) + i)
            if (h := before[i]) >= 0 and (r := get((ids[h] << 32) + rank)) is not None:
                push(heap, (r << 32) + h)
        return [x for x in ids if x >= 0]

    def encode_piece(self, piece: str) -> bytes:
        """Ids of a pre-token as little-endian int32."""
        b = piece.encode("utf-8", "surrogatepass")
        found = self.whole(b)
        return struct.pack("<i", found) if found is not None else struct.pack(f"<{len(m := self.merged(b))}i", *m)

    def encode_segment(self, segment: str) -> bytes:
        """Ids of a segment. Most are a blank and letters, then perhaps one stop or comma; the pattern cuts the rest."""
        if segment[1:].isalpha() and segment[0] == " ":
            pieces: tuple[str, ...] | list[str] = (segment,)
        elif segment[-1:] in (".", ",") and segment[0] == " " and segment[1:-1].isalpha():
            pieces = (segment[:-1], segment[-1])
        else:
            pieces = self.pieces(segment)
        get, out = self.known.get, []
        for p in pieces:
            if (x := get(p)) is None:
                x = self.encode_piece(p)
                self.known.put(p, x)
            out.append(x)
        return out[0] if len(out) == 1 else b"".join(out)

    def segments(self, text: str) -> list[str]:
        """The text cut before each U+0020 that is followed by anything but white space. Joined they are the text."""
        parts = text.split(" ")
        out, held = [], parts[0]
        for p in parts[1:]:
            if p and not p[0].isspace():
                out.append(held)
                held = " " + p
            else:
                held += " " + p
        out.append(held)
        return out

    def encoded(self, segments: list[str]) -> list[bytes]:
        """Ids of each segment as little-endian int32, remembered ones first."""
        found = list(map(self.cache.new.get, segments))
        if None in found:
            get, put = self.cache.get, self.cache.put
            for i, x in enumerate(found):
                if x is None:
                    s = segments[i]
                    if (x := get(s)) is None:
                        x = self.encode_segment(s)
                        put(s, x)
                    found[i] = x
        return found

    def encode_array(self, text: str) -> np.ndarray:
        """Ids of a text, as int32."""
        return np.frombuffer(b"".join(self.encoded(self.segments(text))), dtype="<i4")

    def encode(self, text: str) -> list[int]:
        return self.encode_array(text).tolist()


@lru_cache(maxsize=4)
def tokenizer(rank_file: str, pattern: str) -> Tokenizer:
    """One per worker and vocabulary."""
    return Tokenizer(rank_file, pattern)


@lru_cache(maxsize=4)
def decoder(rank_file: str) -> Decoder:
    return Decoder(rank_file)


def public_vocabulary() -> tuple[str, str]:
    """Path and pattern of the default vocabulary; both are parameters of the operators."""
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN


def encode(text: Column, rank_file: str, pattern: str) -> Column:
    """Column of ids (array of int) of a text; null and empty texts have no ids. Special tokens are ordinary text."""

    @F.pandas_udf("array<int>")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        t = tokenizer(rank_file, pattern)
        for texts in batches:
            yield pd.Series([t.encode_array(x or "") for x in texts], dtype=object)

    return of(text)


def decode(ids: Column, rank_file: str) -> Column:
    """Column of the bytes (binary) that ids stand for; a null array has none."""

    @F.pandas_udf("binary")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        d = decoder(rank_file)
        for rows in batches:
            yield pd.Series([d.decode(x if x is not None else ()) for x in rows], dtype=object)

    return of(ids)


def round_trip(text: Column, rank_file: str, pattern: str) -> Column:
    """Struct of ``ids`` and ``decoded`` of a text, both made by one worker, which halves the Python processes."""

    @F.pandas_udf("ids array<int>, decoded binary")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        t, d = tokenizer(rank_file, pattern), decoder(rank_file)
        for texts in batches:
            ids = [t.encode_array(x or "") for x in texts]
            yield pd.DataFrame({"ids": pd.Series(ids, dtype=object), "decoded": pd.Series([d.decode(x) for x in ids], dtype=object)})

    return of(text)


def joined(ids: Column) -> Column:
    """Decimal ids joined by commas."""
    return F.array_join(ids.cast("array<string>"), ",")


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every whole text (null: as empty)."""
    small_batches(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", round_trip(F.col("text"), *public_vocabulary()).alias("r"))
    ids, decoded = F.col("r.ids"), F.col("r.decoded")
    return docs.select("doc_id", F.size(ids).cast("long").alias("n_tokens"), F.sha2(joined(ids).cast("binary"), 256).alias("ids_sha256"), F.sha2(decoded, 256).alias("decoded_sha256"))


def stage_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Last pipeline stage: doc_id, source, n_tokens and the ids of every remaining document, copies included."""
    small_batches(spark)
    encoded = docs.select("doc_id", "source", encode(F.col("text"), *public_vocabulary()).alias("ids"))
    return encoded.select("doc_id", "source", F.size("ids").cast("long").alias("n_tokens"), "ids")
