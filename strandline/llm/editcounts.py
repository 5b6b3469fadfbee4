"""Token counts that follow edits without encoding a document again.

A document is cut into segments (see ``bpe``): runs of whole pre-tokens that begin at a place where the pattern cuts
whatever surrounds it, namely a U+0020 followed by anything but white space; long ones, as in texts without blanks, are
cut further where letters, digits, marks and white space meet. A pre-token itself is never cut. Slots of ``SLOT`` segments
are the leaves of a segment tree whose nodes hold characters and tokens below them. An edit descends by characters to the
segments it touches, takes two characters of context before and one after (a cut depends on the characters on its two
sides, or on itself and the next one), encodes that stretch again, and adds the differences along the paths to the root.
A slot that has grown to ``GROWN`` times its size is dealt out again, so many edits at one place stay cheap.

Trees can be kept in a table: ``kept_tree`` gives the leaves' sizes and counts, from which ``edited_counts`` builds the tree
again without encoding anything.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import Tokenizer, public_vocabulary, tokenizer
from .common import small_batches, table

SLOT = 32
GROWN = 4
#: Characters of a segment from which it is cut further.
LONG = 64
#: Where the pattern cuts whatever surrounds the two characters. An apostrophe may belong to the letters behind it.
_MEET = regex.compile(r"(?<=\p{L})(?=[^\p{L}\s])|(?<=\p{N})(?=[^\p{N}\s])|(?<=[^\s\p{L}\p{N}])(?=\p{N})|(?<=[^\s\p{L}\p{N}'])(?=\p{L})|(?<=\S)(?=\s)")


def cut(text: str, t: Tokenizer) -> list[str]:
    """Segments of a text, long ones cut into parts of about ``LONG`` characters."""
    whole = t.segments(text)
    if max(map(len, whole)) <= LONG:
        return whole
    out = []
    for s in whole:
        if len(s) <= LONG:
            out.append(s)
            continue
        at = 0
        for m in _MEET.finditer(s):
            if m.start() - at >= LONG:
                out.append(s[at : m.start()])
                at = m.start()
        out.append(s[at:])
    return out


class EditTree:
    """Segment tree over one text. ``total`` is its number of tokens, ``encoded`` how many segments edits have encoded.

    ``kept``: lengths and token counts of the segments, as an earlier tree gave them; else the text is cut and encoded.
    """

    def __init__(self, text: str, t: Tokenizer, kept: tuple[list[int], list[int]] | None = None) -> None:
        self.t, self.encoded = t, 0
        if kept is None:
            segments = cut(text, t)
            counts = self.count(segments)
        else:
            stops = list(accumulate(kept[0]))
            if (stops[-1] if stops else 0) != len(text):
                raise ValueError("the kept tree is not one of this text")
            segments, counts = [text[b - n : b] for b, n in zip(stops, kept[0], strict=True)], list(kept[1])
        self.build(segments, counts)

    def count(self, segments: list[str]) -> list[int]:
        return [len(x) >> 2 for x in self.t.encoded(segments)]

    def build(self, segments: list[str], counts: list[int]) -> None:
        self.slots = [(segments[i : i + SLOT], counts[i : i + SLOT]) for i in range(0, len(segments), SLOT)]
        n = 1
        while n < len(self.slots):
            n *= 2
        self.n = n
        self.chars, self.tokens = [0] * (2 * n), [0] * (2 * n)
        for i, (s, c) in enumerate(self.slots):
            self.chars[n + i], self.tokens[n + i] = sum(map(len, s)), sum(c)
        for i in range(n - 1, 0, -1):
            self.chars[i] = self.chars[2 * i] + self.chars[2 * i + 1]
            self.tokens[i] = self.tokens[2 * i] + self.tokens[2 * i + 1]

    def leaves(self) -> tuple[list[int], list[int]]:
        """Lengths and token counts of all segments, in order."""
        return [len(s) for own, _ in self.slots for s in own], [c for _, own in self.slots for c in own]

    @property
    def total(self) -> int:
        return self.tokens[1]

    def find(self, at: int) -> tuple[int, int]:
        """The slot that holds the character at an offset, and the slot's own offset; past the end, the last one."""
        i, start = 1, 0
        at = min(at, self.chars[1] - 1) if self.chars[1] else 0
        while i < self.n:
            i *= 2
            if at - start >= self.chars[i]:
                start += self.chars[i]
                i += 1
        return i - self.n, start

    def edit(self, start: int, stop: int, text: str) -> None:
        """Replaces the code points from start to stop (held to the text, and to each other) by ``text``."""
        size = self.chars[1]
        start = min(max(0, start), size)
        stop = min(max(start, stop), size)
        first, offset = self.find(max(0, start - 2))
        last, _ = self.find(min(size, stop + 1))
        last = max(first, last)
        segments = [s for k in range(first, last + 1) for s in self.slots[k][0]]
        counts = [c for k in range(first, last + 1) for c in self.slots[k][1]]
        begins = [offset, *accumulate(map(len, segments), initial=offset)][1:]
        i = max(0, bisect_right(begins, max(offset, start - 2), 0, len(segments)) - 1)
        # The first segment that begins behind the character after the edit: its cut has seen nothing of the edit.
        j = max(i + 1, bisect_right(begins, stop, 0, len(segments)))
        old = "".join(segments[i:j])
        at = begins[i]
        new = cut(old[: start - at] + text + old[stop - at :], self.t)
        self.encoded += len(new)
        segments[i:j] = new
        counts[i:j] = self.count(new)
        # The stretch goes to its slots, evenly. What makes slots grow too large is paid for by the edits that did so.
        share = max(SLOT, -(-len(segments) // (last + 1 - first)))
        for k in range(first, last + 1):
            part = slice((k - first) * share, (k - first + 1) * share)
            self.put(k, segments[part], counts[part])
        if share > GROWN * SLOT:
            self.build([s for own, _ in self.slots for s in own], [c for _, own in self.slots for c in own])

    def put(self, k: int, segments: list[str], counts: list[int]) -> None:
        self.slots[k] = segments, counts
        i = self.n + k
        more_chars, more_tokens = sum(map(len, segments)) - self.chars[i], sum(counts) - self.tokens[i]
        while i:
            self.chars[i] += more_chars
            self.tokens[i] += more_tokens
            i //= 2

    def text(self) -> str:
        return "".join(s for segments, _ in self.slots for s in segments)


def kept_tree(text: Column, rank_file: str, pattern: str) -> Column:
    """Struct (chars, tokens): lengths in code points and token counts of a text's segments, the leaves of its tree. A null or
    empty text has one empty segment."""

    @F.pandas_udf("chars array<int>, tokens array<int>")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        t = tokenizer(rank_file, pattern)
        for texts in batches:
            own = [EditTree(x or "", t).leaves() for x in texts]
            yield pd.DataFrame({"chars": [np.array(c, dtype=np.int32) for c, _ in own], "tokens": [np.array(n, dtype=np.int32) for _, n in own]})

    return of(text)


def edited_counts(text: Column, edits: Column, rank_file: str, pattern: str, kept: Column | None = None) -> Column:
    """Struct (n_tokens, edited_tokens, n_segments, n_encoded): tokens of a text before and after its edits, its segments, and
    those that the edits encoded; with ``kept`` also chars and tokens, the leaves of the tree after the edits, to be kept.

    ``edits``: array of struct (start, stop, text), each over the text as the ones before left it, in code points; parts
    outside the text are held to it, and nulls count as 0, 0 and empty. A null text is empty; null edits are none. ``kept``:
    what ``kept_tree``, or an earlier call, gave for the text; without it, or where it is null, the text is encoded once.
    """

    columns = ["n_tokens", "edited_tokens", "n_segments", "n_encoded", *(["chars", "tokens"] if kept is not None else [])]

    @F.pandas_udf(", ".join(f"{c} {'long' if k < 4 else 'array<int>'}" for k, c in enumerate(columns)))
    def of(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        t = tokenizer(rank_file, pattern)
        for texts, lists, *trees in batches:
            out = []
            old = trees[0].to_dict("records") if trees else [None] * len(texts)
            for x, own, leaves in zip(texts, lists, old, strict=True):
                known = leaves is not None and leaves["chars"] is not None
                tree = EditTree(x or "", t, (list(leaves["chars"]), list(leaves["tokens"])) if known else None)
                before, segments = tree.total, sum(len(s) for s, _ in tree.slots)
                for e in own if own is not None else ():
                    if e is not None:
                        tree.edit(e["start"] or 0, e["stop"] or 0, e["text"] or "")
                after = [np.array(v, dtype=np.int32) for v in tree.leaves()] if trees else []
                out.append((before, tree.total, segments, tree.encoded, *after))
            yield pd.DataFrame(out, columns=columns)

    return of(text, edits) if kept is None else of(text, edits, kept)


def sample_edits(n: Column) -> Column:
    """The edits of the registered query, by a text's length n: a replacement, an insertion, a deletion and an append."""
    third = F.floor(n / 3).cast("int")
    half = F.floor(n / 2).cast("int")
    edit = lambda a, b, t: F.struct(a.alias("start"), b.alias("stop"), F.lit(t).alias("text"))
    return F.array(edit(third, third + 7, "it's 2024"), edit(half, half, " re-encoded\n  here"), edit(third * 2, third * 2 + 11, ""), edit(n + 99, n + 99, " end."))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, edited_tokens, n_segments, n_encoded of every whole text, edited by ``sample_edits``."""
    small_batches(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    docs = docs.select("doc_id", edited_counts(F.col("text"), sample_edits(F.char_length("text")), *public_vocabulary()).alias("c"))
    return docs.select("doc_id", "c.n_tokens", "c.edited_tokens", "c.n_segments", "c.n_encoded")
