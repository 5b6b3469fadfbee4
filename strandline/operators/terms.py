"""Masking by lists of many terms: one pass of an Aho-Corasick automaton over each text."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import redacted

#: From so many terms on, an automaton takes the place of one regular expression for each.
MANY = 16
#: Terms of a list; they go to every task.
MOST_TERMS = 1_000_000
_LOWER = {c: c + 32 for c in range(65, 91)} | {ord("-"): 32, ord("_"): 32}
_WORD = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789")


@lru_cache(maxsize=4)
def automaton(terms: tuple[tuple[str, str], ...]):
    """Automaton over lower-cased terms (A-Z) whose runs of blank, - and _ are one blank; a term's value is (turn, length, label),
    turns falling from the longest term, as in ``text.redacted``."""
    import ahocorasick

    a = ahocorasick.Automaton()
    for turn, (term, label) in enumerate(sorted(terms, key=lambda t: (-len(t[0]), t))):
        own = re.sub(r"[ _-]+", " ", term).translate(_LOWER)
        if own and own not in a:
            a.add_word(own, (turn, len(own), label))
    a.make_automaton()
    return a


def masked_text(text: str, a) -> str:
    """A text with its terms masked: longer terms first, and those of one term from the left; labels are not looked into."""
    flat = text.translate(_LOWER)
    found = []
    for last, (turn, n, label) in a.iter(flat) if len(a) else ():
        start = last + 1 - n
        if (start == 0 or flat[start - 1] not in _WORD) and (last + 1 == len(flat) or flat[last + 1] not in _WORD):
            found.append((turn, start, last + 1, label))
    if not found:
        return text
    taken = bytearray(len(text))
    spans = []
    for _, start, end, label in sorted(found):
        # Spans taken so far are no shorter, so one that overlaps this one covers an end of it.
        if not taken[start] and not taken[end - 1]:
            taken[start:end] = b"\x01" * (end - start)
            spans.append((start, end, label))
    out, at = [], 0
    for start, end, label in sorted(spans):
        out += [text[at:start], f"[{label}]"]
        at = end
    return "".join([*out, text[at:]])


def masked(text: Column, terms: list[tuple[str, str]]) -> Column:
    """A text with terms (term, label) masked as by ``text.redacted``, in one pass however many terms there are.

    A null text stays null. Without terms texts stay as they are. More than ``MOST_TERMS`` terms raise ValueError.
    """
    if len(terms) > MOST_TERMS:
        raise ValueError(f"{len(terms)} terms; at most {MOST_TERMS} go to the tasks")
    if len(terms) < MANY:
        return redacted(text, terms)
    own = tuple(sorted(set(terms)))

    @F.pandas_udf("string")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        a = automaton(own)
        for texts in batches:
            yield pd.Series([None if t is None else masked_text(t, a) for t in texts], dtype=object)

    return of(text)


def frequent_words(df: DataFrame, text: str, least_chars: int, most: int) -> list[tuple[str, str]]:
    """(word, label) of the ``most`` most frequent words of lower-case letters, for a list of terms made from a table; labels are
    W and a place among ten. ``most`` bounds what the driver gets."""
    words = df.select(F.explode(F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(rf"(?<![A-Za-z0-9])([a-z]{{{least_chars},}})(?![A-Za-z0-9])"), F.lit(1))).alias("w"))
    top = words.groupBy("w").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "w").limit(most).collect()
    return [(r["w"], f"W{i % 10}") for i, r in enumerate(top)]
