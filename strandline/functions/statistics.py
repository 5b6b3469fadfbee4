"""Statistics without a relational form, as Arrow UDFs: exact tests, binomial sums, local alignment, Python's rounding."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType


def fisher_exact(a: int, b: int, c: int, d: int) -> float:
    """Two-sided p of a 2x2 table: tables of the same margins that are no likelier, with a relative slack of 1e-7."""
    n1, n2, k = a + b, c + d, a + c
    logs = lambda x: math.lgamma(n1 + 1) - math.lgamma(x + 1) - math.lgamma(n1 - x + 1) + math.lgamma(n2 + 1) - math.lgamma(k - x + 1) - math.lgamma(n2 - k + x + 1)
    values = [logs(x) for x in range(max(0, k - n2), min(k, n1) + 1)]
    base = max(values)
    p = [math.exp(v - base) for v in values]
    own = math.exp(logs(a) - base) * (1 + 1e-7)
    return min(1.0, sum(x for x in p if x <= own) / sum(p))


def binomial_cdf(k: int, n: int, p: float) -> float:
    """P(X <= k) of a binomial."""
    return min(1.0, sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(0, min(k, n) + 1))) if k >= 0 else 0.0


def local_alignment(x: str, y: str, match: int = 2, mismatch: int = -3, opening: int = -5, extension: int = -2) -> int:
    """Best local alignment score with affine gaps, by anti-dependent rows over numpy arrays."""
    if not x or not y:
        return 0
    b = np.frombuffer(y.encode("utf-32-le"), dtype=np.uint32)
    best, n = 0, len(b)
    h, e = np.zeros(n + 1, dtype=np.int64), np.full(n + 1, -(10**9), dtype=np.int64)
    ramp = np.arange(n + 1) * extension
    for ch in x:
        e = np.maximum(e + extension, h + opening)
        diagonal = h[:-1] + np.where(b == ord(ch), match, mismatch)
        t = np.maximum(np.concatenate([[0], diagonal]), np.maximum(e, 0))
        # A gap along the row from any earlier cell: a running maximum after the ramp is taken out.
        f = np.concatenate([[-(10**9)], np.maximum.accumulate(t - ramp)[:-1]]) + ramp + opening - extension
        h = np.maximum(t, f)
        h[0] = 0
        best = max(best, int(h.max()))
    return best


def _padded(texts: list[str], pad: int) -> np.ndarray:
    """Code points of texts as rows of one width, filled up with ``pad``."""
    out = np.full((len(texts), max(map(len, texts))), pad, dtype=np.uint32)
    for row, text in zip(out, texts, strict=True):
        row[: len(text)] = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return out


def local_alignments(xs: list[str], ys: list[str], match: int = 2, mismatch: int = -3, opening: int = -5, extension: int = -2, cells: int = 1 << 18) -> list[int]:
    """``local_alignment`` of many pairs at once: pairs of like lengths share numpy rows, ``cells`` of them at a time.

    Fillings match nothing, so that with penalties below 0 no score in them passes one before them.
    """
    out = [0] * len(xs)
    order = sorted((i for i in range(len(xs)) if xs[i] and ys[i]), key=lambda i: (len(ys[i]), len(xs[i])))
    at = 0
    while at < len(order):
        stop = at + 1
        while stop < len(order) and (stop + 1 - at) * (len(ys[order[stop]]) + 1) <= cells:
            stop += 1
        some = order[at:stop]
        a, b = _padded([xs[i] for i in some], 0xFFFFFFFF), _padded([ys[i] for i in some], 0xFFFFFFFE)
        n, low = b.shape[1], -(10**9)
        h, e = np.zeros((len(some), n + 1), dtype=np.int64), np.full((len(some), n + 1), low, dtype=np.int64)
        best, ramp = np.zeros(len(some), dtype=np.int64), np.arange(n + 1) * extension
        for k in range(a.shape[1]):
            e = np.maximum(e + extension, h + opening)
            t = np.maximum(e, 0)
            t[:, 1:] = np.maximum(t[:, 1:], h[:, :-1] + np.where(b == a[:, k : k + 1], match, mismatch))
            f = np.maximum.accumulate(t - ramp, axis=1)[:, :-1] + ramp[1:] + opening - extension
            h = t
            h[:, 1:] = np.maximum(h[:, 1:], f)
            h[:, 0] = 0
            best = np.maximum(best, h.max(axis=1))
        for i, v in zip(some, best.tolist(), strict=True):
            out[i] = v
        at = stop
    return out


class SuffixAutomaton:
    """All substrings of a text in a number of states that its length bounds twice over."""

    def __init__(self, text: str) -> None:
        self.next: list[dict[str, int]] = [{}]
        self.link, self.length, last = [-1], [0], 0
        for ch in text:
            new = self._state(self.length[last] + 1, {}, 0)
            at = last
            while at != -1 and ch not in self.next[at]:
                self.next[at][ch] = new
                at = self.link[at]
            if at != -1:
                old = self.next[at][ch]
                if self.length[old] == self.length[at] + 1:
                    self.link[new] = old
                else:
                    # A state that stands for longer texts too is split: its shorter ones get a state of their own.
                    short = self._state(self.length[at] + 1, dict(self.next[old]), self.link[old])
                    while at != -1 and self.next[at].get(ch) == old:
                        self.next[at][ch] = short
                        at = self.link[at]
                    self.link[old] = self.link[new] = short
            last = new

    def _state(self, length: int, onward: dict[str, int], link: int) -> int:
        self.next.append(onward)
        self.length.append(length)
        self.link.append(link)
        return len(self.length) - 1

    def longest_in(self, other: str) -> tuple[int, int]:
        """(length, end) of the first of the longest substrings of ``other`` that are in the text."""
        at = n = best = end = 0
        for i, ch in enumerate(other):
            while at and ch not in self.next[at]:
                at = self.link[at]
                n = self.length[at]
            if ch in self.next[at]:
                at, n = self.next[at][ch], n + 1
            if n > best:
                best, end = n, i + 1
        return best, end


def common_substring(x: str, y: str) -> str:
    """The longest text that stands in both; of several the one that ends first in y."""
    n, end = SuffixAutomaton(x).longest_in(y)
    return y[end - n : end]


@F.pandas_udf(StringType())
def longest_common(x: pd.Series, y: pd.Series) -> pd.Series:
    """A null text counts as empty."""
    return pd.Series([common_substring(a or "", b or "") for a, b in zip(x, y, strict=True)], dtype=object)


@F.pandas_udf(DoubleType())
def fisher(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
    return pd.Series([fisher_exact(*map(int, t)) for t in zip(a, b, c, d, strict=True)], dtype=float)


@F.pandas_udf(DoubleType())
def binomial(k: pd.Series, n: pd.Series, p: pd.Series) -> pd.Series:
    return pd.Series([binomial_cdf(int(i), int(j), float(q)) for i, j, q in zip(k, n, p, strict=True)], dtype=float)


@F.pandas_udf(LongType())
def smith_waterman(x: pd.Series, y: pd.Series) -> pd.Series:
    return pd.Series(local_alignments([a or "" for a in x], [b or "" for b in y]), dtype="int64")


@F.pandas_udf(DoubleType())
def pair_weight(text: pd.Series) -> pd.Series:
    """Sum of n log2 n over the counts n of a text's overlapping character pairs."""

    def one(s: str) -> float:
        c = np.frombuffer(s.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
        n = np.unique((c[:-1] << 21) + c[1:], return_counts=True)[1]
        return float((n * np.log2(n)).sum())

    return pd.Series([one(s) for s in text], dtype=float)


@F.pandas_udf(DoubleType())
def py_round(x: pd.Series, digits: pd.Series) -> pd.Series:
    """Rounding half to even on the binary value, as Python does it."""
    return pd.Series([None if pd.isna(v) else round(float(v), int(k)) for v, k in zip(x, digits, strict=True)], dtype=float)


def register(spark: SparkSession) -> None:
    """Names for SQL users."""
    for name, f in (("fisher_exact", fisher), ("binomial_cdf", binomial), ("smith_waterman", smith_waterman), ("longest_common", longest_common), ("py_round", py_round)):
        spark.udf.register(name, f)
