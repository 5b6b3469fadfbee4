"""URL filters: host and path rules first, then gradient-boosted trees on lexical features of the URL.

The trees are regression trees on binned features, boosted on the logistic loss, trained on the driver from a bounded
sample of labelled URLs (``max_rows``). Scoring runs where the rows are, over whole batches.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

# The rules, as (verdict, host, path).
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NAMES = ("length", "host_length", "path_length", "query_length", "depth", "labels", "digit_ratio", "upper_ratio", "punct_ratio", "entropy", "host_entropy", "parameters", "longest_label", "hyphens", "suffix_rate", "suffix_seen", "section_rate", "section_seen", "extension", "secure", "fragment", "longest_digits")


def host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty for null or without ``://``."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://([^/?#]*)", 1), UPPER, LOWER)


def path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://[^/?#]*([^?#]*)", 1)


def rule_struct(host_: Column, path_: Column, rules: tuple[tuple[str, str, str], ...] = RULES) -> Column:
    """(rule, verdict) of the longest rule that fits: its host or a subdomain of it, and a path that begins with its path."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host_ == h) | host_.endswith("." + h)) & path_.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def entropy(s: str) -> float:
    """Shannon entropy of a string's characters in bits."""
    n = len(s)
    return -sum(c / n * math.log2(c / n) for c in Counter(s).values()) if n else 0.0


_DIGITS = re.compile(r"[0-9]+")


def parts(url: str | None) -> tuple[str, str, str, str]:
    """scheme, host, path, query with fragment."""
    scheme, sep, rest = (url or "").partition("://")
    if not sep:
        return "", "", "", url or ""
    m = re.match(r"([^/?#]*)([^?#]*)(.*)", rest, re.S)
    return scheme, m[1].translate(str.maketrans(UPPER, LOWER)), m[2], m[3]


def suffix(host_: str) -> str:
    """The last two labels of a host."""
    return ".".join(host_.split(".")[-2:])


def section(host_: str, path_: str) -> str:
    """The last label of a host with the first part of the path, which tells sites' parts apart."""
    return host_.rsplit(".", 1)[-1] + "/" + path_.partition("/")[2].partition("/")[0]


def lexical(url: str | None, suffixes: dict[str, tuple[float, int]]) -> list[float]:
    """Features of one URL, in the order of ``NAMES``; null counts as empty, and a text without a scheme is all query.
    ``suffixes``: block rate and count of host suffixes, and of sections, in training."""
    u = url or ""
    scheme, h, p, q = parts(u)
    n = max(1, len(u))
    labels = h.split(".")
    rate, seen = suffixes.get(suffix(h), (0.5, 0))
    section_rate, section_seen = suffixes.get(section(h, p), (0.5, 0))
    return [
        len(u),
        len(h),
        len(p),
        len(q),
        sum(1 for x in p.split("/") if x),
        len(labels),
        sum(c.isdigit() for c in u) / n,
        sum(c.isupper() for c in u) / n,
        sum(not c.isalnum() for c in u) / n,
        entropy(u),
        entropy(h),
        q.count("=") + q.count("&"),
        max(map(len, labels)),
        h.count("-") + p.count("-"),
        rate,
        math.log1p(seen),
        section_rate,
        math.log1p(section_seen),
        float("." in p.rsplit("/", 1)[-1]),
        float(scheme == "https"),
        float("#" in q),
        max((len(x) for x in _DIGITS.findall(u)), default=0),
    ]


@dataclass(frozen=True)
class Trees:
    """Boosted trees of one depth as arrays: a node's feature and bound; leaves follow in order. Size is fixed by count and depth."""

    bias: float
    features: np.ndarray
    bounds: np.ndarray
    leaves: np.ndarray
    suffixes: dict[str, tuple[float, int]]

    def margin(self, x: np.ndarray) -> np.ndarray:
        depth = int(math.log2(self.leaves.shape[1])) if len(self.leaves) else 0
        out = np.full(len(x), self.bias)
        rows = np.arange(len(x))
        for f, b, v in zip(self.features, self.bounds, self.leaves, strict=True):
            node = np.zeros(len(x), dtype=np.int64)
            for _ in range(depth):
                node = 2 * node + 1 + (x[rows, f[node]] > b[node])
            out += v[node - (len(f))]
        return out

    def block_probability(self, urls: list[str | None]) -> np.ndarray:
        x = np.array([lexical(u, self.suffixes) for u in urls], dtype=float).reshape(-1, len(NAMES))
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -30, 30)))


def boost(x: np.ndarray, y: np.ndarray, rounds: int = 40, depth: int = 3, rate: float = 0.3, bins: int = 32, ridge: float = 1.0) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
    """Bias, and per tree the features, bounds and leaf values, by second-order boosting on histograms of binned features."""
    p = min(0.99, max(0.01, float(y.mean()) if len(y) else 0.5))
    bias = math.log(p / (1 - p))
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) if len(x) else np.zeros(0) for f in range(x.shape[1])]
    binned = np.column_stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)]) if len(x) else np.zeros((0, x.shape[1]), dtype=np.int64)
    margin = np.full(len(x), bias)
    inner = 2**depth - 1
    all_f, all_b, all_v = [], [], []
    for _ in range(rounds if len(x) else 0):
        q = 1 / (1 + np.exp(-margin))
        g, h = y - q, q * (1 - q)
        feature, bound = np.zeros(inner, dtype=np.int64), np.full(inner, np.inf)
        node = np.zeros(len(x), dtype=np.int64)
        for level in range(depth):
            for k in range(2**level - 1, 2 ** (level + 1) - 1):
                own = node == k
                best = 1e-6
                total_g, total_h = g[own].sum(), h[own].sum()
                for f, c in enumerate(cuts):
                    if not len(c) or not own.any():
                        continue
                    left_g = np.cumsum(np.bincount(binned[own, f], g[own], len(c) + 1))[:-1]
                    left_h = np.cumsum(np.bincount(binned[own, f], h[own], len(c) + 1))[:-1]
                    gain = left_g**2 / (left_h + ridge) + (total_g - left_g) ** 2 / (total_h - left_h + ridge) - total_g**2 / (total_h + ridge)
                    j = int(gain.argmax())
                    if gain[j] > best:
                        best, feature[k], bound[k] = gain[j], f, c[j]
            node = 2 * node + 1 + (x[np.arange(len(x)), feature[node]] > bound[node])
        leaf = node - inner
        value = rate * np.bincount(leaf, g, 2**depth) / (np.bincount(leaf, h, 2**depth) + ridge)
        margin += value[leaf]
        all_f.append(feature)
        all_b.append(bound)
        all_v.append(value)
    return bias, np.array(all_f).reshape(-1, inner), np.array(all_b).reshape(-1, inner), np.array(all_v).reshape(-1, 2**depth)


def fit(labelled: DataFrame, max_rows: int = 20_000) -> Trees:
    """Trees from rows (url, block) with block 0 or 1: at most ``max_rows`` of them, those of the least hashes of the URL.

    A bound on the hash, set from the count so that about twice as many pass, comes before the sort: what partitions sort
    and send does not grow with the table.

    Suffix statistics come from one half of the sample and the trees from the other, so that a rate never holds the label
    it helps to predict. Without rows, every URL has an even chance.
    """
    known = labelled.where("block in (0, 1)").groupBy("url").agg(F.max("block").alias("block"))
    part = min(1.0, 2.0 * max_rows / max(1, known.count()))
    known = known.withColumn("h", F.xxhash64("url")).where(F.col("h") <= F.lit(round(part * 2**64) - 2**63 - 1 if part < 1 else 2**63 - 1))
    rows = known.orderBy("h", "url").limit(max_rows).collect()
    half: dict[str, list[int]] = {}
    for r in rows[::2]:
        _, h, p, _ = parts(r["url"])
        for key in (suffix(h), section(h, p)):
            half.setdefault(key, []).append(r["block"])
    suffixes = {s: ((sum(v) + 1) / (len(v) + 2), len(v)) for s, v in half.items()}
    use = rows[1::2] or rows
    x = np.array([lexical(r["url"], suffixes) for r in use], dtype=float).reshape(-1, len(NAMES))
    return Trees(*boost(x, np.array([float(r["block"]) for r in use])), suffixes)


def block_probability(url: Column, model: Trees, spark: SparkSession) -> Column:
    """Column of the model's probability that a URL is to be blocked; null counts as empty."""
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for urls in batches:
            yield pd.Series(shared.value.block_probability(list(urls)), dtype=float)

    return of(url)


def judge(pages: DataFrame, model: Trees | None = None) -> DataFrame:
    """``pages`` with host, path, rule, verdict (replaced where present) from their column url.

    Without a model, one is trained on the URLs that the rules judge, with the rules' verdicts as labels.
    """
    new = ["host", "path", "rule", "verdict"]
    rows = pages.drop(*new).withColumns({"host": host(F.col("url")), "path": path(F.col("url"))}).withColumn("__r", rule_struct(F.col("host"), F.col("path")))
    if model is None:
        model = fit(rows.where("__r is not null").select("url", (F.col("__r.verdict") == "block").cast("int").alias("block")))
    learned = F.when(block_probability(F.col("url"), model, pages.sparkSession) >= 0.5, "block").otherwise("allow")
    out = rows.withColumns({"rule": F.col("__r.rule"), "verdict": F.coalesce(F.col("__r.verdict"), learned)})
    return out.select(*[c for c in pages.columns if c not in new], *new)


def op9_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, host, path, rule, verdict of every page; a null url has an empty host and path and the trees' verdict on an empty
    text. Rows that repeat are judged alike; an empty table gives no rows."""
    return judge(table(spark, sf_dir, "pages").select("page_id", "url"))
