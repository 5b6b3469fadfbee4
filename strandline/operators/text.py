"""Checks of prose and traces: numbers, positions, sentences, quotes, redaction, findings."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NUMBER = r"(?<![\w.])(\d+(?:\.\d+)?)(?![\w.]*\w)"
#: Rules for findings, as (name, pattern).
RULES = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}"),
    ("path", r"/(?:home|Users|mnt|media)/[A-Za-z0-9._/-]+"),
    ("assignment", r"(?:password|secret|token|api_key)\x20*[:=]\x20*[A-Za-z0-9+/_-]{8,}"),
    ("long_hex", r"\b[0-9a-f]{32,}\b"),
    ("digits11", r"\b[0-9]{11}\b"),
)


def numbers(text: Column) -> Column:
    """Array of the numbers in prose, as doubles; digits inside words and versions are none."""
    return F.transform(F.regexp_extract_all(text, F.lit(NUMBER), F.lit(1)), lambda x: x.try_cast("double"))


def supported(number: Column, values: Column, tolerance: float = 0.011) -> Column:
    """A value that the number may stand for: within a tolerance of it, of its rounding, or of its percentage."""
    near = lambda v: F.abs(number - v) <= tolerance
    return F.exists(values, lambda v: near(v) | near(F.round(v, 0)) | (v.between(0, 1) & near(v * 100)))


def sentences(text: Column) -> Column:
    """Array of sentences: cut after . ! ? before white space, and at line breaks."""
    return F.filter(F.split(text, r"(?<=[.!?])\s+|\n+"), lambda s: s != "")


def redacted(text: Column, terms: list[tuple[str, str]]) -> Column:
    """Text with terms masked by their labels, longest term first, whatever the case; blank, - and _ are one in a term."""
    for term, label in sorted(terms, key=lambda t: (-len(t[0]), t)):
        body = r"[ _-]".join(re.escape(p) for p in re.split(r"[ _-]+", term))
        text = F.regexp_replace(text, rf"(?i)(?<![A-Za-z0-9]){body}(?![A-Za-z0-9])", f"[{label}]")
    return text


def findings(df: DataFrame, key: str, text: str, rules: tuple[tuple[str, str], ...] = RULES) -> DataFrame:
    """(key, rule, found): every match of every rule."""
    all_ = F.concat(*[_matches(text, name, p) for name, p in rules])
    return df.select(key, F.explode(all_).alias("f")).select(key, "f.rule", "f.found")


def _matches(text: str, name: str, pattern: str) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1)), lambda m: F.struct(F.lit(name).alias("rule"), m.alias("found")))


def checksum_valid(code: Column) -> Column:
    """Eleven digits whose last is the weighted sum of the others modulo 11; on 10 a second set of weights, then 0."""
    digits = F.transform(F.filter(F.split(code, ""), lambda c: c != ""), lambda c: c.cast("int"))

    # The two sets of weights of this kind of number.
    def weighted(weights: list[int]) -> Column:
        return F.aggregate(F.zip_with(F.slice(digits, 1, 10), F.array(*[F.lit(w) for w in weights]), lambda d, w: d * w), F.lit(0), lambda s, x: s + x) % 11

    one, two = weighted([1, 2, 3, 4, 5, 6, 7, 8, 9, 1]), weighted([3, 4, 5, 6, 7, 8, 9, 1, 2, 3])
    check = F.when(one < 10, one).when(two < 10, two).otherwise(0)
    return F.when(code.rlike(r"^[0-9]{11}$"), F.get(digits, F.lit(10)) == check).otherwise(F.lit(False))


def identifier_valid(code: Column) -> Column:
    """``checksum_valid``, and the digits before it are a date: the first names the century (1 and 2 the 19th, up to 6 the 21st),
    then come year, month and day; no year before 1870."""
    part = lambda at, n: F.substring(code, at, n).cast("int")
    year = 1800 + 100 * F.floor((part(1, 1) - 1) / 2) + part(2, 2)
    dated = F.when(code.rlike(r"^[1-6][0-9]{10}$"), part(4, 2).between(1, 12) & part(6, 2).between(1, 31) & (year >= 1870)).otherwise(F.lit(False))
    return F.when(dated, checksum_valid(code)).otherwise(F.lit(False))


def mentions(text: Column) -> Column:
    """array<struct<raw,lo,hi>> of positions in prose: grouped whole numbers, and Mb or kb with their rounding interval."""
    grouped = F.transform(F.regexp_extract_all(text, F.lit(r"\b(\d{1,3}(?:,\d{3})+)\b"), F.lit(1)), lambda r: F.struct(r.alias("raw"), F.replace(r, F.lit(","), F.lit("")).cast("double").alias("lo"), F.replace(r, F.lit(","), F.lit("")).cast("double").alias("hi")))

    def unit(name: str, size: float) -> Column:
        raw = F.regexp_extract_all(text, F.lit(rf"\b(\d+(?:\.\d+)?) ?{name}\b"), F.lit(1))

        def one(r: Column) -> Column:
            decimals = F.coalesce(F.char_length(F.get(F.split(r, r"\."), F.lit(1))), F.lit(0))
            half = F.lit(size) * 0.5 * F.pow(F.lit(10.0), -decimals)
            return F.struct(F.concat(r, F.lit(f" {name}")).alias("raw"), (r.cast("double") * size - half).alias("lo"), (r.cast("double") * size + half).alias("hi"))

        return F.transform(raw, one)

    return F.concat(grouped, unit("Mb", 1e6), unit("kb", 1e3))


def scrubbed(text: Column, home: str = "/home/") -> Column:
    """Home folders become ~, other absolute paths their last part."""
    text = F.regexp_replace(text, re.escape(home) + r"[A-Za-z0-9._-]+", "~")
    return F.regexp_replace(text, r"(?<![\w~.])/(?:[\w.-]+/)+([\w.-]+)", "$1")


def call_shape(text: Column) -> Column:
    """A tool call written as text: a JSON object with a name and arguments, a tag, or name(argument=...)."""
    return text.rlike(r'\{\s*"(?:name|tool)"\s*:\s*"\w+"\s*,\s*"(?:arguments|parameters|params)"\s*:') | text.rlike(r"<tool_call>|<function=") | text.rlike(r"^\s*\w+\(\w+\s*=")


#: Fixed value: what a claim about a gene's function or disease looks like.
FUNCTION_CLAIM = r"\bgene\b.{0,40}\bfunction\b|\bencodes\b|\bassociated with\b.{0,40}\bdisease\b"


def unlooked_claims(report: Column, tools: Column, phrases: list[str]) -> Column:
    """Array of flags of a report: ``provenance`` where it has one of the phrases, ``gene function`` where it speaks of one
    though no call of the run (array of tool names) looked genes up."""
    low = F.lower(F.coalesce(report, F.lit("")))
    said = F.lit(False)
    for p in phrases:
        said = said | F.contains(low, F.lit(p.lower()))
    looked = F.coalesce(F.array_contains(tools, "gene_at_locus"), F.lit(False))
    return F.filter(F.array(F.when(said, "provenance"), F.when(low.rlike(FUNCTION_CLAIM) & ~looked, "gene function")), lambda f: f.isNotNull())


def unsupported_sizes(report: Column, positions: Column) -> Column:
    """Array of the sizes (``1,200 bp``, ``3.5 kb``) in a report that no two of the positions (array of numbers) lie apart,
    give or take 2 % or 2 bases."""
    pattern = r"(?i)([\d,]*\d(?:\.\d+)?)\s*(bp|base pairs?|kb|kilobases?)\b"
    sizes = F.arrays_zip(F.regexp_extract_all(report, F.lit(pattern), F.lit(1)).alias("n"), F.regexp_extract_all(report, F.lit(pattern), F.lit(2)).alias("u"))
    bases = lambda s: F.replace(s["n"], F.lit(","), F.lit("")).try_cast("double") * F.when(F.lower(s["u"]).startswith("k"), 1000).otherwise(1)
    apart = lambda x: F.exists(positions, lambda a: F.exists(positions, lambda b: (a != b) & (F.abs(F.abs(a - b) - x) <= F.greatest(F.lit(2.0), 0.02 * x))))
    return F.transform(F.filter(sizes, lambda s: ~F.coalesce(apart(bases(s)), F.lit(False))), lambda s: s["n"])


def without_paths(df: DataFrame, column: str, fields: list[str]) -> DataFrame:
    """``df`` whose struct ``column`` has, in place of fields that hold paths, a handle: the first 12 digits of their sha256."""
    handle = F.struct(*[F.substring(F.sha2(F.col(f"{column}.{f}").cast("binary"), 256), 1, 12).alias(f"{f}_handle") for f in fields])
    rest = [f for f in df.schema[column].dataType.fieldNames() if f not in fields]
    return df.withColumn(column, F.struct(*[F.col(f"{column}.{f}").alias(f) for f in rest], *[handle[f"{f}_handle"].alias(f"{f}_handle") for f in fields]))
