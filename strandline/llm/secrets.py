"""Secret scans with SQL functions only: three base patterns, and sliding-window entropy over candidate strings.

Positions come without a Python UDF: ``split`` by a pattern gives what stands between the matches that
``regexp_extract_all`` gives, so running sums of the lengths are the matches' code-point offsets.

Entropy: a candidate is a run of 20 or more characters of ``CANDIDATE``. A window of 20 characters moves over it; as a
character enters and one leaves, only those two counts change, and with them the sum of c*log2(c) that the entropy needs.
A candidate is reported if its highest window reaches the bound of its character class and no allow-list entry fits it.
Letters alone are no secret where they read like words: no window has ``RARE_PAIRS`` pairs of letters that English, French,
German and Spanish words seldom have. Joined words have one or two such pairs in a window, random letters eight. Entropy spans that base spans cover wholly are left out; others stay beside them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

# The base patterns, in the order in which kinds are listed.
ASSIGN = r"""((?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"(AKIA[A-Z0-9]+)"
HEX = r"([0-9a-f]{24,})"
KINDS = ("assign", "access", "hex", "entropy")

CANDIDATE = r"([A-Za-z0-9+/_=-]{20,})"
WINDOW = 20

#: Character classes in the order tried, and the bits of entropy in a window from which a candidate counts: the 1% point of
#: windows of 20 uniformly random characters of 10, 16, 26, 36, 52 and 62 kinds, rounded down. tests simulate them.
CLASSES = (
    (r"^[0-9]+$", 2.48),
    (r"^(?:[0-9a-f]+|[0-9A-F]+)$", 2.90),
    (r"^(?:[a-z/_=+-]+|[A-Z/_=+-]+)$", 3.22),
    (r"^(?:[0-9a-z/_=+-]+|[0-9A-Z/_=+-]+)$", 3.40),
    (r"^[A-Za-z/_=+-]+$", 3.58),
    (r"^.+$", 3.64),
)

#: Letters and separators only; of these, what has fewer than ``RARE_PAIRS`` such pairs (overlapping ones count) in each window
#: of ``WINDOW`` characters, looked at every ``STRIDE``, is words.
LETTERS = r"^[A-Za-z/_=+-]+$"
RARE_PAIRS = 4
STRIDE = 4
RARE = (
    "a[aq]|b[cdfgkmnpqtvwxz]|c[bdfgjmpvwxz]|d[cfkpqtxz]|f[bcdghjkmnpqvwxz]|g[bcdfjkmpqvwxz]|h[bcdfghjkpqvxz]|i[hjuwyi]|"
    "j[bcdfghjklmnpqrstvwxyz]|k[bcdfghjmpqvxz]|l[hjqrxz]|m[cdfghjkqrtvwxz]|n[rx]|o[q]|p[bcdgjkmnqvwxz]|q[^u/_=+-]|r[jqxz]|"
    "s[jrvxz]|t[bdfgjkpqvx]|u[hjkquwy]|v[bcdfghjklmnpqstvwxyz]|w[bcdfgjkmpqtuvxyz]|x[bdfghjkmnqrsvwxz]|y[hjkquvwxyz]|z[bcdfghjkmnpqrstvx]"
)

#: What is never a secret: UUIDs, a repeated character, and alphabets.
ALLOWED = (
    r"^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$",
    r"^(.)\1*$",
    r"^(?:0123456789|abcdefghijklmnopqrstuvwxyz|ABCDEFGHIJKLMNOPQRSTUVWXYZ|[+/_=-])+$",
)

SPAN = "array<struct<start:int,ord:int,end:int>>"


def found(text: Column, pattern: str, kind: int, keep, group: int = 1) -> Column:
    """Spans of the leftmost non-overlapping matches whose ``group`` satisfies ``keep``, as array of (start, ord, end)."""
    parts = F.zip_with(
        F.arrays_zip(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"), F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("g")),
        F.split(text, pattern, -1),
        lambda x, gap: F.struct(F.char_length(gap).alias("gap"), F.char_length(x["m"]).alias("size"), keep(x["g"]).alias("kept")),
    )
    start = F.struct(F.lit(0).alias("at"), F.from_json(F.lit("[]"), SPAN).alias("spans"))

    def step(state: Column, x: Column) -> Column:
        begin = state["at"] + x["gap"]
        end = begin + x["size"]
        own = F.array(F.struct(begin.alias("start"), F.lit(kind).alias("ord"), end.alias("end")))
        return F.struct(F.coalesce(end, state["at"]).alias("at"), F.when(F.coalesce(x["kept"], F.lit(False)), F.concat(state["spans"], own)).otherwise(state["spans"]).alias("spans"))

    spans = F.aggregate(parts, start, step, lambda s: s["spans"])
    return F.when(text.rlike(pattern), spans).otherwise(F.from_json(F.lit("[]"), SPAN))


def _weight(n: Column) -> Column:
    return F.when(n > 0, n * F.log2(n)).otherwise(F.lit(0.0))


def peak_entropy(candidate: Column, window: int = WINDOW) -> Column:
    """Highest Shannon entropy, in bits, of any window of a string of ASCII characters; 0 if it is shorter than a window."""
    begin = F.struct(F.lit("").alias("win"), F.lit(0.0).alias("sum"), F.lit(0.0).alias("best"))

    def count(text: Column, c: Column) -> Column:
        return (F.length(text) - F.length(F.replace(text, c, F.lit("")))).cast("double")

    def step(s: Column, c: Column) -> Column:
        full = F.length(s["win"]) >= window
        kept = F.when(full, F.substring(s["win"], 2, window)).otherwise(s["win"])
        gone = count(kept, F.substring(s["win"], 1, 1))
        less = F.when(full, _weight(gone + 1) - _weight(gone)).otherwise(F.lit(0.0))
        more = count(kept, c)
        total = s["sum"] - less + _weight(more + 1) - _weight(more)
        best = F.when(F.length(kept) == window - 1, F.greatest(s["best"], F.log2(F.lit(float(window))) - total / window)).otherwise(s["best"])
        return F.struct(F.concat(kept, c).alias("win"), total.alias("sum"), best.alias("best"))

    return F.aggregate(F.filter(F.split(candidate, ""), lambda c: c != ""), begin, step, lambda s: s["best"])


def is_random(candidate: Column) -> Column:
    """Not allow-listed, and its highest window reaches the bound of its character class."""
    bound = F.lit(99.0)
    for pattern, bits in reversed(CLASSES):
        bound = F.when(candidate.rlike(pattern), F.lit(bits)).otherwise(bound)
    at = F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(candidate) - WINDOW + 1), F.lit(STRIDE))
    odd = F.exists(at, lambda i: F.regexp_count(F.substring(candidate, i, F.lit(WINDOW + STRIDE)), F.lit(f"(?i)(?={RARE})[a-z]")) >= RARE_PAIRS)
    fine = candidate.rlike(LETTERS) & ~odd
    for pattern in ALLOWED:
        fine = fine | candidate.rlike(pattern)
    return F.when(fine, F.lit(False)).otherwise(peak_entropy(candidate) >= bound)


def scan(docs: DataFrame) -> DataFrame:
    """``docs`` with ``base`` and ``spans``: arrays of (start, ord, end) in order of start, then kind.

    Offsets count code points, the end is exclusive, ``ord`` indexes ``KINDS``. A null text is scanned as empty.
    Columns of these names that ``docs`` has are replaced.
    """
    whole = F.coalesce(F.col("text"), F.lit(""))
    base = F.array_sort(
        F.concat(
            found(whole, ASSIGN, 0, lambda g: F.char_length(g) >= 6, 2),
            found(whole, ACCESS, 1, lambda g: F.char_length(g) >= 20),
            found(whole, HEX, 2, lambda g: F.char_length(g) >= 24),
        )
    )
    step = docs.withColumns({"base": base, "spans": found(whole, CANDIDATE, 3, is_random)})
    # Base spans are in order of start: how far they cover an entropy span from its start on, without a gap.
    reach = lambda e: F.aggregate("base", e["start"], lambda at, b: F.when(b["start"] <= at, F.greatest(at, b["end"])).otherwise(at))
    clear = F.filter("spans", lambda e: reach(e) < e["end"])
    return step.withColumn("spans", F.when(F.size("spans") == 0, F.col("base")).otherwise(F.array_sort(F.concat("base", clear))))


def listed(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["ord"]), s["start"], s["end"])), ",")


def redacted(text: Column, spans: Column) -> Column:
    """The text with each stretch that spans cover replaced by ``[secret]``; overlapping and touching spans make one."""
    begin = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(s: Column, x: Column) -> Column:
        gap = F.when(x["start"] > s["at"], F.substring(text, s["at"] + 1, x["start"] - s["at"])).otherwise("")
        mark = F.when((x["start"] > s["at"]) | (s["at"] == 0), F.lit("[secret]")).otherwise("")
        return F.struct(F.greatest(s["at"], x["end"]).alias("at"), F.concat(s["out"], gap, mark).alias("out"))

    done = F.aggregate(spans, begin, step)
    return F.when(F.size(spans) == 0, text).otherwise(F.aggregate(F.array(done), F.lit(""), lambda _, s: F.concat(s["out"], F.substring(text, s["at"] + 1, 2147483647))))


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans of every whole text (null: as empty)."""
    docs = scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    ords = F.transform("base", lambda s: s["ord"])
    counts = [(F.size(ords) - F.size(F.array_remove(ords, k))).cast("long").alias(f"n_{KINDS[k]}") for k in range(3)]
    return docs.select("doc_id", *counts, F.sha2(listed(F.col("base")).cast("binary"), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def stage_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: every document stays; what a span covers becomes ``[secret]``, and n_chars follows the text."""
    out = scan(docs).withColumn("text", redacted(F.col("text"), F.col("spans")))
    kept = [F.when(F.size("spans") > 0, F.char_length("text")).otherwise(F.col(c)).cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(c) for c in docs.columns]
    return out.select(*kept)
