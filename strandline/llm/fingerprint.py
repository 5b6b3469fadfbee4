"""Order MinHash document fingerprints, with SQL functions only.

Items of a text are its runs of three words (the last two runs are shorter) together with their occurrence number, so that
a repeated run counts each time. A hash of an item chooses one of 32 bins; in each bin the two items of the least hashes
are kept and hashed as a tuple in the order in which they stand in the text. Two texts' likeness is the share of bins with
equal tuples: it falls with every edit, and also where the same runs stand in another order.

All per-text work is array expressions over one row: no row is made for a word. Sorting uses arrays of longs, in which the
upper 40 bits are the hash and the lower 24 the position. Positions from 2**24 words on wrap, alike for equal texts.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Scratch, table

RUN = 3
BINS_LOG2 = 5
KEEP = 2
LOW = (1 << 24) - 1
BUCKET = 256
#: Bytes of text in a range of ids, about, and most ranges: their bounds and tops go to the driver and to every task.
RANGE_BYTES = 32 << 20
RANGES = 1 << 13
#: More elements than any array has; slice adds the start to it, so it stays clear of the largest int.
_FAR = 1_000_000_000


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once for each row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(text, "\t\n\x0b\x0c\r", "     "), " "), "")


def _packed(hash_: Column, position: Column) -> Column:
    return hash_.bitwiseAND(F.lit(~LOW)).bitwiseOR(position.cast("long").bitwiseAND(F.lit(LOW)))


def packed_runs(own: Column) -> Column:
    """Sorted array of the packed runs of a word array: one lambda over the words, hashing all words of a run at once."""
    parts = F.arrays_zip(*[(own if k == 0 else F.slice(own, k + 1, _FAR)).alias(f"w{k}") for k in range(RUN)])
    one = F.transform(parts, lambda x, i: _packed(F.xxhash64(*[x[f"w{k}"] for k in range(RUN)]), i))
    return F.sort_array(one)


def repeats(packed: Column) -> Column:
    """Whether a sorted array of packed runs has equal ones."""
    pairs = F.zip_with(packed, F.slice(packed, 2, _FAR), lambda a, b: F.coalesce(F.shiftright(a, 24) == F.shiftright(b, 24), F.lit(False)))
    return F.exists(pairs, lambda x: x)


def occurrences(packed: Column) -> Column:
    """Structs (v, r) of a sorted array of packed runs: r counts the equal runs before it.

    Equal runs stand together, so r is found by doubling: if the run 2**j places before is equal, r is 2**j more than
    that one's r, else r is below 2**j and known already. The loop ends at the first distance without equal runs.
    """
    begin = F.struct(F.transform(packed, lambda v: F.struct(v.alias("v"), F.lit(0).alias("r"))).alias("x"), F.lit(True).alias("more"))

    def step(state: Column, j: Column) -> Column:
        gap = F.lit(1).cast("int") * F.pow(F.lit(2.0), j).cast("int")
        x = state["x"]
        none = F.lit(None).cast("struct<v:bigint,r:int>")
        moved = F.concat(F.array_repeat(none, gap), F.slice(x, F.lit(1), F.greatest(F.size(x) - gap, F.lit(0))))
        equal = lambda a, b: F.coalesce(F.shiftright(a["v"], 24) == F.shiftright(b["v"], 24), F.lit(False))
        after = F.zip_with(x, F.slice(moved, F.lit(1), F.size(x)), lambda a, b: F.struct(a["v"].alias("v"), F.when(equal(a, b), gap + b["r"]).otherwise(a["r"]).alias("r"), equal(a, b).alias("hit")))
        done = let(after, lambda y: F.struct(F.transform(y, lambda e: F.struct(e["v"].alias("v"), e["r"].alias("r"))).alias("x"), F.exists(y, lambda e: e["hit"]).alias("more")))
        go = state["more"] & (gap < F.size(x))
        return F.when(go, done).otherwise(F.struct(x.alias("x"), F.lit(False).alias("more")))

    return F.aggregate(F.sequence(F.lit(0), F.lit(24)), begin, step, lambda s: s["x"])


def tuples(items: Column) -> Column:
    """Of sorted packed items: for each bin that has any, bin * 2**32 + a hash of its least ``KEEP`` items in text order."""
    bin_ = lambda v: F.shiftrightunsigned(v, 64 - BINS_LOG2)

    def least(y: Column) -> Column:
        before = F.concat(F.array_repeat(F.lit(None).cast("bigint"), KEEP), F.slice(y, F.lit(1), F.greatest(F.size(y) - KEEP, F.lit(0))))
        flags = F.zip_with(y, F.slice(before, F.lit(1), F.size(y)), lambda a, b: F.when(b.isNull() | (bin_(a) != bin_(b)), a))
        return F.filter(flags, lambda a: a.isNotNull())

    def pairs(y: Column) -> Column:
        following = F.slice(y, 2, _FAR)
        previous = F.concat(F.array(F.lit(None).cast("bigint")), y)
        place = lambda v: v.bitwiseAND(F.lit(LOW))
        name = lambda v: F.shiftrightunsigned(v, 24)
        whole = F.arrays_zip(y.alias("a"), following.alias("b"), F.slice(previous, F.lit(1), F.size(y)).alias("c"))
        first = F.filter(whole, lambda s: s["c"].isNull() | (bin_(s["a"]) != bin_(s["c"])))

        def one(s: Column) -> Column:
            a, b = s["a"], s["b"]
            alone = b.isNull() | (bin_(a) != bin_(b))
            h = F.when(alone, F.xxhash64(name(a))).when(place(a) <= place(b), F.xxhash64(name(a), name(b))).otherwise(F.xxhash64(name(b), name(a)))
            return F.shiftleft(bin_(a), 32).bitwiseOR(h.bitwiseAND(F.lit((1 << 32) - 1)))

        return F.transform(first, one)

    return let(least(items), pairs)


def with_signature(df: DataFrame, text: str, out: str) -> DataFrame:
    """``df`` with ``out``: an array of at most 32 longs, the signature of a text; empty for a text without words.

    Each step is a column of its own that the next refers to more than once, so it is computed once and sorting runs on
    arrays of longs in generated code.
    """
    df = df.withColumn("__w", words(F.col(text))).withColumn("__r", packed_runs(F.col("__w"))).drop("__w")
    item = lambda v, r: _packed(F.xxhash64(F.shiftright(v, 24), r), v)
    few = F.transform("__r", lambda v: item(v, F.lit(0)))
    many = F.transform(occurrences(F.col("__r")), lambda s: item(s["v"], s["r"]))
    df = df.withColumn("__i", F.sort_array(F.when(repeats(F.col("__r")), many).otherwise(few))).drop("__r")
    return df.withColumn(out, tuples(F.col("__i"))).drop("__i")


def fingerprint(sig: Column) -> Column:
    """The signature as a string: hexadecimal parts joined by dots."""
    return F.array_join(F.transform(sig, lambda v: F.lower(F.hex(v))), ".")


def likeness(a: Column, b: Column) -> Column:
    """Bins with equal tuples over bins that either text has; 1 for two texts without words."""
    bins = lambda s: F.transform(s, lambda v: F.shiftrightunsigned(v, 32))
    either = F.size(a) + F.size(b) - F.size(F.array_intersect(bins(a), bins(b)))
    return F.when(either == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / either)


def with_next(docs: DataFrame, carried: list[str]) -> DataFrame:
    """``docs`` (doc_id and ``carried`` columns) with next_<column>: of the next row in descending doc_id, after the last
    the first. Null ids come last; rows of equal id follow each other by a hash of the first carried
    column.

    Rows are dealt to ranges of ids between quantiles over all ids, so that gaps and outliers leave ranges even. Their number
    follows the rows (``BUCKET`` each) up to 512, and from there on the bytes (``RANGE_BYTES`` each), so a task's part does not
    grow with the table, up to ``RANGES`` of them; beyond 260 GB of text ranges grow again. Null ids have ranges of their hashes. Each range's
    first row is also sent to the range above, whose last row it follows. Only one row for each range is handled as a
    whole, so no task sees all rows.
    """
    docs = docs.select("doc_id", *carried)
    # Of the first column alone, as below; the others are made of it.
    n, size = docs.agg(F.count("*"), F.coalesce(F.sum(F.octet_length(carried[0])), F.lit(0))).first()
    ranges = max(1, min(RANGES, max(min(512, -(-n // BUCKET)), size // RANGE_BYTES)))
    cuts = docs.agg(F.percentile_approx("doc_id", [k / ranges for k in range(1, ranges)] or [0.5], max(51_200, 20 * ranges)).alias("q")).first()["q"] if n else None
    bounds = sorted({int(c) for c in cuts or []})
    # Of the first column alone: the others may cost as much as a signature, and are not needed to find each range's top.
    tie = F.xxhash64(carried[0])
    # The number of bounds at or below an id, by halving; ranges of null ids are negative, the least hash highest.
    place = _rank(F.col("doc_id"), bounds)
    rows = docs.withColumns({"tie": tie, "bucket": F.coalesce(place, -1 - F.pmod(F.shiftrightunsigned(tie, 56) + 128, F.lit(256)))})
    order_of = F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id", F.bitwise_not("tie").alias("later"))
    tops = rows.groupBy("bucket").agg(F.max(order_of).alias("top"))
    everything = W.orderBy(F.col("bucket").asc())
    tops = tops.withColumn("to", F.coalesce(F.lead("bucket").over(everything), F.min("bucket").over(W.partitionBy())))
    # Written, so that its size is known: at most RANGES + 257 short rows, so the texts are not shuffled for this join.
    tops = Scratch(docs.sparkSession, "next").keep(tops.select(F.col("bucket").alias("b"), F.col("top.doc_id").alias("top"), F.bitwise_not("top.later").alias("top_tie"), "to"))
    sent = rows.join(F.broadcast(tops), F.col("bucket") == F.col("b"))
    copies = F.array(F.struct(F.col("bucket").alias("at"), F.lit(False).alias("ghost")), F.struct(F.col("to").alias("at"), F.lit(True).alias("ghost")))
    is_top = F.col("doc_id").eqNullSafe(F.col("top")) & (F.col("tie") == F.col("top_tie"))
    sent = sent.withColumn("copy", F.explode(F.when(is_top, copies).otherwise(F.slice(copies, 1, 1)))).select("doc_id", *carried, "tie", "copy.at", "copy.ghost")
    order = W.partitionBy("at").orderBy("ghost", F.col("doc_id").desc(), "tie")
    return sent.withColumns({f"next_{c}": F.lead(c).over(order) for c in carried}).where("not ghost").drop("at", "ghost", "tie")


def _rank(value: Column, bounds: list[int]) -> Column:
    """How many of the sorted bounds are at or below a value, by halving; null for null."""
    if not bounds:
        return F.when(value.isNotNull(), F.lit(0).cast("long"))
    # One literal, whatever the number of bounds.
    known = F.from_json(F.lit(json.dumps(bounds)), "array<bigint>")

    def step(s: Column, _: Column) -> Column:
        mid = F.floor((s["lo"] + s["hi"]) / 2).cast("int")
        up = (s["lo"] < s["hi"]) & (value >= F.get(known, mid))
        return F.struct(F.when(up, mid + 1).otherwise(s["lo"]).alias("lo"), F.when(up | (s["lo"] >= s["hi"]), s["hi"]).otherwise(mid).alias("hi"))

    begin = F.struct(F.lit(0).alias("lo"), F.lit(len(bounds)).alias("hi"))
    steps = F.sequence(F.lit(0), F.lit(len(bounds).bit_length()))
    return F.when(value.isNotNull(), F.aggregate(steps, begin, step, lambda s: s["lo"].cast("long")))


def op6_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every whole text.

    A null text counts as empty; an empty one has an empty fingerprint, and two empty ones are alike (1). Nulls of doc_id come
    last in the order; rows that repeat follow each other, and one row is its own next. An empty table gives no rows.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    docs = with_next(with_signature(docs, "text", "sig"), ["text", "sig"])
    n = F.char_length("text")
    part = F.floor(n / 3).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - part), F.substring(F.col("next_text"), F.lit(1), part))
    docs = docs.withColumns({"n_chars": n.cast("long"), "edited": edited}).drop("text", "next_text")
    docs = with_signature(docs.withColumn("edited_sha256", F.sha2(F.col("edited").cast("binary"), 256)), "edited", "edited_sig").drop("edited")
    return docs.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        fingerprint(F.col("sig")).alias("fingerprint"),
        fingerprint(F.col("edited_sig")).alias("edited_fingerprint"),
        likeness(F.col("sig"), F.col("edited_sig")).alias("near_edited"),
        likeness(F.col("sig"), F.col("next_sig")).alias("near_next"),
    )
