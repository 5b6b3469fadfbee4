"""CIGAR strings, SA tags, flag bits, sequences: the expressions over one aligned record, without UDFs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the SAM flag.
PAIRED, PROPER, UNMAPPED, MATE_UNMAPPED, REVERSE, MATE_REVERSE, SECONDARY, QC_FAIL, DUPLICATE, SUPPLEMENTARY = 0x1, 0x2, 0x4, 0x8, 0x10, 0x20, 0x100, 0x200, 0x400, 0x800
NOT_PRIMARY = UNMAPPED | SECONDARY | SUPPLEMENTARY
NOT_CLIP = UNMAPPED | SECONDARY
NOT_JUNCTION = UNMAPPED | SECONDARY | QC_FAIL | DUPLICATE


def has(flag: Column, bits: int) -> Column:
    """All of the bits are set."""
    return flag.bitwiseAND(F.lit(bits)) == bits


def lacks(flag: Column, bits: int) -> Column:
    """None of the bits is set."""
    return flag.bitwiseAND(F.lit(bits)) == 0


def operations(cigar: Column) -> Column:
    """array<struct<len,op>>; empty for null, ``*`` and empty strings."""
    found = F.regexp_extract_all(F.coalesce(cigar, F.lit("")), F.lit(r"\d+[MIDNSHP=X]"), F.lit(0))
    return F.transform(found, lambda x: F.struct(F.substring(x, F.lit(1), F.length(x) - 1).cast("long").alias("len"), F.substring(x, -1, 1).alias("op")))


def total(ops: Column, kinds: str) -> Column:
    """Summed length of the operations of some kinds."""
    return F.aggregate(F.filter(ops, lambda o: o["op"].isin(list(kinds))), F.lit(0).cast("long"), lambda s, o: s + o["len"])


def reference_length(ops: Column) -> Column:
    return total(ops, "MDN=X")


def clips(ops: Column, kinds: str = "S") -> Column:
    """struct<left,right>: clipped bases at the ends; the outermost operation only."""
    first, last = F.get(ops, F.lit(0)), F.get(ops, F.size(ops) - 1)
    size = lambda o: F.when(o["op"].isin(list(kinds)), o["len"]).otherwise(F.lit(0).cast("long"))
    return F.struct(F.coalesce(size(first), F.lit(0)).alias("left"), F.when(F.size(ops) > 1, F.coalesce(size(last), F.lit(0))).otherwise(F.lit(0).cast("long")).alias("right"))


def blocks(pos0: Column, ops: Column) -> Column:
    """array<struct<s,e>>: half-open stretches of the reference with aligned bases; deletions and skips part them."""
    begin = F.struct(pos0.cast("long").alias("at"), F.array().cast("array<struct<s:bigint,e:bigint>>").alias("out"))

    def step(state: Column, o: Column) -> Column:
        stop = state["at"] + F.when(o["op"].isin(list("MDN=X")), o["len"]).otherwise(F.lit(0).cast("long"))
        own = F.array(F.struct(state["at"].alias("s"), stop.alias("e")))
        return F.struct(stop.alias("at"), F.when(o["op"].isin(list("M=X")), F.concat(state["out"], own)).otherwise(state["out"]).alias("out"))

    return F.aggregate(ops, begin, step, lambda s: s["out"])


def overlap(spans: Column, start: Column, stop: Column) -> Column:
    """Bases of the spans that lie in [start, stop)."""
    return F.aggregate(spans, F.lit(0).cast("long"), lambda s, x: s + F.greatest(F.lit(0).cast("long"), F.least(x["e"], stop) - F.greatest(x["s"], start)))


def segments(tag: Column, least_fields: int = 5) -> Column:
    """SA entries as array<struct<chrom,pos,strand,cigar,mapq,nm>>.

    With five or more fields wanted, entries need a whole-number position and mapping quality; with fewer, a field that is
    missing or no number is null.
    """
    parts = F.filter(F.split(F.coalesce(tag, F.lit("")), ";"), lambda x: x != "")
    fields = F.transform(parts, lambda x: F.split(x, ","))

    def entry(f: Column) -> Column:
        return F.struct(
            F.get(f, F.lit(0)).alias("chrom"),
            F.get(f, F.lit(1)).try_cast("long").alias("pos"),
            F.get(f, F.lit(2)).alias("strand"),
            F.get(f, F.lit(3)).alias("cigar"),
            F.get(f, F.lit(4)).try_cast("int").alias("mapq"),
            F.get(f, F.lit(5)).try_cast("int").alias("nm"),
        )

    out = F.transform(F.filter(fields, lambda f: F.size(f) >= least_fields), entry)
    return F.filter(out, lambda e: e["pos"].isNotNull() & e["mapq"].isNotNull()) if least_fields >= 5 else out


def reverse_complement(seq: Column) -> Column:
    return F.reverse(F.translate(seq, "ACGTNacgtn", "TGCANtgcan"))


def requantised(quality: Column, bins: list[int]) -> Column:
    """The nearest bin of a quality; on a tie the lower one."""
    return F.array_min(F.array(*[F.struct(F.abs(quality - b).alias("d"), F.lit(b).alias("b")) for b in bins]))["b"]


def breakend(alt: Column) -> Column:
    """struct<chrom,pos,orientation> of an ALT in breakend notation; fields are null for other ALTs.

    A piece before the bracket joins its 3' end, one after it its 5' end; ``[`` continues the partner to the right
    (its 5' end), ``]`` to the left (its 3' end).
    """
    pattern = r"^([ACGTNacgtn.]*)([\[\]])([^\[\]:]+):(\d+)[\[\]]([ACGTNacgtn.]*)$"
    # The pattern is matched once; where it holds, the brackets and the colon part the text.
    ok, even = alt.rlike(pattern), F.translate(alt, "]", "[")
    before, place = F.substring_index(even, "[", 1), F.substring_index(F.substring_index(even, "[", 2), "[", -1)
    here = F.when(before != "", "3").otherwise("5")
    there = F.when(F.substring_index(alt, "[", 1) == before, "5").otherwise("3")
    return F.struct(F.when(ok, F.substring_index(place, ":", 1)).alias("chrom"), F.when(ok, F.substring_index(place, ":", -1).try_cast("long")).alias("pos"), F.when(ok, F.concat(here, F.lit("to"), there)).alias("orientation"))


def short_id(prefix: str, text: Column, digits: int) -> Column:
    """``prefix`` and the first hexadecimal digits of the text's SHA-256."""
    return F.concat(F.lit(prefix), F.substring(F.sha2(text.cast("binary"), 256), 1, digits))
