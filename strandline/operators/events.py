"""Rearrangements: junctions grouped into events, described, supported, ranked and commented."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..graph import components
from ..joins import band_join

#: Junctions of one chromosome pair belong together if one end is near and the other not farther than this.
GROUP_NEAR, GROUP_FAR = 10_000, 10_000_000


def rearrangements(junctions: DataFrame, near: int = GROUP_NEAR, far: int = GROUP_FAR) -> DataFrame:
    """One row for each event: event (least id), members (sorted ids), n_junctions, pattern, span_a, span_b.

    ``junctions``: id, ca, pa, cb, pb, orientation. Junctions within one chromosome (ca = cb) stay alone. Groups are the
    components of the relation "one end within ``near``, the other within ``far``", joined by bins of either end.
    """
    a = junctions.where("ca <> cb").select(*[F.col(c).alias(f"x_{c}") for c in ("id", "ca", "pa", "cb", "pb")])
    b = junctions.where("ca <> cb").select(*[F.col(c).alias(f"y_{c}") for c in ("id", "ca", "pa", "cb", "pb")])
    same = [("x_ca", "y_ca"), ("x_cb", "y_cb")]
    one = band_join(a, b, same, [("x_pa", "y_pa", near), ("x_pb", "y_pb", far)])
    two = band_join(a, b, same, [("x_pb", "y_pb", near), ("x_pa", "y_pa", far)])
    edges = one.unionByName(two).where("x_id < y_id").select("x_id", "y_id")
    comp = components(edges, "x_id", "y_id")
    own = junctions.join(comp, junctions["id"] == comp["node"], "left").withColumn("event", F.coalesce("component", "id"))
    o = F.collect_set("orientation")
    g = own.groupBy("event").agg(
        F.array_sort(F.collect_list("id")).alias("members"),
        F.count("*").alias("n_junctions"),
        o.alias("orientations"),
        (F.max("pa") - F.min("pa")).alias("span_a"),
        (F.max("pb") - F.min("pb")).alias("span_b"),
    )
    return g.withColumn("pattern", pattern(F.col("n_junctions"), F.col("orientations")))


def pattern(n: Column, orientations: Column) -> Column:
    """single, complex (three or more), same direction, reciprocal (complementary pair) or other."""
    both = lambda a, b: F.array_contains(orientations, a) & F.array_contains(orientations, b)
    return (
        F.when(n == 1, "single")
        .when(n > 2, "complex")
        .when(F.size(orientations) == 1, "same direction")
        .when(both("3to5", "5to3") | both("3to3", "5to5"), "reciprocal")
        .otherwise("other")
    )


def event_support(junctions: DataFrame, events: DataFrame, fragments: Column, caller: Column) -> DataFrame:
    """(event, fragments, caller): per orientation only the best junction's fragments count; the caller's counts all do."""
    own = junctions.withColumns({"__f": fragments, "__c": fragments + caller}).join(events.select("event", F.explode("members").alias("id")), "id")
    best = own.groupBy("event", "orientation").agg(F.max("__f").alias("f"), F.sum("__c").alias("c"))
    return best.groupBy("event").agg(F.sum("f").cast("long").alias("fragments"), F.sum("c").cast("long").alias("caller"))


def ranked(events: DataFrame, order: list[Column], top: int) -> DataFrame:
    """The ``top`` events with their rank. Only the top rows are numbered, after a distributed top-k."""
    return events.orderBy(*order).limit(top).withColumn("rank", F.row_number().over(W.orderBy(*order)).cast("long"))


def with_cautions(events: DataFrame, texts: list[tuple[Column, Column]]) -> DataFrame:
    """``events`` with cautions: the texts whose conditions hold, in order."""
    return events.withColumn("cautions", F.filter(F.array(*[F.when(c, t) for c, t in texts]), lambda x: x.isNotNull()))


def derivative(chrom_kept: Column, pos_kept: Column, chrom_moved: Column, pos_moved: Column, centromere: Column) -> Column:
    """struct<name,pieces>: the derivative chromosome of one junction, named after the piece that holds a centromere."""
    piece = lambda c, p, holds: F.struct(c.alias("chrom"), p.alias("breakpoint"), holds.alias("has_centromere"))
    pieces = F.array(piece(chrom_kept, pos_kept, centromere), piece(chrom_moved, pos_moved, ~centromere))
    owner = F.filter(pieces, lambda x: x["has_centromere"])
    return F.struct(F.concat(F.lit("der("), F.get(owner, F.lit(0))["chrom"], F.lit(")")).alias("name"), pieces.alias("pieces"))


def iscn(ca: Column, band_a: Column, cb: Column, band_b: Column) -> Column:
    """t(A;B)(bandA;bandB); null where a band is unknown."""
    return F.when(band_a.isNotNull() & band_b.isNotNull(), F.format_string("t(%s;%s)(%s;%s)", ca, cb, band_a, band_b))


def summary_row(rank: Column, name: Column, breakpoints: Column, pattern: Column, pairs: Column, splits: Column, fragments: Column, genes: Column, cautions: Column) -> Column:
    """One line for an event: rank, name, breakpoints (array of struct chromosome, start, end), pattern, support in words,
    genes that it breaks (null: not looked up; empty: none) and cautions (null or empty: none)."""
    whole = lambda x: F.format_number(x, 0)
    place = lambda b: F.concat(b["chromosome"], F.lit(":"), whole(b["start"]), F.when(b["end"] != b["start"], F.concat(F.lit("–"), whole(b["end"]))).otherwise(""))
    count = lambda n, one: F.concat(n.cast("string"), F.lit(f" {one}"), F.when(n == 1, "").otherwise("s"))
    broken = (
        F.when(genes.isNull(), "genes not looked up (no local gene table)")
        .when(F.size(genes) == 0, "no gene at the breakpoints")
        .otherwise(F.concat(F.lit("breaks "), F.array_join(genes, ", ")))
    )
    warned = F.when(F.coalesce(F.size(cautions), F.lit(0)) > 0, F.concat(F.lit("; cautions: "), F.array_join(cautions, "; "))).otherwise("")
    return F.concat(
        rank.cast("string"), F.lit(". "), name, F.lit(" "), F.array_join(F.transform(breakpoints, place), " ↔ "), F.lit(" - "), pattern, F.lit("; "),
        count(pairs, "read pair"), F.lit(", "), count(splits, "split read"), F.lit(" ("), count(fragments, "read"), F.lit("); "), broken, warned,
    )
