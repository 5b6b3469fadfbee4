"""Names of contigs: primary contig, display and rank, and the order of a junction's two ends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Chromosomes of the primary assembly in rank order.
PRIMARY = [str(i) for i in range(1, 23)] + ["X", "Y"]
#: What an orientation becomes when the two ends change places.
FLIP = {"3to5": "5to3", "5to3": "3to5", "3to3": "3to3", "5to5": "5to5", "NtoN": "NtoN"}
#: The orientation of the other junction of a balanced exchange.
COMPLEMENT = {"3to5": "5to3", "5to3": "3to5", "3to3": "5to5", "5to5": "3to3"}


def primary(name: Column) -> Column:
    """The primary contig that an alternate or unplaced name starts with (``chrN_``); else the name."""
    found = F.regexp_extract(name, r"^(chr(?:\d+|[XYM]))_", 1)
    return F.when(found != "", found).otherwise(name)


def plain(name: Column) -> Column:
    """Without a leading ``chr``; MT is M."""
    bare = F.regexp_replace(name, r"^chr", "")
    return F.when(bare == "MT", "M").otherwise(bare)


def is_primary(name: Column) -> Column:
    return plain(name).isin(PRIMARY)


def rank(name: Column) -> Column:
    """1..22, X 23, Y 24, M 25; other names 1000 plus the sum of their code points."""
    bare = plain(name)
    points = F.aggregate(F.filter(F.split(name, ""), lambda c: c != ""), F.lit(0), lambda s, c: s + F.ascii(c))
    special = F.when(bare == "X", 23).when(bare == "Y", 24).when(bare == "M", 25)
    return F.coalesce(special, F.when(bare.rlike(r"^(?:[1-9]|1\d|2[0-2])$"), F.try_to_number(bare, F.lit("99")).cast("int")), 1000 + points)


def flipped(orientation: Column, table: dict[str, str] | None = None) -> Column:
    """Orientation seen from the other end; null stays null."""
    pairs = [F.lit(x) for kv in (table or FLIP).items() for x in kv]
    return F.element_at(F.create_map(*pairs), orientation)


def contig_class(name: Column) -> Column:
    """primary, mitochondrial, decoy, hla, alt, random, unplaced or other, by the shape of a name."""
    return (
        F.when(plain(name).isin(PRIMARY), "primary")
        .when(plain(name) == "M", "mitochondrial")
        .when(name.rlike(r"_decoy$|^hs37d5$"), "decoy")
        .when(name.startswith("HLA-"), "hla")
        .when(name.endswith("_alt"), "alt")
        .when(name.endswith("_random"), "random")
        .when(name.startswith("chrUn_"), "unplaced")
        .otherwise("other")
    )


def resolve(rows: DataFrame, column: str, contigs: DataFrame) -> DataFrame:
    """``rows`` with name and length of the header's contig that ``column`` means: its own spelling, else with ``chr`` added
    or taken away; null where the header has neither. Nothing is renamed by guess: a name that is there stays."""
    known = contigs.select("name", "length", F.lit(0).alias("order")).distinct()
    other = F.when(F.col("name").startswith("chr"), F.expr("substring(name, 4)")).otherwise(F.concat(F.lit("chr"), "name"))
    spelled = known.withColumn("spelling", F.col("name")).unionByName(known.select("name", "length", F.lit(1).alias("order"), other.alias("spelling")))
    best = spelled.groupBy("spelling").agg(F.min_by(F.struct("name", "length"), F.struct("order", "name")).alias("found"))
    return rows.join(best, rows[column] == F.col("spelling"), "left").drop("spelling").select(*rows.columns, "found.name", "found.length")


def genome_order(chrom1: Column, pos1: Column, chrom2: Column, pos2: Column, orientation: Column) -> Column:
    """struct<ca,pa,cb,pb,orientation>: a junction with its lower end (rank, name, position) first; a swap flips the orientation."""
    low, high = F.struct(rank(chrom1), plain(chrom1), pos1), F.struct(rank(chrom2), plain(chrom2), pos2)
    swap = F.coalesce(low > high, F.lit(False))
    pick = lambda a, b: F.when(swap, b).otherwise(a)
    return F.struct(pick(chrom1, chrom2).alias("ca"), pick(pos1, pos2).alias("pa"), pick(chrom2, chrom1).alias("cb"), pick(pos2, pos1).alias("pb"), F.when(swap, flipped(orientation)).otherwise(orientation).alias("orientation"))
