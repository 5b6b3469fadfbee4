"""Design of synthetic tests: grids, tiles, random positions, spaced draws, expected counts, splitting by name."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..graph import shared_folder, written
from ..joins import band_join, interval_join


def grid(contigs: DataFrame, step: int, flank: int) -> DataFrame:
    """(contig, pos, start, end): positions every ``step`` bases with a whole flank on both sides (0-based, half-open)."""
    inside = contigs.where(F.col("length") > 2 * flank)
    return inside.select("contig", F.explode(F.sequence(F.lit(flank).cast("long"), F.col("length") - flank - 1, F.lit(step).cast("long"))).alias("pos")).withColumns({"start": F.col("pos") - flank, "end": F.col("pos") + flank})


def unmasked(candidates: DataFrame, masks: DataFrame, bucket: int = 16_384) -> DataFrame:
    """Candidates (contig, start, end) whose flank meets no masked interval; N bases are masked, if a mask lists them."""
    m = masks.select(F.col("contig").alias("m_contig"), F.col("start").alias("m_start"), F.col("end").alias("m_end"))
    c = candidates.select("contig", "start", "end")
    hit = interval_join(c, m, [("contig", "m_contig")], (F.col("start"), F.col("end")), (F.col("m_start"), F.col("m_end")), bucket)
    return candidates.join(hit.select("contig", "start", "end").distinct(), ["contig", "start", "end"], "left_anti")


def n_runs(tiles: DataFrame, tile: int) -> DataFrame:
    """(contig, start, end) of the runs of N in tiles of a sequence (``sources.text_formats.fasta``), cut at tile ends."""
    runs = F.regexp_extract_all(F.upper("seq"), F.lit("(N+|[^N]+)"), F.lit(1))
    length = lambda s: F.char_length(s).cast("long")
    placed = F.aggregate(runs, F.struct((F.col("tile") * tile).alias("at"), F.array().cast("array<struct<s:bigint,e:bigint>>").alias("out")), lambda s, r: F.struct((s["at"] + length(r)).alias("at"), F.when(r.startswith("N"), F.concat(s["out"], F.array(F.struct(s["at"].alias("s"), (s["at"] + length(r)).alias("e"))))).otherwise(s["out"]).alias("out")), lambda s: s["out"])
    return tiles.select("contig", F.explode(placed).alias("r")).select("contig", F.col("r.s").alias("start"), F.col("r.e").alias("end"))


def tiled(df: DataFrame, seq: str, width: int = 150, step: int = 10) -> DataFrame:
    """``df`` with offset, strand and tile: every ``width`` bases of a sequence, ``step`` apart, as read from both strands."""
    n = F.char_length(seq)
    at = df.where(n >= width).withColumn("offset", F.explode(F.sequence(F.lit(0), n - width, F.lit(step))))
    own = F.substring(F.col(seq), F.col("offset") + 1, F.lit(width))
    back = F.reverse(F.translate(own, "ACGTacgt", "TGCAtgca"))
    return at.withColumn("both", F.explode(F.array(F.struct(F.lit("+").alias("strand"), own.alias("tile")), F.struct(F.lit("-").alias("strand"), back.alias("tile"))))).select(*df.columns, "offset", "both.strand", "both.tile")


def mappability(placed: DataFrame, by: list[str], correct: Column) -> DataFrame:
    """(by, tiles, correct, mappability): the share of tiles that an aligner put where they come from."""
    return placed.groupBy(*by).agg(F.count("*").alias("tiles"), F.count_if(correct).alias("correct"), (F.count_if(correct) / F.count("*")).alias("mappability"))


def genome_positions(offsets: DataFrame, contigs: DataFrame) -> DataFrame:
    """``offsets`` (offset into the contigs laid end to end) with contig and pos; ``contigs`` (contig, length, ord).

    The contigs' starts are one small table; offsets meet them by bins of the shortest power of two that holds a contig.
    """
    run = W.orderBy("ord").rowsBetween(W.unboundedPreceding, -1)
    starts = contigs.withColumn("first", F.coalesce(F.sum("length").over(run), F.lit(0))).select("contig", "first", (F.col("first") + F.col("length")).alias("stop"))
    x = interval_join(offsets, starts.withColumn("_g", F.lit(0)), [], (F.col("offset"), F.col("offset") + 1), (F.col("first"), F.col("stop")), 1 << 26, longest=(1, None))
    return x.withColumn("pos", F.col("offset") - F.col("first")).drop("first", "stop", "_g")


def expected_pairs(df: DataFrame, depth: Column, insert: Column, read: Column, clonal: Column) -> DataFrame:
    """``df`` with fragments, spanning and both_clear: what a depth lets one expect at a junction that a share of the
    molecules carry: fragments a base, fragments that span it, and those whose reads both stay clear of it."""
    rate = depth / (2 * read)
    return df.withColumns({"fragments": rate, "spanning": rate * insert * clonal, "both_clear": rate * F.greatest(F.lit(0), insert - 2 * read) * clonal})


def reads_per_spanning_fragment(mean: float, sd: float, read: int) -> Column:
    """Mean number of reads of a spanning fragment that cover the junction: of fragments at least ``read`` long and normal in
    length, each of the two reads covers it with chance ``read / length``, weighed by length, as longer ones span more."""
    sizes = F.sequence(F.lit(read), F.lit(round(mean + 6 * sd)))
    weight = lambda x: F.exp(-F.pow((x - mean) / sd, F.lit(2.0)) / 2) * x
    add = lambda f: F.aggregate(F.transform(sizes, f), F.lit(0.0), lambda s, v: s + v)
    return add(lambda x: weight(x) * F.least(F.lit(2.0), 2.0 * read / x)) / add(weight)


def local_score(columns: Column) -> Column:
    """struct<run,score>: longest run of matches, and best sum of a stretch, along aligned columns (array of boolean; a match
    is 1, a mismatch -3); both 0 for an empty array."""
    zero = F.struct(*[F.lit(0).alias(k) for k in ("now", "run", "sum", "score")])

    def step(s: Column, m: Column) -> Column:
        now = F.when(m, s["now"] + 1).otherwise(0)
        total = F.greatest(F.lit(0), s["sum"] + F.when(m, 1).otherwise(-3))
        return F.struct(now.alias("now"), F.greatest(s["run"], now).alias("run"), total.alias("sum"), F.greatest(s["score"], total).alias("score"))

    return F.aggregate(columns, zero, step, lambda s: F.struct(s["run"].alias("run"), s["score"].alias("score")))


def by_prefix(reads: DataFrame, name: str = "qname", at: str = "_") -> DataFrame:
    """``reads`` with library, the name's part before the first ``at``; written by it, each library is a folder."""
    return reads.withColumn("library", F.substring_index(name, at, 1))


def half_removed(names: DataFrame, seed: int) -> DataFrame:
    """floor(n / 2) of the distinct names, by a hash with a seed (ties by name): which fragments give way to simulated ones."""
    x = names.select("qname").distinct().withColumn("h", F.xxhash64("qname", F.lit(seed)))
    half = x.agg(F.floor(F.count("*") / 2).alias("k"))
    # The hash's k-th value by running counts of its buckets, not by a sort in one task.
    b = x.withColumn("b", F.shiftrightunsigned("h", 48))
    per = b.groupBy("b").agg(F.count("*").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(W.orderBy("b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    ranked = b.join(per, "b").withColumn("i", F.col("before") + F.row_number().over(W.partitionBy("b").orderBy("h", "qname")))
    return ranked.crossJoin(F.broadcast(half)).where("i <= k").select("qname")


def arithmetic(before: DataFrame, removed: DataFrame, added: DataFrame, after: DataFrame) -> DataFrame:
    """One row: records before, removed, added and after, and whether before - removed + added = after."""
    n = lambda d, k: d.agg(F.count("*").alias(k))
    gone = before.join(removed.select("qname").distinct(), "qname", "left_semi")
    x = n(before, "before").crossJoin(n(gone, "removed")).crossJoin(n(added, "added")).crossJoin(n(after, "after"))
    return x.withColumn("holds", F.col("before") - F.col("removed") + F.col("added") == F.col("after"))


def spaced_draw(candidates: DataFrame, spacing: int, seed: int) -> DataFrame:
    """Candidates (id, contig, pos) that a draw in the order of a seeded hash takes, if it skips any within ``spacing`` bases of
    one already taken: no task sees the whole pool.

    In a round every candidate that comes first among its undecided neighbours is taken, and its neighbours are out. That is
    what the draw one by one gives; the rounds follow the longest chain of falling hashes, which is short.
    """
    spark = candidates.sparkSession
    root, turn = f"{shared_folder(spark)}/draw-{uuid.uuid4().hex[:12]}", 0
    left = candidates.select("id", "contig", "pos", F.struct(F.xxhash64("id", F.lit(seed)), "id").alias("rank"))
    taken = None
    while True:
        left = written(left, f"{root}/left{turn}")
        if left.isEmpty():
            break
        near = band_join(left, left.select(F.col("id").alias("n_id"), F.col("contig").alias("n_contig"), F.col("pos").alias("n_pos"), F.col("rank").alias("n_rank")), [("contig", "n_contig")], [("pos", "n_pos", spacing)])
        own = written(near.groupBy("id").agg(F.min("n_rank").alias("first"), F.max("rank").alias("rank")).where("first = rank").select("id"), f"{root}/taken{turn}")
        taken = own if taken is None else taken.unionAll(own)
        # The self-join names each candidate as its own neighbour, so what was taken is out as well.
        out = near.join(own.select(F.col("id").alias("n_id")), "n_id", "left_semi").select("id").distinct()
        left = left.join(out, "id", "left_anti")
        turn += 1
    return candidates.join(taken, "id", "left_semi") if taken is not None else candidates.limit(0)
