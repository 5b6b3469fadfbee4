"""Mixing sources to target weights by a low-discrepancy schedule, with SQL functions only.

Targets. Each source weighs a given amount; all share ``share`` of all words, but none gets more than ``most`` times its
own words, and what it can't take goes to the others by weight, until none is above. That is a water level, so it has a
closed form: sort sources by cap over weight; those under the level stop at their caps.

Schedule. Slot i of the mix lies at the golden-ratio point frac((i + 1) * phi); the cumulative targets map the point to a
source, and ranking a source's slots says which of its blocks a slot takes. A source's blocks cut the stream of its
documents, shuffled by a hash of their ids, every ``block`` words; slot of rank r takes block r modulo their number. A
source that gets fewer slots than its target needs (golden-ratio points miss by a few at most) has the rest appended; of
its last slot only as many words are taken as its target leaves, and slots beyond the target are dropped. So a source's
words are its target, rounded down, and no document is taken more than ``most`` times when ``most`` is whole.

Scale. Running sums over a source would put all its rows into one task. Here a source's stream is dealt to cells of
about ``CELL`` rows by the hash; sums run within cells, and over cells through a table of cells that is summed the same
way. Slots are ranked in runs of consecutive slots likewise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Scratch, table, word_count

#: What the sources weigh, in their order, again and again.
WEIGHTS = (3, 1, 2)
BLOCK = 256
CELL = 1024
GOLDEN = 0.6180339887498949


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: tuple[int, int] = (3, 2), most: int = 2) -> DataFrame:
    """source, source_size, target, lo, hi for rows (source, source_size), one for each source.

    Sources are ordered by code point, null last. lo and hi bound the source's part of the cumulative targets in [0, 1).
    The windows here are over one row for each source, not over documents. Sources without words have target 0.
    """
    order = W.orderBy(F.col("source").isNull(), "source")
    ranked = sizes.withColumn("i", F.row_number().over(order) - 1)
    weight = F.get(F.array(*[F.lit(w) for w in weights]), (F.col("i") % len(weights)).cast("int")).cast("long")
    w = ranked.select("source", "source_size", "i", weight.alias("w"))
    w = w.withColumns({"all_size": F.sum("source_size").over(W.partitionBy()), "ratio": most * F.col("source_size") / F.col("w")})
    by_ratio = W.orderBy("ratio", "i")
    before = by_ratio.rowsBetween(W.unboundedPreceding, -1)
    after = by_ratio.rowsBetween(W.currentRow, W.unboundedFollowing)
    w = w.withColumns({"capped": F.coalesce(F.sum(most * F.col("source_size")).over(before), F.lit(0)), "open_w": F.sum("w").over(after)})
    # A source stops at its cap if the level that all from it on would share lies above its own ratio.
    level = (F.lit(share[0]) * F.col("all_size") / F.lit(share[1]) - F.col("capped")) / F.col("open_w")
    w = w.withColumn("level", level).withColumn("stops", F.col("level") >= F.col("ratio"))
    free = F.min(F.when(~F.col("stops"), F.struct("ratio", "i", "level"))).over(W.partitionBy())
    w = w.withColumn("final", free["level"])
    w = w.withColumn("target", F.when(F.col("stops"), (most * F.col("source_size")).cast("double")).otherwise(F.col("w") * F.col("final")))
    cum = F.sum("target").over(W.orderBy("i").rowsBetween(W.unboundedPreceding, W.currentRow))
    total = F.sum("target").over(W.partitionBy())
    w = w.withColumns({"hi": F.when(total > 0, cum / total).otherwise(F.lit(0.0)), "total": total})
    return w.select("source", "i", "source_size", "target", F.coalesce(F.lag("hi").over(W.orderBy("i")), F.lit(0.0)).alias("lo"), "hi", "total")


def running(df: DataFrame, group: list[str], cell: str, order: list[Column], value: Column, out: str, level: int = 0) -> DataFrame:
    """``df`` with ``out``: the sum of ``value`` over earlier rows of the same group, in the order (cell, order).

    Only the rows of one cell meet in a task. Cells' own sums are summed over a table of cells, recursively in cells of
    ``CELL`` cells, down to a level that has so few rows that one task for each group is right.
    """
    own, upper, before, here_ = (f"__{x}{level}" for x in ("sum", "upper", "before", "here"))
    sums = df.groupBy(*group, cell).agg(F.sum(value).alias(own))
    if level >= 1:
        over = W.partitionBy(*group).orderBy(cell).rowsBetween(W.unboundedPreceding, -1)
        starts = sums.withColumn(before, F.coalesce(F.sum(own).over(over), F.lit(0)))
    else:
        starts = running(sums.withColumn(upper, F.floor(F.col(cell) / CELL)), group, upper, [F.col(cell)], F.col(own), before, level + 1)
    keys = [f"__{g}{level}" for g in [*group, cell]]
    starts = starts.select(*[F.col(g).alias(k) for g, k in zip([*group, cell], keys, strict=True)], before)
    same = F.lit(True)
    for g, k in zip([*group, cell], keys, strict=True):
        same = same & F.col(g).eqNullSafe(F.col(k))
    over = W.partitionBy(*group, cell).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    here = df.withColumn(here_, F.coalesce(F.sum(value).over(over), F.lit(0)))
    return here.join(starts, same, "left").withColumn(out, F.col(before) + F.col(here_)).drop(here_, *keys, *([before] if before != out else []))


def schedule(goal: DataFrame, slots: int, block: int = BLOCK) -> DataFrame:
    """slot, i (source), rank, words: which block-sized part of which source each slot of the mix takes.

    ``goal``: what ``targets`` returns.
    """
    goal = goal.withColumn("quota", F.floor(F.col("target") + 1e-6).cast("long"))
    whole, rest = F.floor(F.col("quota") / F.greatest(F.col("source_size"), F.lit(1))), F.col("quota") % F.greatest(F.col("source_size"), F.lit(1))
    goal = goal.withColumns({"blocks": F.ceil(F.col("source_size") / block), "rest": rest}).withColumn("need", whole * F.col("blocks") + F.ceil(F.col("rest") / block))
    spark = goal.sparkSession
    points = spark.range(slots).select(F.col("id").alias("slot"), ((F.col("id") + 1) * F.lit(GOLDEN) % 1.0).alias("u"))
    # Points and parts meet by thousandths of [0, 1), so the number of sources doesn't multiply the slots.
    bounds = goal.where("hi > lo").select("i", "lo", "hi", F.explode(F.sequence(F.floor(F.col("lo") * 1000), F.floor(F.col("hi") * 1000))).alias("t"))
    near = points.withColumn("t", F.floor(F.col("u") * 1000)).join(bounds, "t")
    placed = near.where("u >= lo and u < hi").select("slot", "i", F.floor(F.col("slot") / CELL).alias("run"))
    ranked = running(placed, ["i"], "run", [F.col("slot")], F.lit(1), "rank").select("slot", "i", "rank")
    got = ranked.groupBy("i").agg(F.count("*").alias("got"))
    short = goal.join(got, "i", "left").withColumn("got", F.coalesce("got", F.lit(0))).where("got < need")
    more = short.select(F.lit(slots).cast("long").alias("slot"), "i", F.explode(F.sequence(F.col("got"), F.col("need") - 1)).alias("rank"))
    facts = goal.select("i", "blocks", "need", "rest")
    every = ranked.unionByName(more).join(facts, "i").where("rank < need")
    words = F.when((F.col("rank") == F.col("need") - 1) & (F.col("rest") > 0), F.col("rest") - (F.ceil(F.col("rest") / block) - 1) * block).otherwise(F.lit(block))
    return every.select("slot", "i", "rank", (F.col("rank") % F.col("blocks")).cast("long").alias("block"), words.cast("long").alias("words"))


def laid_out(docs: DataFrame, scratch: Scratch, block: int) -> tuple[DataFrame, DataFrame, int]:
    """(rows, goal, slots): each row of ``docs`` with its place (offset) in its source's shuffled stream of words.

    rows: i, offset, size, tie, source_size, target and __row, a struct of the columns of ``docs`` without its text, so that
    none of them can clash with a column of the plan. Sizes and targets are written, so texts are read once.
    """
    own = [c for c in docs.columns if c != "text"]
    sized = docs.select("doc_id", "source", F.struct(*own).alias("__row"), word_count(F.col("text")).alias("size"), F.xxhash64("text").alias("tie"))
    sized = scratch.keep(sized)
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    facts = sizes.agg(F.sum("source_size").alias("words"), F.sum("n").alias("n")).first()
    words, n = int(facts["words"] or 0), int(facts["n"] or 0)
    goal = scratch.keep(targets(sizes.select("source", "source_size")))
    known = goal.select(F.col("source").alias("__source"), "i", "source_size", "target")
    rows = sized.join(known, F.col("source").eqNullSafe(F.col("__source"))).drop("__source")
    key = F.xxhash64("doc_id", F.lit("mix"))
    cells = max(1, -(-n // CELL))
    rows = rows.withColumns({"__key": key, "cell": F.pmod(F.shiftrightunsigned(key, 1), F.lit(cells))})
    laid = running(rows, ["i"], "cell", [F.col("__key"), F.col("doc_id"), F.col("tie")], F.col("size"), "offset").drop("cell", "__key")
    return laid, goal, -(-words * 3 // 2 // block) + 1


def mix(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """The mixing plan: a row for each row of ``docs``, without its text, with size, source_size, target, taken and tie.

    ``docs`` needs doc_id, text and source; its other columns stay, but for those named like new ones. Sizes count words;
    null and empty texts have none and take none. taken: words that the mix takes of the row, repeats counted. tie: a
    hash of the text, which tells rows of one doc_id apart. Rows equal in doc_id and text are dealt one after the other.
    """
    new = ["size", "source_size", "target", "taken", "tie"]
    laid, goal, slots = laid_out(docs, Scratch(docs.sparkSession, "mix"), block)
    taking = schedule(goal, slots, block).groupBy("i", "block").agg(F.collect_list("words").alias("takes"))
    parts = in_blocks(laid.where("size > 0").select("i", "offset", "size"), block)
    none = F.lit(0).cast("long")
    overlap = F.aggregate("takes", none, lambda s, t: s + F.greatest(none, F.least(F.col("end"), F.col("block") * block + t) - F.col("begin")))
    taken = parts.join(taking, ["i", "block"]).select("i", "offset", overlap.alias("o")).groupBy("i", "offset").agg(F.sum("o").alias("taken"))
    taken = taken.select(F.col("i").alias("__i"), F.col("offset").alias("__o"), "taken")
    same = (F.col("i") == F.col("__i")) & (F.col("offset") == F.col("__o")) & (F.col("size") > 0)
    out = laid.join(taken, same, "left").withColumn("taken", F.coalesce("taken", F.lit(0)).cast("long"))
    return out.select(*[F.col("__row")[c].alias(c) for c in docs.columns if c not in [*new, "text"]], *new)


def in_blocks(rows: DataFrame, block: int) -> DataFrame:
    """``rows`` (offset, size) for each block that they have words in, with block, begin and end in the source's stream."""
    last = F.floor((F.col("offset") + F.col("size") - 1) / block)
    parts = rows.withColumn("block", F.explode(F.sequence(F.floor(F.col("offset") / block), last)))
    return parts.withColumns({"begin": F.greatest(F.col("offset"), F.col("block") * block), "end": F.least(F.col("offset") + F.col("size"), (F.col("block") + 1) * block)})


def mixed(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """The mix itself: slot, source, rank and text, a row for each scheduled block, whose words are joined by one blank.

    Read in the order of (slot, source, rank) it is the mixed stream; all blocks but a source's last have ``block`` words.
    A block is made of the words of the documents that meet in it, in the order of the source's shuffled stream, and is
    taken as often as the schedule says, so each source's words are its target, rounded down.
    """
    laid, goal, slots = laid_out(docs, Scratch(docs.sparkSession, "mixed"), block)
    copies = W.partitionBy("doc_id", "tie").orderBy("offset")
    places = laid.where("size > 0").select(F.col("__row.doc_id").alias("doc_id"), "tie", "i", "offset", "size")
    places = places.withColumn("copy", F.row_number().over(copies))
    words = F.filter(F.split(F.translate("text", "\t\n\x0b\x0c\r", "     "), " "), lambda w: w != "")
    texts = docs.select("doc_id", F.xxhash64("text").alias("tie"), words.alias("w")).where(F.size("w") > 0)
    texts = texts.withColumn("copy", F.row_number().over(W.partitionBy("doc_id", "tie").orderBy("tie")))
    named = [F.col(c).alias(f"p_{c}") for c in ("doc_id", "tie", "copy")]
    own = texts.join(places.select(*named, "i", "offset", "size"), F.col("doc_id").eqNullSafe(F.col("p_doc_id")) & (F.col("tie") == F.col("p_tie")) & (F.col("copy") == F.col("p_copy")))
    parts = in_blocks(own.select("i", "offset", "size", "w"), block)
    cut = F.slice("w", (F.col("begin") - F.col("offset") + 1).cast("int"), (F.col("end") - F.col("begin")).cast("int"))
    whole = parts.groupBy("i", "block").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("begin", cut.alias("w")))), lambda p: p["w"])).alias("w"))
    slots_ = schedule(goal, slots, block).join(whole, ["i", "block"]).join(goal.select("i", "source"), "i")
    return slots_.select("slot", "source", "rank", F.array_join(F.slice("w", F.lit(1), F.col("words").cast("int")), " ").alias("text"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, size, source_size, target, taken of every document. Null and empty texts have size 0 and nothing is taken of them;
    null sources are one source, the last; rows that repeat are mixed each on its own; an empty table gives no rows."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")


def stage_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: each document comes as often as the mix takes it, to the nearest whole number: 0, 1 or 2 times.

    Documents without words have nothing to take; they come once.
    """
    plan = mix(docs.select("doc_id", "text", "source")).groupBy("doc_id", "tie").agg(F.sum("taken").alias("taken"), F.sum("size").alias("size"))
    times = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size") + 0.5).cast("int")).otherwise(1)
    plan = plan.select(F.col("doc_id").alias("__d"), F.col("tie").alias("__t"), times.alias("__n"))
    both = docs.join(plan, F.col("doc_id").eqNullSafe(F.col("__d")) & (F.xxhash64("text") == F.col("__t")))
    return both.where("__n > 0").withColumn("__k", F.explode(F.sequence(F.lit(1), F.col("__n")))).select(*docs.columns)
