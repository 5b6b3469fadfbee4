"""Statistics over evidence tables: histograms, spread, quantiles, votes, cross-tabulations, sequences, subsets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.statistics import pair_weight
from . import selection


def histogram(df: DataFrame, group: list[str], value: Column, width: int) -> DataFrame:
    """(group, bucket, n): counts by ``floor(value / width)``."""
    return df.groupBy(*group, F.floor(value / width).cast("long").alias("bucket")).agg(F.count("*").alias("n"))


def spread(df: DataFrame, group: str, value: str, cap: float) -> DataFrame:
    """n, mean, population deviation, median, median absolute deviation and share above a cap, by group. Medians are exact and
    found by ``selection.at_ranks``, so a group with a large part of all rows is never gathered."""
    x = df.select(group, F.col(value).cast("double").alias(value)).where(F.col(value).isNotNull())
    one = x.groupBy(group).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("sd"), (F.count_if(F.col(value) > cap) / F.count("*")).alias("above"))
    middle = selection.medians(x, group, value)
    off = x.join(middle, group).select(group, F.abs(F.col(value) - F.col("median")).alias(value))
    return one.join(middle, group).join(selection.medians(off, group, value).withColumnRenamed("median", "mad"), group).select(group, "n", "mean", "sd", "median", "above", "mad")


def index_quantiles(df: DataFrame, group: str, value: str, at: list[float]) -> DataFrame:
    """(group, q, value) with the value at index int(q * (n - 1)) of the sorted values: lower, never interpolated."""
    found = selection.at_ranks(df, group, value, [F.floor(F.lit(q) * (F.col("n") - 1)) for q in at])
    names = F.array(*[F.lit(float(q)) for q in at])
    return found.select(group, F.get(names, F.col("turn")).alias("q"), "value")


def vote(df: DataFrame, key: list[str], choice: str) -> DataFrame:
    """The choice of most rows by key (ties: the larger), its votes, all votes, and its share."""
    g = df.groupBy(*key, choice).agg(F.count("*").alias("n"))
    return g.groupBy(*key).agg(F.max_by(choice, F.struct("n", choice)).alias("winner"), F.max("n").alias("votes"), F.sum("n").cast("long").alias("total")).withColumn("share", F.col("votes") / F.col("total"))


def recurrence_counts(df: DataFrame, group: str, key: list[str]) -> DataFrame:
    """By group: keys seen once (errors), keys seen more often, and rows of the latter."""
    g = df.groupBy(group, *key).agg(F.count("*").alias("n"))
    return g.groupBy(group).agg(F.count_if(F.col("n") == 1).alias("singletons"), F.count_if(F.col("n") > 1).alias("recurrent"), F.sum(F.when(F.col("n") > 1, F.col("n")).otherwise(0)).cast("long").alias("recurrent_rows"))


def crosstab(df: DataFrame, row: str, column: str, values: list[str]) -> DataFrame:
    """A column n_<value> for each listed value; values are listed, so that no extra pass looks for them."""
    g = df.groupBy(row).pivot(column, values).agg(F.count(F.lit(1)))
    return g.select(row, *[F.coalesce(F.col(v), F.lit(0)).cast("long").alias(f"n_{v}") for v in values])


def guarded_pearson(df: DataFrame, group: str, x: str, y: str) -> DataFrame:
    """Correlation by group; null with fewer than three pairs or no variance in either."""
    ok = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    return ok.groupBy(group).agg(F.count("*").alias("n"), F.when((F.count("*") >= 3) & (F.var_pop(x) > 0) & (F.var_pop(y) > 0), F.corr(x, y)).alias("r"))


def subset_sums(classes: DataFrame, name: str, parts: list[str], goals: list[int], most: int = 24) -> DataFrame:
    """(subset, sums of ``parts``) of every non-empty subset of classes whose sums are within ``goals``.

    For tables of a few classes: the number of subsets is a power of two, so more than ``most`` rows raise ValueError. The
    classes are one small row beside a distributed range of subsets.
    """
    k = classes.count()
    if k > most:
        raise ValueError(f"{k} classes have 2**{k} subsets; at most {most} classes are searched")
    row = classes.agg(F.array_sort(F.collect_list(F.struct(F.col(name).alias("name"), *[F.col(p).cast("long").alias(p) for p in parts]))).alias("all"))
    masks = classes.sparkSession.range(1, 1 << k).crossJoin(F.broadcast(row))
    own = masks.select(F.filter("all", lambda c, i: F.get(F.split(F.lpad(F.bin("id"), max(k, 1), "0"), ""), k - 1 - i) == "1").alias("own"))
    total = lambda p: F.aggregate("own", F.lit(0).cast("long"), lambda s, c: s + c[p])
    sums = own.select(F.array_join(F.transform("own", lambda c: c["name"]), "+").alias("subset"), *[total(p).alias(p) for p in parts])
    for p, g in zip(parts, goals, strict=True):
        sums = sums.where(F.col(p) <= g)
    return sums


def subset_matches(classes: DataFrame, name: str, parts: list[str], goals: list[int], most: int = 48) -> DataFrame:
    """(subset, sums of ``parts``) of every subset of classes, the empty one too, whose sums equal ``goals``.

    Met in the middle: the classes are cut into two halves, whose subsets have their sums each, and the halves join where these
    add up. So k classes take two tables of 2 ** (k / 2) rows and an equi-join. More than ``most`` rows raise ValueError.
    Null parts count as 0.
    """
    spark = classes.sparkSession
    rows = classes.select(F.col(name).cast("string").alias("name"), *[F.coalesce(F.col(p).cast("long"), F.lit(0)).alias(p) for p in parts]).orderBy("name").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} classes")

    def half(own: list, tag: str) -> DataFrame:
        bit = lambda i: F.getbit(F.col("id"), F.lit(i))
        total = lambda p: sum((F.when(bit(i) == 1, r[p]).otherwise(0) for i, r in enumerate(own)), F.lit(0)).cast("long")
        names = F.array(*[F.when(bit(i) == 1, r["name"]) for i, r in enumerate(own)]).cast("array<string>")
        return spark.range(1 << len(own)).select(F.array_compact(names).alias(f"names{tag}"), *[total(p).alias(f"{p}{tag}") for p in parts])

    middle = len(rows) // 2
    a, b = half(rows[:middle], "_a"), half(rows[middle:], "_b")
    on = F.lit(True)
    for p, g in zip(parts, goals, strict=True):
        on = on & (F.col(f"{p}_b") == F.lit(g) - F.col(f"{p}_a"))
    both = a.join(b, on)
    return both.select(F.array_join(F.concat("names_a", "names_b"), "+").alias("subset"), *[(F.col(f"{p}_a") + F.col(f"{p}_b")).alias(p) for p in parts])


def longest_run(s: Column) -> Column:
    """Length of the longest run of one character; 0 for empty and null texts."""
    runs = F.regexp_extract_all(F.coalesce(s, F.lit("")), F.lit(r"(?s)((.)\2*)"), F.lit(1))
    return F.coalesce(F.array_max(F.transform(runs, lambda r: F.char_length(r))), F.lit(0)).cast("long")


def longest_pair_run(s: Column) -> Column:
    """Repeats of the longest run of one unit of two different characters, looked for from every position."""
    runs = F.regexp_extract_all(F.coalesce(s, F.lit("")), F.lit(r"(?s)(?=((.)(?!\2)(.)(?:\2\3)*))"), F.lit(1))
    return F.floor(F.coalesce(F.array_max(F.transform(runs, lambda r: F.char_length(r))), F.lit(0)) / 2).cast("long")


def pair_entropy(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, n_pairs, entropy): Shannon entropy in bits of a text's overlapping character pairs, for each row of two
    characters or more. A row counts its own pairs, in numpy, so nothing is exploded or shuffled.
    """
    own = df.select(key, F.col(text).alias("t")).where(F.length("t") >= 2)
    x = own.select(key, (F.length("t") - 1).cast("long").alias("n_pairs"), pair_weight("t").alias("s"))
    return x.select(key, "n_pairs", (F.log2("n_pairs") - F.col("s") / F.col("n_pairs")).alias("entropy"))


def even_thinning(df: DataFrame, group: str, order: list[Column], priority: Column, cap: int) -> DataFrame:
    """At most ``cap`` rows of each group: all priority rows first, the rest evenly spread over the order; with n_before.

    Places in the order come from ``selection.ranked``, in cells of even size whatever the groups' sizes. Rows that tie in
    the whole order are in one cell. A null priority counts as false.
    """
    x = df.withColumn("__p", F.coalesce(priority, F.lit(False)))
    x = selection.ranked(x, [group, "__p"], order)
    sizes = x.groupBy(group, "__p").agg(F.count("*").alias("k")).groupBy(group).agg(F.sum("k").alias("n_before"), F.coalesce(F.sum(F.when(F.col("__p"), F.col("k"))), F.lit(0)).alias("__first"))
    x = x.join(sizes.withColumnRenamed(group, "__g"), F.col(group).eqNullSafe(F.col("__g"))).drop("__g")
    rest = F.col("n_before") - F.col("__first")
    room = F.greatest(F.lit(0), F.lit(cap) - F.col("__first"))
    # The i-th of n is kept if it is the first of its share: floor(i * room / n) moves past floor((i - 1) * room / n).
    slot = lambda i: F.floor(i * room / rest)
    spread_ = (room > 0) & ((rest <= room) | (F.col("rank") == 0) | (slot(F.col("rank")) > slot(F.col("rank") - 1)))
    keep = F.when(F.col("__p"), F.col("rank") < cap).otherwise(spread_)
    return x.where(keep).drop("__p", "rank", "__first")


def spanning(reads: DataFrame, at: Column) -> DataFrame:
    """Names whose reads together begin before a position and end after it: (qname, first, last, n)."""
    g = reads.groupBy("qname").agg(F.min("pos0").alias("first"), F.max("end0").alias("last"), F.count("*").alias("n"))
    return g.withColumn("x", at).where("first < x and last > x")


def remove_and_inject(reads: DataFrame, names: DataFrame, added: DataFrame) -> DataFrame:
    """All rows of the named fragments go, and rows of ``added`` come."""
    return reads.join(names.select("qname"), "qname", "left_anti").unionByName(added)


def set_difference(a: DataFrame, b: DataFrame, key: str, value: str) -> DataFrame:
    """(key, state) by a full outer join: only left, only right, changed or same; nulls compare as values."""
    x = a.select(F.col(key).alias("ka"), F.col(value).alias("va"))
    y = b.select(F.col(key).alias("kb"), F.col(value).alias("vb"))
    j = x.join(y, F.col("ka") == F.col("kb"), "full_outer")
    state = F.when(F.col("kb").isNull(), "only left").when(F.col("ka").isNull(), "only right").when(F.col("va").eqNullSafe(F.col("vb")), "same").otherwise("changed")
    return j.select(F.coalesce("ka", "kb").alias(key), state.alias("state"))
