"""Comparisons and tallies over records of runs: gates, agreement, expected against got, digests, commitments, provenance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..joins import band_join


def compared(expected: DataFrame, got: DataFrame, key: list[str], value: str) -> DataFrame:
    """(key, expected, got, verdict): MATCH or DIFFERS for each key of either; nulls compare as values."""
    x = expected.select(*key, F.col(value).alias("expected"), F.lit(True).alias("_x"))
    y = got.select(*key, F.col(value).alias("got"), F.lit(True).alias("_y"))
    j = x.join(y, key, "full_outer")
    same = F.col("_x").isNotNull() & F.col("_y").isNotNull() & F.col("expected").eqNullSafe(F.col("got"))
    return j.select(*key, "expected", "got", F.when(same, "MATCH").otherwise("DIFFERS").alias("verdict"))


def first_of_each(key: list[str], *tables: DataFrame) -> DataFrame:
    """The tables one after the other; of rows with equal keys the first table's least row stays."""
    columns = tables[0].columns
    x = None
    for i, t in enumerate(tables):
        one = t.select(*columns, F.lit(i).alias("_from"))
        x = one if x is None else x.unionByName(one)
    rest = [c for c in columns if c not in key]
    best = x.groupBy(*key).agg(F.min(F.struct("_from", *rest)).alias("_b"))
    return best.select(*[F.col(c) if c in key else F.col(f"_b.{c}") for c in columns])


def gates(df: DataFrame, by: list[str], checks: list[tuple[str, Column, Column, float]]) -> DataFrame:
    """(by, gate, part, whole, fraction, passed): of each check (name, counted, among, least fraction); null without any row
    to count among."""
    parts = [F.struct(F.lit(n).alias("gate"), F.count_if(a & c).alias("part"), F.count_if(a).alias("whole"), F.lit(least).alias("least")) for n, c, a, least in checks]
    g = df.groupBy(*by).agg(F.array(*parts).alias("g")).select(*by, F.explode("g").alias("g"))
    share = F.when(F.col("g.whole") > 0, F.col("g.part") / F.col("g.whole"))
    return g.select(*by, "g.gate", "g.part", "g.whole", share.alias("fraction"), (share >= F.col("g.least")).alias("passed"))


def agreement(one: DataFrame, two: DataFrame, key: str, value: str) -> DataFrame:
    """One row: n (keys of both), agree, and the keys that disagree, sorted."""
    j = one.select(key, F.col(value).alias("a")).join(two.select(key, F.col(value).alias("b")), key)
    same = F.col("a").eqNullSafe(F.col("b"))
    return j.agg(F.count("*").alias("n"), F.count_if(same).alias("agree"), F.array_sort(F.collect_list(F.when(~same, F.col(key)))).alias("disagree"))


def tallies(df: DataFrame, by: list[str], counts: dict[str, Column], total: Column, name: str) -> DataFrame:
    """Counts of conditions by columns, with rows ``name`` that sum, by the later columns, the rows for which ``total`` holds."""
    own = df.groupBy(*by).agg(F.count("*").alias("n"), *[F.count_if(c).alias(k) for k, c in counts.items()])
    summed = df.where(total).groupBy(*by[1:]).agg(F.count("*").alias("n"), *[F.count_if(c).alias(k) for k, c in counts.items()])
    return own.unionByName(summed.withColumn(by[0], F.lit(name)).select(*own.columns))


def compositions(df: DataFrame, group: str, kind: str) -> DataFrame:
    """(kinds, groups): how many groups are made of which set of kinds."""
    g = df.groupBy(group).agg(F.array_join(F.array_sort(F.collect_set(kind)), "+").alias("kinds"))
    return g.groupBy("kinds").agg(F.count("*").alias("groups"))


def preferred(df: DataFrame, key: list[str], replacement: Column, order: list[Column]) -> DataFrame:
    """One row for each key: a replacement if there is one, else the scheduled row; among equals the first by ``order``."""
    return df.withColumn("_r", F.row_number().over(W.partitionBy(*key).orderBy(replacement.desc(), *order))).where("_r = 1").drop("_r")


def unmatched_claims(claims: DataFrame, calls: DataFrame) -> DataFrame:
    """``claims`` (run, check) without a call that backs them; ``calls`` (run, tool, contigs) back ``tool`` and ``tool@contig``."""
    keys = F.concat(F.array(F.col("tool")), F.transform(F.filter(F.coalesce("contigs", F.array().cast("array<string>")), lambda c: c.isNotNull() & (c != "")), lambda c: F.concat(F.col("tool"), F.lit("@"), c)))
    made = calls.select("run", F.explode(keys).alias("check")).distinct()
    return claims.join(made, ["run", "check"], "left_anti")


def found_truths(truths: DataFrame, found: DataFrame, tolerance: int) -> DataFrame:
    """(event, truth): events that have a breakpoint near every breakpoint of a truth.

    ``truths`` (truth, contig, pos) and ``found`` (event, contig, pos) have a row for each breakpoint. A truth meets events
    only at the breakpoint with the fewest found ones around it, and its others are looked up in the event's own list; so
    the pairs follow the rarest breakpoints, however crowded the others are. Breakpoints with nulls are left out.
    """
    width = max(2 * tolerance, 1)
    bin_of = lambda p: F.floor(p / F.lit(width)).cast("long")
    known = "contig is not null and pos is not null"
    spots = truths.where(known).select("truth", "contig", "pos").distinct()
    crowds = found.where(known).groupBy("contig", bin_of(F.col("pos")).alias("bin")).agg(F.count("*").alias("n"))
    around = spots.withColumn("bin", F.explode(F.sequence(bin_of(F.col("pos") - tolerance), bin_of(F.col("pos") + tolerance)))).join(crowds, ["contig", "bin"], "left")
    load = around.groupBy("truth", "contig", "pos").agg(F.sum(F.coalesce("n", F.lit(0))).alias("n"))
    anchors = load.groupBy("truth").agg(F.min(F.struct("n", "contig", "pos")).alias("a"), F.collect_list(F.struct("contig", "pos")).alias("t_ends"))
    anchors = anchors.where("a.n > 0").select("truth", "t_ends", F.col("a.contig").alias("t_contig"), F.col("a.pos").alias("t_pos"))
    events = found.where(known).groupBy("event").agg(F.array_sort(F.collect_set(F.struct("contig", "pos"))).alias("f_ends"))
    at = events.withColumn("f", F.explode("f_ends")).select("event", "f_ends", "f", F.col("f.contig").alias("f_contig"), F.col("f.pos").alias("f_pos"))
    near = lambda e, contig, pos: (e["contig"] == contig) & (F.abs(e["pos"] - pos) <= tolerance)
    pairs = band_join(anchors, at, [("t_contig", "f_contig")], [("t_pos", "f_pos", tolerance)])
    # An event with several breakpoints near the anchor comes by the first of them only.
    pairs = pairs.where(F.get(F.filter("f_ends", lambda e: near(e, F.col("t_contig"), F.col("t_pos"))), F.lit(0)) == F.col("f"))
    return pairs.where(F.forall("t_ends", lambda x: F.exists("f_ends", lambda e: near(e, x["contig"], x["pos"])))).select("event", "truth")


def adjudicated(df: DataFrame, by: list[str], category: str, genuine: list[str], counted: Column) -> DataFrame:
    """(by, counted, genuine, false_positive, fp_rate, categories): what of the counted reads was genuine, with a count for
    each category as ``name:n`` texts in order of name; the rate is null without any."""
    own = df.where(counted).groupBy(*by, category).agg(F.count("*").alias("n"))
    real = F.col(category).isin(genuine)
    g = own.groupBy(*by).agg(F.sum("n").cast("long").alias("counted"), F.sum(F.when(real, F.col("n")).otherwise(0)).cast("long").alias("genuine"), F.array_sort(F.collect_list(F.concat_ws(":", F.col(category), F.col("n").cast("string")))).alias("categories"))
    return g.withColumn("false_positive", F.col("counted") - F.col("genuine")).withColumn("fp_rate", F.when(F.col("counted") > 0, F.col("false_positive") / F.col("counted")))


def mode(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """(by, n, mode, share, least, most): the value of most rows (the least of ties), its share, and both extremes."""
    c = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("k"))
    g = c.groupBy(*by).agg(F.sum("k").cast("long").alias("n"), F.min_by(value, F.struct(-F.col("k"), F.col(value))).alias("mode"), F.max("k").alias("k"), F.min(value).alias("least"), F.max(value).alias("most"))
    return g.select(*by, "n", "mode", (F.col("k") / F.col("n")).alias("share"), "least", "most")


def strongest_missed(ends: DataFrame, survived: Column, strength: Column, key: str) -> DataFrame:
    """The row of ``ends`` with the greatest strength among those that did not survive; ties go to the least key."""
    return ends.where(~survived).agg(F.max_by(F.struct(*[F.col(c) for c in ends.columns]), F.struct(strength.alias("s"), F.struct(-F.col(key)).alias("k"))).alias("r")).where("r is not null").select("r.*")


def last_core_call(calls: DataFrame, run: str, turn: str, tool: str, core: list[str], summary: str) -> DataFrame:
    """(run, valid): a run's summary call exists and no core call comes after its last one."""
    at = lambda names: F.max(F.when(F.col(tool).isin(names), F.col(turn)))
    g = calls.groupBy(run).agg(at([summary]).alias("s"), at([c for c in core if c != summary]).alias("c"))
    return g.select(run, (F.col("s").isNotNull() & (F.col("c").isNull() | (F.col("c") < F.col("s")))).alias("valid"))


def table_digest(df: DataFrame, order: str, columns: list[str], by: list[str] | None = None) -> DataFrame:
    """(by, md5): digest of a small table's rows in order, fields joined by tabs and rows by line feeds; nulls are empty.

    For catalogues such as a header's contigs, whose rows fit one row.
    """
    line = F.concat_ws("\t", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])
    rows = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), line.alias("line")))), lambda r: r["line"])
    return df.groupBy(*(by or [])).agg(F.md5(F.array_join(rows, "\n").cast("binary")).alias("md5"))


def commitment(salt: Column, fields: dict[str, Column]) -> Column:
    """sha256 of a salt and a JSON object with sorted keys and text values, as published before an answer is opened."""
    body = F.to_json(F.struct(*[F.coalesce(fields[k].cast("string"), F.lit("")).alias(k) for k in sorted(fields)]))
    return F.sha2(F.concat(salt, body).cast("binary"), 256)


def run_name(name: Column) -> Column:
    """struct<model,condition,run,replacement> of a file name ``model__condition__runN[_rM].json``; null if it is none."""
    pattern = r"([^/]+?)__([^/_]+(?:_[^/_]+)*)__run(\d+)(?:_r(\d+))?\.json$"
    part = lambda k: F.regexp_extract(name, pattern, k)
    return F.when(name.rlike(pattern), F.struct(part(1).alias("model"), part(2).alias("condition"), part(3).try_cast("int").alias("run"), part(4).try_cast("int").alias("replacement")))


def visible(rows: DataFrame, labels: DataFrame, private: bool) -> DataFrame:
    """Rows whose label is public, and with ``private`` those of private labels too; an unlisted label is private."""
    if private:
        return rows
    return rows.join(labels.where(F.col("kind") == "public").select("label").distinct(), "label", "left_semi")
