"""Joins by nearness, planned as equi-joins on bins: band, interval, and nearest on either side.

A plain range predicate plans as a nested loop over all pairs. Each helper here deals rows to bins, joins the bins by
equality (hash or sort-merge, spillable, skew-splittable by AQE) and keeps the exact predicate as a residual condition.
Bin widths follow the tolerance or the interval lengths, so results do not depend on them. Spans of any length take a few
rows: bins come in levels, each eight times as wide as the one before, and a span lives on the level of its own length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _bin(value: Column, width: int) -> Column:
    return F.floor(value / F.lit(width)).cast("long")


def band_join(left: DataFrame, right: DataFrame, equal: list[tuple[str, str]], bands: list[tuple[str, str, int]]) -> DataFrame:
    """Pairs of rows with equal keys whose band columns differ by at most a tolerance each.

    ``equal``: (left column, right column); ``bands``: (left column, right column, tolerance). Columns of both sides must
    have different names. Every band makes bins, twice its tolerance wide, so that a crowd in one band is parted by the
    others; a left row goes to the one or two bins of each band that its tolerance reaches, a right row to its own.
    """
    a, b, on = left, right, F.lit(True)
    for k, (lc, rc, t) in enumerate(bands):
        width = max(2 * int(t), 1)
        a = a.withColumn(f"__bin{k}", F.explode(F.sequence(_bin(F.col(lc) - F.lit(t), width), _bin(F.col(lc) + F.lit(t), width))))
        b = b.withColumn(f"__bin_r{k}", _bin(F.col(rc), width))
        on = on & (F.col(f"__bin{k}") == F.col(f"__bin_r{k}"))
    for lc, rc in equal:
        on = on & (F.col(lc) == F.col(rc))
    for lc, rc, t in bands:
        on = on & (F.abs(F.col(lc) - F.col(rc)) <= F.lit(t))
    return a.join(b, on).drop(*[f"{c}{k}" for k in range(len(bands)) for c in ("__bin", "__bin_r")])


#: Levels of bins, and how much wider each is than the one before.
LEVELS, WIDER = 12, 8
#: A bound on span lengths that says nothing, for a side that is not to be measured.
ANY_LENGTH = 1 << 60


def level_of(length: Column, width: int) -> Column:
    """The least level whose bins are as wide as a span, so that it touches two of them at most."""
    return sum((F.when(length > width * WIDER**k, 1).otherwise(0) for k in range(LEVELS - 1)), F.lit(0))


def _levels(side: DataFrame, level: Column, longest: int | None, width: int) -> Column:
    """Bits of the levels that a side's spans live on: measured once, or all up to that of a known length."""
    if longest is None:
        return F.coalesce(side.select(F.bit_or(F.call_function("shiftleft", F.lit(1), level))).scalar(), F.lit(0))
    return F.lit((1 << (1 + sum(longest > width * WIDER**k for k in range(LEVELS - 1)))) - 1)


def _dealt(side: DataFrame, s: str, e: str, width: int, guest: int, others: Column) -> DataFrame:
    """Rows for each bin in which a span meets others: ``_t`` 0 where the left side is at home, 1 where the right is.

    ``guest`` is this side's ``_t`` as a visitor; it visits the levels of the others' spans that are longer, and for the left
    side also as long. At home it waits for shorter ones, of which there are none on the first level of the left side.
    """
    own = side.withColumn("_own", level_of(F.col(e) - F.col(s), width))
    spot = lambda t, k: F.struct(F.lit(t).alias("t"), k.cast("int").alias("l"))
    visits = [F.when((F.col("_own") + (1 - guest) <= k) & (F.getbit(others, F.lit(k)) == 1), spot(guest, F.lit(k))) for k in range(LEVELS)]
    stays = F.when((F.col("_own") > 0) | F.lit(guest == 0), spot(1 - guest, F.col("_own")))
    own = own.withColumn("_at", F.explode(F.array_compact(F.array(stays, *visits)))).withColumn("_w", (F.lit(width) * F.pow(F.lit(float(WIDER)), F.col("_at.l"))).cast("long"))
    own = own.withColumn("_b", F.explode(F.sequence(F.floor(F.col(s) / F.col("_w")), F.floor((F.col(e) - 1) / F.col("_w")))))
    return own.withColumns({"_t": F.col("_at.t"), "_l": F.col("_at.l")}).drop("_own", "_at")


def interval_join(
    left: DataFrame,
    right: DataFrame,
    equal: list[tuple[str, str]],
    left_span: tuple[Column, Column],
    right_span: tuple[Column, Column],
    width: int,
    how: str = "inner",
    longest: tuple[int | None, int | None] = (ANY_LENGTH, None),
) -> DataFrame:
    """Pairs of rows with equal keys whose half-open spans overlap: left.start < right.end and left.end > right.start.

    Of each pair the shorter span visits the level of bins that the longer one lives on, where both touch at most two bins;
    so a span of any length is at most two rows for each level that the other side has. A pair is kept only in the first bin
    both touch, so no pair comes twice and no distinct is needed.

    ``width``: of the first level's bins. ``longest``: bounds on the spans' lengths, left and right; where one is None, the
    levels in use are read off that side first, by one aggregate. With a side that is costly to read, or read by Python, give
    a bound (``ANY_LENGTH`` if there is none): the other side then visits all levels up to it. ``how``: inner, left_semi or
    left_anti; for the last two, ``left`` must have no equal rows that are to be told apart. Empty spans overlap nothing.
    """
    (ls, le), (rs, re) = left_span, right_span
    a = left.withColumns({"__ls": ls.cast("long"), "__le": le.cast("long")}).where("__le > __ls")
    b = right.withColumns({"__rs": rs.cast("long"), "__re": re.cast("long")}).where("__re > __rs")
    in_a = _levels(a, level_of(F.col("__le") - F.col("__ls"), width), longest[0], width)
    in_b = _levels(b, level_of(F.col("__re") - F.col("__rs"), width), longest[1], width)
    a_bins = _dealt(a, "__ls", "__le", width, 1, in_b).withColumnsRenamed({"_t": "__t", "_l": "__l", "_b": "__b", "_w": "__w"})
    b = _dealt(b, "__rs", "__re", width, 0, in_a).withColumnsRenamed({"_t": "__u", "_l": "__m", "_b": "__c"}).drop("_w")
    on = (F.col("__b") == F.col("__c")) & (F.col("__l") == F.col("__m")) & (F.col("__t") == F.col("__u"))
    for lc, rc in equal:
        on = on & (F.col(lc) == F.col(rc))
    on = on & (F.col("__ls") < F.col("__re")) & (F.col("__le") > F.col("__rs"))
    if how == "inner":
        first = F.col("__b") == F.floor(F.greatest("__ls", "__rs") / F.col("__w"))
        return a_bins.join(b, on & first).drop("__b", "__c", "__ls", "__le", "__rs", "__re", "__t", "__u", "__l", "__m", "__w")
    hit = a_bins.join(b, on, "left_semi").drop("__b", "__ls", "__le", "__t", "__l", "__w").distinct()
    return hit if how == "left_semi" else _anti(left, hit)


def _anti(left: DataFrame, hit: DataFrame) -> DataFrame:
    renamed = hit.select([F.col(c).alias(f"__h_{c}") for c in left.columns])
    on = F.lit(True)
    for c in left.columns:
        on = on & F.col(c).eqNullSafe(F.col(f"__h_{c}"))
    return left.join(renamed, on, "left_anti")


def nearest(
    points: DataFrame, key: str, targets: DataFrame, equal: list[tuple[str, str]], at: Column, edge: Column, side: str, reach: int, tie: list[Column], take: list[str]
) -> DataFrame:
    """For each point the nearest target strictly to its ``side`` within ``reach``: columns key, distance and ``take``.

    ``edge`` is the target's end (side left) or start (side right). Ties go to the least ``tie``. Points without a target
    in reach are left out. Distances are at least 1.
    """
    width = max(reach, 1)
    p = points.withColumn("__at", at).withColumn("__b", F.explode(F.array(*[_bin(F.col("__at"), width) + F.lit(d) for d in (-1, 0, 1)])))
    t = targets.withColumn("__edge", edge).withColumn("__c", _bin(F.col("__edge"), width))
    gap = F.col("__at") - F.col("__edge") if side == "left" else F.col("__edge") - F.col("__at")
    on = F.col("__b") == F.col("__c")
    for lc, rc in equal:
        on = on & (F.col(lc) == F.col(rc))
    pairs = p.join(t, on & (gap >= 1) & (gap <= reach)).withColumn("distance", gap)
    best = pairs.groupBy(key).agg(F.min(F.struct("distance", *[x.alias(f"__t{i}") for i, x in enumerate(tie)], *take)).alias("__m"))
    return best.select(key, "__m.distance", *[f"__m.{c}" for c in take])
