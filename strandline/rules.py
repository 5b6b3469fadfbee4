"""Scoring ladders as data. The score and the attainable ceiling read the same rows, so they cannot disagree.

A ladder is a list of (operator, bound, score), the first that holds counts. Layers with too little evidence score by
``minimum``; a layer without evidence to judge is null and leaves the denominator.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The ladders, the bands of the total, and the limits of the reciprocal verdict.
LADDERS: dict[str, list[tuple[str, float, float]]] = {
    "discordant": [(">=", 0.5, 25.0), (">=", 0.2, 15.0), (">", 0.0, 7.5)],
    "clip": [(">=", 10.0, 25.0), (">=", 3.0, 15.0)],
    "split": [(">=", 0.3, 25.0), (">=", 0.1, 15.0), (">", 0.0, 7.5)],
    "depth": [("<", 0.3, 25.0), ("<", 0.7, 15.0)],
}
BANDS = [(70.0, "strong"), (40.0, "moderate"), (0.0, "weak")]
RECIPROCAL = {"strong": 5, "some": 2, "back": 3}
LOW_MAPQ_LIMIT = 0.4


def minimum_support(window_bp: Column) -> Column:
    """Reads that a lowest tier needs: three at a half-window of 500 bp, in proportion to others, and two at least."""
    return F.greatest(F.lit(2), F.rint(3.0 * window_bp / 500.0).cast("int"))


def ladder(layer: str, value: Column, support: Column | None = None, minimum: Column | None = None) -> Column:
    """Score of a value on a layer's ladder; null for a null value. ``>`` rungs also need the minimum support if given."""
    out = F.lit(0.0)
    for op, bound, score in reversed(LADDERS[layer]):
        holds = {">=": value >= bound, ">": value > bound, "<": value < bound}[op]
        if op == ">" and support is not None:
            holds = holds & (support >= minimum)
        out = F.when(holds, F.lit(score)).otherwise(out)
    return F.when(value.isNotNull(), out)


def top(layer: str) -> float:
    return max(s for _, _, s in LADDERS[layer])


def normalised(scores: list[Column]) -> Column:
    """Sum of the layers that are not null over what these could reach, of 100; null without any."""
    raw = sum((F.coalesce(s, F.lit(0.0)) for s in scores), F.lit(0.0))
    reach = sum((F.when(s.isNotNull(), F.lit(25.0)).otherwise(F.lit(0.0)) for s in scores), F.lit(0.0))
    return F.when(reach > 0, raw * 100.0 / reach)


def band(score: Column, low_mapq: Column | None = None) -> Column:
    """Word for a normalised score: NOT ASSESSABLE for null, QUALITY-LIMITED where too many reads map badly."""
    out = F.lit("none")
    for bound, word in reversed(BANDS):
        out = F.when((score > bound) if bound == 0 else (score >= bound), F.lit(word)).otherwise(out)
    out = F.when(score.isNull(), F.lit("NOT ASSESSABLE")).otherwise(out)
    return out if low_mapq is None else F.when(score.isNotNull() & (low_mapq > LOW_MAPQ_LIMIT), F.lit("QUALITY-LIMITED")).otherwise(out)


def ceiling(scores: dict[str, Column], held: str = "discordant", zero: tuple[str, ...] = ("depth",)) -> Column:
    """What the total could still reach: the held layer at its observed tier, ``zero`` layers at none, others at their top."""
    parts = [F.when(s.isNotNull(), s if k == held else F.lit(0.0 if k in zero else top(k))) for k, s in scores.items()]
    return normalised(parts)


def reciprocal(here: Column, there: Column, back: Column) -> Column:
    """Verdict from supporting reads at both ends and reads that point back; balanced needs all three."""
    strong, some, least = RECIPROCAL["strong"], RECIPROCAL["some"], RECIPROCAL["back"]
    return (
        F.when((here >= strong) & (there >= strong) & (back >= least), "RECIPROCAL")
        .when((here >= strong) & (there >= some), "ASYMMETRIC")
        .when((here >= some) & (there >= some), "PARTIAL")
        .when((here >= some) | (there >= some), "ONE-SIDED")
        .otherwise("INSUFFICIENT")
    )
