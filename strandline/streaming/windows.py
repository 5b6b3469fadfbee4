"""Event-time windows and line-at-a-time operators; each works on a batch and on a streaming DataFrame alike.

Event-time windows are an addition of this engine: the positional bins of ``operators.locus`` carried over to time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.terms import masked


def _marked(df: DataFrame, ts: str, late: str | None) -> DataFrame:
    """A stream's watermark; it needs a timestamp, so one without time zone is taken in the session's."""
    return df.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late) if late and df.isStreaming else df


def tumbling(df: DataFrame, ts: str, keys: list[str], size: str, aggs: list[Column], slide: str | None = None, late: str | None = "10 minutes") -> DataFrame:
    """Aggregates by keys and fixed (or, with ``slide``, overlapping) windows: window_start, window_end, keys, aggregates."""
    w = F.window(ts, size, slide) if slide else F.window(ts, size)
    g = _marked(df, ts, late).groupBy(w.alias("w"), *keys).agg(*aggs)
    return g.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *[c for c in g.columns if c != "w"])


def sessions(df: DataFrame, ts: str, keys: list[str], gap: str, aggs: list[Column], late: str | None = "10 minutes") -> DataFrame:
    """Aggregates by keys and sessions that a gap ends."""
    g = _marked(df, ts, late).groupBy(F.session_window(ts, gap).alias("w"), *keys).agg(*aggs)
    return g.select(F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), *[c for c in g.columns if c != "w"])


def redact_lines(lines: DataFrame, terms: list[tuple[str, str]], column: str = "value") -> DataFrame:
    """Stateless filter for a line stream. Without terms it refuses to start, so nothing leaves unmasked."""
    if not terms:
        raise ValueError("no terms to mask: refusing to pass lines through")
    return lines.withColumn(column, masked(F.col(column), terms))


def counters(records: DataFrame, key: Column) -> DataFrame:
    """Keyed counts over a stream of records (complete or update mode) or a batch."""
    return records.groupBy(key.alias("key")).agg(F.count("*").alias("n"))


def append_calls(calls: DataFrame, path: str, checkpoint: str):
    """Starts an append-only call log; rows are found again by ``call_id`` with a plain read."""
    return calls.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").start()


def provenance(calls: DataFrame) -> DataFrame:
    """Session state over a stream (session, chrom, pos, label): each row with the label that first named its position.

    State is one value for each (session, position), kept by a deduplicating first aggregate; in batch it is ``min_by``.
    """
    g = calls.groupBy("session", "chrom", "pos").agg(F.min(F.struct("ord", "label")).alias("m"), F.count("*").alias("n"))
    return g.select("session", "chrom", "pos", F.col("m.label").alias("first_label"), "n")
