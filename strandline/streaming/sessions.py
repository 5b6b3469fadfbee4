"""Where a queried position came from: state of a session over a stream of records and queries, and the same over a batch.

Rows: session, ord (a whole number that rises within a session), chrom, pos, start, end, label; a row with a label records the
position, one without asks for it. A query is answered by the position itself if it was recorded, else by the first recorded
position of the chromosome from start to end. A position recorded again keeps its turn and takes the new label.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..joins import interval_join

COLUMNS = ["session", "ord", "chrom", "pos", "start", "end", "label"]
FOUND = "session string, ord long, source string, at long, label string"
#: Where a position came from.
KNOWN, UNKNOWN = "candidate_set", "caller_supplied"


class Recorded(StatefulProcessor):
    """A session's recorded positions, as a map from (chrom, pos) to the turn of its first record and its latest label. Entries
    that are not written for ``ttl_ms`` leave the state."""

    def __init__(self, ttl_ms: int | None) -> None:
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getMapState("seen", "chrom string, pos long", "turn long, label string", self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        # A batch of a session may come in several frames, in any order.
        every = pd.concat(list(rows)).sort_values("ord", kind="stable")
        out = []
        for r in every.itertuples():
            if isinstance(r.label, str):
                at = (r.chrom, int(r.pos))
                turn = self.seen.getValue(at)[0] if self.seen.containsKey(at) else int(r.ord)
                self.seen.updateValue(at, (turn, r.label))
            else:
                out.append((key[0], int(r.ord), *self.answer(r)))
        yield pd.DataFrame(out, columns=["session", "ord", "source", "at", "label"]).astype({"ord": "int64", "at": "Int64"})

    def answer(self, r) -> tuple[str, int | None, str | None]:
        if not pd.isna(r.pos) and self.seen.containsKey((r.chrom, int(r.pos))):
            return KNOWN, int(r.pos), self.seen.getValue((r.chrom, int(r.pos)))[1]
        if pd.isna(r.start) or pd.isna(r.end):
            return UNKNOWN, None, None
        inside = [(v[0], k[1], v[1]) for k, v in self.seen.iterator() if k[0] == r.chrom and r.start <= k[1] <= r.end]
        return (KNOWN, *min(inside)[1:]) if inside else (UNKNOWN, None, None)

    def close(self) -> None:
        pass


def answered_stream(calls: DataFrame, ttl_ms: int | None = 24 * 3600 * 1000) -> DataFrame:
    """(session, ord, source, at, label) of each query of a stream, from what its session recorded before, in earlier batches
    too. State needs the RocksDB state store; with a time to live, sessions that fall silent leave nothing behind. Spark then
    goes on with batches to clear old entries, so such a stream is run until it is stopped, not with ``availableNow``."""
    own = calls.select(F.col("session").cast("string").alias("session"), *[F.col(c).cast("string" if c in ("chrom", "label") else "long").alias(c) for c in COLUMNS[1:]])
    return own.groupBy("session").transformWithStateInPandas(Recorded(ttl_ms), outputStructType=FOUND, outputMode="Append", timeMode="ProcessingTime" if ttl_ms else "None")


def answered(calls: DataFrame) -> DataFrame:
    """The same over a batch, by an equality join for the position and an interval join for the range."""
    own = calls.select(F.col("session").cast("string").alias("session"), *COLUMNS[1:])
    asked = own.where("label is null").drop("label")
    told = own.where("label is not null and pos is not null").select(F.col("session").alias("r_session"), F.col("ord").alias("r_ord"), F.col("chrom").alias("r_chrom"), F.col("pos").alias("r_pos"), F.col("label").alias("r_label"))
    key = (F.col("session") == F.col("r_session")) & (F.col("chrom") == F.col("r_chrom")) & (F.col("r_ord") < F.col("ord"))
    exact = asked.join(told, key & (F.col("pos") == F.col("r_pos"))).groupBy("session", "ord").agg(F.min(F.lit(0)).alias("rank"), F.max("r_pos").alias("at"), F.max_by("r_label", "r_ord").alias("label"))
    spans = asked.where("start is not null and end is not null")
    pairs = interval_join(spans, told, [("session", "r_session"), ("chrom", "r_chrom")], (F.col("start"), F.col("end") + 1), (F.col("r_pos"), F.col("r_pos") + 1), 256, longest=(None, 1)).where("r_ord < ord")
    each = pairs.groupBy("session", "ord", "r_pos").agg(F.min("r_ord").alias("turn"), F.max_by("r_label", "r_ord").alias("label"))
    near = each.groupBy("session", "ord").agg(F.min(F.struct("turn", F.col("r_pos").alias("at"), "label")).alias("m")).select("session", "ord", F.lit(1).alias("rank"), "m.at", "m.label")
    best = exact.unionByName(near).groupBy("session", "ord").agg(F.min(F.struct("rank", "at", "label")).alias("m"))
    out = asked.select("session", "ord").join(best, ["session", "ord"], "left")
    return out.select("session", "ord", F.when(F.col("m").isNotNull(), KNOWN).otherwise(UNKNOWN).alias("source"), "m.at", "m.label")
