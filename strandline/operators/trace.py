"""Analytics over call logs and conversations: durations, costs, provenance of values, polarity of sentences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def durations(log: DataFrame, key: str, at: str, end: Column | None = None) -> DataFrame:
    """``log`` with seconds until the key's next mark; the last mark lasts until ``end``, or is null."""
    over = W.partitionBy(key).orderBy(at, *[c for c in ("event_id",) if c in log.columns])
    nxt = F.lead(at).over(over)
    nxt = nxt if end is None else F.coalesce(nxt, end)
    seconds = lambda c: F.unix_micros(c.cast("timestamp")) / 1e6
    return log.withColumn("seconds", seconds(nxt) - seconds(F.col(at)))


def first_seen(values: DataFrame, session: str, turn: str, value: str) -> DataFrame:
    """(session, value, first): the least turn in which a value came up, i.e. a running distinct set as a table."""
    return values.groupBy(session, value).agg(F.min(turn).alias("first"))


def composed(uses: DataFrame, returned: DataFrame, session: str, turn: str, value: str) -> DataFrame:
    """Uses of a value with known: whether some earlier turn of the session returned it."""
    seen = first_seen(returned, session, turn, value)
    return uses.join(seen, [session, value], "left").withColumn("known", F.coalesce(F.col("first") < F.col(turn), F.lit(False))).drop("first")


def cost(calls: DataFrame, prices: DataFrame, model: str, tokens: str) -> DataFrame:
    """(model, n, tokens, cost) by model; the cost of a model without a price is null, not zero."""
    priced = calls.join(prices, model, "left")
    return priced.groupBy(model).agg(F.count("*").alias("n"), F.sum(tokens).cast("long").alias("tokens"), F.when(F.count("price") == F.count("*"), F.sum(F.col(tokens) * F.col("price"))).alias("cost"))


def polarity(df: DataFrame, keys: list[str], sentence: str, term: str, positive: str, negative: str) -> DataFrame:
    """Sentences that hold the term, with the polarity of the cue that stands nearest before it; none without a cue."""
    s = F.lower(F.col(sentence))
    at = F.instr(s, term)
    before = F.substring(s, F.lit(1), at - 1)
    last = lambda cue: F.when(F.instr(before, cue) > 0, F.char_length(before) - F.instr(F.reverse(before), cue[::-1]) - len(cue) + 2).otherwise(0)
    p, n = last(positive), last(negative)
    word = F.when((p == 0) & (n == 0), "none").when(p > n, "positive").otherwise("negative")
    return df.where(at > 0).select(*keys, word.alias("polarity"))


def universal(df: DataFrame, key: str, condition: Column) -> DataFrame:
    """(key, n, all_hold): whether every row of a key meets the condition; null counts as not."""
    return df.groupBy(key).agg(F.count("*").alias("n"), F.every(F.coalesce(condition, F.lit(False))).alias("all_hold"))
