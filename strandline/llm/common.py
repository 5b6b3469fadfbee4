"""Shared helpers of the training-data operators: readers, durable intermediate tables, word arrays.

Words everywhere are maximal runs of characters other than U+0020 and U+0009..U+000D. On UTF-8 bytes that is
exactly ``bytes.split()``, so Python operators receive texts cast to BINARY and never decode them.
"""

from __future__ import annotations

import gc
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..graph import removed, shared_folder

#: Java regular expression of one word.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data directory, read by Spark only, so any store that Spark reads will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Scratch:
    """Durable intermediate tables under the shared folder; ``drop`` removes one as soon as it is no longer needed.

    Tables that a returned, still lazy DataFrame reads stay until the application's folder is cleaned by the cluster.
    """

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark, self.root, self.n = spark, f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}", 0

    def keep(self, df: DataFrame) -> DataFrame:
        """Write ``df`` and return a DataFrame that reads the written table, which survives lost executors."""
        self.n += 1
        path = f"{self.root}/{self.n}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch = path
        return out

    def drop(self, *dfs: DataFrame) -> None:
        """Delete the tables that ``keep`` wrote for these DataFrames."""
        for df in dfs:
            removed(self.spark, df._scratch)

    def free_shuffles(self) -> None:
        """Let Spark's cleaner remove shuffle files of finished jobs, which else stay until the driver collects garbage."""
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()


def small_batches(spark: SparkSession, rows: int = 512) -> None:
    """At most ``rows`` rows in an Arrow batch, so that whole texts and what is made of them fit a Python worker."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))


def word_count(text: Column) -> Column:
    """Number of words of a text, null as 0, by splitting on one character (no regular expression in the loop)."""
    blank = F.translate(F.coalesce(text, F.lit("")), "\t\n\x0b\x0c\r", "     ")
    return F.size(F.array_remove(F.split(blank, " "), "")).cast("long")


_WORD_HASH: dict[bytes, int] = {}
_WORD_HASH_MAX = 400_000


def hash_words(words: list[bytes]) -> np.ndarray:
    """64-bit hashes of words; a bounded dictionary saves hashing frequent words again."""
    global _WORD_HASH
    get = _WORD_HASH.get
    out = [get(w) for w in words]
    if None in out:
        put, h = _WORD_HASH, xxhash.xxh3_64_intdigest
        for i, x in enumerate(out):
            if x is None:
                out[i] = put[words[i]] = h(words[i])
        if len(put) > _WORD_HASH_MAX:
            _WORD_HASH = {}
    return np.array(out, dtype=np.uint64)


def slices(ids: Iterable, texts: Iterable[bytes], most: int = 2 << 20) -> Iterator[tuple[list, list[bytes]]]:
    """Runs of rows whose texts have about ``most`` bytes together, which bounds a worker's memory; a long text is a run of its own."""
    own_ids: list = []
    own: list[bytes] = []
    n = 0
    for i, t in zip(ids, texts, strict=True):
        own_ids.append(i)
        own.append(t or b"")
        n += len(own[-1])
        if n >= most:
            yield own_ids, own
            own_ids, own, n = [], [], 0
    if own:
        yield own_ids, own


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash (splitmix64), elementwise."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
