"""Quality classifier by compression: one zstandard dictionary from good and one from bad labelled texts.

Each whole text is compressed with both. The difference of the two sizes over their sum says which dictionary fits it
better; a logistic calibration turns it, together with the log of the length and the compression ratio (both change how
far a given difference is to be trusted), into a probability of label 1.

Fitting uses a bounded sample: ``per_class`` labelled texts of each class, chosen by a hash of the id among texts of at
most ``max_train_bytes``; one half makes the dictionaries, the other half the calibration, so no text calibrates a
dictionary that holds it. Everything else runs over all rows, batch by batch, without a shuffle.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

DICTIONARY_BYTES = 262_144
LEVEL = 3
THRESHOLD = 0.7


@dataclass(frozen=True)
class QualityModel:
    """Two dictionaries and the calibration's mean, scale and weights. Its size is bounded by the parameters above."""

    good: bytes
    bad: bytes
    mean: tuple[float, ...]
    scale: tuple[float, ...]
    weights: tuple[float, ...]

    def scorer(self) -> Compressors:
        return Compressors(self.good, self.bad)

    def probability(self, x: np.ndarray) -> np.ndarray:
        z = self.weights[0] + ((x - np.array(self.mean)) / np.array(self.scale)) @ np.array(self.weights[1:])
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


class Compressors:
    """Compressed sizes under both dictionaries, as features."""

    def __init__(self, good: bytes, bad: bytes) -> None:
        self.pair = []
        for data in (good, bad):
            d = zstandard.ZstdCompressionDict(data)
            d.precompute_compress(level=LEVEL)
            self.pair.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_dict_id=False))

    def features(self, text: bytes) -> tuple[float, float, float]:
        a, b = (len(c.compress(text)) for c in self.pair)
        return (b - a) / (a + b), float(np.log1p(len(text))), len(text) / (a + b)


def calibrate(x: np.ndarray, y: np.ndarray, prior: float, rounds: int = 60) -> tuple[tuple[float, ...], ...]:
    """Logistic regression by Newton's steps with a small ridge; classes are weighted to the share ``prior`` of label 1."""
    mean, scale = x.mean(0), x.std(0) + 1e-9
    a = np.c_[np.ones(len(x)), (x - mean) / scale]
    w = np.where(y == 1, prior / max((y == 1).mean(), 1e-9), (1 - prior) / max((y == 0).mean(), 1e-9))
    b = np.zeros(a.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ b, -30, 30)))
        step = np.linalg.solve((a * (w * p * (1 - p))[:, None]).T @ a + 0.05 * np.eye(len(b)), a.T @ (w * (y - p)) - 0.05 * b)
        b += np.clip(step, -4, 4)
    return tuple(mean), tuple(scale), tuple(b)


def fit(documents: DataFrame, labels: DataFrame, per_class: int = 1000, max_train_bytes: int = 65_536) -> QualityModel:
    """Fit on at most ``2 * per_class`` whole texts of at most ``max_train_bytes`` each, which bounds what the driver gets.

    ``labels``: doc_id, quality (0/1; null rows are left out). With fewer than 8 usable texts of a class, dictionaries are
    that class's raw texts. Without any text of one class the calibration gives the prior of the other.
    """
    known = labels.where("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    counts = {r["quality"]: r["n"] for r in known.groupBy("quality").agg(F.count("*").alias("n")).collect()}
    chosen = None
    for q in (0, 1):
        part = known.where(F.col("quality") == q).orderBy(F.xxhash64("doc_id"), "doc_id").limit(2 * per_class)
        chosen = part if chosen is None else chosen.unionByName(part)
    texts = documents.select("doc_id", F.col("text").cast("binary").alias("text")).where(F.octet_length("text").between(1, max_train_bytes))
    rows = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "quality").agg(F.min("text").alias("text"))
    best = rows.where("quality = 0").orderBy(F.xxhash64("doc_id")).limit(per_class).unionAll(rows.where("quality = 1").orderBy(F.xxhash64("doc_id")).limit(per_class)).collect()
    split: dict[int, list[bytes]] = {q: [bytes(r["text"]) for r in sorted(best, key=lambda r: r["doc_id"] * 0x9E3779B97F4A7C15 % (1 << 64)) if r["quality"] == q] for q in (0, 1)}
    dictionaries = {q: dictionary(t[::2] or [b" "]) for q, t in split.items()}
    scorer = Compressors(dictionaries[1], dictionaries[0])
    held = [(scorer.features(t), q) for q in (0, 1) for t in (split[q][1::2] or split[q])]
    x = np.array([f for f, _ in held] or [(0.0, 0.0, 0.0)])
    y = np.array([q for _, q in held] or [1])
    prior = min(0.98, max(0.02, counts.get(1, 0) / max(1, sum(counts.values()))))
    return QualityModel(dictionaries[1], dictionaries[0], *calibrate(x, y, prior))


def dictionary(texts: list[bytes]) -> bytes:
    """A trained dictionary; where texts are too few or too alike for the trainer, their raw bytes."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, texts, k=200, d=8).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return (b"\n".join(texts))[-DICTIONARY_BYTES:].ljust(8, b" ")


def score(documents: DataFrame, model: QualityModel, column: str = "score") -> DataFrame:
    """``documents`` with a column ``column``: the probability of label 1, from the text alone.

    A null text counts as empty, and an empty text has the calibrated score of no difference. An existing column of the
    same name is replaced. Rows are scored where they are; the model goes to each task by broadcast (its size is fixed).
    """
    shared = documents.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        m = shared.value
        scorer = m.scorer()
        for texts in batches:
            x = np.array([scorer.features(t if t is not None else b"") for t in texts], dtype=float).reshape(-1, 3)
            yield pd.Series(m.probability(x))

    return documents.withColumn(column, of(F.col("text").cast("binary")))


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows never used for fitting: crc32 of the id's decimal text, modulo 4, is 2."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2


def fit_tables(spark: SparkSession, sf_dir: str) -> QualityModel:
    return fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").where(~F.coalesce(held_out(), F.lit(True))))


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted (1 where score >= 0.7) of every document. Null texts count as empty, and empty ones have
    the score of no difference; a null doc_id is not held out; rows that repeat score alike; an empty table gives no rows."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score(docs, fit_tables(spark, sf_dir))
    return scored.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def stage_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents with a score of at least 0.7 stay; columns are those of ``docs``, in
    their order, whatever their names. Null and empty texts are judged by the score of no difference."""
    scored = score(docs, fit_tables(spark, sf_dir), "__score")
    return scored.where(F.col("__score") >= THRESHOLD).select(*docs.columns)


def crc_group(doc_id: int) -> int:
    """The same fold in Python, for tests."""
    return zlib.crc32(str(doc_id).encode()) % 4
