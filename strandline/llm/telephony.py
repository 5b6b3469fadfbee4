"""Media columns of telephony audio: mu-law, A-law and IMA ADPCM in RIFF/WAVE, decoded to PCM and resampled.

mu-law and A-law are expanded by tables of 256 entries. ADPCM is sequential within a block but not across blocks, so the
decoder steps through the samples of all blocks of a batch at once. Everything is integer arithmetic, so equal media give
equal samples and features everywhere.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, small_batches, table

RATE = 8000
TARGET_RATE = 16000
BLOCK = 64
PCM, ALAW, ULAW, IMA = 1, 6, 7, 17

# Fixed values of the IMA ADPCM format: how a 4-bit code moves the step index, and the step sizes.
INDEX_MOVES = np.array([-1, -1, -1, -1, 2, 4, 6, 8] * 2, dtype=np.int32)
STEPS = np.array(
    [
        7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449,
        494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442,
        11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767,
    ],
    dtype=np.int32,
)


def ulaw_table() -> np.ndarray:
    """int16 for each mu-law byte: the byte inverted is sign, 3 bits of exponent, 4 of mantissa, with a bias of 132."""
    b = ~np.arange(256, dtype=np.int32) & 0xFF
    size = ((((b & 0x0F) << 3) + 132) << ((b >> 4) & 7)) - 132
    return np.where(b & 0x80, -size, size).astype(np.int16)


def alaw_table() -> np.ndarray:
    """int16 for each A-law byte: every other bit is inverted; sign, 3 bits of exponent, 4 of mantissa."""
    b = np.arange(256, dtype=np.int32) ^ 0x55
    exponent, low = (b >> 4) & 7, ((b & 0x0F) << 4) + 8
    size = np.where(exponent == 0, low, (low + 256) << np.maximum(exponent - 1, 0))
    return np.where(b & 0x80, size, -size).astype(np.int16)


TABLES = {ULAW: ulaw_table(), ALAW: alaw_table()}


def ima_blocks(blocks: np.ndarray) -> np.ndarray:
    """Samples (int16, blocks x 2 * (size - 4) + 1) of mono IMA ADPCM blocks (uint8, blocks x size).

    A block begins with its first sample (int16, little endian), its step index (held to 0..88) and an unused byte; each
    further byte has two codes, the low one first.
    """
    count, size = blocks.shape
    out = np.empty((2 * (size - 4) + 1, count), dtype=np.int16)
    value = np.ascontiguousarray(blocks[:, :2]).view("<i2")[:, 0].astype(np.int32)
    index = np.minimum(blocks[:, 2], 88).astype(np.int32)
    out[0] = value
    body = np.ascontiguousarray(blocks[:, 4:].T)
    for k in range(2 * (size - 4)):
        code = (body[k >> 1] >> (4 * (k & 1))) & 15
        step = STEPS[index]
        move = step >> 3
        move += np.where(code & 1, step >> 2, 0)
        move += np.where(code & 2, step >> 1, 0)
        move += np.where(code & 4, step, 0)
        value += np.where(code & 8, -move, move)
        np.clip(value, -32768, 32767, out=value)
        index += INDEX_MOVES[code]
        np.clip(index, 0, 88, out=index)
        out[k + 1] = value
    return out.T


def wave(data: bytes, form: int, rate: int = RATE, block: int = 1) -> bytes:
    """A mono RIFF/WAVE file. ``block``: bytes of an ADPCM block, or of a sample."""
    bits = {PCM: 16, IMA: 4}.get(form, 8)
    per_block = 2 * (block - 4) + 1 if form == IMA else 1
    extra = struct.pack("<HH", 2, per_block) if form == IMA else struct.pack("<H", 0)
    fmt = struct.pack("<HHIIHH", form, 1, rate, rate * block // per_block, block, bits) + (b"" if form == PCM else extra)
    fact = b"" if form == PCM else b"fact" + struct.pack("<II", 4, len(data) // block * per_block)
    body = b"WAVEfmt " + struct.pack("<I", len(fmt)) + fmt + fact + b"data" + struct.pack("<I", len(data)) + data + b"\0" * (len(data) & 1)
    return b"RIFF" + struct.pack("<I", len(body)) + body


def parse(media: bytes) -> tuple[int, int, int, bytes] | None:
    """(format, rate, block, data) of a RIFF/WAVE file; None for what is none. A cut data chunk gives what there is."""
    form, data = described(media)
    return None if form is None or data is None else (form[0], form[2], form[4], data)


def described(media: bytes) -> tuple[tuple[int, ...] | None, bytes | None]:
    """(format, channels, rate, bytes a second, block, bits) and data of a RIFF/WAVE file; None for what is not there."""
    if len(media) < 12 or media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        return None, None
    at, form, data = 12, None, None
    while at + 8 <= len(media) and data is None:
        name, size = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
        if name == b"fmt " and size >= 16:
            form = struct.unpack_from("<HHIIHH", media, at + 8)
        elif name == b"data":
            data = media[at + 8 : at + 8 + size]
        at += 8 + size + (size & 1)
    return form, data


def decoded(media: bytes | None) -> tuple[int, np.ndarray] | None:
    """Rate and int16 samples of a telephony file: mono mu-law or A-law of 8 bits, PCM of 8 (unsigned) or 16 bits, or IMA
    ADPCM in blocks of at least 5 bytes. None for null, other formats, more channels, and a rate of 0."""
    form, data = described(media) if media is not None else (None, None)
    if form is None or data is None:
        return None
    kind, channels, rate, _, block, bits = form
    if channels != 1 or rate == 0 or (kind, bits) not in {(PCM, 8), (PCM, 16), (ULAW, 8), (ALAW, 8), (IMA, 4)} or (kind == IMA and block < 5):
        return None
    if (kind, bits) == (PCM, 8):
        return rate, ((np.frombuffer(data, dtype=np.uint8).astype(np.int32) - 128) << 8).astype(np.int16)
    return rate, samples(kind, block, data)


def pcm_file(media: bytes | None, target_rate: int) -> bytes | None:
    """A 16-bit RIFF/WAVE file of what ``decoded`` gives, resampled."""
    x = decoded(media)
    return None if x is None else wave(resample(x[1], x[0], target_rate).astype("<i2").tobytes(), PCM, target_rate, 2)


def samples(form: int, block: int, data: bytes) -> np.ndarray:
    """int16 samples of a data chunk; an incomplete ADPCM block at the end is left out."""
    if form in TABLES:
        return TABLES[form][np.frombuffer(data, dtype=np.uint8)]
    if form == IMA:
        whole = len(data) // block * block
        return ima_blocks(np.frombuffer(data[:whole], dtype=np.uint8).reshape(-1, block)).ravel()
    return np.frombuffer(data[: len(data) & ~1], dtype="<i2")


def resample(x: np.ndarray, rate: int, target: int) -> np.ndarray:
    """Linear interpolation at ``target`` samples a second, rounded down; the last sample holds to the end."""
    if rate == target or not len(x):
        return x
    n = len(x) * target // rate
    place = np.arange(n, dtype=np.int64) * rate
    left = place // target
    part = place - left * target
    y = x.astype(np.int64)
    right = np.minimum(left + 1, len(x) - 1)
    return (y[left] + (y[right] - y[left]) * part // target).astype(np.int16)


def summary(x: np.ndarray) -> str:
    """count,peak,rms,zero crossings of int16 samples, as whole numbers."""
    if not len(x):
        return "0,0,0,0"
    y = x.astype(np.int64)
    negative = x < 0
    return f"{len(x)},{max(int(y.max()), -int(y.min()))},{math.isqrt(int((y * y).sum()) // len(x))},{int((negative[1:] != negative[:-1]).sum())}"


def padded(text: bytes) -> bytes:
    """The bytes with zeros up to a positive multiple of 64."""
    return text + b"\0" * (max(1, -(-len(text) // BLOCK)) * BLOCK - len(text))


def store(text: Column) -> Column:
    """Column of media (binary): the padded UTF-8 bytes of a text, each byte one mu-law sample. Null is empty."""

    @F.pandas_udf("binary")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([wave(padded(t or b""), ULAW) for t in texts], dtype=object)

    return of(text.cast("binary"))


def to_pcm(media: Column, target_rate: int = TARGET_RATE) -> Column:
    """Column of PCM (binary, a 16-bit RIFF/WAVE file at ``target_rate``); null for what ``decoded`` has no samples of."""

    @F.pandas_udf("binary")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for rows in batches:
            yield pd.Series([pcm_file(m, target_rate) for m in rows], dtype=object)

    return of(media)


def features(payloads: list[bytes], pcm: list[bytes]) -> list[str]:
    """Of each payload: the summary of its stored PCM (mu-law at 8 kHz resampled to 16 kHz), of its bytes taken as A-law in the
    same way, and of its bytes taken as ADPCM blocks of 64 bytes. Payloads are multiples of 64 bytes."""
    flat = np.frombuffer(b"".join(payloads), dtype=np.uint8).reshape(-1, BLOCK)
    blocks = ima_blocks(flat)
    out, at = [], 0
    for p, m in zip(payloads, pcm, strict=True):
        n = len(p) // BLOCK
        alaw = resample(TABLES[ALAW][np.frombuffer(p, dtype=np.uint8)], RATE, TARGET_RATE)
        out.append(f"ulaw:{summary(decoded(m)[1])};alaw:{summary(alaw)};ima:{summary(blocks[at : at + n].ravel())}")
        at += n
    return out


def stored_and_read(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media (as ``store``), payload (read back from the media), pcm (as ``to_pcm``) and feature of each row of
    ``docs`` (doc_id, text; others are left out). A null text is stored as an empty one; equal texts have equal media."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for ids, texts in slices(rows["doc_id"], rows["text"]):
                media = [wave(padded(t), ULAW) for t in texts]
                payloads = [parse(m)[3] for m in media]
                pcm = [pcm_file(m, TARGET_RATE) for m in media]
                yield pd.DataFrame({"doc_id": pd.Series(ids, dtype=rows["doc_id"].dtype), "n_bytes": [len(t) for t in texts], "media": media, "payload": payloads, "pcm": pcm, "feature": features(payloads, pcm)})

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInPandas(work, f"doc_id {kind}, n_bytes long, media binary, payload binary, pcm binary, feature string")


def op10_telephony(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature, pcm_bytes, pcm_sha256 of
    every whole text."""
    small_batches(spark)
    out = stored_and_read(table(spark, sf_dir, "documents"))
    tail = F.substring("payload", -BLOCK, BLOCK)
    return out.select(
        "doc_id",
        "n_bytes",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(tail).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        "feature",
        F.octet_length("pcm").cast("long").alias("pcm_bytes"),
        F.sha2("pcm", 256).alias("pcm_sha256"),
    )
