"""Texts inside files: archives of documents, compressed files, comments of images, plain text in either encoding."""

from __future__ import annotations

import gzip
import io
import struct
import zipfile
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# What files begin with, and the archive members that hold text.
ZIP, GZIP, PNG = b"PK", b"\x1f\x8b", b"\x89PNG\r\n\x1a\n"
MEMBERS = (".xml", ".rels", ".txt")


def parts(data: bytes) -> list[tuple[str, str | None]]:
    """(part, text) of a file: part is empty for the file as it stands, else names what the text was taken out of. A text of
    None says that the bytes are binary, or broken, and were not read as text."""
    if data.startswith(ZIP):
        return _archive(data) or [("", None)]
    if data.startswith(GZIP):
        return _tried("gunzip", lambda: gzip.decompress(data).decode("utf-8", "replace"))
    if data.startswith(PNG):
        return _comments(data)
    return [("", None if b"\0" in data[:8192] else _decoded(data))]


def _decoded(data: bytes) -> str:
    try:
        return data.decode()
    except UnicodeDecodeError:
        return data.decode("latin-1")


def _tried(part: str, read) -> list[tuple[str, str | None]]:
    try:
        return [(part, read())]
    except (OSError, EOFError, ValueError, IndexError, zlib.error, zipfile.BadZipFile):
        return [(part, None)]


def _archive(data: bytes) -> list[tuple[str, str | None]]:
    try:
        z = zipfile.ZipFile(io.BytesIO(data))
    except zipfile.BadZipFile:
        return []
    return [x for n in z.namelist() if n.endswith(MEMBERS) for x in _tried(n, lambda n=n: z.read(n).decode("utf-8", "replace"))]


def _comments(data: bytes) -> list[tuple[str, str | None]]:
    """Chunks of an image that hold text: plain, compressed, or international with a flag that says which."""

    def compressed(body: bytes) -> str:
        return zlib.decompress(body.split(b"\0", 1)[1][1:]).decode("latin-1")

    def international(body: bytes) -> str:
        rest = body.split(b"\0", 1)[1]
        text = rest[2:].split(b"\0", 2)[2]
        return (zlib.decompress(text) if rest[0] else text).decode("utf-8", "replace")

    readers = {"tEXt": lambda b: b.decode("latin-1"), "zTXt": compressed, "iTXt": international}
    out, at = [], len(PNG)
    while at + 8 <= len(data):
        size, name = struct.unpack_from(">I4s", data, at)
        body, kind = data[at + 8 : at + 8 + size], name.decode("latin-1")
        if kind in readers:
            out += _tried(kind, lambda body=body, kind=kind: readers[kind](body))
        at += 12 + size
    return out


def texts(files: DataFrame) -> DataFrame:
    """(path, part, text) of files (path, content): a row for each text that a file holds; null text for what was not read."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for path, content in zip(rows["path"], rows["content"], strict=True):
                own = parts(content if content is not None else b"")
                yield pd.DataFrame({"path": path, "part": [p for p, _ in own], "text": [t for _, t in own]}, dtype=object)

    return files.select("path", "content").mapInPandas(work, "path string, part string, text string")


def container_texts(spark: SparkSession, path: str) -> DataFrame:
    """``texts`` of the files of a folder, each read whole by one task, as such containers must be. Spark gives no row for
    an empty file."""
    return texts(spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path))


def term_list(spark: SparkSession, path: str) -> DataFrame:
    """(term, label) of a list of terms to mask: a term a line, a label behind a tab, else REDACTED; ``#`` begins a comment.
    Only local files can be checked for other readers; that check is the caller's."""
    rows = spark.read.text(path).where((F.trim("value") != "") & ~F.col("value").startswith("#"))
    f = F.split("value", "\t", 2)
    label = F.trim(F.coalesce(F.get(f, F.lit(1)), F.lit("")))
    return rows.select(f[0].alias("term"), F.when(label == "", "REDACTED").otherwise(label).alias("label")).where(F.trim("term") != "")
