"""BAM as a batch data source: BGZF blocks inflated and records decoded in Python, without native libraries.

``spark.dataSource.register(BamSource)`` and ``spark.read.format("strandline_bam").load(path)``. A file is read in splits of
``splitBytes``: a split finds the first block that begins in it and in there the first place from which a chain of records
reads on without contradiction; a record belongs to the split in which its block begins. With options ``contig``, ``start``
and ``end`` only records that overlap the region (0-based, half-open) are returned, and a ``.bai`` beside the file says which
blocks to read. Files that are gzip but not BGZF are one split. Files are opened through Arrow's file systems, so local
paths and the URIs that these know will do; for other stores use ``from_binary_files``.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from itertools import chain

from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "file_ord bigint, qname string, flag int, contig string, pos0 bigint, mapq int, cigar string, mate_contig string, mate_pos0 bigint, tlen bigint, seq string, qual string, tags map<string,string>"
#: Bytes from which the place of the first record of a split is told.
GUESS = 1 << 17
_SIZES = {"c": "b", "C": "B", "s": "<h", "S": "<H", "i": "<i", "I": "<I", "f": "<f"}


def inflated(data: bytes) -> bytes:
    """Bytes of a BGZF or gzip file: its members inflated one after the other."""
    out, at = [], 0
    while at < len(data):
        d = zlib.decompressobj(31)
        out.append(d.decompress(data[at:]))
        at = len(data) - len(d.unused_data)
        if not d.eof:
            break
    return b"".join(out)


def tag_values(raw: bytes) -> dict[str, str]:
    """Optional fields of a record, values as text; arrays are joined by commas."""
    tags, at = {}, 0
    while at + 3 <= len(raw):
        name, kind = raw[at : at + 2].decode(), chr(raw[at + 2])
        at += 3
        if kind in _SIZES:
            n = struct.calcsize(_SIZES[kind])
            tags[name] = str(struct.unpack_from(_SIZES[kind], raw, at)[0])
            at += n
        elif kind == "A":
            tags[name] = chr(raw[at])
            at += 1
        elif kind in "ZH":
            end = raw.index(b"\0", at)
            tags[name] = raw[at:end].decode("latin-1")
            at = end + 1
        elif kind == "B":
            sub, count = chr(raw[at]), struct.unpack_from("<I", raw, at + 1)[0]
            n = struct.calcsize(_SIZES[sub])
            tags[name] = ",".join(str(struct.unpack_from(_SIZES[sub], raw, at + 5 + k * n)[0]) for k in range(count))
            at += 5 + count * n
        else:
            break
    return tags


def header(b: bytes) -> tuple[list[tuple[str, int]], int] | None:
    """Contigs (name, length) of inflated bytes and where the first record begins; None if the bytes end before that."""
    if len(b) < 8:
        return None
    if b[:4] != b"BAM\1":
        raise ValueError("not a BAM file")
    at = 8 + struct.unpack_from("<i", b, 4)[0]
    if len(b) < at + 4:
        return None
    contigs, (count,) = [], struct.unpack_from("<i", b, at)
    at += 4
    for _ in range(count):
        if len(b) < at + 4 or len(b) < at + 8 + (n := struct.unpack_from("<i", b, at)[0]):
            return None
        contigs.append((b[at + 4 : at + 3 + n].decode(), struct.unpack_from("<i", b, at + 4 + n)[0]))
        at += 8 + n
    return contigs, at


def record(b: bytes, at: int, size: int, names: list[str], ordinal: int) -> tuple:
    """Row of ``SCHEMA`` of the record whose ``size`` bytes begin at ``at + 4``."""
    ref, pos, n_name, mapq, _, n_cigar, flag, n_seq, mate, mate_pos, tlen = struct.unpack_from("<iiBBHHHiiii", b, at + 4)
    p = at + 36
    qname = b[p : p + n_name - 1].decode()
    p += n_name
    ops = struct.unpack_from(f"<{n_cigar}I", b, p)
    p += 4 * n_cigar
    packed = b[p : p + (n_seq + 1) // 2]
    p += (n_seq + 1) // 2
    seq = "".join("=ACMGRSVTWYHKDBN"[x >> 4] + "=ACMGRSVTWYHKDBN"[x & 15] for x in packed)[:n_seq]
    quals = b[p : p + n_seq]
    p += n_seq
    cigar = "".join(f"{o >> 4}{'MIDNSHP=X'[o & 15]}" for o in ops) or "*"
    qual = "*" if quals[:1] == b"\xff" or not quals else bytes(q + 33 for q in quals).decode("latin-1")
    return (ordinal, qname, flag, names[ref] if ref >= 0 else None, pos, mapq, cigar, names[mate] if mate >= 0 else None, mate_pos, tlen, seq or "*", qual, tag_values(b[p : at + 4 + size]))


def records(data: bytes) -> Iterator[tuple]:
    """Rows of ``SCHEMA`` from the bytes of a whole BAM file."""
    b = inflated(data)
    head = header(b)
    if head is None:
        raise ValueError("the header is cut short")
    names, at, ordinal = [n for n, _ in head[0]], head[1], 0
    while at + 4 <= len(b):
        (size,) = struct.unpack_from("<i", b, at)
        yield record(b, at, size, names, ordinal)
        ordinal += 1
        at += 4 + size


def block_size(b: bytes, at: int = 0) -> int:
    """Bytes of the BGZF block that begins at a place; 0 if none does."""
    if b[at : at + 4] != b"\x1f\x8b\x08\x04" or len(b) < at + 18:
        return 0
    (extra,) = struct.unpack_from("<H", b, at + 10)
    p, stop = at + 12, at + 12 + extra
    while p + 4 <= min(stop, len(b)):
        (n,) = struct.unpack_from("<H", b, p + 2)
        if b[p : p + 2] == b"BC" and n == 2 and p + 6 <= len(b):
            return struct.unpack_from("<H", b, p + 4)[0] + 1
        p += 4 + n
    return 0


def opened(path: str):
    """(file, size) of a local path or URI."""
    where, inner = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    return where.open_input_file(inner), where.get_file_info(inner).size


def blocks(f, size: int, at: int) -> Iterator[tuple[int, bytes]]:
    """(offset, inflated bytes) of the blocks from an offset on, read one by one."""
    while at < size:
        f.seek(at)
        raw = f.read(1 << 16)
        n = block_size(raw)
        if not n:
            return
        if len(raw) < n:
            raw += f.read(n - len(raw))
        yield at, zlib.decompressobj(31).decompress(raw[:n])
        at += n


def first_block(f, size: int, at: int) -> int:
    """Offset of the first block that begins at or behind a place: one that another block, or the file's end, follows."""
    f.seek(at)
    raw = f.read(3 << 16)
    p = raw.find(b"\x1f\x8b\x08\x04")
    while p >= 0:
        n = block_size(raw, p)
        if n and (at + p + n == size or block_size(raw, p + n)):
            return at + p
        p = raw.find(b"\x1f\x8b\x08\x04", p + 1)
    return size


def plausible(b: bytes, at: int, contigs: int) -> int:
    """Bytes of the record that may begin at a place, 0 if none can; -1 if its fixed part is not there."""
    if at + 36 > len(b):
        return -1
    size, ref, pos, n_name, _, _, n_cigar, _, n_seq, mate, mate_pos, _ = struct.unpack_from("<iiiBBHHHiiii", b, at)
    fits = 32 + n_name + 4 * n_cigar + (n_seq + 1) // 2 + n_seq <= size <= 1 << 28
    if not (fits and n_seq >= 0 and n_name and -1 <= ref < contigs and -1 <= mate < contigs and pos >= -1 and mate_pos >= -1):
        return 0
    name = b[at + 36 : at + 36 + n_name]
    whole = len(name) == n_name
    return 4 + size if not whole or (name[-1] == 0 and all(33 <= c <= 126 for c in name[:-1])) else 0


def first_record(b: bytes, contigs: int) -> int:
    """The first place from which records follow each other to the end of the bytes; their length if there is none."""
    for at in range(len(b)):
        p = at
        while p < len(b) and (n := plausible(b, p, contigs)) > 0:
            p += n
        if p > at and (p >= len(b) or plausible(b, p, contigs) < 0):
            return at
    return len(b)


class _Split(InputPartition):
    """Blocks that begin in [start, stop) of a file; with ``inside``, the first record begins so many bytes into the first."""

    def __init__(self, path: str, start: int, stop: int, inside: int | None = None) -> None:
        self.path, self.start, self.stop, self.inside = path, start, stop, inside


def split_records(path: str, start: int, stop: int, inside: int | None) -> Iterator[tuple]:
    """Rows of the records that begin in blocks of [start, stop). file_ord is the virtual offset: it rises with the file."""
    f, size = opened(path)
    with f:
        f.seek(0)
        if not block_size(f.read(1 << 10)):
            if start == 0:
                f.seek(0)
                yield from records(f.read())
            return
        b = b""
        for _, more in blocks(f, size, 0):
            b += more
            if (head := header(b)) is not None:
                break
        else:
            raise ValueError("the header is cut short")
        names, skip = [n for n, _ in head[0]], head[1]
        at = start if inside is not None or start == 0 else first_block(f, size, start)
        # Bytes not yet read as records; marks say where in them which block begins.
        b, marks, place, known = b"", [], 0, inside is not None or start == 0
        if inside is not None:
            place = inside
        elif start == 0:
            place = skip
        for offset, more in chain(blocks(f, size, at), [(size, b"")]):
            if offset >= stop and known and place == len(b):
                break
            marks.append((len(b), offset))
            b += more
            if not known:
                # A long stretch leaves no chain of records but the true one; a record that begins later is another split's.
                if len(b) < GUESS and offset < size:
                    continue
                place = first_record(b, len(names))
                if place == len(b):
                    return
                known = True
            while place + 4 <= len(b):
                (n,) = struct.unpack_from("<i", b, place)
                if place + 4 + n > len(b):
                    break
                base, begun = next((m for m in reversed(marks) if m[0] <= place), marks[0])
                if begun >= stop:
                    return
                yield record(b, place, n, names, begun << 16 | (place - base))
                place += 4 + n
            if place < len(b) and next(m for m in reversed(marks) if m[0] <= place)[1] >= stop:
                return
            keep = next((m for m in reversed(marks) if m[0] <= place), (0, offset))[0]
            if keep and place <= len(b):
                b, marks, place = b[keep:], [(m - keep, o) for m, o in marks if m >= keep], place - keep


def index(data: bytes) -> list[dict]:
    """Of each contig of a ``.bai``: bins (number to list of (begin, end) virtual offsets), linear offsets, mapped, unmapped."""
    if data[:4] != b"BAI\1":
        raise ValueError("not a BAI index")
    (count,) = struct.unpack_from("<i", data, 4)
    at, out = 8, []
    for _ in range(count):
        own: dict = {"bins": {}, "linear": [], "mapped": 0, "unmapped": 0}
        (n_bin,) = struct.unpack_from("<i", data, at)
        at += 4
        for _ in range(n_bin):
            number, n_chunk = struct.unpack_from("<Ii", data, at)
            chunks = [struct.unpack_from("<QQ", data, at + 8 + 16 * k) for k in range(n_chunk)]
            at += 8 + 16 * n_chunk
            # Fixed value: the number of the bin that holds a contig's counts instead of offsets.
            if number == 37450 and n_chunk == 2:
                own["mapped"], own["unmapped"] = chunks[1]
            else:
                own["bins"][number] = chunks
        (n,) = struct.unpack_from("<i", data, at)
        own["linear"] = list(struct.unpack_from(f"<{n}Q", data, at + 4))
        at += 4 + 8 * n
        out.append(own)
    return out


def region_chunks(own: dict, start: int, stop: int) -> list[tuple[int, int]]:
    """Merged (begin, end) virtual offsets of the bins that may hold records of a region."""
    # Bins of 512 Mb, 64 Mb, 8 Mb, 1 Mb, 128 kb and 16 kb, each level's first number and the bits of its width.
    levels = ((0, 29), (1, 26), (9, 23), (73, 20), (585, 17), (4681, 14))
    numbers = {first + k for first, bits in levels for k in range(start >> bits, ((stop - 1) >> bits) + 1)}
    least = own["linear"][min(start >> 14, len(own["linear"]) - 1)] if own["linear"] else 0
    out: list[list[int]] = []
    for b, e in sorted(c for n, chunks in own["bins"].items() if n in numbers for c in chunks if c[1] > least):
        if out and b >> 16 <= out[-1][1] >> 16:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([b, e])
    return [(b, e) for b, e in out]


class _Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.paths = options["path"].split(",")
        self.split = int(options.get("splitBytes", options.get("splitbytes", 64 << 20)))
        self.contig = options.get("contig")
        self.start, self.end = int(options.get("start", 0)), int(options.get("end", 1 << 29))

    def partitions(self) -> list[InputPartition]:
        out: list[InputPartition] = []
        for path in self.paths:
            f, size = opened(path)
            f.close()
            found = self.indexed(path)
            if found is None:
                out += [_Split(path, a, min(size, a + self.split)) for a in range(0, max(size, 1), self.split)]
            else:
                out += [_Split(path, b >> 16, (e >> 16) + 1, b & 0xFFFF) for b, e in found]
        return out or [_Split(self.paths[0], 0, 0)]

    def indexed(self, path: str) -> list[tuple[int, int]] | None:
        """Chunks of the region by the index beside a file; None without a region or an index."""
        if self.contig is None:
            return None
        try:
            f, _ = opened(f"{path}.bai")
        except (OSError, FileNotFoundError):
            return None
        with f:
            entries = index(f.read())
        names = [n for n, _ in contigs_of(path)]
        return region_chunks(entries[names.index(self.contig)], self.start, self.end) if self.contig in names else []

    def read(self, partition: _Split) -> Iterator[tuple]:
        if partition.stop <= partition.start:
            return
        for r in split_records(partition.path, partition.start, partition.stop, partition.inside):
            if self.contig is None or (r[3] == self.contig and r[4] < self.end and r[4] + max(1, aligned_length(r[6])) > self.start):
                yield r


def contigs_of(path: str) -> list[tuple[str, int]]:
    """Contigs (name, length) of a file's header."""
    f, size = opened(path)
    with f:
        b = b""
        for _, more in blocks(f, size, 0):
            b += more
            if (head := header(b)) is not None:
                return head[0]
        f.seek(0)
        head = header(inflated(f.read()))
    if head is None:
        raise ValueError("the header is cut short")
    return head[0]


def aligned_length(cigar: str) -> int:
    """Bases of the reference that a CIGAR covers."""
    n = total = 0
    for c in cigar:
        if c.isdigit():
            n = 10 * n + int(c)
        else:
            total, n = total + n * (c in "MDN=X"), 0
    return total


class BamSource(DataSource):
    """Reads files that Arrow can open; for stores that only Spark reads, use ``from_binary_files``. Options: splitBytes, and
    contig, start, end for a region."""

    @classmethod
    def name(cls) -> str:
        return "strandline_bam"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> _Reader:
        return _Reader(dict(self.options))


def from_binary_files(files: DataFrame) -> DataFrame:
    """Records of BAM files read by Spark's ``binaryFile`` (columns path, content): path and the columns of ``SCHEMA``."""
    from pyspark.sql import functions as F
    from pyspark.sql.functions import udtf

    @udtf(returnType=SCHEMA)
    class Decode:
        def eval(self, content: bytes):
            yield from records(content)

    return files.lateralJoin(Decode(F.col("content").outer())).select("path", *[c.split()[0] for c in SCHEMA.split(", ")])


def index_statistics(files: DataFrame) -> DataFrame:
    """(path, ord, mapped, unmapped) of the contigs, in header order, that ``.bai`` files (path, content) count."""

    def work(batches):
        import pandas as pd

        for rows in batches:
            for path, content in zip(rows["path"], rows["content"], strict=True):
                own = index(content)
                yield pd.DataFrame({"path": path, "ord": range(len(own)), "mapped": [x["mapped"] for x in own], "unmapped": [x["unmapped"] for x in own]})

    return files.select("path", "content").mapInPandas(work, "path string, ord int, mapped long, unmapped long")


def stage(reads: DataFrame, path: str) -> None:
    """Parquet by contig, sorted by position, so that region predicates prune files and row groups."""
    reads.repartitionByRange("contig", "pos0").sortWithinPartitions("contig", "pos0").write.mode("errorifexists").partitionBy("contig").parquet(path)
