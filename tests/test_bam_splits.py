"""BAM files read in splits and by region, against the records that were written."""

from __future__ import annotations

import random
import struct
import zlib

from strandline.sources import bam


def bgzf(data, size):
    """Blocks of ``size`` bytes of data, and where each begins: (data offset, file offset)."""
    out, marks = b"", []
    for a in [*range(0, len(data), size), None]:
        part = b"" if a is None else data[a : a + size]
        c = zlib.compressobj(1, zlib.DEFLATED, -15)
        body = c.compress(part) + c.flush()
        if a is not None:
            marks.append((a, len(out)))
        out += b"\x1f\x8b\x08\x04\0\0\0\0\0\xff\x06\0BC\x02\0" + struct.pack("<H", len(body) + 25) + body + struct.pack("<II", zlib.crc32(part), len(part))
    return out, marks


def made(n, size):
    """(file bytes, rows (name, contig, pos, length), index bytes) of n records on two contigs in order."""
    rnd = random.Random(n)
    names = [("c1", 900_000), ("c2", 900_000)]
    head = b"BAM\1" + struct.pack("<i", 4) + b"@CO\n" + struct.pack("<i", 2)
    for name, length in names:
        head += struct.pack("<i", len(name) + 1) + name.encode() + b"\0" + struct.pack("<i", length)
    rows = sorted((rnd.randrange(2), rnd.randrange(800_000), rnd.randint(5, 300)) for _ in range(n))
    data, places = head, []
    for i, (ref, pos, m) in enumerate(rows):
        name = f"read{i}".encode() + b"\0"
        body = struct.pack("<iiBBHHHiiii", ref, pos, len(name), 60, 0, 1, 0, m, -1, -1, 0) + name + struct.pack("<I", m << 4) + rnd.randbytes((m + 1) // 2) + bytes(rnd.randrange(60) for _ in range(m)) + b"XZZ" + rnd.choice([b"a", b"bb" * 400]) + b"\0"
        places.append((len(data), len(data) + 4 + len(body)))
        data += struct.pack("<i", len(body)) + body
    out, marks = bgzf(data, size)

    def virtual(at):
        base, offset = max(m for m in marks if m[0] <= min(at, marks[-1][0] + size - 1))
        return offset << 16 | (at - base)

    def bin_of(a, b):
        b -= 1
        for first, bits in ((4681, 14), (585, 17), (73, 20), (9, 23), (1, 26)):
            if a >> bits == b >> bits:
                return first + (a >> bits)
        return 0

    bai = b"BAI\1" + struct.pack("<i", 2)
    for ref in range(2):
        bins, linear = {}, {}
        for (r, pos, m), (a, b) in zip(rows, places, strict=True):
            if r == ref:
                bins.setdefault(bin_of(pos, pos + m), []).append((virtual(a), virtual(b) if b < len(data) else len(out) << 16))
                for w in range(pos >> 14, ((pos + m - 1) >> 14) + 1):
                    linear[w] = min(linear.get(w, 1 << 63), virtual(a))
        bins[37450] = [(0, 0), (sum(r == ref for r, _, _ in rows), ref)]
        bai += struct.pack("<i", len(bins)) + b"".join(struct.pack("<Ii", k, len(c)) + b"".join(struct.pack("<QQ", *x) for x in c) for k, c in bins.items())
        top = max(linear, default=-1) + 1
        full, last = [], 0
        for w in range(top):
            last = linear.get(w, last)
            full.append(last)
        bai += struct.pack("<i", top) + struct.pack(f"<{top}Q", *full)
    return out, [(f"read{i}", names[r][0], p, m) for i, (r, p, m) in enumerate(rows)], bai


def test_splits_give_every_record_once():
    import tempfile

    for n, size, split in ((0, 900, 500), (1, 900, 50), (400, 700, 999), (400, 65_000, 3000), (300, 100, 4000)):
        out, rows, _ = made(n, size)
        with tempfile.NamedTemporaryFile(suffix=".bam") as f:
            f.write(out)
            f.flush()
            got = [r for a in range(0, len(out), split) for r in bam.split_records(f.name, a, min(len(out), a + split), None)]
        assert [(r[1], r[3], r[4], bam.aligned_length(r[6])) for r in got] == rows
        assert all(x[0] < y[0] for x, y in zip(got, got[1:], strict=False))


def test_regions_and_index(spark, tmp_path):
    out, rows, bai = made(2000, 3000)
    p = tmp_path / "x.bam"
    p.write_bytes(out)
    spark.dataSource.register(bam.BamSource)
    read = spark.read.format("strandline_bam")
    whole = read.option("splitBytes", 20_000).load(str(p))
    assert sorted((r.qname, r.pos0) for r in whole.select("qname", "pos0").collect()) == sorted((q, x) for q, _, x, _ in rows)
    want = sorted(q for q, c, x, m in rows if c == "c2" and x < 430_000 and x + m > 400_000)
    region = lambda: spark.read.format("strandline_bam").option("contig", "c2").option("start", 400_000).option("end", 430_000).option("splitBytes", 20_000).load(str(p))
    plain = sorted(r.qname for r in region().collect())
    (tmp_path / "x.bam.bai").write_bytes(bai)
    assert plain == want == sorted(r.qname for r in region().collect()) and len(want) > 20
    assert spark.read.format("strandline_bam").option("contig", "none").load(str(p)).count() == 0
    stats = bam.index_statistics(spark.read.format("binaryFile").load(str(tmp_path / "x.bam.bai"))).orderBy("ord").collect()
    assert [(r.mapped, r.unmapped) for r in stats] == [(sum(c == "c1" for _, c, _, _ in rows), 0), (sum(c == "c2" for _, c, _, _ in rows), 1)]
