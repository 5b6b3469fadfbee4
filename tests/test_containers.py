"""Texts inside files, terms to mask, and reads of many kinds at the ends of one chromosome."""

from __future__ import annotations

import gzip
import io
import struct
import zipfile
import zlib

from pyspark.sql import functions as F

from strandline.operators import junctions as J
from strandline.sources import containers


def chunk(kind, body):
    return struct.pack(">I", len(body)) + kind + body + b"\0\0\0\0"


def test_container_texts(spark, tmp_path):
    z = io.BytesIO()
    with zipfile.ZipFile(z, "w") as f:
        f.writestr("word/document.xml", "<a>ż</a>")
        f.writestr("image.bin", b"\1\2")
    image = containers.PNG + chunk(b"IDAT", b"a@b.c") + chunk(b"tEXt", b"k\0caf\xe9") + chunk(b"zTXt", b"k\0\0" + zlib.compress(b"packed")) + chunk(b"iTXt", b"k\0\1\0en\0k\0" + zlib.compress("ż".encode())) + chunk(b"zTXt", b"broken")
    files = {"a.docx": z.getvalue(), "b.gz": gzip.compress(b"inside"), "c.png": image, "d.bin": b"x\0y", "e.txt": "ąż\n".encode(), "f.txt": b"caf\xe9", "g.gz": b"\x1f\x8bbroken", "h.docx": b"PK broken", "i.txt": b""}
    for n, b in files.items():
        (tmp_path / n).write_bytes(b)
    got = {(r.path.rsplit("/", 1)[1], r.part, r.text) for r in containers.container_texts(spark, str(tmp_path)).collect()}
    assert got == {
        ("a.docx", "word/document.xml", "<a>ż</a>"), ("b.gz", "gunzip", "inside"), ("c.png", "tEXt", "k\0café"), ("c.png", "zTXt", "packed"), ("c.png", "zTXt", None), ("c.png", "iTXt", "ż"),
        ("d.bin", "", None), ("e.txt", "", "ąż\n"), ("f.txt", "", "café"), ("g.gz", "gunzip", None), ("h.docx", "", None),
    }


def test_term_list(spark, tmp_path):
    p = tmp_path / "terms"
    p.write_text("# note\nname one\tPERSON\nplain\n\n \t\nx\t\n")
    assert sorted(tuple(r) for r in containers.term_list(spark, str(p)).collect()) == [("name one", "PERSON"), ("plain", "REDACTED"), ("x", "REDACTED")]


def test_kinds_within_one_chromosome(spark):
    a, b = 10_000, 10_900
    schema = "file_ord bigint, qname string, flag int, contig string, pos0 bigint, mapq int, cigar string, mate_contig string, mate_pos0 bigint, tags map<string,string>"
    rows = [
        ("proper", 0x3 | 0x20, a - 200, 60, "100M", "chr1", b + 50, {}),
        ("joins", 0x1 | 0x20, a - 150, 60, "100M", "chr1", b + 60, {}),
        ("joins", 0x1 | 0x10, b + 60, 60, "100M", "chr1", a - 150, {}),
        ("same", 0x1, a - 100, 60, "100M", "chr1", a - 6000, {}),
        ("out", 0x1 | 0x10, a - 90, 60, "100M", "chr1", a + 6000, {}),
        ("wide", 0x1 | 0x20, a - 80, 60, "100M", "chr1", a + 6000, {}),
        ("alone", 0x1 | 0x8, a - 70, 60, "100M", None, None, {}),
        ("alt", 0x1 | 0x20, a - 60, 60, "100M", "chr1_KI1_random", 5, {}),
        ("other", 0x1 | 0x20, a - 50, 60, "100M", "chr9", 5, {}),
        ("away", 0x0, a - 40, 60, "60M40S", None, None, {"SA": "chr5,77,+,60S40M,60,0;"}),
        ("split", 0x0, a - 60, 60, "60M40S", None, None, {"SA": f"chr1,{b + 1},+,60S40M,60,0;"}),
        ("cut", 0x0, a - 30, 60, "80M20S", None, None, {}),
        ("vague", 0x0, a - 20, 3, "100M", None, None, {}),
        ("normal", 0x3 | 0x20, a - 10, 60, "100M", "chr1", a + 200, {}),
        ("twin", 0x403, a - 10, 60, "100M", "chr1", a + 200, {}),
    ]
    d = spark.createDataFrame([(i, n, f, "chr1", p, q, c, m, mp, t) for i, (n, f, p, q, c, m, mp, t) in enumerate(rows)], schema).withColumn("end0", F.col("pos0") + F.regexp_extract("cigar", r"^(\d+)M", 1).cast("long"))
    j = spark.createDataFrame([(1, "chr1", a, "chr1", b)], "id bigint, ca string, pa bigint, cb string, pb bigint")
    x = J.review(d, j, 400).cache()
    at_a = {r.qname: (r.kind, r.is_pair, r.is_split) for r in x.where("end = 'A'").collect()}
    # Both ends lie within two windows, so the far mate of a read is looked for only near the partner.
    assert at_a == {
        "proper": (None, False, False), "joins": ("pair_partner", True, False), "same": ("pair_orientation", False, False), "out": ("pair_orientation", False, False), "wide": ("pair_insert_size", False, False),
        "alone": ("mate_unmapped", False, False), "alt": ("pair_alt_contig", False, False), "other": ("pair_other_chrom", False, False), "away": ("split_other", False, False),
        "split": ("split_partner", False, True), "cut": ("clipped", False, False), "vague": ("ambiguous", False, False), "normal": (None, False, False),
    }
    assert {r.orientation: (r.pairs, r.splits, r.fragments) for r in J.support(x).collect()} == {"3to5": (1, 1, 2)}
    c = {r.end: r for r in J.end_counts(x).collect()}["A"]
    assert (c.primary_reads, c.low_mapq_reads, c.normal_reads, c.by_kind["pair_orientation"]) == (13, 1, 2, 2)
