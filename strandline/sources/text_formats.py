"""Readers of text formats as DataFrames: SAM, VCF, masks, genes, disorders, bands, GTF, FASTQ, logs.

All are plain Spark text scans with expressions, splittable and pruned; no reader collects a file. ``ord`` columns keep
the order in a file where results depend on it; they rise with the file order but are not consecutive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.alignments import breakend, operations, reference_length


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(ord, value) of a text file, compressed or not."""
    return spark.read.text(path).withColumn("ord", F.monotonically_increasing_id())


def _f(k: int) -> Column:
    return F.get(F.col("f"), F.lit(k))


def first_entries(entries: Column) -> Column:
    """Map of (key, value) entries; of a key that repeats, the first value counts."""
    keys = F.transform(entries, lambda e: e["key"])
    return F.map_from_entries(F.filter(entries, lambda e, i: F.array_position(keys, e["key"]) == i + 1))


def _rest(f: Column, first: int) -> Column:
    """The elements of an array from a place (counted from 1) to its end."""
    return F.slice(f, F.lit(first), F.greatest(F.size(f) - (first - 1), F.lit(0)))


def sam(spark: SparkSession, path: str) -> DataFrame:
    """Aligned records of a SAM text: positions 0-based, end0 exclusive by the CIGAR, tags as a map of name to value."""
    rows = lines(spark, path).where(~F.col("value").startswith("@")).withColumn("f", F.split("value", "\t")).where(F.size("f") >= 11)
    tags = first_entries(F.transform(_rest(F.col("f"), 12), lambda t: F.struct(F.substring(t, 1, 2).alias("key"), F.substring(t, F.lit(6), F.char_length(t)).alias("value"))))
    pos0 = _f(3).cast("long") - 1
    out = rows.select(
        F.col("ord").alias("file_ord"),
        _f(0).alias("qname"),
        _f(1).cast("int").alias("flag"),
        _f(2).alias("contig"),
        pos0.alias("pos0"),
        _f(4).cast("int").alias("mapq"),
        _f(5).alias("cigar"),
        F.when(_f(6) == "=", _f(2)).when(_f(6) != "*", _f(6)).alias("mate_contig"),
        (_f(7).cast("long") - 1).alias("mate_pos0"),
        _f(8).cast("long").alias("tlen"),
        _f(9).alias("seq"),
        _f(10).alias("qual"),
        tags.alias("tags"),
    )
    return out.withColumn("end0", F.col("pos0") + reference_length(operations(F.col("cigar"))))


def sam_contigs(spark: SparkSession, path: str) -> DataFrame:
    """(name, length, ord, has_ah) of a SAM header's reference sequences."""
    head = lines(spark, path).where(F.col("value").startswith("@SQ"))
    pick = lambda tag: F.regexp_extract("value", rf"\t{tag}:([^\t]*)", 1)
    return head.select(pick("SN").alias("name"), pick("LN").cast("long").alias("length"), "ord", F.col("value").contains("\tAH:").alias("has_ah"))


def vcf(spark: SparkSession, path: str) -> DataFrame:
    """Records of a VCF text: ord, chrom, pos, id, ref, alt, filter, info (map; flags have the value ``true``; a value
    begins after the first ``=``, and of keys that repeat the first counts)."""
    rows = lines(spark, path).where(~F.col("value").startswith("#")).withColumn("f", F.split("value", "\t")).where(F.size("f") >= 8)
    halves = F.transform(F.filter(F.split(_f(7), ";"), lambda x: (x != "") & (x != ".")), lambda x: F.split(x, "=", 2))
    entries = F.transform(halves, lambda h: F.struct(h[0].alias("key"), F.coalesce(F.get(h, F.lit(1)), F.lit("true")).alias("value")))
    return rows.select("ord", _f(0).alias("chrom"), _f(1).cast("long").alias("pos"), F.when(_f(2) != ".", _f(2)).alias("id"), _f(3).alias("ref"), _f(4).alias("alt"), _f(6).alias("filter"), first_entries(entries).alias("info"))


def declared_info(spark: SparkSession, path: str) -> DataFrame:
    """INFO keys that a VCF header declares; others are read as null."""
    return lines(spark, path).where(F.col("value").startswith("##INFO")).select(F.regexp_extract("value", r"ID=([^,>]+)", 1).alias("key"))


def convention(records: DataFrame, first: int | None = None) -> DataFrame:
    """One row: how breakends name their partner (chr2_pos2, mateid or undetermined) with the counts that say so.

    ``first`` bounds the look to the first records, as a caller that stops early would; by default all are looked at.
    """
    own = records.orderBy("ord").limit(first) if first else records
    bnd = own.where(F.element_at("info", F.lit("SVTYPE")) == "BND")
    has = lambda k: F.map_contains_key("info", k)
    g = bnd.agg(F.count("*").alias("breakends"), F.count_if(has("CHR2") & has("POS2")).alias("with_chr2_pos2"), F.count_if(has("MATEID")).alias("with_mateid"))
    kind = F.when(F.col("breakends") == 0, "undetermined").when(F.col("with_chr2_pos2") > 0, "chr2_pos2").when(F.col("with_mateid") > 0, "mateid").otherwise("unknown_breakend_convention")
    return g.withColumn("convention", kind)


def junction_rows(records: DataFrame) -> DataFrame:
    """Junctions of VCF records, one for each record: partner from CHR2/POS2, else from the ALT, else END on the chromosome.

    Supports are null where absent. Mates of one junction are still two rows; ``operators.callsets.mate_pairs`` joins them.
    """
    info = lambda k: F.element_at("info", F.lit(k))
    alt = breakend(F.col("alt"))
    return records.select(
        "ord",
        F.col("id").alias("caller_id"),
        F.col("chrom").alias("chrom1"),
        F.col("pos").alias("pos1"),
        F.coalesce(info("CHR2"), alt["chrom"], F.col("chrom")).alias("chrom2"),
        F.coalesce(info("POS2").try_cast("long"), alt["pos"], info("END").try_cast("long"), F.col("pos")).alias("pos2"),
        F.coalesce(info("CT"), alt["orientation"]).alias("orientation"),
        info("SVTYPE").alias("svtype"),
        F.col("filter"),
        info("PE").try_cast("long").alias("pe"),
        info("SR").try_cast("long").alias("sr"),
        F.when(F.map_contains_key("info", "PRECISE"), True).when(F.map_contains_key("info", "IMPRECISE"), False).alias("precise"),
        info("MATEID").alias("mate_id"),
    )


def mask(spark: SparkSession, path: str) -> DataFrame:
    """(contig, start, end, is_whole, label): lines of one field name whole contigs, of three or more half-open intervals."""
    f = lines(spark, path).where(~F.col("value").startswith("#") & (F.trim("value") != "")).withColumn("f", F.split(F.trim("value"), r"\s+"))
    return f.select(_f(0).alias("contig"), _f(1).try_cast("long").alias("start"), _f(2).try_cast("long").alias("end"), (F.size("f") < 3).alias("is_whole"), _f(3).alias("label"))


def genes(spark: SparkSession, path: str) -> DataFrame:
    """Genes of a tab-separated table (chrom, start, end, strand, name, gene_id, type, transcript_id, exon starts, exon ends)."""
    f = lines(spark, path).where(~F.col("value").startswith("#")).withColumn("f", F.split("value", "\t")).where(F.size("f") >= 7)
    numbers = lambda k: F.transform(F.filter(F.split(F.coalesce(_f(k), F.lit("")), ","), lambda x: x != ""), lambda x: x.cast("long"))
    return f.select("ord", _f(0).alias("chrom"), _f(1).cast("long").alias("start"), _f(2).cast("long").alias("end"), _f(3).alias("strand"), _f(4).alias("name"), _f(5).alias("gene_id"), _f(6).alias("type"), _f(7).alias("transcript_id"), F.arrays_zip(numbers(8).alias("s"), numbers(9).alias("e")).alias("exons"))


def mim_genes(spark: SparkSession, path: str) -> DataFrame:
    """(symbol, mim) of entries of type gene or gene/phenotype; a symbol's last row counts."""
    f = lines(spark, path).where(~F.col("value").startswith("#")).withColumn("f", F.split("value", "\t"))
    own = f.where(_f(1).isin("gene", "gene/phenotype") & (F.coalesce(_f(3), F.lit("")) != ""))
    return own.groupBy(_f(3).alias("symbol")).agg(F.max_by(F.struct(_f(0).try_cast("int").alias("mim"), (_f(1) == "gene/phenotype").alias("phenotype")), "ord").alias("m")).select("symbol", "m.mim", "m.phenotype")


def disorders(spark: SparkSession, path: str) -> DataFrame:
    """(symbol, diseases): sorted OMIM and ORPHA ids by gene symbol, from rows gene id, symbol, association, disease id."""
    f = lines(spark, path).where(~F.col("value").startswith("#")).withColumn("f", F.split("value", "\t"))
    own = f.where(F.coalesce(_f(3), F.lit("")).rlike("^(?:OMIM|ORPHA):"))
    return own.groupBy(_f(1).alias("symbol")).agg(F.array_sort(F.collect_set(_f(3))).alias("diseases"))


def cytobands(spark: SparkSession, path: str) -> DataFrame:
    """(contig, start0, end, band, stain)."""
    f = lines(spark, path).where(~F.col("value").startswith("#")).withColumn("f", F.split("value", "\t")).where(F.size("f") >= 5)
    return f.select(_f(0).alias("contig"), _f(1).cast("long").alias("start0"), _f(2).cast("long").alias("end"), _f(3).alias("band"), _f(4).alias("stain"))


def gtf(spark: SparkSession, path: str) -> DataFrame:
    """Features of a GTF: chrom, feature, start, end, strand, attributes (map, last value of a name) and tags (array)."""
    f = lines(spark, path).where(~F.col("value").startswith("#")).withColumn("f", F.split("value", "\t")).where(F.size("f") >= 9)
    names = F.regexp_extract_all(_f(8), F.lit(r'(\S+) "([^"]*)"'), F.lit(1))
    values = F.regexp_extract_all(_f(8), F.lit(r'(\S+) "([^"]*)"'), F.lit(2))
    pairs = F.zip_with(names, values, lambda k, v: F.struct(k.alias("key"), v.alias("value")))
    tags = F.transform(F.filter(pairs, lambda p: p["key"] == "tag"), lambda p: p["value"])
    plain = F.filter(pairs, lambda p: p["key"] != "tag")
    attributes = F.map_from_entries(F.transform(F.array_distinct(F.transform(plain, lambda p: p["key"])), lambda k: F.struct(k, F.element_at(F.filter(plain, lambda p: p["key"] == k), -1)["value"])))
    return f.select("ord", _f(0).alias("chrom"), _f(2).alias("feature"), _f(3).cast("long").alias("start"), _f(4).cast("long").alias("end"), _f(6).alias("strand"), attributes.alias("attributes"), tags.alias("tags"))


def fastq(spark: SparkSession, path: str) -> DataFrame:
    """(name, seq, qual): records of four lines, whatever their lines begin with; a last record that is cut short is left out.

    Lines are numbered within their file without one task reading all: a line's place in its split, plus the lines of the
    file's earlier splits, of which there is one row each.
    """
    rows = spark.read.text(path).select("value", "_metadata.file_path", F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("ord"))
    splits = rows.groupBy("file_path", "block").agg(F.min("ord").alias("first"), F.count("*").alias("n"))
    before = Window.partitionBy("file_path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.withColumn("skip", F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).select("file_path", "block", "skip")
    line = F.col("ord") + F.col("skip")
    placed = rows.join(splits, ["file_path", "block"]).select("file_path", F.floor(line / 4).alias("record"), (line % 4).alias("k"), "value")
    part = lambda k: F.max(F.when(F.col("k") == k, F.col("value"))).alias(f"l{k}")
    whole = placed.groupBy("file_path", "record").agg(*[part(k) for k in range(4)]).where("l3 is not null")
    name = F.get(F.split(F.substring(F.col("l0"), F.lit(2), F.char_length("l0")), r"\s"), F.lit(0))
    return whole.select(F.regexp_replace(name, r"/[12]$", "").alias("name"), F.col("l1").alias("seq"), F.col("l3").alias("qual"))


def fasta(spark: SparkSession, path: str, tile: int = 65_536) -> DataFrame:
    """(contig, tile, seq): a FASTA as tiles of fixed size, so that a region is a look-up in one or two tiles.

    Lines keep their place by the bases before them, counted as for FASTQ; a line is cut where a tile ends. A line belongs to
    the last header before it: that of its own split, or else the last of the splits before, of which there is a row each. A
    name that stands in two files, or twice in one, is counted apart, so its tiles come twice.
    """
    rows = spark.read.text(path).select("value", "_metadata.file_path", F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("ord"))
    name = F.get(F.split(F.substring(F.col("value"), F.lit(2), F.char_length("value")), r"\s"), F.lit(0))
    rows = rows.withColumn("head", F.when(F.col("value").startswith(">"), F.struct("ord", name.alias("contig"))))
    # Splits of a file in order: what the earlier ones end with.
    splits = rows.groupBy("file_path", "block").agg(F.max("head").alias("m"))
    earlier = Window.partitionBy("file_path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.select(F.col("file_path").alias("f"), F.col("block").alias("b"), F.last("m", True).over(earlier).alias("carried"))
    so_far = Window.partitionBy("file_path", "block").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    own = rows.withColumn("here", F.last("head", True).over(so_far)).where(F.col("head").isNull() & (F.trim("value") != ""))
    own = own.join(splits, (F.col("file_path") == F.col("f")) & (F.col("block") == F.col("b"))).withColumn("h", F.coalesce("here", "carried")).where("h is not null")
    own = own.select("file_path", F.col("h.ord").alias("entry"), F.col("h.contig").alias("contig"), "block", "ord", F.trim("value").alias("v"))
    key = ["file_path", "entry"]
    sums = own.groupBy(*key, "block").agg(F.sum(F.char_length("v")).alias("bases"))
    before = Window.partitionBy(*key).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("skip", F.coalesce(F.sum("bases").over(before), F.lit(0)))
    inside = Window.partitionBy(*key, "block").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    placed = own.join(sums.select(*key, "block", "skip"), [*key, "block"]).withColumn("at", F.col("skip") + F.coalesce(F.sum(F.char_length("v")).over(inside), F.lit(0)))
    last = F.col("at") + F.char_length("v") - 1
    pieces = placed.withColumn("tile", F.explode(F.sequence(F.floor(F.col("at") / tile), F.floor(last / tile))))
    start = F.greatest(F.lit(0), F.col("tile") * tile - F.col("at"))
    stop = F.least(F.char_length("v").cast("long"), (F.col("tile") + 1) * tile - F.col("at"))
    cut = pieces.select(*key, "contig", "tile", (F.col("at") + start).alias("at"), F.substring(F.col("v"), (start + 1).cast("int"), (stop - start).cast("int")).alias("v"))
    tiles = cut.groupBy(*key, "contig", "tile").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "v"))), lambda x: x["v"]), "").alias("seq"))
    return tiles.select("contig", "tile", "seq")


def sequences(tiles: DataFrame, regions: DataFrame, tile: int = 65_536) -> DataFrame:
    """``regions`` (contig, start, end; half-open, 0-based) with their bases, seq; null where the contig is unknown."""
    x = regions.withColumn("__id", F.monotonically_increasing_id())
    parts = x.select("__id", F.col("contig").alias("c"), "start", "end", F.explode(F.sequence(F.floor(F.col("start") / tile), F.floor((F.col("end") - 1) / tile))).alias("t"))
    hit = parts.join(tiles.select(F.col("contig").alias("c"), F.col("tile").alias("t"), "seq"), ["c", "t"])
    first = F.greatest(F.lit(0), F.col("start") - F.col("t") * tile)
    stop = F.least(F.lit(tile).cast("long"), F.col("end") - F.col("t") * tile)
    cut = hit.select("__id", "t", F.substring(F.col("seq"), (first + 1).cast("int"), (stop - first).cast("int")).alias("v"))
    joined = cut.groupBy("__id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("t", "v"))), lambda p: p["v"]), "").alias("seq"))
    return x.join(joined, "__id", "left").drop("__id")


def phases(spark: SparkSession, path: str) -> DataFrame:
    """(ord, at, phase) of a log whose lines begin with [YYYY-Mon-DD HH:MM:SS]."""
    rows = lines(spark, path).where(F.col("value").rlike(r"^\[\d{4}-[A-Z][a-z]{2}-\d{2} \d{2}:\d{2}:\d{2}\]"))
    return rows.select("ord", F.to_timestamp(F.substring("value", 2, 20), "yyyy-MMM-dd HH:mm:ss").alias("at"), F.trim(F.substring(F.col("value"), F.lit(24), F.char_length("value"))).alias("phase"))


def log_figures(spark: SparkSession, path: str) -> DataFrame:
    """(phase, began, seconds) of a log's phases, each as long as until the next one, within a file; the last has null."""
    rows = phases(spark, path)
    own = rows.withColumn("file", F.input_file_name()) if "file" not in rows.columns else rows
    nxt = F.lead("at").over(Window.partitionBy("file").orderBy("ord"))
    return own.select("phase", F.col("at").alias("began"), (F.unix_timestamp(nxt) - F.unix_timestamp("at")).alias("seconds"))


def resource_use(spark: SparkSession, path: str) -> DataFrame:
    """(file, wall_seconds, max_rss_kb) that the time program adds to a log: ``Elapsed ...: [h:]m:s`` and the resident set."""
    rows = lines(spark, path).select(F.input_file_name().alias("file"), F.regexp_replace("value", r"^\s+|\s+$", "").alias("v"))
    clock = F.regexp_extract("v", r"^Elapsed \(wall clock\) time.*: ([0-9:.]+)$", 1)
    fields = F.reverse(F.split(clock, ":"))
    seconds = F.when(clock != "", F.aggregate(F.transform(fields, lambda x, i: x.try_cast("double") * F.pow(F.lit(60.0), i)), F.lit(0.0), lambda s, x: s + x))
    rss = F.regexp_extract("v", r"^Maximum resident set size \(kbytes\): (\d+)$", 1).try_cast("long")
    return rows.groupBy("file").agg(F.max(seconds).alias("wall_seconds"), F.max(rss).alias("max_rss_kb")).where("wall_seconds is not null or max_rss_kb is not null")


def header_records(spark: SparkSession, path: str) -> DataFrame:
    """(kind, ord, fields) of a SAM header's lines: SQ, RG, PG, HD with their fields as a map (a tag's first value counts)."""
    head = lines(spark, path).where(F.col("value").rlike(r"^@(HD|SQ|RG|PG)\t")).withColumn("f", F.split("value", "\t"))
    entries = F.transform(F.filter(_rest(F.col("f"), 2), lambda t: t.rlike("^[A-Za-z][A-Za-z0-9]:")), lambda t: F.struct(F.substring(t, 1, 2).alias("key"), F.substring(t, F.lit(4), F.char_length(t)).alias("value")))
    return head.select(F.substring("value", 2, 2).alias("kind"), "ord", first_entries(entries).alias("fields"))


def json_records(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """JSON documents, one for each file, compressed or not."""
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema else reader).json(path)
