"""Sinks: tagged records as SAM text, tables with provenance, records that never overwrite, FASTQ, cases, call logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def tagged(reads: DataFrame, colour: Column, label: Column) -> DataFrame:
    """Records with the tags YC (colour as ``r,g,b``) and XG (label) set, whatever they had of these; null sets no tag."""
    kept = F.map_filter(F.coalesce("tags", F.create_map().cast("map<string,string>")), lambda k, _: ~k.isin("YC", "XG"))
    own = F.map_filter(F.create_map(F.lit("YC"), colour, F.lit("XG"), label), lambda _, v: v.isNotNull())
    return reads.withColumn("tags", F.map_concat(kept, own))


def sam_lines(reads: DataFrame) -> DataFrame:
    """(contig, pos0, file_ord, value): records as lines of SAM, the counterpart of ``text_formats.sam``; tags sorted by name."""
    text = lambda c: F.coalesce(F.col(c), F.lit("*"))
    number = lambda c, d: F.coalesce(F.col(c), F.lit(d)).cast("string")
    mate = F.when(F.col("mate_contig").isNull(), "*").when(F.col("mate_contig") == F.col("contig"), "=").otherwise(F.col("mate_contig"))
    whole = F.lit(r"^[+-]?\d+$")
    tags = F.transform(F.array_sort(F.map_entries(F.coalesce("tags", F.create_map().cast("map<string,string>")))), lambda e: F.concat(e["key"], F.when(F.regexp_like(e["value"], whole), ":i:").otherwise(":Z:"), e["value"]))
    line = F.concat_ws(
        "\t", text("qname"), number("flag", 0), text("contig"), (F.coalesce("pos0", F.lit(-1)) + 1).cast("string"), number("mapq", 0), text("cigar"), mate,
        (F.coalesce("mate_pos0", F.lit(-1)) + 1).cast("string"), number("tlen", 0), text("seq"), text("qual"), tags,
    )
    return reads.select("contig", "pos0", "file_ord", line.alias("value"))


def write_sam(reads: DataFrame, contigs: DataFrame, path: str) -> None:
    """A sorted SAM text in parts under ``path``, whose first part is the header (contigs: name, length, ord): lines sorted by
    the contig's place and position over range partitions, so parts in order are the whole file."""
    head = contigs.select(F.lit(-1).alias("a"), F.col("ord").cast("long").alias("b"), F.lit(0).cast("long").alias("c"), F.concat(F.lit("@SQ\tSN:"), "name", F.lit("\tLN:"), F.col("length").cast("string")).alias("value"))
    order = contigs.select(F.col("name").alias("contig"), F.col("ord").alias("place"))
    body = sam_lines(reads).join(F.broadcast(order), "contig", "left").select(F.coalesce("place", F.lit(2**30)).cast("int").alias("a"), F.col("pos0").alias("b"), F.col("file_ord").alias("c"), "value")
    head.unionByName(body).repartitionByRange("a", "b", "c").sortWithinPartitions("a", "b", "c").select("value").write.text(path)


def region_slice(reads: DataFrame, regions: DataFrame, around: int = 10_000) -> DataFrame:
    """Records that overlap a region (contig, pos) widened by ``around`` bases, each once however many regions it meets."""
    from ..joins import interval_join

    r = regions.select(F.col("contig").alias("r_contig"), F.greatest(F.lit(0), F.col("pos") - around).alias("r_start"), (F.col("pos") + around).alias("r_end"))
    keys = interval_join(reads.select("file_ord", "contig", "pos0", "end0"), r, [("contig", "r_contig")], (F.col("pos0"), F.col("end0")), (F.col("r_start"), F.col("r_end")), max(2 * around, 256))
    return reads.join(keys.select("file_ord").distinct(), "file_ord", "left_semi")


def write_table(df: DataFrame, path: str, source: str | None = None) -> None:
    """Tab-separated, gzip-compressed parts with a header line; with ``source``, a file that it was made from, its name,
    length and sha256 go to ``path``.provenance as JSON."""
    df.write.option("sep", "\t").option("header", True).option("compression", "gzip").csv(path)
    if source:
        made = df.sparkSession.read.format("binaryFile").load(source)
        made.select(F.element_at(F.split("path", "/"), -1).alias("name"), "length", F.sha2("content", 256).alias("sha256")).write.json(f"{path}.provenance")


def write_record(df: DataFrame, path: str) -> None:
    """JSON records under a path that must not exist yet: a record is written whole (Spark's commit) or not at all."""
    df.write.mode("errorifexists").json(path)


def fastq_lines(reads: DataFrame, mate: Column | None = None) -> DataFrame:
    """(value) of four lines a record from name, seq, qual; ``mate`` adds /1 or /2 to names. A null quality is all I."""
    name = F.concat(F.lit("@"), "name", F.concat(F.lit("/"), mate.cast("string")) if mate is not None else F.lit(""))
    return reads.select(F.concat_ws("\n", name, "seq", F.lit("+"), F.coalesce("qual", F.repeat(F.lit("I"), F.char_length("seq")))).alias("value"))


def write_fastq(reads: DataFrame, path: str, mate: Column | None = None) -> None:
    fastq_lines(reads, mate).write.text(path)


def save_cases(cases: DataFrame, path: str) -> None:
    """Cases (any columns, nested ones included) as one JSON object a line, nulls kept."""
    cases.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value")).write.mode("errorifexists").text(path)


def load_cases(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """What ``save_cases`` wrote; fields that a case lacks are null."""
    return spark.read.text(path).select(F.from_json("value", schema).alias("c")).select("c.*")


def append_calls(calls: DataFrame, path: str) -> None:
    """Adds calls (id, tool, parameters, result as JSON, at) to a log of Parquet files, foldered by tool."""
    calls.write.mode("append").partitionBy("tool").parquet(path)


def call(spark: SparkSession, path: str, ids: DataFrame) -> DataFrame:
    """The logged calls of some ids (id), the last one where an id was logged again."""
    own = spark.read.parquet(path).join(ids.select("id").distinct(), "id", "left_semi")
    rest = [c for c in own.columns if c != "id"]
    return own.groupBy("id").agg(F.max_by(F.struct(*rest), "at").alias("c")).select("id", "c.*")
