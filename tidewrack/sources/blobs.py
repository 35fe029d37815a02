"""Blobs: files as rows of (blob_id, path, length, content), whole or in chunks, and archives built for fixtures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

MIB = 1024 * 1024
CHUNK_MB = 512


def read_blobs(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """The files below path as blobs; blob_id is a hash of the path."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.load(path).select(F.xxhash64("path").alias("blob_id"), "path", "length", "content")


def in_range(blobs: DataFrame, start: int, end: int) -> DataFrame:
    """Only the bytes from start to end of each blob, with base_offset added."""
    if end <= start:
        raise ValueError("the range's end must lie behind its start")
    part = F.expr(f"substring(content, {start} + 1, {min(end - start, 2**31 - 1)})")
    return blobs.withColumn("content", part).withColumn("base_offset", F.lit(start).cast("long"))


def chunks(blobs: DataFrame, chunk_mb: float = CHUNK_MB) -> DataFrame:
    """(blob_id, chunk_no, base_offset, content): blobs cut every chunk_mb. Nothing is carried over a cut."""
    size = int(chunk_mb * MIB)
    n = F.greatest(F.ceil(F.length("content") / size), F.lit(1)).cast("int")
    cut = blobs.select("blob_id", "content", F.explode(F.sequence(F.lit(0), n - 1)).alias("chunk_no"))
    return cut.select("blob_id", "chunk_no", (F.col("chunk_no") * size).cast("long").alias("base_offset"), F.expr(f"substring(content, chunk_no * {size} + 1, {size})").alias("content"))


def input_format(path: Column | str, by_name: bool = True) -> Column:
    """gzip for paths that end in gz, else zip."""
    c = F.col(path) if isinstance(path, str) else path
    return F.when(F.lower(c).endswith("gz"), "gzip").otherwise("zip") if by_name else F.lit("zip")


# ---- archives from tables


def le_hex(n: Column, size: int) -> Column:
    """A number as hex of size bytes, least significant first."""
    h = F.lpad(F.hex(n.cast("long")), 2 * size, "0")
    return F.concat(*(F.substring(h, 2 * i + 1, 2) for i in reversed(range(size))))


def stored_zip(members: DataFrame, archive: str = "archive_id", name: str = "name", body: str = "body", order: str = "ord", original: str | None = None) -> DataFrame:
    """(blob_id, content): one ZIP archive of stored members for each archive_id, members in order.

    With original, body holds the deflated member and original what it was. An archive's members are brought together, as they have to lie in one blob.
    """
    n, size = F.hex(F.encode(F.col(name), "UTF-8")), F.length(body)
    name_length = F.length(F.encode(F.col(name), "UTF-8"))
    whole = F.col(original or body)
    method = F.lit("0800" if original else "0000")
    common = F.concat(F.lit("14000000"), method, F.lit("00002100"), le_hex(F.crc32(whole), 4), le_hex(size, 4), le_hex(F.length(whole), 4), le_hex(name_length, 2), F.lit("0000"))
    local = F.concat(F.lit("504B0304"), common, n, F.hex(body))
    before = Window.partitionBy("blob_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    rows = members.select(F.col(archive).alias("blob_id"), F.col(order).alias("ord"), local.alias("local"), common.alias("common"), n.alias("n"))
    rows = rows.withColumn("at", F.coalesce(F.sum(F.shiftright(F.length("local"), 1)).over(before), F.lit(0)))
    entry = F.concat(F.lit("504B01021400"), "common", F.lit("00000000000000000000"), le_hex(F.col("at"), 4), "n")
    listed = rows.select("blob_id", F.struct("ord", "local", entry.alias("entry")).alias("r")).groupBy("blob_id").agg(F.array_sort(F.collect_list("r")).alias("m"))
    built = listed.select("blob_id", F.size("m").alias("count"), F.array_join(F.col("m.local"), "").alias("l"), F.array_join(F.col("m.entry"), "").alias("c"))
    half = lambda c: F.shiftright(F.length(c), 1)
    end = F.concat(F.lit("504B050600000000"), le_hex(F.col("count"), 2), le_hex(F.col("count"), 2), le_hex(half("c"), 4), le_hex(half("l"), 4), F.lit("0000"))
    return built.select("blob_id", F.unhex(F.concat("l", "c", end)).alias("content"))
