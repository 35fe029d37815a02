"""From signatures to spans: neighbour rules, archives, and what to decode.

All rules look at a signature and its neighbours within a blob, so they are one
window over (blob_id) by offset and one filter; nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KIB = 1024
#: kinds that a ZIP member's data can end at
ZIP_ENDS = ["LocalFileHeader", "CentralDirEntry", "CentralDirSignature", "EndOfCentralDir", "EndOfCentralDir64", "EndOfCentralDirLocator", "ExtraData", "DataDescriptor"]


def _by_blob():
    return Window.partitionBy("blob_id").orderBy("offset", "seq")


def filtered(signatures: DataFrame) -> DataFrame:
    """Without the signatures that their neighbours make implausible. A rule looks at the neighbour found before, kept or not."""
    w = _by_blob()
    kind, gap = F.col("sig_type"), F.col("_next_offset") - F.col("offset")
    follows, before = F.col("_next"), F.col("_prev")
    is_ = lambda *names: kind.isin(*names)
    some = follows.isNotNull()
    wrong = (
        F.when(is_("SplitArchiveIndicator", "SplitArchiveSingleSegment") & some & (gap != 4), True)
        .when(is_("BZIP2StreamHeader") & some & (follows != "BZIP2BlockHeader"), True)
        .when(is_("BZIP2BlockHeader") & some & (gap > 920 * KIB), True)
        .when(is_("DataDescriptor") & some & (gap > 32), True)
        .when(is_("LocalFileHeader") & some & (gap < 30), True)
        .when(is_("ZlibHeader") & some & (gap < 26), True)
        .when(is_("ALZipArchiveHeader") & some & ((follows != "ALZipFileHeader") | (gap > 16)), True)
        .when(is_("PNG_iTXt", "PNG_zTXt") & some & (follows != "PNGChunkEnd"), True)
        .when(is_("PNGChunkEnd") & (before.isNull() | ~before.isin("PNG_iTXt", "PNG_zTXt")), True)
        .when(is_("PDF_FlateEnd") & (before == "PDF_FlateEnd"), True)
        .when(
            is_("DeflateSyncMark") & before.isNotNull() & some,
            ((before == "DeflateSyncMark") & (F.col("offset") - F.col("_prev_offset") < 128 * KIB))
            | ((before == "LocalFileHeader") & (follows == "LocalFileHeader") & (F.col("_next_offset") - F.col("_prev_offset") < 2 * KIB * KIB))
            | ((before == "PDF_FlateHeader") & (follows == "PDF_FlateEnd")),
        )
        .otherwise(False)
    )
    seen = (
        signatures.withColumn("_next", F.lead("sig_type").over(w))
        .withColumn("_next_offset", F.lead("offset").over(w))
        .withColumn("_prev", F.lag("sig_type").over(w))
        .withColumn("_prev_offset", F.lag("offset").over(w))
    )
    return seen.where(~wrong).select(*signatures.columns)


def archives(signatures: DataFrame) -> DataFrame:
    """Adds archive_no: a new archive begins behind each end of a central directory, where a start marker is put in.

    An end that nothing follows starts no archive.
    """
    ends = F.col("sig_type").isin("EndOfCentralDir", "EndOfCentralDir64") & ~F.coalesce(F.lead("sig_type").over(_by_blob()), F.lit("")).isin("EndOfCentralDirLocator", "EndOfCentralDir")
    behind = F.coalesce(F.sum(F.when(F.col("_ends"), 1).otherwise(0)).over(_by_blob().rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    marked = signatures.withColumn("_ends", ends).withColumn("archive_no", behind.cast("int"))
    starts = marked.where("_ends").select(
        "blob_id",
        "seq",
        F.col("attrs")["record_end"].cast("long").alias("offset"),
        F.lit("zipStartOfFile").alias("sig_type"),
        F.col("attrs")["record_end"].cast("long").alias("header_end"),
        F.expr("map()").cast("map<string,string>").alias("attrs"),
        (F.col("archive_no") + 1).alias("archive_no"),
    )
    return marked.drop("_ends").unionByName(starts)


def spans(numbered: DataFrame) -> DataFrame:
    """The spans of archives(): blob_id, archive_no, span_no, kind, start, end, known_start, known_end, name_hint, orig_size, method.

    Neighbours decide, the one before first; runs of WavPack or BZIP2 records are
    one span; behind the first central directory entry, or the end, of an archive
    nothing is a span.
    """
    group = F.when(F.col("sig_type") == "WavPackRecordHeader", "wpk").when(F.col("sig_type").isin("BZIP2StreamHeader", "BZIP2BlockHeader", "BZIP2EndOfStream"), "bz2")
    w = Window.partitionBy("blob_id", "archive_no").orderBy("offset", "seq")
    up_to_before = w.rowsBetween(Window.unboundedPreceding, -1)
    s = numbered.withColumn("_group", group)
    # in a run only its first signature counts as the one before
    s = s.withColumn("_inner", F.coalesce(F.col("_group").isNotNull() & (F.lag("_group").over(w) == F.col("_group")) & (F.col("sig_type") != "BZIP2StreamHeader"), F.lit(False))).where("NOT _inner")
    for name, c in (("sig_type", "p_type"), ("offset", "p_offset"), ("header_end", "p_end"), ("attrs", "p_attrs")):
        s = s.withColumn(c, F.lag(name).over(w))
    stop = F.col("sig_type").isin("CentralDirEntry", "zipEOF")
    s = s.withColumn("_stopped", F.coalesce(F.max(stop).over(up_to_before), F.lit(False))).where("NOT _stopped")
    prev, curr = F.col("p_type"), F.col("sig_type")
    rule: Column = (
        F.when(prev == "LocalFileHeader", "R1")
        .when(prev.isNotNull() & (prev != "LocalFileHeader") & (curr == "LocalFileHeader"), "R2")
        .when(prev == "ZlibHeader", "R3")
        .when(prev == "gzipHeader", "R4")
        .when(prev == "PDF_FlateHeader", "R5")
        .when(prev == "ALZipFileHeader", "R6")
        .when(prev == "WavPackRecordHeader", "R7")
        .when(prev.isin("BZIP2StreamHeader", "BZIP2BlockHeader"), "R8")
        .when(prev == "RARFileHeader", "R9")
        .when(prev.isin("DeflateSyncMark", "RawDeflateStart"), "R10")
        .when(prev.isin("PNG_iTXt", "PNG_zTXt") & (curr == "PNGChunkEnd"), "R11")
        .when(prev.isNull() & (curr == "LocalFileHeader"), "R12")
        .when((curr == "PDF_FlateEnd") & (prev.isNull() | (prev != "PDF_FlateHeader")), "R13")
        .when(curr == "DataDescriptor", "R14")
        .when(curr == "CentralDirEntry", "R15")
        .when((curr == "zipEOF") & (prev == "LocalFileHeader"), "R16")
        .when(curr.isin("gzipEOF", "ZlibEOF"), "R17")
        .when(curr.isin("ALZipFileHeader", "ALZipEOF"), "R18")
        .when(curr == "RARFileHeader", "R19")
    )
    s = s.withColumn("rule", rule).where("rule IS NOT NULL")
    has = lambda *r: F.col("rule").isin(*r)
    kind = (
        F.when(has("R1", "R2", "R12", "R14", "R15", "R16"), "zip")
        .when(has("R3"), "zlib")
        .when(has("R4"), "gzip")
        .when(has("R17"), F.when(curr == "gzipEOF", "gzip").otherwise("zlib"))
        .when(has("R5", "R13"), "pdf")
        .when(has("R6", "R18"), "alzip")
        .when(has("R7"), "wpk")
        .when(has("R8"), "bz2")
        .when(has("R9", "R19"), "rar")
        .when(has("R10"), "raw")
        .otherwise("png")
    )
    known_start = F.when(has("R1", "R3", "R4", "R5", "R6", "R7", "R8", "R9", "R10", "R11", "R16"), True).when(has("R15"), prev.isNotNull() & (prev == "LocalFileHeader")).otherwise(False)
    known_end = (
        F.when(has("R1", "R2", "R12", "R14", "R15", "R16"), curr.isin(*ZIP_ENDS))
        .when(has("R3"), curr.isin("ZlibEOF", "ZlibHeader"))
        .when(has("R4"), curr == "gzipEOF")
        .when(has("R17"), curr == "gzipEOF")
        .when(has("R5"), curr == "PDF_FlateEnd")
        .when(has("R6", "R18"), curr.isin("ALZipFileHeader", "ALZipEOF"))
        .when(has("R11", "R13"), True)
        .when(prev == "RawDeflateStart", True)
        .otherwise(False)
    )
    start = F.coalesce("p_end", F.lit(0))
    # a zlib member ends with a checksum of 4 bytes, a chunk's stream too; a gzip member with 8
    tail = F.when((curr == "ZlibHeader") & has("R3"), 4).when(has("R4") & (curr == "gzipHeader"), 8).when(has("R11"), 4).otherwise(0)
    end = F.greatest(start, F.col("offset") - tail)
    # before a first header at the very start there is nothing to look for
    s = s.where(~(has("R2", "R12", "R13", "R14", "R15") & ~F.coalesce(known_start, F.lit(False)) & (end <= start)))
    return s.select(
        "blob_id",
        "archive_no",
        F.row_number().over(w).cast("int").alias("span_no"),
        "rule",
        kind.alias("kind"),
        F.when(has("R19"), F.col("offset")).when(has("R7", "R8", "R9"), F.col("p_offset")).otherwise(start).alias("start"),
        F.when(has("R9"), F.col("p_end") + F.col("p_attrs")["compressed"].cast("long")).when(has("R19"), F.col("header_end") + F.col("attrs")["compressed"].cast("long")).otherwise(end).alias("end"),
        known_start.alias("known_start"),
        F.coalesce(known_end, F.lit(False)).alias("known_end"),
        F.col("p_attrs")["name"].alias("name_hint"),
        F.when(curr == "gzipEOF", F.col("attrs")["size"].cast("long")).otherwise(F.col("p_attrs")["size"].cast("long")).alias("orig_size"),
        F.col("p_attrs")["method"].cast("int").alias("method"),
    )


# ---- joins of local headers with the central directory


def _named(numbered: DataFrame, kind: str, columns: dict[str, Column]) -> DataFrame:
    return numbered.where(F.col("sig_type") == kind).select("blob_id", "archive_no", F.col("attrs")["name"].alias("name"), *(c.alias(n) for n, c in columns.items()))


def header_skew(numbered: DataFrame) -> DataFrame:
    """(blob_id, archive_no, name, offset, local_offset, skew): each local header with the first central entry of its name; skew is null without one."""
    local = _named(numbered, "LocalFileHeader", {"offset": F.col("offset")})
    central = _named(numbered, "CentralDirEntry", {"entry": F.col("offset"), "local_offset": F.col("attrs")["local_offset"].cast("long")})
    first = central.groupBy("blob_id", "archive_no", "name").agg(F.min_by("local_offset", "entry").alias("local_offset"))
    return local.join(first, ["blob_id", "archive_no", "name"], "left").withColumn("skew", F.col("offset") - F.col("local_offset"))


def archive_skew(numbered: DataFrame) -> DataFrame:
    """(blob_id, archive_no, matched, skews, skew, base_skew): whether an archive's headers agree on one skew; base_skew is what its end record says."""
    w = Window.partitionBy("blob_id", "archive_no")
    own = header_skew(numbered).groupBy("blob_id", "archive_no").agg(F.count("skew").alias("matched"), F.count_distinct("skew").alias("skews"), F.min("skew").alias("skew"))
    first = numbered.where("sig_type = 'CentralDirEntry'").groupBy("blob_id", "archive_no").agg(F.min("offset").alias("dir"))
    ends = numbered.where("sig_type = 'EndOfCentralDir'").select("blob_id", "archive_no", F.min(F.col("attrs")["dir_offset"].cast("long")).over(w).alias("dir_offset")).distinct()
    base = first.join(ends, ["blob_id", "archive_no"]).select("blob_id", "archive_no", (F.col("dir") - F.col("dir_offset")).alias("base_skew"))
    return own.join(base, ["blob_id", "archive_no"], "full")


def first_names(numbered: DataFrame) -> DataFrame:
    """(blob_id, archive_no, name): the name a lost first member had, from the central entry before that of the first local header left."""
    local = numbered.where("sig_type = 'LocalFileHeader'").groupBy("blob_id", "archive_no").agg(F.min_by(F.col("attrs")["name"], "offset").alias("first_left"))
    w = Window.partitionBy("blob_id", "archive_no").orderBy("offset", "seq")
    central = numbered.where("sig_type = 'CentralDirEntry'").select("blob_id", "archive_no", F.col("attrs")["name"].alias("entry"), F.lag(F.col("attrs")["name"]).over(w).alias("name"))
    return central.join(local, ["blob_id", "archive_no"]).where("entry = first_left AND name IS NOT NULL").select("blob_id", "archive_no", "name")


def first_entry(numbered: DataFrame) -> DataFrame:
    """(blob_id, archive_no, name) of the first central entry."""
    return numbered.where("sig_type = 'CentralDirEntry'").groupBy("blob_id", "archive_no").agg(F.min_by(F.col("attrs")["name"], "offset").alias("name"))


def signature_counts(signatures: DataFrame) -> DataFrame:
    """(sig_type, n): the counters of what was found."""
    return signatures.groupBy("sig_type").agg(F.count("*").alias("n"))


def raw_members(blobs: DataFrame, found: DataFrame, prefix: bytes = b"") -> DataFrame:
    """(blob_id, span_no, kind, body): spans of codecs that are handed on as they are, RAR members with an archive head before them."""
    head = F.when(F.col("kind") == "rar", F.lit(bytearray(bytes.fromhex("526172211A0700CF907300000D00000000000000")))).otherwise(F.lit(bytearray(prefix)))
    kept = found.where(F.col("kind").isin("bz2", "wpk", "rar"))
    return kept.join(blobs, "blob_id").select("blob_id", "archive_no", "span_no", "kind", F.concat(head, F.expr("substring(content, cast(start + 1 AS int), cast(end - start AS int))")).alias("body"))


def stored_members(blobs: DataFrame, found: DataFrame) -> DataFrame:
    """(blob_id, archive_no, span_no, name_hint, body): members stored without compression whose stated size is the span's."""
    kept = found.where("kind = 'zip' AND method = 0 AND orig_size = end - start")
    return kept.join(blobs, "blob_id").select("blob_id", "archive_no", "span_no", "name_hint", F.expr("substring(content, cast(start + 1 AS int), cast(end - start AS int))").alias("body"))
