"""The whole way from blobs to recovered members, and from texts to a model."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import corruption, deflate, ngrams, reconstruct, signatures, spans, words
from ..operators.signatures import ScanOptions
from ..sources import sinks
from ..sources.staging import staged


@dataclass(frozen=True)
class RecoverOptions:
    """What to scan for and how to write it. format: text, html, cells or listing."""

    scan: ScanOptions = field(default_factory=ScanOptions)
    format: str = "text"
    junk_paths: bool = False
    rounds: int | None = None
    iterations: int = 1
    ending: str | None = None
    aggressive: bool = True
    align: bool = True
    local_weight: float = 0.0
    prune: bool = False
    encoding: str = "utf8"
    unknown: int = sinks.UNKNOWN


def member_id(*parts: str) -> Column:
    return F.concat_ws("/", *(F.col(p).cast("string") for p in parts))


def find_spans(blobs: DataFrame, options: RecoverOptions = RecoverOptions()) -> DataFrame:
    """The spans of blobs (blob_id, content), with member_id, a name for each."""
    numbered = spans.archives(spans.filtered(signatures.signatures(blobs, options.scan)))
    found = spans.spans(numbered)
    lost = spans.first_names(numbered).select(F.col("blob_id").alias("_b"), F.col("archive_no").alias("_a"), F.col("name").alias("_lost"))
    named = found.join(lost, (F.col("blob_id") == F.col("_b")) & (F.col("archive_no") == F.col("_a")), "left")
    # a member whose local header is gone has the name that the directory puts before the first left
    named = named.withColumn("name_hint", F.coalesce("name_hint", F.when(F.col("rule") == "R12", F.col("_lost")))).drop("_b", "_a", "_lost")
    return named.withColumn("member_id", member_id("blob_id", "archive_no", "span_no"))


def marked_corrupt(streams: DataFrame, decoded: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """streams (id, body, ...) with corrupt_from and corrupt_to (bytes) where decoded (id, cells) reads as no language.

    Windows of 512 bytes with eight words or more, two fifths of them outside
    vocabulary (word), are corrupt; the first stretch of them is taken back to
    the bits it was decoded from. Streams without one have nulls.
    """
    flags = corruption.unknown_words_in(sinks.plain_text(decoded), vocabulary)
    ranges = corruption.corrupt_ranges(flags, corruption.WORD_WINDOW)
    ranges = staged(ranges, "corrupt-ranges")
    hit = streams.join(ranges.select("id").distinct(), "id", "left_semi")
    found = deflate.corrupt_bytes(ranges, deflate.stream_checkpoints(hit, corruption.WORD_SLIDE)).withColumnRenamed("id", "_id")
    return streams.join(found, F.col("id") == F.col("_id"), "left").drop("_id")


def recover_members(blobs: DataFrame, options: RecoverOptions = RecoverOptions(), vocabulary: DataFrame | None = None) -> DataFrame:
    """The members of blobs: member_id, blob_id, archive_no, span_no, kind, name, orig_size, method, cells, bytes, known, unknown, discontinuities, complete.

    Spans are cut out of their blob by a join on blob_id, stored members taken as
    they are, deflated ones decoded as far as they go. Streams of codecs that are
    only handed on (bz2, wpk, rar) are members too: as they stand, RAR ones behind
    an archive's head. With a vocabulary (word) members that stop reading as
    words are decoded again around what is corrupt.
    """
    found = staged(find_spans(blobs, options), "spans")
    # a RAR header is met twice: as the one before, and as the one behind what precedes it
    again = found.where("rule = 'R9'").select("blob_id", "archive_no", "start").withColumn("rule", F.lit("R19"))
    found = found.join(again, ["blob_id", "archive_no", "start", "rule"], "left_anti")
    raw = spans.raw_members(blobs.select("blob_id", "content"), found.where("kind IN ('bz2', 'wpk', 'rar')"))
    raw = raw.select(member_id("blob_id", "archive_no", "span_no").alias("id"), "body")
    cut = found.where("kind NOT IN ('bz2', 'wpk', 'rar')").join(blobs.select("blob_id", "content"), "blob_id").select(
        "member_id",
        "method",
        F.col("known_start"),
        (F.col("method") == 9).alias("deflate64"),
        F.expr("substring(content, cast(start + 1 AS int), cast(end - start AS int))").alias("body"),
    )
    stored = cut.where("method = 0").select(F.col("member_id").alias("id"), "body")
    packed = cut.where("method IS NULL OR method <> 0").select(F.col("member_id").alias("id"), "body", "known_start", F.coalesce("deflate64", F.lit(False)).alias("deflate64"))
    decoded = deflate.decoded(packed).drop("blocks")
    if vocabulary is not None:
        decoded = staged(decoded, "decoded")
        streams = staged(marked_corrupt(packed.where("known_start"), decoded, vocabulary).where("corrupt_from < corrupt_to"), "corrupt-streams")
        again = deflate.decoded(streams).drop("blocks")
        decoded = decoded.join(streams.select("id"), "id", "left_anti").unionByName(again)
    plain = deflate.literal_cells(stored.unionByName(raw))
    names = ["member_id", "blob_id", "archive_no", "span_no", "kind", F.col("name_hint").alias("name"), "orig_size", "method"]
    both = decoded.unionByName(plain)
    return found.join(both, F.col("member_id") == F.col("id")).select(*names, "cells", "bytes", "known", "unknown", "discontinuities", "complete")


def recover(blobs: DataFrame, options: RecoverOptions = RecoverOptions(), model: DataFrame | None = None, averages: DataFrame | None = None, vocabulary: DataFrame | None = None) -> DataFrame:
    """What members are written as: member_id, name, and body (text), html, cells, or the listing's columns. With a model unknown bytes are inferred first."""
    members = staged(recover_members(blobs, options, vocabulary), "members")
    cells = members.select(F.col("member_id").alias("id"), "cells", "discontinuities")
    if model is not None:
        cells = reconstruct.reconstruct(cells, model, averages, options.rounds, options.encoding, options.aggressive, options.align, options.local_weight, options.prune, options.ending, options.iterations)
    base = F.concat(F.lit("member-"), F.col("archive_no").cast("string"))
    kept = F.col("kind").isin("bz2", "wpk", "rar")
    own = F.when(~kept, F.col("name"))  # what is handed on is no plain file of its header's name
    names = {x: sinks.output_name(own, base, F.col("span_no").cast("long"), x, options.junk_paths, options.format == "html") for x in ("dat", "bz2", "wpk", "rar")}
    name = F.when(kept, F.coalesce(*(F.when(F.col("kind") == x, names[x]) for x in ("bz2", "wpk", "rar")))).otherwise(names["dat"])
    named = members.select(F.col("member_id").alias("_id"), name.alias("name"))
    if options.format == "listing":
        return deflate.listing(members.select(F.col("member_id").alias("id"), "bytes", "known"))
    made = sinks.html(cells) if options.format == "html" else cells if options.format == "cells" else sinks.plain_text(cells, options.unknown)
    return made.join(named, F.col("id") == F.col("_id")).select(F.col("id").alias("member_id"), "name", *(c for c in made.columns if c != "id"))


def status(members: DataFrame) -> int:
    """What a command would exit with: 0 where members were found and every one is whole, else 1. Wrong options raise ValueError (2)."""
    n, whole = members.agg(F.count("*"), F.count_if("complete")).first()
    return 0 if n and n == whole else 1


def train(bodies: DataFrame, max_n: int = ngrams.MAX_N, min_freq: int = 1, utf8: bool = True) -> dict[str, DataFrame]:
    """The tables of a model of (model_id, body): ngrams, reverse, counts, words, lengths."""
    grams = ngrams.ngram_counts(bodies, max_n, min_freq)
    return {
        "ngrams": grams,
        "reverse": ngrams.reverse_ngrams(grams),
        "counts": ngrams.average_frequency(grams, bodies),
        "words": words.word_frequencies(bodies, utf8),
        "lengths": ngrams.closed_words(bodies),
    }


def statistics(members: DataFrame) -> DataFrame:
    """(metric, value): counters over recovered members, as rows."""
    sums = members.agg(
        F.count("*").alias("members"),
        F.count_if("complete").alias("complete"),
        F.sum("bytes").alias("bytes"),
        F.sum("known").alias("known_bytes"),
        F.sum("unknown").alias("unknown_bytes"),
        F.sum("discontinuities").cast("long").alias("discontinuities"),
        F.count_if(F.col("kind") == "zip").alias("zip_members"),
    )
    return sums.select(F.explode(F.map_from_arrays(F.array(*(F.lit(c) for c in sums.columns)), F.array(*(F.coalesce(c, F.lit(0)).cast("long") for c in sums.columns)))).alias("metric", "value"))


#: counters by kind of signature
SIGNATURE_COUNTERS = {
    "gzipHeader": "gzip_file_header",
    "ZlibHeader": "zlib_file_header",
    "ALZipFileHeader": "ALZip_file_header",
    "PDF_FlateHeader": "FlateDecode_file_header",
    "RARMarker": "rar_marker",
    "RARFileHeader": "rar_file_header",
    "LzipSignature": "lzip_marker",
    "CabinetSignature": "cabinet_marker",
    "7zipSignature": "SevenZip_signature",
    "XzStreamSignature": "Xz_signature",
    "DeflateSyncMark": "Deflate_syncmarker",
    "LocalFileHeader": "local_file_header",
    "CentralDirEntry": "central_dir_entry",
    "EndOfCentralDir": "end_of_central_dir",
    "EndOfCentralDir64": "end_of_central_dir",
}


def _as_rows(sums: DataFrame) -> DataFrame:
    """The columns of one row as (metric, value)."""
    names = sums.columns
    return sums.select(F.explode(F.map_from_arrays(F.array(*map(F.lit, names)), F.array(*(F.coalesce(c, F.lit(0)).cast("long") for c in names)))).alias("metric", "value"))


def counters(
    signatures: DataFrame | None = None,
    members: DataFrame | None = None,
    streams: DataFrame | None = None,
    before: DataFrame | None = None,
    after: DataFrame | None = None,
    accuracy: DataFrame | None = None,
) -> DataFrame:
    """(metric, value) of what is given: signatures; members of recover_members; deflated streams (id, body); cells (id, cells) before and after inference; rows of reconstruct.accuracy.

    Every counter is a row, zeros too, but for the stages of the block search, which have rows where they count something.
    """
    parts = []
    if signatures is not None:
        names = {k: f"_{i}" for i, k in enumerate(SIGNATURE_COUNTERS)}
        sums = signatures.agg(*(F.count_if(F.col("sig_type") == k).alias(n) for k, n in names.items()))
        by = {}
        for k, n in names.items():
            by[SIGNATURE_COUNTERS[k]] = by.get(SIGNATURE_COUNTERS[k], F.lit(0)) + F.col(n)
        parts.append(_as_rows(sums.select(*(c.alias(n) for n, c in by.items()))))
    if members is not None:
        gap, whole = F.col("discontinuities") > 0, F.col("complete")
        parts.append(
            _as_rows(
                members.agg(
                    F.count_if(whole & (F.col("method") == 0)).alias("uncompressed_files_recovered"),
                    F.count_if(whole & (F.coalesce("method", F.lit(8)) != 0)).alias("complete_comp_files_recovered"),
                    F.count_if(~whole & ~gap).alias("truncated_files_recovered"),
                    F.count_if(~whole & gap).alias("file_tails_recovered"),
                )
            )
        )
    if streams is not None:
        parts.append(deflate.stage_counts(streams))
        parts.append(packet_histogram(deflate.packets(streams)).select(F.concat(F.lit("packet_count_"), F.col("packets").cast("string")).alias("metric"), F.col("members").alias("value")))
    if before is not None:
        found = reconstruct.occurrences(before, 0).groupBy("id", "coindex").agg(F.count("*").alias("n"))
        parts.append(_as_rows(found.agg(F.sum("n").alias("unknown_bytes"), F.count("*").alias("replacements_needed"))))
        if after is not None:
            left = reconstruct.occurrences(after, 0).groupBy("id", "coindex").agg(F.count("*").alias("n"))
            both = found.join(left.withColumnRenamed("n", "left"), ["id", "coindex"], "left")
            parts.append(_as_rows(both.agg(F.sum(F.col("n") - F.coalesce("left", F.lit(0))).alias("bytes_replaced"), F.count_if(F.col("left").isNull()).alias("replacements_found"), F.sum("left").alias("reconst_unaltered"))))
    if accuracy is not None:
        sums = {"total_bytes": "total", "identical_bytes": "identical", "reconst_bytes": "reconstructed", "reconst_correct": "correct"}
        folded = F.sum(F.col("correct_folded") - F.col("correct")).alias("reconst_correct_casefolded")
        parts.append(_as_rows(accuracy.agg(*(F.sum(c).alias(n) for n, c in sums.items()), folded)))
    if not parts:
        raise ValueError("nothing to count")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def packet_histogram(packets: DataFrame) -> DataFrame:
    """(packets, members): how many members have so many blocks, ten and more in one."""
    return packets.groupBy("id").agg(F.least(F.count("*"), F.lit(10)).alias("packets")).groupBy("packets").agg(F.count("*").alias("members"))
