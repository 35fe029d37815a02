"""Queries over constructed inputs, one case a document, that state what each detector, rule and constraint has to give."""

from __future__ import annotations

import zlib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.native import byte_slices
from ..operators import corruption, deflate, ngrams, reconstruct, signatures, spans
from ..operators.signatures import ScanOptions
from ..sources import blobs, sinks
from ..sources.staging import shared_dir, staged
from . import recover


def _z(n: int) -> str:
    return "00" * n


def _rar() -> str:
    body = bytes.fromhex("74008025000500000005000000" + _z(9) + "1D30" + "0500" + "00000000") + b"a.txt"
    return ((zlib.crc32(body) & 0xFFFF).to_bytes(2, "little") + body + b"hello").hex().upper()


_LOCAL = "504B0304" + _z(22) + "0100" + "0000" + "61"
#: bytes in hex, and what is found in them: (kind, offset, end of the header)
SIGNATURES: list[tuple[str, list[tuple[str, int, int]]]] = [
    ("504B010214001400" + _z(40), [("CentralDirEntry", 0, 46)]),
    (_LOCAL, [("LocalFileHeader", 0, 31)]),
    ("504B0505" + _z(8), [("CentralDirSignature", 0, 6)]),
    ("504B0506" + _z(18), [("EndOfCentralDir", 0, 0)]),
    ("504B0606" + _z(52), [("EndOfCentralDir64", 0, 0)]),
    ("504B0607" + _z(16), [("EndOfCentralDirLocator", 0, 0)]),
    ("504B0608" + _z(8), [("ExtraData", 0, 8)]),
    ("504B0708" + _z(8), [("SplitArchiveIndicator", 0, 0)]),
    (_LOCAL + "504B0708" + _z(12), [("LocalFileHeader", 0, 31), ("DataDescriptor", 31, 47)]),
    ("7776706B" + _z(30), [("WavPackRecordHeader", 0, 0)]),
    ("425A6839" + _z(8), [("BZIP2StreamHeader", 0, 0)]),
    ("314159265359" + _z(8), [("BZIP2BlockHeader", 0, 0)]),
    ("177245385090" + _z(8), [("BZIP2EndOfStream", 0, 0)]),
    ("424C5A010300" + _z(20), [("ALZipFileHeader", 0, 16)]),
    ("414C5A01" + _z(8), [("ALZipArchiveHeader", 0, 8)]),
    ("434C5A01" + _z(8) + "434C5A02", [("ALZipEOF", 0, 16)]),
    ("4C5A495001" + _z(8), [("LzipSignature", 0, 0)]),
    ("4D534346" + _z(4) + "64000000" + _z(4) + "32000000" + _z(20), [("CabinetSignature", 0, 0)]),
    ("526172211A0700" + _z(8), [("RARMarker", 0, 0)]),
    (_rar(), [("RARFileHeader", 0, 37)]),
    ("377ABCAF271C" + _z(8), [("7zipSignature", 0, 0)]),
    ("FD377A585A00" + _z(8), [("XzStreamSignature", 0, 0)]),
    ("010000FFFF05", [("DeflateSyncMark", 1, 5)]),
    (b"FlateDecode>>\nstream\n".hex().upper() + "789C" + _z(9), [("PDF_FlateHeader", 23, 23)]),
    ("79" * 8 + b"endstream\n".hex().upper() + _z(9), [("PDF_FlateEnd", 4, 4)]),
    ("000000147A545874" + "61620000789C" + _z(14) + _z(9), [("PNG_zTXt", 14, 14), ("PNGChunkEnd", 28, 28)]),
    ("0000001469545874" + "61620001000000789C" + _z(11) + _z(9), [("PNG_iTXt", 17, 17), ("PNGChunkEnd", 28, 28)]),
    ("4B57414A88F027D101000E00" + _z(4), [("KWAJSignature", 0, 0)]),
    ("535A444488F0273341" + _z(4), [("SZDDSignature", 0, 0)]),
    ("535A2088F02733D1" + _z(4), [("SZDDAltSignature", 0, 0)]),
    # near misses
    ("504B01020A001400" + _z(40), []),
    ("504B0304" + _z(30), []),
    ("504B0506" + "0041" + _z(18), []),
    ("504B0606" + _z(7) + "01" + _z(44), []),
    ("504B0607" + "00000001" + _z(16), []),
    ("504B0608" + "00000001" + _z(8), []),
    ("7776706B" + _z(4) + "1004" + _z(30), []),
    ("425A6830" + _z(8), []),
    ("424C5A010302" + _z(20), []),
    ("434C5A01" + _z(8) + "434C5A04", []),
    ("4C5A495002" + _z(8), []),
    ("C10000FFFF05", []),
]


def _turn(n: int) -> Column:
    return F.pmod(F.col("doc_id"), F.lit(n)).cast("int")


def signature_cases(spark, d) -> DataFrame:
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id")
    literal = F.element_at(F.array(*(F.lit(h) for h, _ in SIGNATURES)), _turn(len(SIGNATURES)) + 1)
    made = docs.select(F.col("doc_id").alias("blob_id"), F.unhex(F.concat(F.repeat(F.lit("78"), _turn(50)), literal)).alias("content"))
    return signatures.signatures(made, ScanOptions(legacy_compress=True)).select("blob_id", "offset", "sig_type", "header_end")


def signature_cases_sql() -> str:
    rows = ", ".join(f"({i}, {p}, '{k}', {e})" for i, (_, found) in enumerate(SIGNATURES) for k, p, e in found)
    ends = ", ".join(f"({i}, {len(h) // 2})" for i, (h, _) in enumerate(SIGNATURES))
    return f"""WITH c(i, p, k, e) AS (VALUES {rows}), z(i, n) AS (VALUES {ends})
SELECT doc_id AS blob_id, doc_id % 50 + p AS "offset", k AS sig_type, doc_id % 50 + e AS header_end FROM documents JOIN c ON c.i = doc_id % {len(SIGNATURES)}
UNION ALL SELECT doc_id, doc_id % 50 + n, 'zipEOF', doc_id % 50 + n FROM documents JOIN z ON z.i = doc_id % {len(SIGNATURES)}"""


#: signatures (offset, kind; headers are 30 bytes long), and the spans: (rule, kind, start, end, start known, end known), starts of 0 stay where they are
SPANS: list[tuple[list[tuple[int, str]], list[tuple[str, str, int, int, bool, bool]]]] = [
    ([(0, "LocalFileHeader"), (100, "LocalFileHeader"), (200, "CentralDirEntry"), (300, "zipEOF")], [("R1", "zip", 30, 100, True, True), ("R1", "zip", 130, 200, True, True)]),
    ([(0, "DataDescriptor"), (100, "LocalFileHeader"), (200, "CentralDirEntry")], [("R14", "zip", 0, 0, False, True), ("R2", "zip", 30, 100, False, True), ("R1", "zip", 130, 200, True, True)]),
    ([(0, "ZlibHeader"), (100, "ZlibHeader"), (200, "ZlibEOF")], [("R3", "zlib", 30, 96, True, True), ("R3", "zlib", 130, 200, True, True)]),
    ([(0, "gzipHeader"), (100, "gzipHeader"), (200, "gzipEOF")], [("R4", "gzip", 30, 92, True, False), ("R4", "gzip", 130, 200, True, True)]),
    ([(0, "PDF_FlateHeader"), (160, "PDF_FlateEnd"), (300, "zipEOF")], [("R5", "pdf", 30, 160, True, True)]),
    ([(0, "ALZipFileHeader"), (90, "ALZipFileHeader"), (150, "ALZipEOF")], [("R6", "alzip", 30, 90, True, True), ("R6", "alzip", 120, 150, True, True)]),
    ([(0, "WavPackRecordHeader"), (50, "WavPackRecordHeader"), (90, "zipEOF")], [("R7", "wpk", -1, 90, True, False)]),
    ([(0, "BZIP2StreamHeader"), (4, "BZIP2BlockHeader"), (80, "BZIP2EndOfStream"), (90, "zipEOF")], [("R8", "bz2", -1, 90, True, False)]),
    ([(0, "DeflateSyncMark"), (90, "zipEOF")], [("R10", "raw", 30, 90, True, False)]),
    ([(0, "PNG_zTXt"), (90, "PNGChunkEnd"), (120, "zipEOF")], [("R11", "png", 30, 86, True, True)]),
    ([(50, "LocalFileHeader"), (300, "zipEOF")], [("R12", "zip", 0, 50, False, True), ("R1", "zip", 80, 300, True, False)]),
    ([(60, "PDF_FlateEnd"), (90, "zipEOF")], [("R13", "pdf", 0, 60, False, True)]),
    ([(60, "CentralDirEntry"), (90, "zipEOF")], [("R15", "zip", 0, 60, False, True)]),
    ([(60, "gzipEOF")], [("R17", "gzip", 0, 60, False, True)]),
    ([(60, "ALZipEOF"), (90, "zipEOF")], [("R18", "alzip", 0, 60, False, True)]),
    ([(0, "RawDeflateStart"), (90, "ZlibEOF")], [("R10", "raw", 30, 90, True, True)]),
]


def _rows(spark, d, cases) -> DataFrame:
    """The signatures of the case of each document, as a scan gives them; all offsets are moved by doc_id % 100."""
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id")
    lists = F.array(*(F.array(*(F.struct(F.lit(p).alias("p"), F.lit(k).alias("k")) for p, k in rows)) for rows, _ in cases))
    each = docs.select("doc_id", F.posexplode(F.element_at(lists, _turn(len(cases)) + 1)).alias("seq", "x"))
    offset = F.col("x.p") + F.pmod(F.col("doc_id"), F.lit(100))
    return each.select(F.col("doc_id").alias("blob_id"), "seq", offset.cast("long").alias("offset"), F.col("x.k").alias("sig_type"), (offset + 30).cast("long").alias("header_end"), F.expr("map()").cast("map<string,string>").alias("attrs"))


def span_cases(spark, d) -> DataFrame:
    return spans.spans(spans.archives(_rows(spark, d, SPANS))).select("blob_id", "rule", "kind", "start", "end", "known_start", "known_end")


def span_cases_sql() -> str:
    """-1 stands for the start of the first signature. What stands before a first header that can end something is a tail of that."""
    rows = ", ".join(f"({i}, '{r}', '{k}', {s}, {e}, {a}, {b})" for i, (_, found) in enumerate(SPANS) for r, k, s, e, a, b in found if not (e == 0))
    return f"""WITH c(i, r, k, s, e, a, b) AS (VALUES {rows})
SELECT doc_id AS blob_id, r AS rule, k AS kind, CASE WHEN s = 0 THEN 0 WHEN s = -1 THEN doc_id % 100 ELSE s + doc_id % 100 END::BIGINT AS start, (e + doc_id % 100)::BIGINT AS "end", a AS known_start, b AS known_end
FROM documents JOIN c ON c.i = doc_id % {len(SPANS)}
UNION ALL SELECT doc_id, rule, kind, 0, doc_id % 100, false, true FROM documents
  JOIN (VALUES (0, 'R12', 'zip'), (1, 'R14', 'zip'), (5, 'R18', 'alzip')) v(i, rule, kind) ON v.i = doc_id % {len(SPANS)} WHERE doc_id % 100 > 0"""


_END = (10_000_000, "zipEOF")
#: signatures, and the places of those that stay
FILTERS: list[tuple[list[tuple[int, str]], list[int]]] = [
    ([(0, "SplitArchiveIndicator"), (9, "LocalFileHeader"), _END], [1, 2]),
    ([(0, "SplitArchiveIndicator"), (4, "LocalFileHeader"), _END], [0, 1, 2]),
    ([(0, "BZIP2StreamHeader"), (4, "BZIP2BlockHeader"), (900_000, "BZIP2EndOfStream"), _END], [0, 1, 2, 3]),
    ([(0, "BZIP2StreamHeader"), _END], [1]),
    ([(0, "BZIP2BlockHeader"), _END], [1]),
    ([(0, "DataDescriptor"), (33, "LocalFileHeader"), _END], [1, 2]),
    ([(0, "LocalFileHeader"), (29, "LocalFileHeader"), _END], [1, 2]),
    ([(0, "ZlibHeader"), (25, "ZlibHeader"), _END], [1, 2]),
    ([(0, "ALZipArchiveHeader"), (17, "ALZipFileHeader"), _END], [1, 2]),
    ([(0, "ALZipArchiveHeader"), (8, "ALZipFileHeader"), _END], [0, 1, 2]),
    ([(0, "PNG_zTXt"), _END], [1]),
    ([(0, "PNGChunkEnd"), _END], [1]),
    ([(0, "PDF_FlateEnd"), (9, "PDF_FlateEnd"), _END], [0, 2]),
    ([(0, "LocalFileHeader"), (500, "DeflateSyncMark"), (900, "LocalFileHeader"), _END], [0, 2, 3]),
    ([(0, "PDF_FlateHeader"), (500, "DeflateSyncMark"), (900, "PDF_FlateEnd"), _END], [0, 2, 3]),
    ([(0, "gzipHeader"), (500, "DeflateSyncMark"), (1000, "DeflateSyncMark"), (300_000, "DeflateSyncMark"), _END], [0, 1, 3, 4]),
]


def filter_cases(spark, d) -> DataFrame:
    return spans.filtered(_rows(spark, d, FILTERS)).select("blob_id", "offset", "sig_type")


def filter_cases_sql() -> str:
    rows = ", ".join(f"({i}, {given[k][0]}, '{given[k][1]}')" for i, (given, kept) in enumerate(FILTERS) for k in kept)
    return f"""WITH c(i, p, k) AS (VALUES {rows}) SELECT doc_id AS blob_id, (p + doc_id % 100)::BIGINT AS "offset", k AS sig_type FROM documents JOIN c ON c.i = doc_id % {len(FILTERS)}"""


# ---- archives one behind the other


def joined_archives(spark, d, zips: DataFrame) -> DataFrame:
    """Each archive twice in its blob, after a few bytes that are none."""
    twice = zips.withColumn("content", F.concat(F.lit(bytearray(b"junk!")), F.col("content"), F.col("content")))
    numbered = spans.archives(spans.filtered(signatures.signatures(twice)))
    return numbered.where("sig_type = 'LocalFileHeader'").select("blob_id", "archive_no", "offset", F.col("attrs")["name"].alias("name"))


JOINED_SQL = """SELECT blob_id, a::INT AS archive_no, 5 + local_offset + a * (ends + 22) AS "offset", name FROM o, (SELECT unnest([0, 1]) AS a)"""


# ---- sinks


def _literal(spark, d) -> DataFrame:
    return deflate.literal_cells(spark.read.parquet(f"{d}/documents.parquet").select(F.col("doc_id").alias("id"), F.encode("text", "UTF-8").alias("body")))


def error_marks(spark, d) -> DataFrame:
    """Texts against truths whose first byte is another and whose last two are missing."""
    cells = _literal(spark, d)
    truth = spark.read.parquet(f"{d}/documents.parquet").select(F.col("doc_id").alias("id"), F.encode("text", "UTF-8").alias("b"))
    truth = truth.select("id", F.concat(F.lit(bytearray(b"\0")), F.expr("substring(b, 2, greatest(length(b) - 3, 0))")).alias("original"))
    return sinks.marked_text(cells, truth).select("id", F.sha2("body", 256).alias("sha256"))


ERROR_MARKS_SQL = """WITH h AS (SELECT doc_id AS id, hex(encode(text)) AS x FROM documents)
SELECT id, sha256(unhex(CASE WHEN length(x) = 0 THEN '' WHEN length(x) <= 6 THEN '7B' || x || '7D'
  ELSE '7B' || x[1:2] || '7D' || x[3:length(x) - 4] || '7B' || x[length(x) - 3:] || '7D' END)) AS sha256 FROM h"""


def stored_cells(spark, d) -> DataFrame:
    """Cells written and read again."""
    import uuid

    path = f"{shared_dir(spark).rstrip('/')}/cells-{uuid.uuid4().hex}"
    sinks.write_cells(_literal(spark, d), path)
    return sinks.plain_text(sinks.read_cells(spark, path)).select("id", F.sha2("body", 256).alias("sha256"))


STORED_CELLS_SQL = "SELECT doc_id AS id, sha256(encode(text)) AS sha256 FROM documents"


def injected_messages(spark, d) -> DataFrame:
    """A banner before each text, and a mark before its third byte."""
    texts = spark.read.parquet(f"{d}/documents.parquet").select(F.col("doc_id").alias("id"), F.encode(F.concat(F.lit("..."), "text"), "UTF-8").alias("body"))
    at = F.explode(F.array(F.struct(F.lit(0).alias("pos"), F.lit("[begin]").alias("message")), F.struct(F.lit(3).alias("pos"), F.lit("[gap]").alias("message"))))
    messages = texts.select("id", at.alias("x")).select("id", "x.*")
    return sinks.with_messages(texts, messages).select("id", F.decode("body", "UTF-8").alias("body"))


INJECTED_MESSAGES_SQL = "SELECT doc_id AS id, '[begin]...[gap]' || text AS body FROM documents"


def last_window(spark, d) -> DataFrame:
    """The last 512 bytes of each text."""
    return sinks.last_bytes(_literal(spark, d)).select("id", F.hex("body").alias("body"))


LAST_WINDOW_SQL = "SELECT doc_id AS id, right(hex(encode(text)), 1024) AS body FROM documents"


def output_policy(spark, d) -> DataFrame:
    """Names of members where those of every third document are there already."""
    docs = spark.read.parquet(f"{d}/documents.parquet")
    name = F.format_string("doc%d.txt", "doc_id")
    wanted = docs.select("doc_id", name.alias("name"), F.format_string("file-%08d.dat", "doc_id").alias("fallback"))
    there = docs.where("doc_id % 3 = 0").select(name.alias("name"))
    kept, forced = (sinks.settled_names(wanted, there, p) for p in ("fallback", "force"))
    return kept.join(forced.select("doc_id", F.col("written_as").alias("forced")), "doc_id").select("doc_id", "written_as", "forced")


OUTPUT_POLICY_SQL = "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN printf('file-%08d.dat', doc_id) ELSE 'doc' || doc_id || '.txt' END AS written_as, 'doc' || doc_id || '.txt' AS forced FROM documents"


def stored_packets(spark, d) -> DataFrame:
    """Block descriptors written and read again: where each stream begins and ends, its blocks one behind the other."""
    streams = deflate.deflated(spark.read.parquet(f"{d}/documents.parquet").select(F.col("doc_id").alias("id"), F.encode("text", "UTF-8").alias("body")))
    found = staged(deflate.packets(streams), "packets")
    w = Window.partitionBy("id").orderBy("packet_no")
    joined = found.withColumn("_gap", F.col("start_bit") - F.coalesce(F.lag("end_bit").over(w), F.lit(0))).withColumn("_hole", F.col("offset") - F.coalesce(F.sum("size").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return joined.groupBy("id").agg(F.sum("size").alias("bytes"), F.sum("_gap").alias("gap_bits"), F.sum("_hole").alias("gap_bytes"), F.count_if("final").alias("final_blocks"))


STORED_PACKETS_SQL = "SELECT doc_id AS id, octet_length(encode(text))::BIGINT AS bytes, 0::BIGINT AS gap_bits, 0::BIGINT AS gap_bytes, 1::BIGINT AS final_blocks FROM documents"


def output_directories(spark, d) -> DataFrame:
    docs = spark.read.parquet(f"{d}/documents.parquet")
    path = F.format_string("in/%s/file%d.tar.zip", "source", "doc_id")
    return docs.select("doc_id", sinks.directory("out/%/all", path, _turn(3)).alias("directory"))


OUTPUT_DIRECTORIES_SQL = "SELECT doc_id, 'out/file' || doc_id || '.tar' || CASE WHEN doc_id % 3 > 0 THEN '-' || (doc_id % 3) ELSE '' END || '/all' AS directory FROM documents"


def raw_passthrough(spark, d) -> DataFrame:
    """Streams of codecs that are handed on as they are, found in blobs and written with their kind's name."""
    docs = spark.read.parquet(f"{d}/documents.parquet")
    body = F.hex(F.encode(F.md5(F.encode("text", "UTF-8")), "UTF-8"))
    bz2, wpk = F.concat(F.lit("425A6839314159265359"), body, F.lit("177245385090" + _z(5))), F.concat(F.lit("7776706B" + _z(28)), body)
    content = F.concat(F.lit("78787878"), F.element_at(F.array(bz2, wpk, F.lit(_rar())), _turn(3) + 1))
    made = docs.select(F.col("doc_id").alias("blob_id"), F.unhex(content).alias("content"))
    found = recover.recover(staged(made, "raw"))
    return found.select(F.split("member_id", "/")[0].cast("long").alias("blob_id"), F.regexp_extract("name", r"\.(\w+)$", 1).alias("extension"), F.sha2("body", 256).alias("sha256"))


RAW_PASSTHROUGH_SQL = f"""WITH h AS (SELECT doc_id, hex(encode(md5(encode(text)))) AS x FROM documents)
SELECT doc_id AS blob_id, ['bz2', 'wpk', 'rar'][doc_id % 3 + 1] AS extension, sha256(unhex(
  CASE doc_id % 3 WHEN 0 THEN '425A6839314159265359' || x || '177245385090{_z(5)}' WHEN 1 THEN '7776706B{_z(28)}' || x ELSE '526172211A0700CF907300000D00000000000000{_rar()}' END)) AS sha256 FROM h"""


# ---- constraints


def _grid(spark, d) -> DataFrame:
    """A pair of neighbours for each document (null: unknown), and every byte between."""
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id")
    before = F.when(F.col("doc_id") % 7 > 0, F.pmod(F.col("doc_id") * 37, F.lit(256)).cast("int"))
    after = F.when(F.col("doc_id") % 5 > 0, F.pmod(F.col("doc_id") * 101 + 10, F.lit(256)).cast("int"))
    return docs.select("doc_id", before.alias("before"), after.alias("after"), F.explode(F.sequence(F.lit(0), F.lit(255))).alias("byte"))


_GRID = "WITH g AS (SELECT doc_id, CASE WHEN doc_id % 7 > 0 THEN (doc_id * 37) % 256 END AS b, CASE WHEN doc_id % 5 > 0 THEN (doc_id * 101 + 10) % 256 END AS a, unnest(range(0, 256)) AS x FROM documents) "


def encoding_constraints(spark, d) -> DataFrame:
    """How many bytes each encoding, and each kind of line end, allows between two neighbours."""
    c = [F.col(x) for x in ("byte", "before", "after")]
    zero = F.col("doc_id") % 2 == 0
    kinds = {"utf8": reconstruct.forbidden(*c), "euc": reconstruct.forbidden(*c, "euc"), "ascii16": reconstruct.forbidden(*c, "ascii16", zero)}
    kinds |= {k.lower(): reconstruct.forbidden_line_end(*c, F.lit(k)) for k in ("CRLF", "LF", "CR")}
    return _grid(spark, d).groupBy("doc_id").agg(*(F.count_if(~v).alias(k) for k, v in kinds.items()))


ENCODING_CONSTRAINTS_SQL = (
    _GRID
    + """SELECT doc_id,
  count(*) FILTER (NOT (coalesce(b < 128 AND x BETWEEN 128 AND 191, false) OR coalesce(a BETWEEN 128 AND 191 AND x < 128, false) OR coalesce(b >= 192 AND NOT x BETWEEN 128 AND 191, false) OR x IN (192, 193) OR x >= 245)) AS utf8,
  count(*) FILTER (NOT coalesce(b < 128 AND a < 128 AND x >= 128, false)) AS euc,
  CASE WHEN doc_id % 2 = 0 THEN 1 ELSE 255 END AS ascii16,
  count(*) FILTER (NOT (coalesce(x = 13 AND a <> 10, false) OR coalesce(x = 10 AND b <> 13, false))) AS crlf,
  count(*) FILTER (x <> 13) AS lf, count(*) FILTER (x <> 10) AS cr FROM g GROUP BY doc_id"""
)


def _holes(spark, d) -> DataFrame:
    """Cells of each text (id, cells) with every 97th byte from the 48th unknown, each by a number of its own."""
    import numpy as np
    import pyarrow as pa

    def run(batches):
        for b in byte_slices(batches, "body"):
            out = []
            for x in b.column("body").to_pylist():
                c = np.frombuffer(x or b"", dtype=np.uint8).astype("<u4") | np.uint32(0xFFE00000)
                c[48::97] = np.arange(1, len(c[48::97]) + 1)
                out.append(c.astype("<u4").tobytes())
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(out, pa.binary())], ["id", "cells"])

    docs = spark.read.parquet(f"{d}/documents.parquet").select(F.col("doc_id").alias("id"), F.encode("text", "UTF-8").alias("body"))
    return docs.mapInArrow(run, "id long, cells binary")


_HOLES = """WITH h AS (SELECT doc_id AS id, hex(encode(text)) AS x FROM documents),
w AS (SELECT id, x, unnest(range(48, length(x) // 2, 97)) AS pos FROM h),
o AS (SELECT id, (pos - 48) // 97 + 1 AS coindex, pos, x[2 * greatest(pos - 5, 0) + 1:2 * pos] AS l, x[2 * pos + 3:2 * pos + 12] AS r FROM w)
"""


def wildcard_contexts(spark, d) -> DataFrame:
    """The known bytes on either side of every unknown one."""
    found = reconstruct.occurrences(_holes(spark, d))
    return found.select("id", "coindex", "pos", F.hex("left").alias("left"), F.hex("right").alias("right"))


WILDCARD_CONTEXTS_SQL = _HOLES + 'SELECT id, coindex, pos, l AS "left", r AS "right" FROM o'


def _model(spark, d) -> DataFrame:
    docs = spark.read.parquet(f"{d}/documents.parquet")
    return ngrams.ngram_counts(docs.select(F.lit("all").alias("model_id"), F.encode("text", "UTF-8").alias("body")), 3)


_THREE = """, p AS (SELECT regexp_extract_all(x, '..') AS b FROM h), m AS (SELECT gram, count(*) AS freq FROM (SELECT unnest([b[i] || b[i + 1] || b[i + 2] for i in range(1, len(b) - 1)]) AS gram FROM p) GROUP BY 1)
"""
_SIDE = "3 * exp(0.8) * 0.4 * (1 + ln(cf)) / cf * freq"


def side_scores(spark, d) -> DataFrame:
    """The score of every byte for every unknown from two known bytes before and behind it, added up, and the best two."""
    best = reconstruct.ranked_unknowns(_holes(spark, d), _model(spark, d), "none", longest=2)
    return best.select("id", "coindex", "byte", F.round("top", 6).alias("top"), F.round("second", 6).alias("second"), "seen", "occurrences")


SIDE_SCORES_SQL = (
    _HOLES
    + _THREE
    + f""", ml AS (SELECT left(gram, 4) AS c, right(gram, 2) AS y, freq, sum(freq) OVER (PARTITION BY left(gram, 4)) AS cf FROM m),
mr AS (SELECT right(gram, 4) AS c, left(gram, 2) AS y, freq, sum(freq) OVER (PARTITION BY right(gram, 4)) AS cf FROM m),
s AS (SELECT id, coindex, ('0x' || y)::INT AS byte, {_SIDE} AS score FROM o JOIN ml ON ml.c = right(l, 4)
  UNION ALL SELECT id, coindex, ('0x' || y)::INT, {_SIDE} FROM o JOIN mr ON mr.c = left(r, 4)),
t AS (SELECT id, coindex, byte, sum(score) AS score FROM s GROUP BY ALL),
k AS (SELECT *, row_number() OVER w AS rank, coalesce(lead(score) OVER w, 0) AS second FROM t WINDOW w AS (PARTITION BY id, coindex ORDER BY round(score, 9) DESC, byte))
SELECT id, coindex, byte, round(score, 6) AS top, round(second, 6) AS second, 1::BIGINT AS seen, 1::BIGINT AS occurrences FROM k WHERE rank = 1"""
)


_BEST = SIDE_SCORES_SQL[: SIDE_SCORES_SQL.rindex("SELECT id, coindex")].rstrip()


def replacement_ranking(spark, d) -> DataFrame:
    """How sure the best byte of every unknown is, and which a round takes: the surest of each span, and all that are sure anyway."""
    rank = reconstruct.with_span_best(reconstruct.ranked_unknowns(_holes(spark, d), _model(spark, d), "none", longest=2))
    surest, sure = reconstruct.is_chosen(), reconstruct.is_chosen(ratio=reconstruct.AGGRESSIVE_RATIO)
    return rank.select("id", "coindex", "byte", "enough", F.round("ratio", 6).alias("ratio"), F.round("ranking", 6).alias("ranking"), "confidence", surest.alias("surest"), sure.alias("sure"), "pruned")


REPLACEMENT_RANKING_SQL = (
    _BEST
    + """, b AS (SELECT id, coindex, byte, score AS top, second, least(score / greatest(second, 1e-12), 10000.0) AS ratio FROM k WHERE rank = 1),
r AS (SELECT *, 10 * ln(ratio) + 0.25 * ln(1 + top - second) AS ranking, least(floor(8 * (least(ratio, 4.0) - 1.2) + top), 62)::INT AS confidence FROM b),
u AS (SELECT t.id, t.coindex, count(*) AS pruned FROM t JOIN b USING (id, coindex) WHERE t.score < 0.2 * b.top GROUP BY ALL)
SELECT id, coindex, byte, true AS enough, round(ratio, 6) AS ratio, round(ranking, 6) AS ranking, confidence,
  ranking >= 0.96 * max(ranking) OVER (PARTITION BY id) AND confidence >= 1 AS surest, ratio >= 25 AND confidence >= 1 AS sure, coalesce(pruned, 0) AS pruned
FROM r LEFT JOIN u USING (id, coindex)"""
)


def replacement_edits(spark, d) -> DataFrame:
    """Replacements of two windows with some set anew, some taken out, a gap put in before the second window, the first one cleared."""
    docs = spark.read.parquet(f"{d}/documents.parquet").select(F.col("doc_id").alias("id"))
    each = docs.select("id", F.explode(F.array(F.lit(1), F.lit(2), F.lit(32769), F.lit(32770), F.lit(32771))).alias("coindex"))
    made = each.select("id", "coindex", F.pmod(F.col("id"), F.lit(200)).cast("int").alias("byte"), F.lit(5).alias("confidence"))
    taken_out, set_anew = F.lit(None).cast("int"), F.lit(65)
    edits = docs.select("id", F.lit(32769).alias("coindex"), taken_out.alias("byte"), F.lit(1).alias("confidence"))
    edits = edits.unionByName(docs.select("id", F.lit(32770).alias("coindex"), set_anew.alias("byte"), F.lit(62).alias("confidence")))
    edits = edits.unionByName(docs.select("id", F.lit(32790).alias("coindex"), F.lit(66).alias("byte"), F.lit(61).alias("confidence")))
    return reconstruct.cleared_window(reconstruct.moved_behind(reconstruct.edited(made, edits), 1), 0)


REPLACEMENT_EDITS_SQL = """SELECT doc_id AS id, 65538 AS coindex, 65 AS byte, 62 AS confidence FROM documents
UNION ALL SELECT doc_id, 65539, (doc_id % 200)::INT, 5 FROM documents UNION ALL SELECT doc_id, 65558, 66, 61 FROM documents"""


def center_scores(spark, d) -> DataFrame:
    """The sum, and the number, of the scores that bytes get from grams of three with the unknown byte in the middle."""
    found = reconstruct.occurrences(_holes(spark, d), 1)
    averages = spark.createDataFrame([(3, 2.0)], "n int, avgfreq double")
    scores = reconstruct.center_scores(found, staged(_model(spark, d), "grams"), averages, longest=3)
    return scores.groupBy("id", "coindex").agg(F.count("*").alias("bytes"), F.round(F.sum("score"), 6).alias("total"))


CENTER_SCORES_SQL = (
    _HOLES
    + _THREE
    + """SELECT id, coindex, count(*) AS bytes, round(sum(freq * 0.25 * 9 / 2.0), 6) AS total FROM o JOIN m ON left(gram, 2) = right(l, 2) AND right(gram, 2) = left(r, 2) GROUP BY ALL"""
)


# ---- corrupt stretches


def corrupt_stretches(spark, d) -> DataFrame:
    """Windows flagged by turns, joined where they touch: three out of every seven."""
    docs = spark.read.parquet(f"{d}/documents.parquet")
    windows = docs.select(F.col("doc_id").alias("id"), F.explode(F.sequence(F.lit(0), F.length("text").cast("long"), F.lit(64).cast("long"))).alias("window"))
    flags = windows.withColumn("corrupt", (F.col("window") / 64).cast("long") % 14 < 3)
    return corruption.corrupt_ranges(flags, 512).select("id", "start", "end")


CORRUPT_STRETCHES_SQL = """SELECT doc_id AS id, s AS start, (least(s + 128, length(text) // 64 * 64) + 512)::BIGINT AS "end" FROM (SELECT doc_id, text, unnest(range(0, length(text) + 1, 896)) AS s FROM documents)"""

def recovery_counters(spark, d) -> DataFrame:
    """Every counter of a whole recovery: of stored archives, and of texts with holes that are filled with what stood there."""
    members = spark.read.parquet(f"{d}/conversations.parquet").select(F.col("conv_id").alias("archive_id"), F.col("turn").alias("ord"), F.format_string("turn%d.txt", "turn").alias("name"), F.encode("text", "UTF-8").alias("body"))
    archives = staged(blobs.stored_zip(members), "zips")
    holes = staged(_holes(spark, d), "holes")
    truth = spark.read.parquet(f"{d}/documents.parquet").select(F.col("doc_id").alias("id"), F.encode("text", "UTF-8").alias("original"))
    asked = reconstruct.occurrences(holes, 0).join(truth, "id")
    right = asked.select("id", "coindex", F.conv(F.hex(F.expr("substring(original, cast(pos + 1 AS int), 1)")), 16, 10).cast("int").alias("byte"), F.lit(62).alias("confidence"))
    filled = staged(reconstruct.apply_replacements(holes, right.where("coindex % 3 > 0")), "filled")
    return recover.counters(signatures.signatures(archives), recover.recover_members(archives), None, holes, filled, reconstruct.accuracy(filled, truth))


RECOVERY_COUNTERS_SQL = """WITH c AS (SELECT count(*) AS n, count(DISTINCT conv_id) AS blobs FROM conversations),
t AS (SELECT octet_length(encode(text)) AS n FROM documents),
w AS (SELECT sum(n)::BIGINT AS total, sum(holes)::BIGINT AS unknown, sum(holes // 3)::BIGINT AS open FROM (SELECT n, CASE WHEN n > 48 THEN (n - 49) // 97 + 1 ELSE 0 END AS holes FROM t)),
m AS (SELECT unnest(['gzip_file_header', 'zlib_file_header', 'ALZip_file_header', 'FlateDecode_file_header', 'rar_marker', 'rar_file_header', 'lzip_marker', 'cabinet_marker', 'SevenZip_signature', 'Xz_signature', 'Deflate_syncmarker',
    'local_file_header', 'central_dir_entry', 'end_of_central_dir', 'uncompressed_files_recovered', 'complete_comp_files_recovered', 'truncated_files_recovered', 'file_tails_recovered',
    'unknown_bytes', 'replacements_needed', 'bytes_replaced', 'replacements_found', 'reconst_unaltered', 'total_bytes', 'identical_bytes', 'reconst_bytes', 'reconst_correct', 'reconst_correct_casefolded']) AS metric,
  unnest([0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, n, n, blobs, n, 0, 0, 0, unknown, unknown, unknown - open, unknown - open, open, total, total - open, unknown - open, unknown - open, 0]) AS value FROM c, w)
SELECT metric, value::BIGINT AS value FROM m"""

QUERIES = {
    "recovery_counters": (recovery_counters, RECOVERY_COUNTERS_SQL),
    "signature_cases": (signature_cases, signature_cases_sql()),
    "span_cases": (span_cases, span_cases_sql()),
    "filter_cases": (filter_cases, filter_cases_sql()),
    "error_marks": (error_marks, ERROR_MARKS_SQL),
    "stored_cells": (stored_cells, STORED_CELLS_SQL),
    "output_directories": (output_directories, OUTPUT_DIRECTORIES_SQL),
    "raw_passthrough": (raw_passthrough, RAW_PASSTHROUGH_SQL),
    "encoding_constraints": (encoding_constraints, ENCODING_CONSTRAINTS_SQL),
    "wildcard_contexts": (wildcard_contexts, WILDCARD_CONTEXTS_SQL),
    "side_scores": (side_scores, SIDE_SCORES_SQL),
    "replacement_ranking": (replacement_ranking, REPLACEMENT_RANKING_SQL),
    "replacement_edits": (replacement_edits, REPLACEMENT_EDITS_SQL),
    "injected_messages": (injected_messages, INJECTED_MESSAGES_SQL),
    "last_window": (last_window, LAST_WINDOW_SQL),
    "output_policy": (output_policy, OUTPUT_POLICY_SQL),
    "stored_packets": (stored_packets, STORED_PACKETS_SQL),
    "center_scores": (center_scores, CENTER_SCORES_SQL),
    "corrupt_stretches": (corrupt_stretches, CORRUPT_STRETCHES_SQL),
}
