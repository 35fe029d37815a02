import struct
import zlib

import pytest

from tidewrack.operators import signatures as S
from tidewrack.operators import spans as P
from tidewrack.operators.signatures import ScanOptions, scan_bytes


def kinds(content, **options):
    return [(p, k) for p, k, _, _ in scan_bytes(content, ScanOptions(**options)) if k != "zipEOF"]


CASES = [
    ("CentralDirEntry", b"PK\1\2\x14\0\x14\0" + b"\0" * 40, b"PK\1\2\x0a\0\x14\0" + b"\0" * 40),
    ("LocalFileHeader", b"PK\3\4" + b"\0" * 22 + b"\1\0\0\0a", b"PK\3\4" + b"\0" * 30),
    ("CentralDirSignature", b"PK\5\5" + b"\0" * 8, b"PK\5\7" + b"\0" * 8),
    ("EndOfCentralDir", b"PK\5\6" + b"\0" * 18, b"PK\5\6\0\x41" + b"\0" * 18),
    ("EndOfCentralDir64", b"PK\6\6" + b"\0" * 52, b"PK\6\6" + b"\0" * 7 + b"\1" + b"\0" * 44),
    ("EndOfCentralDirLocator", b"PK\6\7" + b"\0" * 16, b"PK\6\7\0\0\0\1" + b"\0" * 16),
    ("ExtraData", b"PK\6\x08" + b"\0" * 8, b"PK\6\x08\0\0\0\1" + b"\0" * 8),
    ("SplitArchiveIndicator", b"PK\7\x08" + b"\0" * 8, b"PK\7\x09" + b"\0" * 8),
    ("SplitArchiveSingleSegment", b"PK00" + b"\0" * 8, b"PK01" + b"\0" * 8),
    ("WavPackRecordHeader", b"wvpk" + b"\0" * 30, b"wvpk\0\0\0\0\x10\x04" + b"\0" * 30),
    ("BZIP2StreamHeader", b"BZh9" + b"\0" * 8, b"BZh0" + b"\0" * 8),
    ("BZIP2BlockHeader", b"1AY&SY" + b"\0" * 8, b"1AY&SX" + b"\0" * 8),
    ("BZIP2EndOfStream", b"\x17rE8P\x90" + b"\0" * 8, b"\x17rE8P\x91" + b"\0" * 8),
    ("ALZipFileHeader", b"BLZ\1\3\0" + b"\0" * 20, b"BLZ\1\3\2" + b"\0" * 20),
    ("ALZipArchiveHeader", b"ALZ\1" + b"\0" * 8, b"ALZ\2" + b"\0" * 8),
    ("ALZipEOF", b"CLZ\1" + b"\0" * 8 + b"CLZ\2", b"CLZ\1" + b"\0" * 8 + b"CLZ\4"),
    ("LzipSignature", b"LZIP\1" + b"\0" * 8, b"LZIP\2" + b"\0" * 8),
    ("CabinetSignature", b"MSCF" + struct.pack("<IIII", 0, 100, 0, 50) + b"\0" * 20, b"MSCF" + struct.pack("<IIII", 0, 50, 0, 100) + b"\0" * 20),
    ("RARMarker", b"Rar!\x1a\x07\0" + b"\0" * 8, b"Rar!\x1a\x07\1" + b"\0" * 8),
    ("7zipSignature", b"7z\xbc\xaf'\x1c" + b"\0" * 8, b"7z\xbc\xaf'\x1d" + b"\0" * 8),
]


@pytest.mark.parametrize("kind,good,bad", CASES)
def test_detectors(kind, good, bad):
    assert (0, kind) in kinds(good)
    assert not any(k == kind for _, k in kinds(bad))


def rar_member():
    body = b"\x74\x00\x80" + struct.pack("<H", 37) + struct.pack("<II", 5, 5) + b"\0" + b"\0" * 8 + b"\x1d\x30" + struct.pack("<H", 5) + b"\0" * 4 + b"a.txt"
    return struct.pack("<H", zlib.crc32(body) & 0xFFFF) + body + b"hello"


def test_other_detectors():
    assert (0, "XzStreamSignature") in kinds(b"\xfd7zXZ\0" + b"\0" * 8)
    assert (3, "DeflateSyncMark") in kinds(b"ab\x01\0\0\xff\xff\x05")
    assert not kinds(b"ab\xc1\0\0\xff\xff\x05")
    r = rar_member()
    assert (4, "RARFileHeader") in kinds(b"xxxx" + r)
    assert not kinds(b"xxxx" + r[:10] + b"\x01" + r[11:])
    assert (1, "DataDescriptor") not in kinds(b"\0PK\7\x08" + b"\0" * 12)
    assert (38, "DataDescriptor") in kinds(CASES[1][1] + b"\0" * 7 + b"PK\7\x08" + b"\0" * 12)
    assert (0, "KWAJSignature") in kinds(b"KWAJ\x88\xf0'\xd1\1\0\x0e\0", legacy_compress=True) and not kinds(b"KWAJ\x88\xf0'\xd1\1\0\x0e\0")


def test_streams_in_documents():
    z = zlib.compress(b"some text, some text, some text" * 20)
    pdf = b"<</Filter/FlateDecode>>\nstream\n" + z + b"\nendstream\n" + b" " * 20
    found = kinds(pdf)
    start = pdf.index(z) + 2
    assert (start, "PDF_FlateHeader") in found and (pdf.index(b"\nendstream") + 1 - 5, "PDF_FlateEnd") in found
    assert not kinds(pdf, exclude_pdf=True)
    chunk = b"Comment\0\0" + z
    png = b"\x89PNG" + struct.pack(">I", len(chunk)) + b"zTXt" + chunk + b"\0\0\0\0" + b" " * 20
    found = kinds(png)
    assert (png.index(z) + 2, "PNG_zTXt") in found and any(k == "PNGChunkEnd" for _, k in found)


def test_formats_and_range():
    short = zlib.compress(b"text " * 200)  # a fixed block
    assert [k for _, k in kinds(short, input_format="zlib")] == ["ZlibEOF"] and (0, "ZlibHeader") in kinds(short, input_format="zlib_all_fixed")
    z = zlib.compress(b" ".join(b"word%d" % (i * i % 977) for i in range(900)))
    assert [k for _, k in kinds(b"xx" + z, input_format="zlib")] == ["ZlibHeader", "ZlibEOF"]
    assert [p for p, k in kinds(z + z, input_format="zlib_all") if k == "ZlibHeader"] == [0, len(z)]
    g = b"\x1f\x8b\x08\x1e\0\0\0\0\0\x03\x02\0zzname\0note\0\x11\x22body" + b"\0" * 8
    (at, kind, end, attrs), *_ = scan_bytes(g, ScanOptions(input_format="gzip"))
    assert (at, kind, g[end : end + 4]) == (0, "gzipHeader", b"body") and (attrs["name"], attrs["comment"]) == ("name", "note")
    assert [k for _, k in kinds(b"anything", input_format="raw")] == ["RawDeflateStart", "ZlibEOF"]
    assert kinds(b"x" * 10 + CASES[10][1], scan_range=(5, 30)) == [(10, "BZIP2StreamHeader")]
    with pytest.raises(ValueError):
        scan_bytes(b"", ScanOptions(input_format="tar"))


def table(spark, rows):
    return spark.createDataFrame([(1, i, p, k, p + 30, {}) for i, (p, k) in enumerate(rows)], S.SCHEMA)


def left(spark, *rows):
    return [(r.offset, r.sig_type) for r in P.filtered(table(spark, rows)).orderBy("offset", "seq").collect()]


def test_neighbour_rules(spark):
    end = (10_000_000, "zipEOF")
    for rows, kept in [
        ([(0, "SplitArchiveIndicator"), (9, "LocalFileHeader"), end], [(9, "LocalFileHeader"), end]),
        ([(0, "SplitArchiveIndicator"), (4, "LocalFileHeader"), end], None),
        ([(0, "BZIP2StreamHeader"), (4, "BZIP2BlockHeader"), (900_000, "BZIP2EndOfStream"), end], None),
        ([(0, "BZIP2StreamHeader"), end], [end]),
        ([(0, "BZIP2BlockHeader"), end], [end]),
        ([(0, "DataDescriptor"), (33, "LocalFileHeader"), end], [(33, "LocalFileHeader"), end]),
        ([(0, "LocalFileHeader"), (29, "LocalFileHeader"), end], [(29, "LocalFileHeader"), end]),
        ([(0, "ZlibHeader"), (25, "ZlibHeader"), end], [(25, "ZlibHeader"), end]),
        ([(0, "PNG_zTXt"), end], [end]),
        ([(0, "PNGChunkEnd"), end], [end]),
        ([(0, "PDF_FlateEnd"), (9, "PDF_FlateEnd"), end], [(0, "PDF_FlateEnd"), end]),
        ([(0, "LocalFileHeader"), (500, "DeflateSyncMark"), (900, "LocalFileHeader"), end], [(0, "LocalFileHeader"), (900, "LocalFileHeader"), end]),
        ([(0, "PDF_FlateHeader"), (500, "DeflateSyncMark"), (900, "PDF_FlateEnd"), end], [(0, "PDF_FlateHeader"), (900, "PDF_FlateEnd"), end]),
        ([(0, "gzipHeader"), (500, "DeflateSyncMark"), (1000, "DeflateSyncMark"), (300_000, "DeflateSyncMark"), end], [(0, "gzipHeader"), (500, "DeflateSyncMark"), (300_000, "DeflateSyncMark"), end]),
    ]:
        assert left(spark, *rows) == (rows if kept is None else kept)


def test_spans(spark):
    def found(*rows):
        return [(r.rule, r.kind, r.start, r.end, r.known_start, r.known_end) for r in P.spans(P.archives(table(spark, rows))).orderBy("span_no").collect()]

    assert found((0, "LocalFileHeader"), (100, "LocalFileHeader"), (200, "CentralDirEntry"), (300, "zipEOF")) == [("R1", "zip", 30, 100, True, True), ("R1", "zip", 130, 200, True, True)]
    assert found((50, "LocalFileHeader"), (300, "zipEOF")) == [("R12", "zip", 0, 50, False, True), ("R1", "zip", 80, 300, True, False)]
    assert found((0, "WavPackRecordHeader"), (50, "WavPackRecordHeader"), (90, "zipEOF")) == [("R7", "wpk", 0, 90, True, False)]
    assert [x[:4] for x in found((0, "BZIP2StreamHeader"), (4, "BZIP2BlockHeader"), (80, "BZIP2EndOfStream"), (90, "zipEOF"))] == [("R8", "bz2", 0, 90)]
    assert found((60, "PDF_FlateEnd"), (90, "zipEOF"))[0] == ("R13", "pdf", 0, 60, False, True)
    assert found((0, "PDF_FlateHeader"), (60, "PDF_FlateEnd"), (90, "zipEOF"))[0] == ("R5", "pdf", 30, 60, True, True)
    assert found((0, "ZlibHeader"), (100, "ZlibHeader"), (200, "ZlibEOF")) == [("R3", "zlib", 30, 96, True, True), ("R3", "zlib", 130, 200, True, True)]
    assert found((0, "RawDeflateStart"), (90, "ZlibEOF"))[0][:2] == ("R10", "raw")


def test_rar_members_are_wrapped_again(spark):
    from tidewrack.sources.blobs import chunks, in_range

    blobs = spark.createDataFrame([(1, b"xxxx" + rar_member() + b"tail"), (2, None), (3, b"")], "blob_id long, content binary")
    spans = P.spans(P.archives(P.filtered(S.signatures(blobs))))
    (body,) = [bytes(r.body) for r in P.raw_members(blobs, spans).collect() if r.kind == "rar"][:1]
    assert body[:7] == b"Rar!\x1a\x07\0" and body[20:].startswith(rar_member()[:37]) and body.endswith(b"hello")
    assert [len(r.content) for r in chunks(blobs.where("blob_id = 1"), 10 / 1024 / 1024).collect()] == [10, 10, 10, 10, 10]
    assert in_range(blobs, 4, 6).where("blob_id = 1").first().content == rar_member()[:2]
    with pytest.raises(ValueError):
        in_range(blobs, 4, 4)
