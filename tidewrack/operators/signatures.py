"""The signature scan: where archives and streams begin and end in any bytes.

A kernel finds, for each kind, the places of its literal with the bytes search
of the interpreter (which skips ahead) and checks what stands around them; zlib
headers have no literal and are found by numpy over all byte pairs. Blobs are
independent; the result is a table, and everything after it is DataFrame code.
"""

from __future__ import annotations

import re
import struct
import zlib
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame

from .deflate import valid_header

SCHEMA = "blob_id long, seq int, offset long, sig_type string, header_end long, attrs map<string,string>"
#: gzip members inside other data are looked for in blobs of at least this size
GZIP_INSIDE = 512 * 1024 * 1024


@dataclass(frozen=True)
class ScanOptions:
    """input_format: zip (everything), gzip, zlib (first stream), zlib_all, zlib_all_fixed, raw; gz_by_name: gzip where a path ends in gz."""

    input_format: str = "zip"
    scan_range: tuple[int, int] = (0, 2**63 - 1)
    exclude_pdf: bool = False
    legacy_compress: bool = False  # KWAJ and SZDD
    gzip_inside: int = GZIP_INSIDE
    extra: dict = field(default_factory=dict)


def u16(b: bytes, at: int) -> int:
    return int.from_bytes(b[at : at + 2], "little")


def u32(b: bytes, at: int) -> int:
    return int.from_bytes(b[at : at + 4], "little")


def _byte(b: bytes, at: int) -> int:
    return b[at] if 0 <= at < len(b) else 0


def zlib_places(b: bytes, fixed: bool) -> list[int]:
    """Places of a zlib header whose first block's header is valid."""
    a = np.frombuffer(b, dtype=np.uint8)
    if len(a) < 6:
        return []
    first, second = a[:-1].astype(np.int32), a[1:].astype(np.int32)
    ok = ((first == 0x78) | ((first == 0x68) & (not fixed))) & ((first * 256 + second) % 31 == 0)
    return [p for p in np.flatnonzero(ok).tolist() if valid_header(b, (p + (6 if b[p + 1] & 0x20 else 2)) * 8, fixed)]


def gzip_header(b: bytes, p: int) -> bool:
    if b[p : p + 2] != b"\x1f\x8b":
        return False
    if p == 0:
        return True
    flags = _byte(b, p + 3)
    return _byte(b, p + 2) == 8 and not flags & 0xE0 and _byte(b, p + 8) <= 9 and (not flags & 4 or u16(b, p + 10) < 32768)


def gzip_fields(b: bytes, p: int) -> tuple[int, dict[str, str]]:
    """Where the compressed data begin, and the optional fields."""
    flags, at = _byte(b, p + 3), p + 10
    found = {"mtime": str(u32(b, p + 4)), "os": str(_byte(b, p + 9))}
    if flags & 4:
        found["extra_len"] = str(u16(b, at))
        at += 2 + u16(b, at)
    for bit, name in ((8, "name"), (16, "comment")):
        if flags & bit:
            end = b.find(b"\0", at)
            end = len(b) if end < 0 else end
            found[name] = b[at:end].decode("latin-1")
            at = end + 1
    if flags & 2:
        found["header_crc"] = str(u16(b, at))
        at += 2
    return at, found


def _name(raw: bytes) -> str | None:
    """A member's name; none where it holds control characters."""
    return None if not raw or any(c < 32 for c in raw) else raw.decode("latin-1")


def rar_header(b: bytes, p: int) -> bool:
    """A RAR file header at p: type, OS, version, method, flags, sizes and its own checksum."""
    if len(b) - p < 32 or b[p + 2] != 0x74:
        return False
    flags_high, size = b[p + 4], u16(b, p + 5)
    if b[p + 15] > 5 or b[p + 24] > 49 or not 0x30 <= b[p + 25] <= 0x35 or flags_high & 0xC0 != 0x80 or b[p + 27] >= 0x10:
        return False
    big = bool(flags_high & 1)
    packed, whole = u32(b, p + 7), u32(b, p + 11)
    if big:
        packed, whole = packed | u32(b, p + 32) << 32, whole | u32(b, p + 36) << 32
    least = (40 if big else 32) + (8 if flags_high & 4 else 0) + u16(b, p + 26)
    if packed > whole or size > len(b) - p or size < least:
        return False
    return zlib.crc32(b[p + 2 : p + size]) & 0xFFFF == u16(b, p)


def png_text(b: bytes, p: int) -> int | None:
    """Where the zlib stream of a PNG text chunk of type at p begins, or none."""
    if p < 4:
        return None
    length = struct.unpack(">I", b[p - 4 : p])[0]
    if length > len(b) - p - 4:
        return None
    end = b.find(b"\0", p + 4, p + 4 + 80)
    if not 1 <= end - (p + 4) <= 79:
        return None
    at = end + 1
    if b[p : p + 1] == b"i":
        if _byte(b, at) != 1 or _byte(b, at + 1) != 0:
            return None
        at += 2
        for _ in range(2):
            end = b.find(b"\0", at, p + 4 + length)
            if end < 0:
                return None
            at = end + 1
    else:
        if _byte(b, at) != 0:
            return None
        at += 1
    if at + 2 > len(b) or _byte(b, at) & 15 != 8 or (_byte(b, at) * 256 + _byte(b, at + 1)) % 31:
        return None
    return at


_PDF = b"FlateDecode>>\nstream\n"


def _zip_kind(b: bytes, p: int, last: str | None) -> str | None:
    """The kind of a PK record at p. last: the record found before it."""
    if p + 8 > len(b):
        return None
    kind = b[p + 2 : p + 4]
    if kind == b"\1\2":
        return "CentralDirEntry" if b[p + 4] >= b[p + 6] else None
    if kind == b"\3\4":
        return "LocalFileHeader" if u16(b, p + 26) > 0 else None
    if kind == b"\5\5":
        return "CentralDirSignature"
    if kind == b"\5\6":
        return "EndOfCentralDir" if b[p + 5] < 0x40 and b[p + 7] < 0x40 and u16(b, p + 6) <= u16(b, p + 4) else None
    if kind == b"\6\6":
        return "EndOfCentralDir64" if _byte(b, p + 11) == 0 and _byte(b, p + 19) == 0 and u32(b, p + 8) <= u32(b, p + 16) else None
    if kind == b"\6\7":
        return "EndOfCentralDirLocator" if b[p + 7] == 0 and _byte(b, p + 19) == 0 else None
    if kind == b"\6\10":
        return "ExtraData" if b[p + 7] == 0 else None
    if kind == b"\7\10":
        first = p == 0 or last in (None, "EndOfCentralDir", "EndOfCentralDir64", "EndOfCentralDirLocator")
        return "SplitArchiveIndicator" if first else "DataDescriptor"
    return "SplitArchiveSingleSegment" if kind == b"00" and p == 0 else None


_CANDIDATES = re.compile(
    b"PK|wvpk|BZh[1-9]|BLZ\x01|1AY&SY|\x17rE8P\x90|" + re.escape(_PDF) + b"|endstream\n|[iz]TXt|\x1f\x8b|ALZ\x01|CLZ\x01|LZIP|MSCF|Rar!\x1a\x07\x00|7z\xbc\xaf'\x1c|7zXZ\x00|t|\x00\x00\xff\xff|KWAJ\x88\xf0'\xd1|SZDD\x88\xf0'3A|SZ \x88\xf0'3\xd1",
    re.S,
)


def scan_all(b: bytes, options: ScanOptions) -> list[tuple[int, str]]:
    """(offset, kind) in the order they were found."""
    out: list[tuple[int, str]] = []
    n = len(b)
    at = 0
    while m := _CANDIDATES.search(b, at):
        p, hit = m.start(), m[0]
        at = p + 1
        c = hit[:1]
        if c == b"P":
            if kind := _zip_kind(b, p, out[-1][1] if out else None):
                out.append((p, kind))
        elif hit == b"wvpk":
            if u16(b, p + 8) < 0x0410 and _byte(b, p + 23) == 0:
                out.append((p, "WavPackRecordHeader"))
        elif hit[:3] == b"BZh":
            out.append((p, "BZIP2StreamHeader"))
        elif hit[:3] == b"BLZ":
            if _byte(b, p + 5) < 2:
                out.append((p, "ALZipFileHeader"))
        elif hit == b"1AY&SY":
            out.append((p, "BZIP2BlockHeader"))
        elif c == b"\x17":
            out.append((p, "BZIP2EndOfStream"))
        elif c == b"F":
            if not options.exclude_pdf and p + 23 < n:
                out.append((p + 23, "PDF_FlateHeader"))
        elif c == b"e":
            if not options.exclude_pdf and p + 10 < n:
                out.append((p - 4 - (p > 0 and b[p - 1] == 10), "PDF_FlateEnd"))
        elif c in b"iz" and hit[1:] == b"TXt":
            if (start := png_text(b, p)) is not None:
                out.append((start + 2, "PNG_iTXt" if c == b"i" else "PNG_zTXt"))
                end = p + 4 + struct.unpack(">I", b[p - 4 : p])[0]
                if end <= n:
                    out.append((end, "PNGChunkEnd"))
        elif c == b"\x1f":
            if n >= options.gzip_inside and gzip_header(b, p):
                out.append((p, "gzipHeader"))
        elif hit == b"ALZ\x01":
            out.append((p, "ALZipArchiveHeader"))
        elif hit == b"CLZ\x01":
            if b[p + 12 : p + 15] == b"CLZ" and _byte(b, p + 15) in (2, 3):
                out.append((p, "ALZipEOF"))
        elif hit == b"LZIP":
            if _byte(b, p + 4) <= 1:
                out.append((p, "LzipSignature"))
        elif hit == b"MSCF":
            if _byte(b, p + 24) < 100 and _byte(b, p + 25) < 10 and u32(b, p + 8) > u32(b, p + 16) and _byte(b, p + 31) == 0:
                out.append((p, "CabinetSignature"))
        elif c == b"R":
            out.append((p, "RARMarker"))
        elif hit[:2] == b"7z":
            if hit[2:3] == b"X":
                if p > 0 and b[p - 1] == 0xFD:
                    out.append((p - 1, "XzStreamSignature"))
            else:
                out.append((p, "7zipSignature"))
        elif c == b"t":
            if p >= 2 and rar_header(b, p - 2):
                out.append((p - 2, "RARFileHeader"))
        elif c == b"\0":
            if p >= 1 and b[p - 1] & 0xC0 == 0 and _byte(b, p + 4) & 6 != 6:
                out.append((p, "DeflateSyncMark"))
        elif options.legacy_compress:
            if c == b"K":
                if _byte(b, p + 9) == 0 and _byte(b, p + 8) < 5 and u16(b, p + 10) >= 14:
                    out.append((p, "KWAJSignature"))
            else:
                out.append((p, "SZDDSignature" if hit[2:3] == b"D" else "SZDDAltSignature"))
    out.append((n, "zipEOF"))
    return out


def scan_bytes(content: bytes, options: ScanOptions = ScanOptions()) -> list[tuple[int, str, int, dict[str, str]]]:
    """(offset, kind, header_end, attributes) of a blob, by offset. Offsets are the blob's, whatever the range."""
    lo, hi = max(0, options.scan_range[0]), min(len(content), options.scan_range[1])
    b = content[lo:hi] if (lo, hi) != (0, len(content)) else content
    how = options.input_format
    if how == "zip":
        found = scan_all(b, options)
    elif how == "gzip":
        places = [m.start() for m in re.finditer(b"\x1f\x8b", b) if gzip_header(b, m.start())]
        found = [(p, "gzipHeader") for p in places] + [(max(0, len(b) - 8), "gzipEOF")]
    elif how in ("zlib", "zlib_all", "zlib_all_fixed"):
        places = zlib_places(b, how == "zlib_all_fixed")
        found = [(p, "ZlibHeader") for p in (places[:1] if how == "zlib" else places)] + [(max(0, len(b) - 4), "ZlibEOF")]
    elif how == "raw":
        found = [(0, "RawDeflateStart"), (len(b), "ZlibEOF")]
    else:
        raise ValueError(f"no input format {how}")
    # only ends of PNG chunks and PDF streams can be out of order
    found = sorted(enumerate(found), key=lambda x: (x[1][0], x[0]))
    return [(p + lo, kind, *_header(b, p, kind, lo)) for _, (p, kind) in found]


def _header(b: bytes, p: int, kind: str, lo: int) -> tuple[int, dict[str, str]]:
    """Where the header at p ends, and what it says."""
    if kind == "LocalFileHeader":
        n, x = u16(b, p + 26), u16(b, p + 28)
        flags, method, packed, whole = u16(b, p + 6), u16(b, p + 8), u32(b, p + 18), u32(b, p + 22)
        found = {"flags": str(flags), "method": str(method), "crc": str(u32(b, p + 14)), "compressed": str(packed), "size": str(0 if whole < packed else whole)}
        if p + 30 + n <= len(b) and (name := _name(b[p + 30 : p + 30 + n])):
            found["name"] = name
        return p + lo + 30 + n + x, found
    if kind == "CentralDirEntry":
        n, x, c = u16(b, p + 28), u16(b, p + 30), u16(b, p + 32)
        found = {"method": str(u16(b, p + 10)), "compressed": str(u32(b, p + 20)), "size": str(u32(b, p + 24)), "local_offset": str(u32(b, p + 42))}
        if name := _name(b[p + 46 : p + 46 + n]):
            found["name"] = name
        return p + lo + 46 + n + x + c, found
    if kind == "EndOfCentralDir":
        comment = u16(b, p + 20)
        return p + lo, {"entries": str(u16(b, p + 10)), "dir_size": str(u32(b, p + 12)), "dir_offset": str(u32(b, p + 16)), "record_end": str(p + lo + 22 + comment)}
    if kind == "EndOfCentralDir64":
        return p + lo, {"record_end": str(p + lo + 22)}
    if kind == "CentralDirSignature":
        return p + lo + 6 + u16(b, p + 4), {}
    if kind == "DataDescriptor":
        return p + lo + 16, {"crc": str(u32(b, p + 4)), "compressed": str(u32(b, p + 8)), "size": str(u32(b, p + 12))}
    if kind == "ExtraData":
        return p + lo + 8 + u32(b, p + 4), {}
    if kind == "gzipHeader":
        end, found = gzip_fields(b, p)
        return end + lo, found
    if kind == "gzipEOF":
        return p + lo, {"size": str(u32(b, p + 4))}
    if kind == "ZlibHeader":
        return p + lo + (6 if _byte(b, p + 1) & 0x20 else 2), {}
    if kind == "ALZipArchiveHeader":
        return p + lo + 8, {}
    if kind == "ALZipFileHeader":
        n, wide = u16(b, p + 4), _byte(b, p + 11) >> 4
        found = {"method": str(_byte(b, p + 13))} if wide else {}
        at = p + 13
        if wide:
            found["compressed"] = str(int.from_bytes(b[p + 19 : p + 19 + wide], "little"))
            found["size"] = str(int.from_bytes(b[p + 19 + wide : p + 19 + 2 * wide], "little"))
            at += 6 + 2 * wide
        if name := _name(b[at : at + n]):
            found["name"] = name
        return at + n + lo, found
    if kind == "ALZipEOF":
        return p + lo + 16, {}
    if kind == "RARFileHeader":
        big = b[p + 4] & 1
        found = {"size": str(u32(b, p + 11)), "compressed": str(u32(b, p + 7) | (u32(b, p + 32) << 32 if big else 0))}
        at = p + 40 if big else p + 32
        if name := _name(b[at : at + u16(b, p + 26)]):
            found["name"] = name
        return p + lo + u16(b, p + 5), found
    if kind == "DeflateSyncMark":
        return p + lo + 4, {}
    return p + lo, {}


def signatures(blobs: DataFrame, options: ScanOptions = ScanOptions()) -> DataFrame:
    """The signatures of blobs (blob_id, content): blob_id, seq, offset, sig_type, header_end, attrs. A null content has none."""
    import pyarrow as pa

    attrs = pa.map_(pa.string(), pa.string())

    def run(batches):
        for batch in batches:
            for i, content in zip(batch.column("blob_id").to_pylist(), batch.column("content")):
                if not content.is_valid:
                    continue
                found = scan_bytes(content.as_py(), options)
                for at in range(0, len(found), 10_000):
                    part = found[at : at + 10_000]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([i] * len(part), pa.int64()),
                            pa.array(range(at, at + len(part)), pa.int32()),
                            pa.array([p for p, *_ in part], pa.int64()),
                            pa.array([k for _, k, _, _ in part], pa.string()),
                            pa.array([e for *_, e, _ in part], pa.int64()),
                            pa.array([list(a.items()) for *_, a in part], attrs),
                        ],
                        ["blob_id", "seq", "offset", "sig_type", "header_end", "attrs"],
                    )

    return blobs.select("blob_id", "content").mapInArrow(run, SCHEMA)
