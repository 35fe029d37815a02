"""Media columns: payloads kept as FLAC streams, read back as PCM blocks.

Each row is encoded, decoded and verified on its own; slices of rows share the
vectorised steps of ``flac``. Nothing is shuffled.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
from pyspark.sql import DataFrame

from . import flac
from .common import text_slices

UNIT = 64
#: bytes of text that are encoded at a time; a longer text comes alone
SLICE = 1_000_000


def payload_of(text: str | None) -> tuple[bytes, int]:
    """The UTF-8 bytes of a text with zeros up to a positive multiple of 64, and their number without these."""
    data = (text or "").encode()
    return data + bytes(-len(data) % UNIT or (0 if data else UNIT)), len(data)


def feature_of(x: np.ndarray) -> str:
    """What samples of 8 bits look like: peak, mean and power in thousandths, sign changes, duration in milliseconds."""
    changes = int(np.count_nonzero((x[1:] < 0) != (x[:-1] < 0)))
    return f"peak={int(np.abs(x).max())};mean={int(x.sum()) * 1000 // len(x)};power={int((x * x).sum()) * 1000 // len(x)};changes={changes};ms={len(x) * 1000 // flac.RATE}"


def stored(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and media (the FLAC stream of the payload) of every row of docs (doc_id, text). A null text is empty."""
    import pyarrow as pa

    def run(batches):
        for b in text_slices(batches, "text", SLICE):
            made = [payload_of(t) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([n for _, n in made], pa.int64()), pa.array(flac.encode([p for p, _ in made]), pa.binary())], ["doc_id", "n_bytes", "media"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes long, media binary")


def pcm_blocks(media: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """The PCM blocks of FLAC streams (id, media): id, block, first_sample, n_samples, byte_offset, pcm.

    A block is what one frame holds; byte_offset is where the frame begins in the
    stream, so that a reader can seek to it. Null or empty media have no blocks;
    a damaged stream is an error.
    """
    import pyarrow as pa

    def run(batches):
        for b in text_slices(batches, "media", SLICE):
            ids, streams = b.column(id_column).to_pylist(), b.column("media").to_pylist()
            kept = [(i, s) for i, s in zip(ids, streams) if s]
            rows: list[tuple] = []
            for (i, s), x in zip(kept, flac.decode([s for _, s in kept])):
                head = flac.Stream(s)
                for k, (first, at, n) in enumerate(head.points or [(0, 0, x.shape[1])]):
                    rows.append((i, k, first, n, head.start + at, flac.pcm(x[:, first : first + n], head.bits)))
            for at in range(0, len(rows), 1000):
                part = list(zip(*rows[at : at + 1000]))
                kinds = [b.column(id_column).type, pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(part, kinds)], [id_column, "block", "first_sample", "n_samples", "byte_offset", "pcm"])

    kind = media.schema[id_column].dataType.simpleString()
    return media.select(id_column, "media").mapInArrow(run, f"{id_column} {kind}, block long, first_sample long, n_samples long, byte_offset long, pcm binary")


def round_trip(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature of every row of docs.

    The payload's digests are those of the samples read back from the stored
    stream, whose checksums are verified. Null and empty texts are 64 zero bytes;
    rows that repeat stay; other columns are left out.
    """
    import pyarrow as pa

    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]

    def run(batches):
        for b in text_slices(batches, "text", SLICE):
            made = [payload_of(t) for t in b.column("text").to_pylist()]
            streams = flac.encode([p for p, _ in made])
            rows = []
            for (_, n), s, x in zip(made, streams, flac.decode(streams)):
                back = (x[0] + 128).astype(np.uint8).tobytes()
                rows.append((n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-UNIT:]), len(s), hashlib.sha256(s).hexdigest(), feature_of(x[0])))
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(list(c), t) for c, t in zip(zip(*rows), kinds))], names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
