"""A data source for files of any size: every chunk is a partition of its own.

``binaryFile`` holds a file in one row, which ends at 2 GiB; disk images are
larger. Here a task seeks to its chunk and reads no more than that. The folder
has to be one that all executors see.

    spark.dataSource.register(ChunkSource)
    spark.read.format("blob_chunks").option("path", p).option("chunk_mb", 512).load()

Options: path; file, the one file below it to read; chunk_mb (512); range, "start,end" in bytes, of every file; glob;
overlap, bytes that a chunk reads on into the next one (0: nothing is carried).
"""

from __future__ import annotations

import fnmatch
import os

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .blobs import CHUNK_MB, MIB

SCHEMA = "blob_id long, path string, length long, chunk_no int, base_offset long, content binary"


class Chunk(InputPartition):
    def __init__(self, path: str, length: int, number: int, start: int, size: int):
        super().__init__((path, number))
        self.path, self.length, self.number, self.start, self.size = path, length, number, start, size


def blob_id(path: str) -> int:
    """What xxhash64 of the path is in Spark."""
    import xxhash

    h = xxhash.xxh64_intdigest(path.encode(), 42)
    return h - (1 << 64) if h >> 63 else h


def scan_range(text: str) -> tuple[int, int]:
    """(start, end) of "start,end", in decimal, 0x or 0o; an error unless the end lies behind the start."""
    start, _, end = text.partition(",")
    found = int(start.strip() or "0", 0), int(end.strip(), 0) if end.strip() else 2**63 - 1
    if found[1] <= found[0]:
        raise ValueError("the range's end must lie behind its start")
    return found


class ChunkReader(DataSourceReader):
    def __init__(self, options: dict):
        self.root = options["path"].removeprefix("file://")
        self.size = max(1, int(float(options.get("chunk_mb", CHUNK_MB)) * MIB))
        self.range = scan_range(options.get("range", "0,"))
        self.glob, self.overlap = options.get("glob", "*"), int(options.get("overlap", "0"))
        self.only = options.get("file")

    def partitions(self):
        out = []
        files = [self.root] if os.path.isfile(self.root) else sorted(os.path.join(d, n) for d, _, names in os.walk(self.root) for n in names)
        for path in files:
            if not fnmatch.fnmatch(os.path.basename(path), self.glob) or self.only not in (None, path):
                continue
            length = os.path.getsize(path)
            lo, hi = self.range[0], min(self.range[1], length)
            for k, start in enumerate(range(lo, hi, self.size)):
                out.append(Chunk(path, length, k, start, min(self.size + self.overlap, hi - start)))
        return out or [Chunk("", 0, -1, 0, 0)]

    def read(self, partition):
        if partition.number < 0:
            return
        with open(partition.path, "rb") as f:
            f.seek(partition.start)
            content = f.read(partition.size)
        yield blob_id(partition.path), partition.path, partition.length, partition.number, partition.start, content


class ChunkSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "blob_chunks"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ChunkReader:
        return ChunkReader(self.options)
