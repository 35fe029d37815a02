import pytest
from pyspark.sql import functions as F

from tidewrack.sources.chunk_source import ChunkSource, blob_id, scan_range


def test_files_are_read_in_chunks(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.img").write_bytes(bytes(range(256)) * 10)
    (tmp_path / "sub" / "b.img").write_bytes(b"xyz")
    (tmp_path / "empty.img").write_bytes(b"")
    (tmp_path / "c.txt").write_bytes(b"no")
    spark.dataSource.register(ChunkSource)

    def load(**options):
        return spark.read.format("blob_chunks").options(path=str(tmp_path), glob="*.img", **options).load()

    rows = load(chunk_mb=1000 / 1024 / 1024).orderBy("path", "chunk_no").collect()
    a = [r for r in rows if r.path.endswith("a.img")]
    assert [(r.chunk_no, r.base_offset, len(r.content)) for r in a] == [(0, 0, 1000), (1, 1000, 1000), (2, 2000, 560)]
    assert b"".join(bytes(r.content) for r in a) == bytes(range(256)) * 10 and len(rows) == 4
    assert a[0].blob_id == blob_id(a[0].path) == spark.range(1).select(F.xxhash64(F.lit(a[0].path)).alias("h")).first().h
    part = load(range="10,20", file=str(tmp_path / "a.img")).collect()
    assert [bytes(r.content) for r in part] == [bytes(range(10, 20))]
    assert [len(r.content) for r in load(chunk_mb=1000 / 1024 / 1024, overlap=5).where("path LIKE '%a.img'").orderBy("chunk_no").collect()] == [1005, 1005, 560]
    assert load().where("path = 'none'").count() == 0


def test_ranges():
    assert scan_range("0x10,32") == (16, 32) and scan_range("5,") == (5, 2**63 - 1)
    with pytest.raises(ValueError):
        scan_range("5,5")
