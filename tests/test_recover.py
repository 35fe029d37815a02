import random
import zlib

import numpy as np
import pytest

from tidewrack.functions import cells as C
from tidewrack.operators import deflate as D
from tidewrack.operators.signatures import ScanOptions
from tidewrack.plans import recover as R
from tidewrack.sources import blobs as B


def members(spark, rows):
    return spark.createDataFrame(rows, "archive_id long, ord int, name string, body binary")


WORDS = b" ".join(b"word%d" % (i * i % 977) for i in range(1500))


def deflated(data):
    c = zlib.compressobj(6, zlib.DEFLATED, -15)
    return c.compress(data) + c.flush()


def archive(spark, rows, packed=False):
    df = members(spark, rows)
    if packed:
        df = spark.createDataFrame([(a, o, n, deflated(b), b) for a, o, n, b in rows], "archive_id long, ord int, name string, body binary, original binary")
        return bytes(B.stored_zip(df, original="original").first().content)
    return bytes(B.stored_zip(df).first().content)


def test_archives_are_those_of_zipfile(spark):
    import io
    import zipfile

    rows = [(1, 0, "a.txt", b"hello"), (1, 1, "b/c.txt", WORDS), (1, 2, "empty", b"")]
    for packed in (False, True):
        z = zipfile.ZipFile(io.BytesIO(archive(spark, rows, packed)))
        assert {n: z.read(n) for n in z.namelist()} == {n: b for _, _, n, b in rows}


def test_members_of_joined_and_damaged_archives(spark):
    rows = [(1, 0, "one.txt", WORDS), (1, 1, "two.txt", WORDS[::-1]), (1, 2, "three.txt", b"short")]
    whole, stored = archive(spark, rows, True), archive(spark, rows)
    lost = b"\0\0\0\0" + whole[4:]
    blobs = spark.createDataFrame([(1, b"junk" + whole + stored), (2, lost), (3, None), (4, b"")], "blob_id long, content binary")
    found = R.recover_members(blobs).collect()
    text = {(r.blob_id, r.archive_no, r.name): C.plain_text(C.unpack(r.cells)) for r in found}
    for a in (0, 1):
        for _, _, n, b in rows:
            assert text[1, a, n] == b
    # the first local header is gone: the directory still names it
    assert text[2, 0, "two.txt"] == WORDS[::-1] and (2, 0, "one.txt") in text
    assert not any(r.blob_id in (3, 4) for r in found)
    assert {r.metric: r.value for r in R.statistics(R.recover_members(blobs.where("blob_id = 1"))).collect()}["complete"] == 6


def test_formats(spark):
    blobs = spark.createDataFrame([(1, archive(spark, [(1, 0, "x/a.txt", b"a < b")], True))], "blob_id long, content binary")
    text = R.recover(blobs, R.RecoverOptions(junk_paths=True)).first()
    assert (text.name, bytes(text.body)) == ("a.txt", b"a < b")
    page = R.recover(blobs, R.RecoverOptions(format="html")).first()
    assert page.name == "x/a.txt.htm" and "a &lt; b" in page.html
    assert sorted(r.mark for r in R.recover(blobs, R.RecoverOptions(format="listing")).collect()) == ["+", "+"]


@pytest.mark.parametrize("how,content", [("zlib", zlib.compress(WORDS)), ("zlib_all", zlib.compress(WORDS) + zlib.compress(WORDS)), ("raw", deflated(WORDS)), ("gzip", b"\x1f\x8b\x08\0\0\0\0\0\0\x03" + deflated(WORDS) + b"\0" * 8)])
def test_single_streams(spark, how, content):
    blobs = spark.createDataFrame([(1, content)], "blob_id long, content binary")
    found = R.recover_members(blobs, R.RecoverOptions(scan=ScanOptions(input_format=how))).orderBy("span_no").collect()
    assert C.plain_text(C.unpack(found[0].cells)) == WORDS and found[0].complete
    if how == "zlib_all":
        assert C.plain_text(C.unpack(found[1].cells)) == WORDS


def test_deflate64_reads_what_has_no_longest_match():
    rng = random.Random(1)
    data = b" ".join(b"w%d" % rng.randint(0, 999) for _ in range(3000))
    found = D.recover(deflated(data), deflate64=True)
    assert C.plain_text(np.array(found.cells, dtype=np.uint32)) == data and found.complete


def test_training(spark):
    made = R.train(spark.createDataFrame([("m", b"the cat and the hat ")], "model_id string, body binary"), 3)
    assert set(made) == {"ngrams", "reverse", "counts", "words", "lengths"} and all(df.count() for df in made.values())
    grams = {bytes(r.gram): r.freq for r in made["ngrams"].collect()}
    assert {bytes(r.gram): r.freq for r in made["reverse"].collect()} == {g[::-1]: n for g, n in grams.items()}


def test_a_stream_gives_what_a_batch_gives(spark, tmp_path):
    from tidewrack.operators.signatures import signatures
    from tidewrack.streaming import chunked

    blobs = spark.createDataFrame([(1, archive(spark, [(1, 0, "a", b"hello"), (1, 1, "b", b"you")]))], "blob_id long, content binary")
    blobs.write.parquet(str(tmp_path / "in"))
    stream = chunked.scanned(chunked.read_stream(spark, str(tmp_path / "in")))
    chunked.written(stream, str(tmp_path / "out"), str(tmp_path / "state")).start().awaitTermination()
    key = lambda df: sorted((r.blob_id, r.offset, r.sig_type) for r in df.collect())
    assert key(spark.read.parquet(str(tmp_path / "out"))) == key(signatures(blobs))


def test_status_and_policies(spark, tmp_path):
    from tidewrack.sources import sinks

    whole = archive(spark, [(1, 0, "a", WORDS), (1, 1, "b", b"you")], True)
    status = lambda content: R.status(R.recover_members(spark.createDataFrame([(1, content)], "blob_id long, content binary")))
    assert (status(whole), status(whole[:1500]), status(b"nothing here")) == (0, 1, 1)
    names = spark.createDataFrame([("a", "x")], "name string, fallback string")
    with pytest.raises(FileExistsError):
        sinks.settled_names(names, names)
    with pytest.raises(ValueError):
        sinks.settled_names(names, names, "ask")
    assert sinks.settled_names(names, names.where("false")).first().written_as == "a"
    sinks.discarded(names)


def test_kernels_take_batches_in_slices():
    """Cells are four times their bytes: no kernel on them may take an Arrow batch (64 MB) at once."""
    import inspect

    from tidewrack.operators import deflate, reconstruct
    from tidewrack.plans import cases
    from tidewrack.sources import sinks

    for module in (deflate, reconstruct, sinks, cases):
        source = inspect.getsource(module)
        assert "in byte_slices(batches" in source and "for b in batches:" not in source
