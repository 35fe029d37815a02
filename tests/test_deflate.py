import random
import zlib

import numpy as np
import pytest

from tidewrack.functions import cells as C
from tidewrack.operators import deflate as D


def pack(data, level=6, strategy=0, flush=0):
    c = zlib.compressobj(level, zlib.DEFLATED, -15, 8, strategy)
    out = b"".join(c.compress(data[i : i + flush]) + c.flush(zlib.Z_FULL_FLUSH) for i in range(0, len(data), flush)) if flush else c.compress(data)
    return out + c.flush()


def text(n, seed=1):
    rng = random.Random(seed)
    return " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "the", "of", "é", "x1"]) + str(rng.randint(0, 50)) for _ in range(n)).encode()


def kernel(z):
    bits, segment, at, found = D.Bits(z), D._Segment(0, True), 0, []
    while True:
        packet = D.decode_block(bits, at, segment)
        found.append(packet)
        at = packet.end
        if packet.final:
            return segment.cells, found


@pytest.mark.parametrize("options", [{}, {"level": 0}, {"strategy": zlib.Z_FIXED}, {"flush": 700}, {"level": 9}, {"strategy": zlib.Z_HUFFMAN_ONLY}])
@pytest.mark.parametrize("data", [b"", b"a", b"a" * 5000, text(900), bytes(range(256)) * 300])
def test_kernel_is_zlibs_inverse(data, options):
    z = pack(data, **options)
    cells, packets = kernel(z)
    assert C.plain_text(np.array(cells, dtype=np.uint32)) == data
    assert sum(p.size for p in packets) == len(data) and packets[-1].end <= len(z) * 8 < packets[-1].end + 8


def test_code_sets():
    with pytest.raises(ValueError):
        D.Codes([1, 1, 1])
    assert not D.Codes([2, 2, 2]).complete and D.Codes([1, 2, 2]).complete
    with pytest.raises(D.Damaged):
        D.read_header(D.Bits(b"\x07\0\0\0"), 0)
    with pytest.raises(D.Damaged):
        D.read_header(D.Bits(b"\x01\x05\x00\x00\x00"), 0)


def test_before_the_start_is_unknown_by_coindex():
    data = text(400)
    z = pack(data + data, level=9, flush=len(data))
    # a copy reaches back; without history it names what it misses
    segment = D._Segment(1, False)
    segment.copy(3, 10, 0)
    segment.cells.append(C.LITERAL | 65)
    segment.copy(2, 2, 0)
    assert segment.cells == [C.WINDOW + 10, C.WINDOW + 9, C.WINDOW + 8, C.LITERAL | 65, C.WINDOW + 8, C.LITERAL | 65]
    with pytest.raises(D.Damaged):
        D._Segment(0, True).copy(3, 1, 0)
    assert D.recover(z).complete


def test_head_cut():
    data = text(30_000)
    z = pack(data, flush=8000)
    found = D.recover(z[3000:], known_start=False)
    c = np.array(found.cells, dtype=np.uint32)
    assert C.is_known(c).all() and data.endswith(C.plain_text(c)) and len(c) > len(data) // 2


def test_middle_overwritten():
    data = text(30_000)
    z = pack(data)
    at = len(z) // 2
    found = D.recover(z[:at] + b"\xaa" * 40 + z[at + 40 :], True, (at, at + 40))
    c = np.array(found.cells, dtype=np.uint32)
    assert found.discontinuities == 1 and C.is_known(c).mean() > 0.5
    first = c[: np.flatnonzero(C.is_marker(c))[0]]
    assert data.startswith(C.plain_text(first))
    last = c[np.flatnonzero(C.is_marker(c))[-1] + 1 :]
    there = np.frombuffer(data[len(data) - len(last) :], np.uint8)
    known = C.is_known(last)
    assert ((last & 0xFF)[known] == there[known]).all()


def test_chain_from_the_end():
    data = text(20_000)
    z = pack(data, flush=6000)
    chain = D.find_chain(z, 0, len(z) * 8)
    assert [c[:2] for c in chain] == [(p.start, p.end) for p in D.recover_blocks(z)]
    later = D.find_chain(z, 8 * 2000, len(z) * 8)
    # where a stored block begins isn't sure without the one before it
    assert later[1:] == chain[len(chain) - len(later) + 1 :] and len(later) > 2


def test_nothing_to_decode():
    assert D.recover(b"").cells == [] and not D.recover(b"\xff\xff\xff\xff").complete
    assert D.find_chain(b"", 0, 0) == [] and len(D.candidates(b"abc", 0, 24)) >= 0


def test_listing_marks(spark):
    rows = spark.createDataFrame([(1, 10, 10), (2, 10, 7)], "id long, bytes long, known long")
    assert sorted((r.id or 0, r.bytes, r.known, r.mark) for r in D.listing(rows).collect()) == [(0, 20, 17, "-"), (1, 10, 10, "+"), (2, 10, 7, "-")]


def test_histogram_of_whole_documents(spark, tmp_path):
    """zlib ends a block after 16,383 symbols: 40,000 characters with few repetitions take three, 20,000 two."""
    from tidewrack.plans import catalog

    rng = random.Random(3)
    texts = ["".join(chr(rng.randrange(33, 127)) for _ in range(n)) for n in (40_000, 20_000, 20_000, 500)]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    found = catalog.QUERIES["packet_histogram"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, found)) == [(1, 1), (2, 2), (3, 1)]


def _flushed(bodies):
    c = zlib.compressobj(6, zlib.DEFLATED, -15)
    return [c.compress(x) + c.flush(zlib.Z_FULL_FLUSH) for x in bodies] + [c.flush()]


def test_a_block_that_ends_within_the_damage_is_not_read_on():
    """The codes known before the damage say nothing about the block behind it."""
    words = [f"word{k * 7919 % 997} ".encode() for k in range(4000)]
    for shift in range(0, 60, 4):
        first, second = b"".join(words[:1500]), b"".join(reversed(words[1500:]))
        parts = _flushed([first, second])
        packed = b"".join(parts)
        lo = len(parts[0]) - 64 + shift
        damaged = packed[:lo] + b"\xaa" * 64 + packed[lo + 64 :]
        found = np.array(D.recover(damaged, True, (lo, lo + 64)).cells, dtype="<u4")
        tail = found[np.flatnonzero(C.is_marker(found))[-1] + 1 :] if C.is_marker(found).any() else found[:0]
        there = np.frombuffer(first + second, dtype=np.uint8)
        there = there[len(there) - len(tail) :]
        assert ((tail & 0xFF) == there)[C.is_known(tail)].all()


def test_fixed_blocks_behind_a_flush_are_found():
    parts = _flushed([b"a text whose head is lost " * 9, b"short", b"and this"])
    found = np.array(D.recover(b"".join(parts)[5:], False).cells, dtype="<u4")
    assert C.plain_text(found).endswith(b"shortand this")


@pytest.mark.parametrize("bodies", [[b"one text, " * 3 + bytes(range(97, 123))], [b"x" * 40_000, b"abc def"], [b"abc def ghi jkl" * 3, b"y" * 40_000], [b""], [b"a"]])
@pytest.mark.parametrize("turn", [0, 1, 2])
def test_damage_leaves_a_fifth(bodies, turn):
    from tidewrack.plans import catalog

    body, known, lo, hi, _, whole = catalog._damage(bodies, turn)
    found = np.array(D.recover(body, known, None if lo is None else (lo, hi)).cells, dtype="<u4")
    assert C.is_known(found).sum() * 5 >= len(whole)


def test_blocks_by_zlib_are_the_kernels():
    r = random.Random(3)
    text = " ".join(r.choice(["one", "two", "three", "seventeen", str(r.random())]) for _ in range(60_000)).encode()
    streams = [pack(text[:n], level) for n in (0, 1, 5, 40, 3000, 200_000, len(text)) for level in (0, 1, 6, 9)]
    streams += [pack(text[:5000], flush=700), pack(text[:9000], strategy=zlib.Z_FIXED), pack(bytes(r.randrange(256) for _ in range(90_000)))]
    for x in streams:
        found = D._whole_blocks(x)
        assert found == D._decoded_blocks(x) and found[-1].final
    assert D._whole_blocks(streams[8][:-20]) is None and D._whole_blocks(b"") is None
    assert D.recover_blocks(streams[-1][:-20]) == D._decoded_blocks(streams[-1][:-20])
