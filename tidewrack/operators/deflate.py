"""DEFLATE decoding of whole and of damaged streams.

Whole streams go through zlib. Where it stops, the own kernel decodes bit by bit
with lookup tables, so that it can start in the middle: what is copied from
before a segment's start becomes co-indices instead of bytes. After damage it
looks for the next place where a block can begin (a vectorised test of all bit
offsets leaves few to decode) or, with the block's codes known, decodes on from
all offsets after the damage until they agree.

Spans are independent of each other: the DataFrame operators are maps.
"""

from __future__ import annotations

import ctypes
import functools
import heapq
import zlib
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import cells as C
from ..functions.native import byte_slices

LENGTH_ORDER = bytes.fromhex("10111200080709060a050b040c030d020e010f")
LENGTHS = [(3 + i, 0) for i in range(8)] + [((4 + i % 4 << i // 4 - 1) + 3, i // 4 - 1) for i in range(8, 28)] + [(258, 0)]
DISTANCES = [(1 + i, 0) for i in range(4)] + [((2 + i % 2 << i // 2 - 1) + 1, i // 2 - 1) for i in range(4, 32)]
#: the last length code of Deflate64 has 16 more bits
LONG_LENGTHS = [*LENGTHS[:-1], (3, 16)]
#: a fixed-code block this short is taken for chance unless it is the whole span
LEAST_FIXED = 3072
SEARCH_LIMIT = 2 * 1024 * 1024 * 8
RESYNC_STARTS = 48
LEAST_STEP = 20


class Damaged(Exception):
    """Decoding can't go on. at: the bit where it stopped."""

    def __init__(self, why: str, at: int):
        super().__init__(why)
        self.at = at


class Bits:
    """A body as one number a place: 32 bits from any bit on."""

    def __init__(self, data: bytes, limit: int | None = None, wide: bool = False):
        """wide: the data are Deflate64."""
        self.wide = wide
        self.data = data + b"\0" * 8
        self.limit = len(data) * 8 if limit is None else limit

    def peek(self, at: int, n: int) -> int:
        return int.from_bytes(self.data[at >> 3 : (at >> 3) + 5], "little") >> (at & 7) & (1 << n) - 1

    def take(self, at: int, n: int) -> int:
        if at + n > self.limit:
            raise Damaged("the data end", at)
        return self.peek(at, n)


class Codes:
    """Canonical codes by lookup: a table from the next bits to (symbol, length)."""

    def __init__(self, lengths: list[int]):
        self.lengths = lengths
        count = [0] * 16
        for n in lengths:
            count[n] += 1
        count[0] = 0
        self.longest = max((n for n in range(16) if count[n]), default=0)
        left = 1
        for n in range(1, 16):
            left = left * 2 - count[n]
            if left < 0:
                raise ValueError("too many codes")
        self.complete = left == 0
        code, first = 0, [0] * 16
        for n in range(1, 16):
            code = code + count[n - 1] << 1
            first[n] = code
        size = 1 << self.longest
        self.table: list[int] = [-1] * size
        self.codes: dict[int, tuple[int, int]] = {}
        for symbol, n in enumerate(lengths):
            if not n:
                continue
            c = first[n]
            first[n] += 1
            reverse = int(format(c, f"0{n}b")[::-1], 2)
            self.codes[symbol] = (reverse, n)
            for i in range(reverse, size, 1 << n):
                self.table[i] = symbol << 4 | n

    def next(self, bits: Bits, at: int) -> tuple[int, int]:
        """The symbol at a place, and the place behind it."""
        entry = self.table[bits.peek(at, self.longest)] if self.longest else -1
        if entry < 0 or at + (entry & 15) > bits.limit:
            raise Damaged("no code", at)
        return entry >> 4, at + (entry & 15)


FIXED = (Codes([8] * 144 + [9] * 112 + [7] * 24 + [8] * 8), Codes([5] * 32))


@dataclass
class Header:
    final: bool
    kind: int
    body: int  # the bit where the body begins
    literals: Codes | None = None
    distances: Codes | None = None
    size: int = 0  # of a stored block


def read_header(bits: Bits, at: int) -> Header:
    """The head of a block; Damaged where it can't be one."""
    final, kind = bits.take(at, 1), bits.take(at + 1, 2)
    if kind == 0:
        body = at + 3 + 7 & ~7
        size, check = bits.take(body, 16), bits.take(body + 16, 16)
        if size ^ check != 0xFFFF:
            raise Damaged("a stored block's size is wrong", at)
        if body + 32 + size * 8 > bits.limit:
            raise Damaged("a stored block runs past the end", at)
        return Header(bool(final), 0, body + 32, size=size)
    if kind == 1:
        return Header(bool(final), 1, at + 3, *FIXED)
    if kind == 3:
        raise Damaged("no such block", at)
    n_literals, n_distances, n_lengths = bits.take(at + 3, 5) + 257, bits.take(at + 8, 5) + 1, bits.take(at + 13, 4) + 4
    if n_literals > 286 or n_distances > (32 if bits.wide else 30):
        raise Damaged("too many codes", at)
    lengths = [0] * 19
    p = at + 17
    for i in range(n_lengths):
        lengths[LENGTH_ORDER[i]] = bits.take(p, 3)
        p += 3
    try:
        codes = Codes(lengths)
        found: list[int] = []
        while len(found) < n_literals + n_distances:
            symbol, p = codes.next(bits, p)
            if symbol < 16:
                found.append(symbol)
            elif symbol == 16:
                if not found:
                    raise ValueError("nothing to repeat")
                found += [found[-1]] * (3 + bits.take(p, 2))
                p += 2
            elif symbol == 17:
                found += [0] * (3 + bits.take(p, 3))
                p += 3
            else:
                found += [0] * (11 + bits.take(p, 7))
                p += 7
        if len(found) > n_literals + n_distances or not found[256]:
            raise ValueError("no end of block")
        literals = Codes(found[:n_literals])
        distances = Codes(found[n_literals:])
        if not literals.complete and sum(1 for n in found[:n_literals] if n) > 1:
            raise ValueError("codes are missing")
        if not distances.complete and sum(1 for n in found[n_literals:] if n) > 1:
            raise ValueError("codes are missing")
    except ValueError as e:
        raise Damaged(str(e), at) from None
    return Header(bool(final), 2, p, literals, distances)


def valid_header(data: bytes, at: int, fixed: bool = True) -> bool:
    """Whether a block can begin at a bit: its head, and the first symbols of a fixed one."""
    bits = Bits(data[at >> 3 : (at >> 3) + 500])
    try:
        head = read_header(bits, at & 7)
        if head.kind == 1:
            if not fixed:
                return False
            made = 0
            p = head.body
            while made < 100:
                symbol, p = head.literals.next(bits, p)
                if symbol == 256:
                    return True
                if symbol > 285:
                    return False
                if symbol < 256:
                    made += 1
                else:
                    length, p, distance = _match(bits, head, symbol, p)
                    if distance > made:
                        return False
                    made += length
        return True
    except Damaged as e:
        return str(e) in ("the data end", "a stored block runs past the end") and len(bits.data) >= 508


def _match(bits: Bits, head: Header, symbol: int, at: int) -> tuple[int, int, int]:
    """Length, place behind, and distance of the copy whose length symbol was read."""
    length, extra = (LONG_LENGTHS if bits.wide else LENGTHS)[symbol - 257]
    if extra:
        length += bits.take(at, extra)
        at += extra
    symbol, at = head.distances.next(bits, at)
    if symbol > (31 if bits.wide else 29):
        raise Damaged("no such distance", at)
    distance, extra = DISTANCES[symbol]
    if extra:
        distance += bits.take(at, extra)
        at += extra
    return length, at, distance


@dataclass
class Packet:
    """A block: where it and its body begin and end, in bits, and what it held."""

    start: int
    body: int
    end: int
    kind: int
    final: bool
    offset: int = 0
    size: int = 0
    corrupt_from: int | None = None
    corrupt_to: int | None = None


@dataclass
class Decoded:
    """cells of all segments, a marker between them; packets; discontinuities."""

    cells: list[int] = field(default_factory=list)
    packets: list[Packet] = field(default_factory=list)
    discontinuities: int = 0
    complete: bool = False


class _Segment:
    """Cells of one segment: copies from before its start are co-indices unless the start is the stream's."""

    def __init__(self, number: int, known: bool, window: int = C.WINDOW):
        self.cells: list[int] = []
        self.number, self.known, self.window = number, known, window

    def copy(self, length: int, distance: int, at: int) -> None:
        if distance > self.window:
            raise Damaged("too far back", at)
        out = self.cells
        start = len(out) - distance
        if start < 0 and self.known:
            raise Damaged("before the start", at)
        for i in range(start, start + length):
            out.append(out[i] if i >= 0 else self.number * self.window - i)


def decode_block(bits: Bits, at: int, segment: _Segment, until: int | None = None) -> Packet:
    """Decodes the block at a bit into the segment. until: a bit of the body to stop before."""
    head = read_header(bits, at)
    return _body(bits, at, head, head.body, segment, until)


def _body(bits: Bits, start: int, head: Header, p: int, segment: _Segment, until: int | None = None) -> Packet:
    first = len(segment.cells)
    if head.kind == 0:
        a = p >> 3
        segment.cells += [C.LITERAL | b for b in bits.data[a : a + head.size]]
        return Packet(start, p, p + head.size * 8, 0, head.final, first, head.size)
    # the hot loop: one look at the data a symbol, enough bits for a whole copy
    out, data, limit, window = segment.cells, bits.data, bits.limit, segment.window
    table, mask = head.literals.table, (1 << head.literals.longest) - 1
    distant, far = head.distances.table, (1 << head.distances.longest) - 1
    lengths, symbols, reach = LONG_LENGTHS if bits.wide else LENGTHS, 31 if bits.wide else 29, 9 if bits.wide else 8
    number, append, literal = int.from_bytes, out.append, C.LITERAL
    stop = limit + 64 if until is None else until
    while p < stop:
        at = p >> 3
        v = number(data[at : at + reach], "little") >> (p & 7)
        entry = table[v & mask]
        n = entry & 15
        q = p + n
        if entry < 0 or q > limit:
            raise Damaged("no code", p)
        symbol = entry >> 4
        if symbol < 256:
            if q > stop:
                break
            append(literal | symbol)
            p = q
            continue
        if symbol == 256:
            if q > stop:
                break
            return Packet(start, head.body, q, head.kind, head.final, first, len(out) - first)
        if symbol > 285:
            raise Damaged("no such length", p)
        length, extra = lengths[symbol - 257]
        v >>= n
        if extra:
            if q + extra > limit:
                raise Damaged("the data end", q)
            length += v & (1 << extra) - 1
            v >>= extra
            q += extra
        entry = distant[v & far]
        n = entry & 15
        if entry < 0 or q + n > limit:
            raise Damaged("no code", q)
        q += n
        symbol = entry >> 4
        if symbol > symbols:
            raise Damaged("no such distance", q)
        distance, extra = DISTANCES[symbol]
        if extra:
            if q + extra > limit:
                raise Damaged("the data end", q)
            distance += v >> n & (1 << extra) - 1
            q += extra
        if q > stop:
            break
        source = len(out) - distance
        if source < 0 or distance > window:
            segment.copy(length, distance, p)
        elif distance >= length:
            out += out[source : source + length]
        else:
            out += (out[source:] * (length // distance + 1))[:length]
        p = q
    raise Damaged("corruption", until if until is not None else p)


def candidates(data: bytes, start: int, end: int) -> np.ndarray:
    """The bits from start to end where the head of a dynamic block can be: kind, counts and the sum of the code-length codes."""
    lo, hi = start >> 3, min(len(data), (end >> 3) + 16)
    if hi <= lo:
        return np.zeros(0, dtype=np.int64)
    a = np.frombuffer(data[lo:hi] + b"\0" * 16, dtype=np.uint8).astype(np.uint64)
    words = np.zeros(len(a) - 15, dtype=np.uint64)
    for i in range(8):
        words |= a[i : i + len(words)] << np.uint64(8 * i)
    more = a[8 : 8 + len(words)]
    out = []
    for bit in range(8):
        w = words >> np.uint64(bit)
        ok = ((w >> np.uint64(1) & np.uint64(3)) == 2) & ((w >> np.uint64(3) & np.uint64(31)) <= 29) & ((w >> np.uint64(8) & np.uint64(31)) <= 29)
        p = np.flatnonzero(ok)
        if not len(p):
            continue
        x, y = words[p], more[p] | a[9 : 9 + len(words)][p] << np.uint64(8) | a[10 : 10 + len(words)][p] << np.uint64(16)
        n = (x >> np.uint64(13 + bit) & np.uint64(15)).astype(np.int64) + 4
        total = np.zeros(len(p), dtype=np.int64)
        for i in range(19):
            s = 17 + bit + 3 * i
            if s + 3 <= 64:
                v = x >> np.uint64(s) & np.uint64(7)
            elif s >= 64:
                v = y >> np.uint64(s - 64) & np.uint64(7)
            else:
                v = (x >> np.uint64(s) | y << np.uint64(64 - s)) & np.uint64(7)
            v = v.astype(np.int64)
            total += np.where((i < n) & (v > 0), 128 >> v, 0)
        out.append((p[total == 128] + lo) * 8 + bit)
    found = np.sort(np.concatenate(out)) if out else np.zeros(0, dtype=np.int64)
    return found[(found >= start) & (found < end)]


def block_edges(data: bytes, start: int, end: int) -> list[tuple[int, int, bool, int]]:
    """(start, end, final, kind) of every block that decodes within the bits: dynamic ones anywhere, stored ones at sound sizes."""
    bits = Bits(data, end)
    edges = []
    for at in candidates(data, start, end).tolist():
        try:
            packet = decode_block(bits, at, _Segment(0, False))
        except Damaged:
            continue
        edges.append((packet.start, packet.end, packet.final, 2))
    lo, hi = start >> 3, end >> 3
    a = np.frombuffer(data[lo:hi], dtype=np.uint8)
    if len(a) >= 5:  # stored blocks: a size beside its complement, zeros from the head to it
        sound = (a[:-3] ^ a[2:-1] == 255) & (a[1:-2] ^ a[3:] == 255)
        for p in np.flatnonzero(sound).tolist():
            at = (p + lo) * 8
            stop = at + 32 + (data[p + lo] | data[p + lo + 1] << 8) * 8
            for head in range(max(start, at - 10), at - 2):
                if stop <= end and bits.peek(head + 1, 2) == 0 and (head + 3 == at or bits.peek(head + 3, at - head - 3) == 0):
                    edges.append((head, stop, bool(bits.peek(head, 1)), 0))
    for at in range(max(start, end - 128), end - 9):  # a short fixed block is taken for real at the end alone
        try:
            head = read_header(bits, at)
            if head.kind == 1 and head.final:
                packet = _body(bits, at, head, head.body, _Segment(0, False))
                if end - packet.end < 8:
                    edges.append((at, packet.end, True, 1))
        except Damaged:
            continue
    return edges


def find_chain(data: bytes, start: int, end: int) -> list[tuple[int, int, bool, int]]:
    """The blocks from a chain that ends at the end with the final one: from there back, always the nearest start.

    The end may be up to 7 bits before a byte's. Blocks before the chain's first
    are left out.
    """
    by_end: dict[int, tuple[int, int, bool, int]] = {}
    edges = block_edges(data, start, end)
    ends = {e[1] for e in edges} | {start}
    for e in edges:
        if e[1] not in by_end or (by_end[e[1]][0] in ends, by_end[e[1]][0]) < (e[0] in ends, e[0]):
            by_end[e[1]] = e
    chain: list[tuple[int, int, bool, int]] = []
    at = next((x for x in range(end, max(start, end - 8), -1) if x in by_end and by_end[x][2]), None)
    while at is not None and at in by_end:
        e = by_end[at]
        if chain and e[2] or e[0] >= e[1] or e[3] == 2 and e[1] - e[0] < LEAST_STEP:
            break
        chain.append(e)
        at = e[0]
    return chain[::-1]


SYNC_MARK = b"\0\0\xff\xff"


def marked_starts(data: bytes, start: int, end: int) -> list[int]:
    """The bits from start to end behind an empty stored block, as a flush leaves it: a block of any kind begins there."""
    found, p = [], data.find(SYNC_MARK, max(0, (start >> 3) - 4))
    while p >= 0 and (p + 4) * 8 < end:
        if (p + 4) * 8 >= start:
            found.append((p + 4) * 8)
        p = data.find(SYNC_MARK, p + 1)
    return found


def next_block(data: bytes, bits: Bits, after: int, until: int | None = None) -> int | None:
    """The first bit behind after (and before until) where a block decodes to its end and something can follow it: a dynamic one anywhere, others behind a flush."""
    step = 64 * 1024 * 8
    stop = bits.limit if until is None else min(bits.limit, until)
    for lo in range(after, min(stop, after + SEARCH_LIMIT), step):
        hi = min(lo + step, stop)
        for at in sorted({*candidates(data, lo, hi).tolist(), *marked_starts(data, lo, hi)}):
            try:
                packet = decode_block(bits, at, _Segment(0, False))
                if packet.final or packet.end + 3 > bits.limit or bits.peek(packet.end + 1, 2) == 3:
                    if packet.final and bits.limit - packet.end < 64:
                        return at
                    continue
                read_header(bits, packet.end)
                return at
            except Damaged:
                continue
    return None


def continued(bits: Bits, at: int, final: bool) -> bool:
    """Whether a block that ends at a bit is followed by what no chance makes: the data's end, a stored or a dynamic block's head; fixed ones must decode."""
    while True:
        if final or at + 3 > bits.limit:
            return bool(final) and bits.limit - at < 64
        try:
            head = read_header(bits, at)
            if head.kind != 1:
                return True
            packet = _body(bits, at, head, head.body, _Segment(0, False))
        except Damaged:
            return False
        at, final = packet.end, packet.final


def reads_on(before: list[int], behind: list[int], codes: Codes) -> bool:
    """Whether cells that were read with a block's codes go on like those before, by their pairs of bytes.

    Bits of another block, read with these codes, give bytes as often as the
    codes' lengths say, each whatever the last one was. The pairs before must
    make those behind a thousand times likelier than that.
    """
    if not behind:
        return True
    old, new = np.array(before[-200_000:], dtype=np.uint32), np.array(behind, dtype=np.uint32)
    pairs = lambda c: ((c[:-1] & 0xFF) << 8 | c[1:] & 0xFF)[C.is_known(c[:-1]) & C.is_known(c[1:])].astype(np.int64)
    counts = np.bincount(pairs(old), minlength=65536).reshape(256, 256).astype(np.float64)
    chance = np.array([2.0 ** -(n or 15) for n in (codes.lengths + [0] * 256)[:256]])
    likely = (counts + 8 * chance) / (counts.sum(1, keepdims=True) + 8)
    return float(np.log2(likely / chance).ravel()[pairs(new)].sum()) > 10


def resynchronise(bits: Bits, head: Header, after: int, limit: int) -> int | None:
    """Where the decoders that start at each of the bits behind after agree, or none.

    The one furthest behind goes on; those at one place are one; the last one
    left is in step with the encoder. Those that meet no code are dropped.
    """
    heap = list(range(after, min(after + RESYNC_STARTS, limit)))
    heapq.heapify(heap)
    seen = set(heap)
    while len(heap) > 1:
        at = heapq.heappop(heap)
        seen.discard(at)
        try:
            symbol, p = head.literals.next(bits, at)
            if symbol == 256 or symbol > 285:
                continue
            if symbol > 256:
                _, p, _ = _match(bits, head, symbol, p)
        except Damaged:
            continue
        if p < limit and p not in seen:
            seen.add(p)
            heapq.heappush(heap, p)
    return heap[0] if heap else None


def recover(data: bytes, known_start: bool = True, corrupt: tuple[int, int] | None = None, deflate64: bool = False) -> Decoded:
    """Decodes a raw DEFLATE (or Deflate64) stream as far as it goes. corrupt: bytes (from, to) known to be wrong.

    A break gives a marker, and a segment of its own to what follows; co-indices
    of segment k begin at k windows.
    """
    if known_start and corrupt is None and not deflate64:
        whole = _intact(data)
        if whole is not None:
            return Decoded([C.LITERAL | b for b in whole], [], 0, True)
    bits = Bits(data, wide=deflate64)
    window = 2 * C.WINDOW if deflate64 else C.WINDOW
    out = Decoded()
    bad = None if corrupt is None else (corrupt[0] * 8, corrupt[1] * 8)
    segment = _Segment(0, known_start, window)
    at: int | None = 0 if known_start else next_block(data, bits, 0)
    if not known_start:
        out.discontinuities = 1

    def close() -> None:
        nonlocal segment
        out.cells += segment.cells
        out.cells.append(C.DISCONTINUITY)
        out.discontinuities += 1
        segment = _Segment(out.discontinuities if known_start else out.discontinuities - 1, False, window)

    while at is not None and at < bits.limit:
        try:
            if bad and bad[0] <= at < bad[1]:
                raise Damaged("corruption", at)
            head = read_header(bits, at)
            until = bad[0] if bad and head.body <= bad[0] else None
            base = len(out.cells)
            packet = _body(bits, at, head, head.body, segment, until)
            packet.offset += base
            out.packets.append(packet)
            if packet.final:
                out.complete = out.discontinuities == 0
                break
            at = packet.end
        except Damaged as e:
            error = max(e.at, at + 1)
            if bad and bad[0] <= error < bad[1] and e.args[0] == "corruption" and error > at + 17:
                # the codes are known: go on in the same block, unless that had ended by then
                resumed = resynchronise(bits, head, bad[1], bits.limit)
                close()
                packet, reach = None, bits.limit
                if resumed is not None:
                    try:
                        base = len(out.cells)
                        packet = _body(bits, at, head, resumed, segment)
                        reach = packet.end
                    except Damaged as again:
                        reach = again.at
                other = next_block(data, bits, bad[1], reach)
                sure = other is None and resumed is not None and reads_on(out.cells, segment.cells, head.literals)
                if sure and packet is not None and continued(bits, packet.end, packet.final):
                    packet.offset += base
                    packet.corrupt_from, packet.corrupt_to = bad[0] >> 3, bad[1] >> 3
                    out.packets.append(packet)
                    bad = None
                    if packet.final:
                        break
                    at = packet.end
                    continue
                if sure and packet is None and reach + 48 >= bits.limit:
                    break  # the data end within the block
                # what was read with codes that were over isn't known
                segment.cells.clear()
                bad = None
                at = other if other is not None else next_block(data, bits, max(error, reach))
                continue
            close()
            at = next_block(data, bits, at + 1 if error <= at else max(at + 1, error - 8 * 1024))
    out.cells += segment.cells
    while out.cells and out.cells[-1] == C.DISCONTINUITY:
        out.cells.pop()
    return out


def _intact(data: bytes) -> bytes | None:
    """What a whole stream decodes to."""
    d = zlib.decompressobj(-15)
    try:
        found = d.decompress(data) + d.flush()
    except zlib.error:
        return None
    return found if d.eof else None


# ---- DataFrame operators


def deflated(bodies: DataFrame, level: int = 6) -> DataFrame:
    """(id, body, original) of (id, body): the body as a raw DEFLATE stream. For fixtures and writers."""
    import pyarrow as pa

    def run(batches):
        for b in byte_slices(batches, "body"):
            packed = []
            for x in b.column("body").to_pylist():
                c = zlib.compressobj(level, zlib.DEFLATED, -15)
                packed.append(c.compress(x or b"") + c.flush())
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(packed, pa.binary()), b.column("body")], ["id", "body", "original"])

    return bodies.select("id", "body").mapInArrow(run, f"id {bodies.schema['id'].dataType.simpleString()}, body binary, original binary")


def decoded(streams: DataFrame) -> DataFrame:
    """(id, cells, bytes, known, unknown, discontinuities, blocks, complete) of raw DEFLATE streams.

    Columns known_start (default true), corrupt_from and corrupt_to (bytes), and
    deflate64 are used where they are there. cells are packed 32-bit numbers; a null body has
    none.
    """
    import pyarrow as pa

    columns = [c for c in ("known_start", "corrupt_from", "corrupt_to", "deflate64") if c in streams.columns]

    def run(batches):
        for b in byte_slices(batches, "body"):
            rows = []
            extra = {c: b.column(c).to_pylist() for c in columns}
            for i, body in enumerate(b.column("body").to_pylist()):
                known = extra["known_start"][i] if "known_start" in extra else True
                bad = None
                if "corrupt_from" in extra and extra["corrupt_from"][i] is not None:
                    bad = (extra["corrupt_from"][i], extra["corrupt_to"][i])
                wide = "deflate64" in extra and bool(extra["deflate64"][i])
                whole = _intact(body) if known and bad is None and not wide and body is not None else None
                if whole is not None:
                    rows.append(((np.frombuffer(whole, dtype=np.uint8) | np.uint32(C.LITERAL)).astype("<u4").tobytes(), len(whole), len(whole), 0, 0, 0, True))
                    continue
                d = recover(body, bool(known), bad, wide) if body is not None else Decoded()
                cells = np.array(d.cells, dtype="<u4")
                unknown = int(C.is_unknown(cells).sum())
                size = len(cells) - int(C.is_marker(cells).sum())
                rows.append((cells.tobytes(), size, size - unknown, unknown, d.discontinuities, len(d.packets), d.complete))
            kinds = [pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_()]
            names = ["cells", "bytes", "known", "unknown", "discontinuities", "blocks", "complete"]
            yield pa.RecordBatch.from_arrays([b.column("id"), *(pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds))], ["id", *names])

    kind = streams.schema["id"].dataType.simpleString()
    return streams.select("id", "body", *columns).mapInArrow(run, f"id {kind}, cells binary, bytes long, known long, unknown long, discontinuities int, blocks int, complete boolean")


def literal_cells(bodies: DataFrame) -> DataFrame:
    """(id, cells, bytes, known, unknown, discontinuities, complete) of bodies (id, body) that weren't compressed."""
    import pyarrow as pa

    def run(batches):
        for b in byte_slices(batches, "body"):
            found = [(np.frombuffer(x or b"", dtype=np.uint8).astype("<u4") | np.uint32(C.LITERAL)).tobytes() for x in b.column("body").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(found, pa.binary())], ["id", "cells"])

    kind = bodies.schema["id"].dataType.simpleString()
    made = bodies.select("id", "body").mapInArrow(run, f"id {kind}, cells binary")
    size = (F.length("cells") / 4).cast("long")
    return made.select("id", "cells", size.alias("bytes"), size.alias("known"), F.lit(0).cast("long").alias("unknown"), F.lit(0).alias("discontinuities"), F.lit(True).alias("complete"))


def packets(streams: DataFrame) -> DataFrame:
    """(id, packet_no, start_bit, body_bit, end_bit, kind, final, offset, size) of the blocks of raw DEFLATE streams (id, body)."""
    import pyarrow as pa

    def run(batches):
        for b in byte_slices(batches, "body"):
            ids, rows = [], []
            for i, body in zip(b.column("id").to_pylist(), b.column("body").to_pylist()):
                found = recover_blocks(body or b"")
                ids += [i] * len(found)
                rows += [(k, p.start, p.body, p.end, p.kind, p.final, p.offset, p.size) for k, p in enumerate(found)]
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.int64(), pa.int64()]
            names = ["packet_no", "start_bit", "body_bit", "end_bit", "kind", "final", "offset", "size"]
            yield pa.RecordBatch.from_arrays([pa.array(ids, b.column("id").type), *(pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds))], ["id", *names])

    kind = streams.schema["id"].dataType.simpleString()
    return streams.select("id", "body").mapInArrow(run, f"id {kind}, packet_no int, start_bit long, body_bit long, end_bit long, kind int, final boolean, offset long, size long")


def checkpoints(data: bytes, step: int = 64) -> list[tuple[int, int]]:
    """(position, bit): for every step of decoded bytes, the bit from which the first symbol at or behind it is read; the last is the end."""
    bits, at, made, found = Bits(data), 0, 0, []
    while at < bits.limit:
        try:
            head = read_header(bits, at)
            if head.kind == 0:
                for k in range(-(-made // step) * step, made + head.size, step):
                    found.append((k, head.body + (k - made) * 8))
                made, p = made + head.size, head.body + head.size * 8
            else:
                p = head.body
                while True:
                    if made >= (found[-1][0] + step if found else 0):
                        found.append((made // step * step, p))
                    symbol, p = head.literals.next(bits, p)
                    if symbol == 256:
                        break
                    if symbol > 285:
                        raise Damaged("no such length", p)
                    if symbol < 256:
                        made += 1
                    else:
                        length, p, _ = _match(bits, head, symbol, p)
                        made += length
            at = p
        except Damaged as e:
            at = max(at, min(e.at, bits.limit))
            break
        if head.final:
            break
    return [*found, (made, at)]


def stream_checkpoints(streams: DataFrame, step: int = 64) -> DataFrame:
    """(id, pos, bit) of raw DEFLATE streams (id, body): where in the stream decoded bytes come from, see checkpoints()."""
    import pyarrow as pa

    def run(batches):
        for b in byte_slices(batches, "body"):
            ids, rows = [], []
            for i, body in zip(b.column("id").to_pylist(), b.column("body").to_pylist()):
                found = checkpoints(body or b"", step)
                ids += [i] * len(found)
                rows += found
            yield pa.RecordBatch.from_arrays([pa.array(ids, b.column("id").type), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64())], ["id", "pos", "bit"])

    return streams.select("id", "body").mapInArrow(run, f"id {streams.schema['id'].dataType.simpleString()}, pos long, bit long")


def corrupt_bytes(ranges: DataFrame, places: DataFrame) -> DataFrame:
    """(id, corrupt_from, corrupt_to): the bytes of a stream behind the first corrupt range (id, start, end) of what it decodes to, by checkpoints (id, pos, bit)."""
    first = ranges.groupBy("id").agg(F.min_by("end", "start").alias("_end"), F.min("start").alias("_start"))
    both = places.join(first, "id")
    return both.groupBy("id").agg(
        F.floor(F.max(F.when(F.col("pos") <= F.col("_start"), F.col("bit"))) / 8).cast("long").alias("corrupt_from"),
        F.ceil(F.coalesce(F.min(F.when(F.col("pos") >= F.col("_end"), F.col("bit"))), F.max("bit")) / 8).cast("long").alias("corrupt_to"),
    )


def stage_counts(streams: DataFrame) -> DataFrame:
    """(metric, value): how many places of streams (id, body) pass each stage of the block search."""
    import pyarrow as pa
    from collections import Counter

    def run(batches):
        counts: Counter = Counter()
        for b in byte_slices(batches, "body"):
            for body in b.column("body").to_pylist():
                bits = Bits(body or b"")
                for at in candidates(body or b"", 0, bits.limit).tolist():
                    counts["candidate_dynhuff_packet"] += 1
                    try:
                        head = read_header(bits, at)
                        counts["valid_huffman_tree"] += 1
                        _body(bits, at, head, head.body, _Segment(0, False))
                        counts["valid_EOD_marker"] += 1
                    except Damaged as e:
                        counts["invalid_bit_lengths" if "codes" in str(e) else "invalid_bitlength_tree" if "repeat" in str(e) else "no_end_of_block"] += 1
                for p in recover_blocks(body or b""):
                    counts[("valid_uncomp_packet", "valid_fixed_packet", "valid_dynhuff_packet")[p.kind]] += 1
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["metric", "value"])

    return streams.select("body").mapInArrow(run, "metric string, value long").groupBy("metric").agg(F.sum("value").alias("value"))


class _ZStream(ctypes.Structure):
    """zlib's z_stream."""

    _fields_ = [
        ("next_in", ctypes.c_char_p), ("avail_in", ctypes.c_uint), ("total_in", ctypes.c_ulong),
        ("next_out", ctypes.c_void_p), ("avail_out", ctypes.c_uint), ("total_out", ctypes.c_ulong),
        ("msg", ctypes.c_char_p), ("state", ctypes.c_void_p), ("zalloc", ctypes.c_void_p), ("zfree", ctypes.c_void_p), ("opaque", ctypes.c_void_p),
        ("data_type", ctypes.c_int), ("adler", ctypes.c_ulong), ("reserved", ctypes.c_ulong),
    ]


@functools.cache
def _zlib():
    """zlib as a library, whose inflate stops at heads and ends of blocks (the module's doesn't); none where it isn't there."""
    try:
        z = ctypes.CDLL("libz.so.1")
        z.zlibVersion.restype = ctypes.c_char_p
        return z
    except (OSError, AttributeError):
        return None


def _whole_blocks(data: bytes) -> list[Packet] | None:
    """The blocks of a whole stream, by zlib; none where that isn't there or the stream isn't whole."""
    z = _zlib()
    if z is None:
        return None
    s, room = _ZStream(), ctypes.create_string_buffer(65536)
    if z.inflateInit2_(ctypes.byref(s), -15, z.zlibVersion(), ctypes.sizeof(s)) != 0:
        return None
    try:
        s.next_in, s.avail_in = data, len(data)
        found: list[Packet] = []
        start, body, offset, idle = 0, None, 0, 0
        while True:
            s.next_out, s.avail_out = ctypes.addressof(room), len(room)
            before = s.total_in, s.total_out, s.data_type
            said = z.inflate(ctypes.byref(s), 6)  # Z_TREES: up to the next head's or block's end
            at = s.total_in * 8 - (s.data_type & 63)
            if said not in (0, 1, -5):
                return None
            if s.data_type & 256 and body is None:
                body = at
            elif said == 1 or s.data_type & 128 and (body is not None):
                head = data[start >> 3] | (data[start + 2 >> 3] << 8 if start + 2 >> 3 > start >> 3 else 0)
                head >>= start & 7
                found.append(Packet(start, body, at, head >> 1 & 3, bool(head & 1), offset, s.total_out - offset))
                if head & 1:
                    return found
                start, body, offset = at, None, s.total_out
            idle = idle + 1 if before == (s.total_in, s.total_out, s.data_type) else 0
            if idle > 1:
                return None
    finally:
        z.inflateEnd(ctypes.byref(s))


def recover_blocks(data: bytes) -> list[Packet]:
    """The blocks of a stream from its start, up to the final one or the first that doesn't decode."""
    whole = _whole_blocks(data)
    return _decoded_blocks(data) if whole is None else whole


def _decoded_blocks(data: bytes) -> list[Packet]:
    """recover_blocks by the own kernel, for streams that aren't whole."""
    bits, segment, at, found = Bits(data), _Segment(0, True), 0, []
    while at < bits.limit:
        try:
            packet = decode_block(bits, at, segment)
        except Damaged:
            break
        found.append(packet)
        if packet.final:
            break
        at = packet.end
    return found


def listing(results: DataFrame) -> DataFrame:
    """(id, bytes, known, mark) and a total row with a null id: + where all is known, else -."""
    mark = F.when(F.col("known") == F.col("bytes"), "+").otherwise("-")
    return results.rollup("id").agg(F.sum("bytes").alias("bytes"), F.sum("known").alias("known")).where((F.grouping_id() == 1) | F.col("id").isNotNull()).withColumn("mark", mark)
