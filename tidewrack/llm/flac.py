"""FLAC streams in numpy: encoding, decoding and seeking.

Frames are independent, and a seek table names where each begins, so all frames
of all streams of a slice are decoded in step: one numpy operation reads the
next Rice code of every frame. Frame headers are verified by CRC-8, frames by
CRC-16 (also in step, two bytes at a time), streams by the MD5 of their samples.
The encoder writes one channel of 8 bits; the decoder reads up to 8 channels of
up to 24 bits with every subframe type of the format.
"""

from __future__ import annotations

import hashlib
import struct

import numpy as np

BLOCK = 1024
RATE = 8000
LPC_ORDER = 4
PRECISION = 12


class FlacError(ValueError):
    """A stream that isn't FLAC, or is damaged."""


def _crc8_table() -> list[int]:
    out = []
    for i in range(256):
        for _ in range(8):
            i = (i << 1 ^ 0x07) & 0xFF if i & 0x80 else i << 1
        out.append(i)
    return out


def _crc16_table() -> np.ndarray:
    """Of two bytes at a time."""
    x = np.arange(65536, dtype=np.int64)
    for _ in range(16):
        x = np.where(x & 0x8000, (x << 1 ^ 0x8005) & 0xFFFF, x << 1)
    return x.astype(np.uint16)


CRC8, CRC16 = _crc8_table(), _crc16_table()


def crc8(data: bytes) -> int:
    c = 0
    for b in data:
        c = CRC8[c ^ b]
    return c


def crc16(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """CRC-16 of each stretch of data, all stretches in step. One of an odd size takes a zero byte in front, which changes nothing."""
    order = np.argsort(-sizes, kind="stable")
    at, n = starts[order].astype(np.int64), sizes[order].astype(np.int64)
    out = np.zeros(len(starts), dtype=np.uint16)
    odd = (n % 2).astype(bool)
    out[odd] = CRC16[data[at[odd]]]
    at = at + odd
    steps = n // 2
    active = np.searchsorted(-steps, -np.arange(int(steps.max()) if len(steps) else 0), "left")  # how many have more steps than that
    high = np.ascontiguousarray(data).astype(np.uint16)
    for i, m in enumerate(active.tolist()):
        p = at[:m] + 2 * i
        out[:m] = CRC16[out[:m] ^ (high[p] << 8 | high[p + 1])]
    back = np.empty_like(out)
    back[order] = out
    return back


def _utf8_number(n: int) -> bytes:
    """The frame number as the format codes it, like UTF-8 but longer."""
    if n < 0x80:
        return bytes([n])
    tail = []
    while True:
        tail.append(0x80 | n & 0x3F)
        n >>= 6
        lead = 6 - len(tail)
        if n < 1 << lead:
            return bytes([(0xFF << lead + 1) & 0xFF | n, *reversed(tail)])


# ---- encoding


def _fold(r: np.ndarray) -> np.ndarray:
    return r << 1 ^ r >> 31


def _rice_bits(size: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Parameter by partition and about how many bits by frame, for the sizes of residuals (frames, samples; the warm-up counted as zeros)."""
    each = size.shape[1] // parts
    sums = 2.0 * size.reshape(len(size), parts, each).sum(2, dtype=np.int64)
    k = np.clip(np.floor(np.log2(np.maximum(sums / each, 0.75))), 0, 14).astype(np.int64)
    return k, (sums / (1 << k) + each * (1 + k) + 4).sum(1)


def _lpc(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Quantised coefficients (frames, LPC_ORDER), nearest sample first, and their shifts."""
    n = x.shape[1]
    w = x * (1 - ((2 * np.arange(n) - n + 1) / (n + 1.0)) ** 2)
    r = np.stack([(w[:, : n - k] * w[:, k:]).sum(1) for k in range(LPC_ORDER + 1)], 1)
    a = r[:, np.abs(np.subtract.outer(np.arange(LPC_ORDER), np.arange(LPC_ORDER)))]
    a = a + np.eye(LPC_ORDER) * (r[:, :1, None] * 1e-4 + 1e-3)
    c = np.linalg.solve(a, r[:, 1:, None])[:, :, 0]
    top = np.maximum(np.abs(c).max(1), 1e-9)
    shift = np.clip(PRECISION - 1 - (np.floor(np.log2(top)).astype(np.int64) + 1), 0, 15)
    q = np.clip(np.rint(c * (1 << shift)[:, None]), -(1 << PRECISION - 1), (1 << PRECISION - 1) - 1).astype(np.int64)
    return q, shift


def encode(payloads: list[bytes]) -> list[bytes]:
    """A FLAC stream of each payload, its bytes (16 or more) being unsigned 8-bit samples."""
    frames: list[list[bytes]] = [[] for _ in payloads]
    samples = [np.frombuffer(p, dtype=np.uint8).astype(np.int32) - 128 for p in payloads]
    by_size: dict[int, list[tuple[int, int, int]]] = {}
    for i, x in enumerate(samples):
        frames[i] = [b""] * -(-len(x) // BLOCK)
        for f in range(len(frames[i])):
            by_size.setdefault(min(BLOCK, len(x) - f * BLOCK), []).append((i, f, f * BLOCK))
    for size, which in by_size.items():
        for at in range(0, len(which), 512):
            part = which[at : at + 512]
            x = np.stack([samples[i][s : s + size] for i, _, s in part])
            for (i, f, _), data in zip(part, _encode_frames(x, [f for _, f, _ in part])):
                frames[i][f] = data
    return [_container(x, f) for x, f in zip(samples, frames)]


def _encode_frames(x: np.ndarray, numbers: list[int]) -> list[bytes]:
    """Frames of equal size: the cheapest of a constant, fixed predictors of order 0 to 2, a linear one, or the samples as they are."""
    count, size = x.shape
    parts = 4 if size % 4 == 0 and size // 4 > LPC_ORDER else 1
    residuals, costs, params = [], [], []

    def offer(r: np.ndarray, order: int, more: int) -> None:
        r[:, :order] = 0
        k, bits = _rice_bits(np.abs(r), parts)
        residuals.append(r)
        costs.append(bits + 8 * order + more)
        params.append(k)

    one = np.diff(x, axis=1, prepend=np.int32(0))
    offer(x.copy(), 0, 0)
    offer(one.copy(), 1, 0)
    offer(np.diff(one, axis=1, prepend=np.int32(0)), 2, 0)
    linear = size > 4 * LPC_ORDER
    if linear:
        q, shift = _lpc(x)
        pred = np.zeros_like(x)
        for j in range(LPC_ORDER):
            pred[:, LPC_ORDER:] += q[:, j : j + 1].astype(np.int32) * x[:, LPC_ORDER - 1 - j : size - 1 - j]
        offer(x - (pred >> shift[:, None].astype(np.int32)), LPC_ORDER, 9 + PRECISION * LPC_ORDER)
    best = np.argmin(np.stack(costs), axis=0)
    cheapest = np.min(np.stack(costs), axis=0)
    constant = (x == x[:, :1]).all(1)
    verbatim = ~constant & (cheapest >= 8 * size)
    orders = np.where(best == 3, LPC_ORDER, best)
    rows = np.arange(count)
    u = residuals[0]
    for i in range(1, len(residuals)):
        u[best == i] = residuals[i][best == i]
    u = _fold(u)
    k = np.stack(params)[best, rows]

    heads = []
    for n in numbers:
        head = b"\xff\xf8" + bytes([7 << 4 | 4, 1 << 1]) + _utf8_number(n) + struct.pack(">H", size - 1)
        heads.append(head + bytes([crc8(head)]))
    kinds = np.where(constant, 0, np.where(verbatim, 1, np.where(best == 3, 32 + LPC_ORDER - 1, 8 + orders)))
    # the bits of the subframes, laid out in one array
    coded = ~constant & ~verbatim
    width = np.zeros((count, size), dtype=np.int32)
    kk = np.repeat(k.astype(np.int32), size // parts, axis=1)
    warm = np.arange(size)[None, :] < orders[:, None]
    rice = coded[:, None] & ~warm
    np.copyto(width, (u >> kk) + 1 + kk, where=rice)
    raw = (verbatim[:, None]) | (coded[:, None] & warm)
    width[raw] = 8
    starts_part = np.zeros((count, size), dtype=bool)
    starts_part[:, :: size // parts] = True
    # the first parameter stands behind the warm-up
    lead = np.where(starts_part, 4, 0)
    lead[:, 0] = 0
    first = np.zeros((count, size), dtype=bool)
    first[rows, orders] = True
    extra = np.where(best == 3, 9 + PRECISION * LPC_ORDER, 0) + 2 + 4 + 4
    lead = np.where(first, lead + extra[:, None], lead)
    lead[~coded] = 0
    ends = np.cumsum(width + lead, axis=1, dtype=np.int64)
    begin = ends - width
    head_bytes = np.array([len(h) for h in heads])
    total = 8 + np.where(constant, 8, ends[:, -1])
    frame_bytes = head_bytes + -(-total // 8) + 2
    offset = np.concatenate([[0], np.cumsum(frame_bytes)])
    bits = np.zeros(int(offset[-1]) * 8, dtype=np.uint8)
    sub = (offset[:-1] + head_bytes) * 8

    def put(at: np.ndarray, value: np.ndarray, n: int) -> None:
        for b in range(n):
            bits[at + b] = value >> (n - 1 - b) & 1

    put(sub + 1, kinds, 6)
    put(sub[constant] + 8, x[constant, 0] & 0xFF, 8)
    base = (sub + 8)[:, None] + begin
    put(base[raw], x[raw] & 0xFF, 8)
    if coded.any():
        c = np.flatnonzero(coded)
        after = base[c, orders[c]] - extra[c]  # behind the warm-up
        lin = best[c] == 3
        if lin.any():
            l = c[lin]
            put(after[lin], np.full(len(l), PRECISION - 1), 4)
            put(after[lin] + 4, shift[l], 5)
            for j in range(LPC_ORDER):
                put(after[lin] + 9 + j * PRECISION, q[l, j] & (1 << PRECISION) - 1, PRECISION)
        put(base[c, orders[c]] - 10, np.zeros(len(c), np.int64), 2)
        put(base[c, orders[c]] - 8, np.full(len(c), parts.bit_length() - 1), 4)
        put(base[c, orders[c]] - 4, k[c, 0], 4)
        for p in range(1, parts):
            put(base[c, p * (size // parts)] - 4, k[c, p], 4)
        at, v, kv = base[rice], u[rice], kk[rice]
        stop = at + (v >> kv)
        bits[stop] = 1
        low = stop + kv
        for b in range(int(kv.max()) if len(kv) else 0):
            if b < kv.min():
                bits[low - b] = v >> b & 1
            else:
                there = np.flatnonzero(kv > b)
                bits[low[there] - b] = v[there] >> b & 1
    data = np.packbits(bits)
    for h, o in zip(heads, offset[:-1].tolist()):
        data[o : o + len(h)] = np.frombuffer(h, dtype=np.uint8)
    sums = crc16(data, offset[:-1], frame_bytes - 2)
    data[offset[1:] - 2] = sums >> 8
    data[offset[1:] - 1] = sums & 0xFF
    whole = data.tobytes()
    return [whole[a:b] for a, b in zip(offset[:-1].tolist(), offset[1:].tolist())]


def _container(x: np.ndarray, frames: list[bytes]) -> bytes:
    sizes = [len(f) for f in frames]
    md5 = hashlib.md5(x.astype(np.int8).tobytes()).digest()
    block = min(BLOCK, len(x))
    info = struct.pack(">HH", block, block) + min(sizes).to_bytes(3, "big") + max(sizes).to_bytes(3, "big")
    info += (RATE << 44 | 0 << 41 | 7 << 36 | len(x)).to_bytes(8, "big") + md5
    points, at = [], 0
    for i, n in enumerate(sizes):
        points.append(struct.pack(">QQH", i * BLOCK, at, min(BLOCK, len(x) - i * BLOCK)))
        at += n
    # a block's length has 24 bits: a longer table goes on in further padding-free streams only by fewer points
    step = -(-len(points) * 18 // 0xFFFFF0)
    table = b"".join(points[:: max(1, step)])
    return b"fLaC" + b"\x00" + len(info).to_bytes(3, "big") + info + b"\x83" + len(table).to_bytes(3, "big") + table + b"".join(frames)


# ---- decoding


class Stream:
    """The metadata of a FLAC stream: samples, channels, bits, rate, md5, the seek points and where the frames begin."""

    def __init__(self, data: bytes):
        if data[:4] != b"fLaC":
            raise FlacError("no FLAC stream")
        self.data, at, self.points = data, 4, []
        self.total = -1
        while True:
            if at + 4 > len(data):
                raise FlacError("the metadata is cut off")
            kind, n = data[at], int.from_bytes(data[at + 1 : at + 4], "big")
            body = data[at + 4 : at + 4 + n]
            if kind & 127 == 0:
                packed = int.from_bytes(body[10:18], "big")
                self.rate, self.channels, self.bits, self.total = packed >> 44, (packed >> 41 & 7) + 1, (packed >> 36 & 31) + 1, packed & (1 << 36) - 1
                self.md5 = body[18:34]
            elif kind & 127 == 3:
                self.points = [struct.unpack(">QQH", body[i : i + 18]) for i in range(0, n - 17, 18)]
            at += 4 + n
            if kind & 128:
                break
        if self.total < 0:
            raise FlacError("no stream information")
        self.start = at
        self.points = [p for p in self.points if p[0] != 0xFFFFFFFFFFFFFFFF]

    def indexed(self) -> bool:
        """Whether the seek table names every frame."""
        at = 0
        for first, _, n in self.points:
            if first != at:
                return False
            at += n
        return at == self.total


def _header(data, at: int) -> tuple[int, int, int, int, int]:
    """Of the frame at a place: block size, channel assignment, bits (0: as the stream says), length, number."""
    head = bytes(data[at : at + 17])
    if len(head) < 6 or head[0] != 0xFF or head[1] & 0xFE != 0xF8:
        raise FlacError(f"no frame at byte {at}")
    size_code, rate_code, assignment, bits_code = head[2] >> 4, head[2] & 15, head[3] >> 4, head[3] >> 1 & 7
    n, lead = 5, head[4]
    more = 0 if lead < 0x80 else 8 - (lead ^ 0xFF).bit_length() - 1
    number = lead if not more else lead & (1 << 6 - more) - 1
    for _ in range(more):
        number, n = number << 6 | head[n] & 0x3F, n + 1
    if size_code == 6:
        size, n = head[n] + 1, n + 1
    elif size_code == 7:
        size, n = int.from_bytes(head[n : n + 2], "big") + 1, n + 2
    else:
        size = 192 if size_code == 1 else 576 << size_code - 2 if size_code < 6 else 256 << size_code - 8
    n += {12: 1, 13: 2, 14: 2}.get(rate_code, 0)
    if crc8(head[:n]) != head[n]:
        raise FlacError(f"the header of the frame at byte {at} is damaged")
    return size, assignment, (0, 8, 12, 0, 16, 20, 24, 32)[bits_code], n + 1, number


class _Bits:
    """64 bits from any bit on, of many places at once."""

    def __init__(self, data: np.ndarray):
        self.padded = np.concatenate([data, np.zeros(16, np.uint8)])
        self.words = np.lib.stride_tricks.as_strided(self.padded.view(np.uint8), shape=(len(self.padded) - 8, 8), strides=(1, 1))
        self.wide = np.ndarray(shape=(len(self.padded) - 8,), dtype=">u8", buffer=self.padded, strides=(1,))
        self.last = len(data) * 8

    def window(self, at: np.ndarray) -> np.ndarray:
        """At least 57 bits from each place, from the top."""
        return self.wide[np.minimum(at, self.last) >> 3].astype(np.uint64) << (at & 7).astype(np.uint64)

    def take(self, at: np.ndarray, n) -> np.ndarray:
        """n bits (0 to 32) from each place."""
        n = np.asarray(n, dtype=np.int64)
        return ((self.window(at) >> np.uint64(1)) >> (63 - n).astype(np.uint64)).astype(np.int64)

    def take_signed(self, at: np.ndarray, n) -> np.ndarray:
        v, n = self.take(at, n), np.asarray(n, dtype=np.int64)
        return np.where((n > 0) & (v >> np.maximum(n - 1, 0) & 1 == 1), v - (1 << n), v)

    def unary(self, at: np.ndarray) -> np.ndarray:
        """The zeros from each place to the next one bit."""
        top = (self.window(at) >> np.uint64(11)).astype(np.float64)
        q = 53 - np.frexp(top)[1].astype(np.int64)
        q[top == 0] = 53
        long = np.flatnonzero(top == 0)
        while len(long):
            if (at[long] + q[long] >= self.last).any():
                raise FlacError("a code runs past the end")
            more = (self.window(at[long] + q[long]) >> np.uint64(11)).astype(np.float64)
            q[long] += np.where(more == 0, 53, 53 - np.frexp(more)[1])
            long = long[more == 0]
        return q


def decode_frames(data: np.ndarray, starts: np.ndarray, channels: np.ndarray, bits: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """The samples (channels, n) of the frame at each start, and where each frame ends. channels and bits: what the streams say."""
    heads = [_header(data, int(s)) for s in starts]
    order = sorted(range(len(heads)), key=lambda i: -heads[i][0])
    size = np.array([heads[i][0] for i in order], dtype=np.int64)
    kind = np.array([heads[i][1] for i in order], dtype=np.int64)
    depth = np.array([heads[i][2] or int(bits[i]) for i in order], dtype=np.int64)
    begin = np.array([int(starts[i]) for i in order], dtype=np.int64)
    at = (begin + np.array([heads[i][3] for i in order], dtype=np.int64)) * 8
    count = np.where(kind < 8, kind + 1, 2)
    if (kind > 10).any() or (count != channels[order]).any():
        raise FlacError("a frame has other channels than its stream")
    reader = _Bits(data)
    most = int(count.max()) if len(count) else 0
    out = np.zeros((most, len(order), int(size[0]) if len(size) else 0), dtype=np.int64)
    for c in range(most):
        has = np.flatnonzero(count > c)
        side = ((kind == 8) & (c == 1)) | ((kind == 9) & (c == 0)) | ((kind == 10) & (c == 1))
        out[c, has], at[has] = _subframes(reader, at[has], size[has], depth[has] + side[has])
    left, right = out[0], out[1] if most > 1 else None
    if right is not None:
        k = kind[:, None]
        mid = left << 1 | right & 1
        new_left = np.where(k == 9, left + right, np.where(k == 10, mid + right >> 1, left))
        new_right = np.where(k == 8, left - right, np.where(k == 10, mid - right >> 1, right))
        out[0], out[1] = new_left, new_right
    stop = at + 7 >> 3
    if (stop + 2 > len(data)).any():
        raise FlacError("a frame is cut off")
    stated = data[stop].astype(np.uint16) << 8 | data[stop + 1]
    if (crc16(data, begin, stop - begin) != stated).any():
        raise FlacError("a frame is damaged")
    found: list = [None] * len(order)
    ends = np.zeros(len(order), dtype=np.int64)
    for row, i in enumerate(order):
        found[i] = out[: count[row], row, : size[row]]
        ends[i] = stop[row] + 2
    return found, ends


def _subframes(reader: _Bits, at: np.ndarray, size: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The samples of a subframe of each frame, sizes falling, and where it ends; all frames in step."""
    count, longest = len(at), int(size[0]) if len(size) else 0
    x = np.zeros((count, longest), dtype=np.int64)
    kind = reader.take(at, 8)
    if (kind & 128).any():
        raise FlacError("a subframe has no valid head")
    at = at + 8
    wasted = np.zeros(count, dtype=np.int64)
    some = np.flatnonzero(kind & 1)
    if len(some):
        wasted[some] = reader.unary(at[some]) + 1
        at[some] += wasted[some]
    kind = kind >> 1 & 63
    depth = depth - wasted
    constant, verbatim = kind == 0, kind == 1
    fixed, linear = (kind >= 8) & (kind <= 12), kind >= 32
    if not (constant | verbatim | fixed | linear).all():
        raise FlacError("a subframe is of a reserved kind")
    order = np.where(fixed, kind - 8, np.where(linear, kind - 31, 0))
    c = np.flatnonzero(constant)
    x[c] = reader.take_signed(at[c], depth[c])[:, None]
    at[c] += depth[c]
    v = np.flatnonzero(verbatim)
    for t in range(int(size[v].max()) if len(v) else 0):
        live = v[size[v] > t]
        x[live, t] = reader.take_signed(at[live], depth[live])
        at[live] += depth[live]
    coded = np.flatnonzero(fixed | linear)
    if not len(coded):
        return np.where(wasted[:, None] > 0, x << wasted[:, None], x), at
    for t in range(int(order[coded].max())):
        live = coded[order[coded] > t]
        x[live, t] = reader.take_signed(at[live], depth[live])
        at[live] += depth[live]
    coefficients = np.zeros((count, 32), dtype=np.int64)
    shift = np.zeros(count, dtype=np.int64)
    l = np.flatnonzero(linear)
    if len(l):
        precision = reader.take(at[l], 4) + 1
        shift[l] = reader.take_signed(at[l] + 4, 5)
        at[l] += 9
        for j in range(int(order[l].max())):
            there = order[l] > j
            coefficients[l[there], j] = reader.take_signed(at[l[there]], precision[there])
            at[l[there]] += precision[there]
    method = reader.take(at[coded], 2)
    if (method > 1).any():
        raise FlacError("residuals of a reserved kind")
    parameter = np.zeros(count, dtype=np.int64)
    parameter[coded] = np.where(method == 1, 5, 4)
    parts = np.zeros(count, dtype=np.int64)
    parts[coded] = reader.take(at[coded] + 2, 4)
    at[coded] += 6
    length = size >> parts
    k = np.zeros(count, dtype=np.int64)
    plain = np.full(count, -1, dtype=np.int64)  # bits of residuals that are stored as they are
    rows = coded  # sizes fall along it
    sizes = size[rows]
    first_of_all, residual_from = int(order[rows].min()), order[rows]
    boundary = np.zeros(longest + 1, dtype=bool)
    for row_length in np.unique(length[rows]).tolist():
        boundary[:: max(1, row_length)] = True
    boundary[np.unique(residual_from)] = True
    late = int(residual_from.max())
    live_at = np.searchsorted(-sizes, -np.arange(longest), "left")
    cursor, kr = at[rows], k[rows]
    plain_r, len_r, par_r = plain[rows], length[rows], parameter[rows]
    res = np.zeros((longest, len(rows)), dtype=np.int64)
    any_plain = False
    for t in range(first_of_all, longest):
        m = int(live_at[t])
        if boundary[t] or t <= late:
            new = np.flatnonzero(((t % len_r[:m] == 0) & (t > residual_from[:m])) | (t == residual_from[:m]))
            if len(new):
                got = reader.take(cursor[new], par_r[new])
                cursor[new] += par_r[new]
                escape = got == (1 << par_r[new]) - 1
                kr[new], plain_r[new] = got, -1
                if escape.any():
                    e = new[escape]
                    plain_r[e] = reader.take(cursor[e], 5)
                    cursor[e] += 5
                    kr[e] = 0
                any_plain = bool((plain_r >= 0).any())
            if t < late:
                on = np.flatnonzero(residual_from[:m] <= t)
                _step(reader, cursor, kr, plain_r, any_plain, res, t, on)
                continue
        _step(reader, cursor, kr, plain_r, any_plain, res, t, slice(0, m))
    at[rows] = cursor
    res = res.T
    fx = np.flatnonzero(fixed[rows])
    for o in np.unique(order[rows][fx]).tolist():
        these = fx[order[rows][fx] == o]
        own = rows[these]
        diff = res[these].copy()
        if o:
            warm = x[own, :o]
            # the differences of the warm-up start the sums, innermost first
            levels = [np.diff(warm, n=d, axis=1)[:, -1] for d in range(o)]
            tail = diff[:, o:]
            for d in reversed(range(o)):
                tail = np.cumsum(tail, axis=1) + levels[d][:, None]
            x[own, o:] = tail
        else:
            x[own] = diff
    lin = np.flatnonzero(linear[rows])
    if len(lin):
        own = rows[lin]
        xs, rs = np.ascontiguousarray(x[own].T), np.ascontiguousarray(res[lin].T)
        depth_of, co, sh = order[own], coefficients[own], shift[own]
        for t in range(int(depth_of.min()), longest):
            deep = min(t, int(depth_of.max()))
            total = co[:, 0] * xs[t - 1]
            for j in range(1, deep):
                total += co[:, j] * xs[t - 1 - j]
            value = rs[t] + (total >> sh)
            xs[t] = value if t >= depth_of.max() else np.where(depth_of <= t, value, xs[t])
        x[own] = xs.T
    return np.where(wasted[:, None] > 0, x << wasted[:, None], x), at


def _step(reader: _Bits, cursor, k, plain, any_plain: bool, res, t: int, on) -> None:
    """Reads the next residual of the frames on."""
    at, kk = cursor[on], k[on]
    w = reader.window(at)
    top = (w >> np.uint64(11)).astype(np.float64)
    q = 53 - np.frexp(top)[1].astype(np.int64)
    used = q + 1 + kk
    if (used > 57).any() or any_plain or not top.all():
        q = reader.unary(at) if not any_plain else np.where(plain[on] >= 0, 0, 0)
        if any_plain:
            rice = plain[on] < 0
            q = np.zeros(len(at), dtype=np.int64)
            q[rice] = reader.unary(at[rice])
        low = reader.take(at + q + 1, kk)
        u = q << kk | low
        value = np.where(u & 1, -(u >> 1) - 1, u >> 1)
        step = q + 1 + kk
        if any_plain:
            stored = ~rice
            value[stored] = reader.take_signed(at[stored], plain[on][stored])
            step[stored] = plain[on][stored]
        res[t, on] = value
        cursor[on] = at + step
        return
    low = ((w << (q + 1).astype(np.uint64)) >> np.uint64(1)) >> (63 - kk).astype(np.uint64)
    u = q << kk | low.astype(np.int64)
    res[t, on] = (u >> 1) ^ -(u & 1)
    cursor[on] = at + used


def decode(streams: list[bytes], verify: bool = True) -> list[np.ndarray]:
    """The samples (channels, n) of each stream. Streams whose seek tables name all frames are decoded in step; others frame by frame."""
    read = [Stream(s) for s in streams]
    out: list = [None] * len(read)
    stepped = [i for i, s in enumerate(read) if s.indexed() and s.points]
    at, starts, of = 0, [], []
    for i in stepped:
        starts += [at + read[i].start + p[1] for p in read[i].points]
        of += [i] * len(read[i].points)
        at += len(streams[i])
    if starts:
        data = np.frombuffer(b"".join(streams[i] for i in stepped), dtype=np.uint8)
        pieces: dict[int, list[np.ndarray]] = {}
        for lo in range(0, len(starts), 2048):
            part = of[lo : lo + 2048]
            a, b = starts[lo], starts[min(lo + 2048, len(starts)) - 1] + 2 * 65536 * 8
            found, _ = decode_frames(data[a:b], np.array(starts[lo : lo + 2048]) - a, np.array([read[i].channels for i in part]), np.array([read[i].bits for i in part]))
            for i, x in zip(part, found):
                pieces.setdefault(i, []).append(x)
        for i, parts in pieces.items():
            out[i] = np.concatenate(parts, axis=1)
    for i, s in enumerate(read):
        if out[i] is None:
            data, p, parts = np.frombuffer(s.data, dtype=np.uint8), s.start, []
            while p < len(data):
                found, ends = decode_frames(data, np.array([p]), np.array([s.channels]), np.array([s.bits]))
                parts.append(found[0])
                p = int(ends[0])
            out[i] = np.concatenate(parts, axis=1) if parts else np.zeros((s.channels, 0), dtype=np.int64)
        if s.total and out[i].shape[1] != s.total:
            raise FlacError("a stream has other samples than it says")
        if verify and any(s.md5):
            if hashlib.md5(pcm(out[i], s.bits)).digest() != s.md5:
                raise FlacError("the samples' MD5 isn't the stream's")
    return out


def pcm(samples: np.ndarray, bits: int) -> bytes:
    """Interleaved little-endian samples in whole bytes, as the stream's MD5 takes them."""
    size = bits + 7 >> 3
    flat = np.ascontiguousarray(samples.T).reshape(-1)
    if size == 1:
        return flat.astype(np.int8).tobytes()
    return flat.astype("<i4").view(np.uint8).reshape(-1, 4)[:, :size].tobytes() if size < 4 else flat.astype("<i4").tobytes()


def read_samples(stream: bytes, first: int, count: int) -> np.ndarray:
    """count samples from first on, decoding from the last seek point before them only as far as needed."""
    s = Stream(stream)
    start = max((p for p in s.points if p[0] <= first), default=(0, 0, 0))
    data, p, at, parts = np.frombuffer(stream, dtype=np.uint8), s.start + start[1], start[0], []
    while p < len(data) and at < first + count:
        found, ends = decode_frames(data, np.array([p]), np.array([s.channels]), np.array([s.bits]))
        lo, hi = max(0, first - at), min(found[0].shape[1], first + count - at)
        if lo < hi:
            parts.append(found[0][:, lo:hi])
        at, p = at + found[0].shape[1], int(ends[0])
    return np.concatenate(parts, axis=1) if parts else np.zeros((s.channels, 0), dtype=np.int64)
