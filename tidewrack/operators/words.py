"""Word boundaries in bytes of unknown quality, and vocabularies.

The boundary rules look one and two bytes back and one ahead, so they are one
regex over Latin-1 text: every alternative is a stretch that isn't split. The
byte 0x7F stands for an unknown byte and never splits.
"""

from __future__ import annotations

import functools

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.native import byte_slices, stretches

MAX_WORD = 250

#: bytes that are no part of words: controls, ASCII marks, Latin-1 marks
NON_WORD = np.ones(256, dtype=bool)
for _lo, _hi in ((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0xC0, 0xFF), (0x7F, 0x7F)):
    NON_WORD[_lo : _hi + 1] = False
for _b in (0xD7, 0xF7):
    NON_WORD[_b] = True
for _b in (0xAA, 0xB5, 0xBA):
    NON_WORD[_b] = False

ALPHA = np.zeros(256, dtype=bool)
ALPHA[0x41:0x5B] = ALPHA[0x61:0x7B] = True
DIGIT = np.zeros(256, dtype=bool)
DIGIT[0x30:0x3A] = True
SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32, 0xA0]] = True


def _rules(pp: np.ndarray, p: np.ndarray, c: np.ndarray, n: np.ndarray, utf8: bool) -> np.ndarray:
    """Whether a word begins at c, between the bytes before (pp, p; pp is 0 where there is none) and behind it (n). Rules come in order; the first that applies decides."""
    is_ = lambda x, ch: x == ord(ch)
    alpha, digit = ALPHA[c], DIGIT[c]
    rules = [
        (c == 0x7F, False),
        ((utf8 & (c >= 0x80)) & ((p >= 0x80) | ~NON_WORD[p]), False),
        (is_(c, "<"), True),
        (is_(p, ">"), True),
        (is_(c, "#") & is_(p, "&"), False),
        (is_(c, "-") & is_(p, "-"), False),
        (is_(c, "/") & is_(p, "<"), False),
        (is_(c, ">") & is_(p, "/"), False),
        (alpha & (is_(p, "<") | is_(p, "&")), False),
        (alpha & is_(p, "/") & is_(pp, "<"), False),
        (alpha & is_(p, "'") & ALPHA[pp], False),
        (digit & (is_(p, ".") | is_(p, ",")), False),
        (digit & is_(p, "#") & is_(pp, "&"), False),
        (is_(c, "'") & ALPHA[p] & ALPHA[n], False),
        (NON_WORD[c], True),
        (NON_WORD[p] & ((p < 0x80) | (not utf8)), True),
    ]
    return np.select([r for r, _ in rules], [np.full(len(c), v) for _, v in rules], default=False)


@functools.cache
def _table(utf8: bool) -> np.ndarray:
    """What the rules say of each pair of a byte and the one before it, by 256 times that one: 0, 1, or 2 where it depends on their neighbours."""
    pairs = np.arange(65536)
    p, c = (pairs >> 8).astype(np.uint8), (pairs & 255).astype(np.uint8)
    said = [_rules(np.full(65536, pp, np.uint8), p, c, np.full(65536, n, np.uint8), utf8) for pp in (0, *b"<&a") for n in (0, *b"a")]
    return np.where(np.all(said, axis=0), 1, np.where(np.any(said, axis=0), 2, 0)).astype(np.uint8)


def all_boundaries(bodies: list[bytes], utf8: bool = True) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The bytes of bodies one behind the other, where each begins (and the last ends), and whether a word begins at each byte."""
    data = b"".join(bodies)
    ends = np.r_[0, np.cumsum([len(x) for x in bodies], dtype=np.int64)]
    c = np.frombuffer(data, dtype=np.uint8)
    if not len(c):
        return data, ends, np.zeros(0, dtype=bool)
    p = np.r_[np.uint8(0x61), c[:-1]]
    firsts = ends[:-1][ends[:-1] < ends[1:]]
    p[firsts] = 0x61
    found = _table(utf8)[p.astype(np.uint16) << 8 | c]
    open_ = np.flatnonzero(found == 2)
    if len(open_):
        edge = np.zeros(len(c) + 2, dtype=bool)
        edge[firsts] = edge[firsts + 1] = True  # nothing stands two before these
        pp = np.where(edge[open_], 0, c[np.maximum(open_ - 2, 0)])
        last = np.zeros(len(c), dtype=bool)
        last[firsts - 1] = True  # the first body's is the last byte of all
        n = np.where(last[open_], 0, c[(open_ + 1) % len(c)])
        found[open_] = _rules(pp, p[open_], c[open_], n, utf8)
    return data, ends, found.astype(bool)


def boundaries(data: bytes, utf8: bool = True) -> np.ndarray:
    """Whether a word begins at each byte, for all bytes at once."""
    return all_boundaries([data], utf8)[2]


def stretches_of(bodies: list[bytes], utf8: bool = True) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """The stretches between boundaries: the bytes of all bodies, and by stretch its start and end in them and its body."""
    data, ends, begins = all_boundaries(bodies, utf8)
    begins[ends[:-1][ends[:-1] < ends[1:]]] = True
    starts = np.flatnonzero(begins)
    stops = np.r_[starts[1:], len(data)] if len(starts) else starts
    return data, starts, stops, np.searchsorted(ends, starts, "right") - 1


#: what bytes.strip() takes away
BLANK = np.zeros(256, dtype=bool)
BLANK[[9, 10, 11, 12, 13, 32]] = True


def blank(data: bytes, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """Whether stretches of data are ASCII white space."""
    filled = np.r_[0, np.cumsum(~BLANK[np.frombuffer(data, dtype=np.uint8)])]
    return filled[stops] == filled[starts]


def words(data: bytes, utf8: bool = True) -> list[bytes]:
    """The words of some bytes: stretches between boundaries that aren't white space or a lone question mark, the last 250 bytes of longer ones."""
    return all_words([data], utf8)[0]


def all_words(bodies: list[bytes], utf8: bool = True) -> tuple[list[bytes], np.ndarray]:
    """The words of bodies, and the body of each."""
    data, starts, stops, body = stretches_of(bodies, utf8)
    if not len(starts):
        return [], body
    c = np.frombuffer(data, dtype=np.uint8)
    filled = np.r_[0, np.cumsum(~SPACE[c])]
    cut = np.maximum(starts, stops - MAX_WORD)
    mark = (stops - cut == 1) & (c[cut] == ord("?")) & (np.r_[body[1:], -1] == body)
    kept = (filled[stops] > filled[cut]) & ~mark & (stops - cut < MAX_WORD)
    return [data[a:z] for a, z in zip(cut[kept].tolist(), stops[kept].tolist())], body[kept]


def word_frequencies(bodies: DataFrame, utf8: bool = True) -> DataFrame:
    """(model_id, word, freq) of (model_id, body); tasks add up before they hand on."""
    import pyarrow as pa
    from collections import Counter

    def rows(held: dict):
        for m, counts in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([m] * len(counts), pa.string()), pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], ["model_id", "word", "freq"])
        held.clear()

    def run(batches):
        held: dict = {}
        for b in byte_slices(batches, "body"):
            bodies: dict[str, list[bytes]] = {}
            for m, x in zip(b.column("model_id").to_pylist(), b.column("body").to_pylist()):
                bodies.setdefault(m, []).append(x or b"")
            for m, own in bodies.items():
                held.setdefault(m, Counter()).update(all_words(own, utf8)[0])
            if sum(map(len, held.values())) > 300_000:
                yield from rows(held)
        yield from rows(held)

    return bodies.select("model_id", "body").mapInArrow(run, "model_id string, word binary, freq long").groupBy("model_id", "word").agg(F.sum("freq").alias("freq"))


def placed(bodies: list[bytes], utf8: bool = True) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Every stretch of bodies that isn't blank: the bytes of all bodies, and by stretch its start and end in them, its body, and its place in that."""
    data, starts, stops, body = stretches_of(bodies, utf8)
    kept = ~blank(data, starts, stops)
    starts, stops, body = starts[kept], stops[kept], body[kept]
    first = np.r_[0, np.cumsum([len(x) for x in bodies], dtype=np.int64)]
    return data, starts, stops, body, starts - first[body]


def all_words_placed(bodies: list[bytes], utf8: bool = True) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """The words of placed, their bodies and their places in them."""
    data, starts, stops, body, pos = placed(bodies, utf8)
    return [data[a:z] for a, z in zip(starts.tolist(), stops.tolist())], body, pos


def word_places(bodies: DataFrame, utf8: bool = True) -> DataFrame:
    """(id, pos, word) of (id, body): every word with the byte where it begins."""
    import pyarrow as pa

    def run(batches):
        for b in byte_slices(batches, "body"):
            data, starts, stops, body, pos = placed([x or b"" for x in b.column("body").to_pylist()], utf8)
            found = stretches(np.frombuffer(data, dtype=np.uint8), starts, stops - starts)
            yield pa.RecordBatch.from_arrays([b.column("id").take(pa.array(body)), pa.array(pos), found], ["id", "pos", "word"])

    kind = bodies.schema["id"].dataType.simpleString()
    return bodies.select("id", "body").mapInArrow(run, f"id {kind}, pos long, word binary")
