"""SentencePiece BPE encoding and decoding in vectorised merge rounds.

The symbols of all new words of a slice lie in one flat numpy array. A round
looks up the rank of every neighbouring pair, takes the lowest of each word,
merges all its places that don't overlap, leftmost first, and compacts the
array; words without a pair are done and leave it. A piece never holds a space
mark behind another character, nor a character that no longer piece holds, so
texts split at those into words whose results can be kept and used again.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import struct
from functools import lru_cache
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame

from .common import text_slices

MARK = "▁"
SHIFT = 21
NO_RANK = np.iinfo(np.int64).max
#: words that a worker keeps with their ids at most; then it starts anew
KEPT_WORDS = 200_000
#: most characters of a word that takes part in the rounds
LONG_WORD = 1000


def _fields(data: bytes):
    """(field number, value) of a protobuf message."""
    at = 0

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            b = data[at]
            at += 1
            out |= (b & 127) << shift
            shift += 7
            if b < 128:
                return out

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            value: object = varint()
        elif kind == 2:
            n = varint()
            value, at = data[at : at + n], at + n
        else:
            n = 4 if kind == 5 else 8
            value, at = data[at : at + n], at + n
        yield tag >> 3, value


class PieceCodec:
    """A SentencePiece BPE model file with byte fallback and identity normalisation."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            message = list(_fields(f.read()))
        self.pieces: list[str] = []
        scores: list[float] = []
        self.kinds: list[int] = []  # 1 normal, 2 unknown, 3 control, 4 user defined, 5 unused, 6 byte
        for field, value in message:
            if field == 1:
                piece = dict(_fields(value))
                self.pieces.append(piece[1].decode())
                scores.append(struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0)
                self.kinds.append(piece.get(3, 1))
        trainer = dict(_fields(next(v for k, v in message if k == 2)))
        normalizer = dict(_fields(next(v for k, v in message if k == 3)))
        if trainer.get(3) != 2 or not trainer.get(35) or normalizer.get(2) or normalizer.get(4, 1) or not normalizer.get(3, 1) or not normalizer.get(5, 1) or set(self.kinds) - {1, 2, 3, 6}:
            raise ValueError("only BPE models with byte fallback, a dummy prefix and no other normalisation are read")
        normal = {p: i for i, (p, k) in enumerate(zip(self.pieces, self.kinds)) if k == 1}
        self.unknown = self.kinds.index(2)
        self.byte_ids = [0] * 256
        for i, (p, k) in enumerate(zip(self.pieces, self.kinds)):
            if k == 6:
                self.byte_ids[int(p[3:5], 16)] = i
        # symbols: piece ids, then characters that are no piece, by code point
        self.n = len(self.pieces)
        self.of_char = np.arange(0x110000, dtype=np.int64) + self.n
        for p, i in normal.items():
            if len(p) == 1:
                self.of_char[ord(p)] = i
        ranks = {s: r for r, s in enumerate(sorted({scores[i] for i in normal.values()}, reverse=True))}
        pairs: dict[int, tuple[int, int]] = {}
        symbol = lambda s: normal[s] if s in normal else self.n + ord(s) if len(s) == 1 else None
        for p, i in normal.items():
            for cut in range(1, len(p)):
                a, b = symbol(p[:cut]), symbol(p[cut:])
                if a is not None and b is not None:
                    pairs[a << SHIFT | b] = (ranks[scores[i]], i)
        self.pairs = pairs
        self.keys = np.array(sorted(pairs), dtype=np.int64)
        self.ranks = np.array([pairs[k][0] for k in self.keys.tolist()], dtype=np.int64)
        self.merged = np.array([pairs[k][1] for k in self.keys.tolist()], dtype=np.int64)
        if any(MARK in p.lstrip(MARK) for p in normal):
            raise ValueError("a piece holds a space mark behind another character")
        breaks = "\n" if not any("\n" in p for p in normal) else ""
        self.words = re.compile(f"{MARK}*[^{MARK}{breaks}]+|{MARK}+" + (f"|[{breaks}]" if breaks else ""))
        self.bytes_of = [
            b"" if k == 3 else " ⁇ ".encode() if k == 2 else bytes([int(p[3:5], 16)]) if k == 6 else p.replace(MARK, " ").encode()
            for p, k in zip(self.pieces, self.kinds)
        ]
        self.digits = [str(i) for i in range(self.n)]
        self.own = list(range(self.n))  # one object per id
        self.kept: dict[str, list[int]] = {}

    # ---- encoding

    def encode(self, texts: list[str]) -> list[list[int]]:
        """The ids of each text, without begin or end ids; an empty text has none."""
        cut = [self.words.findall(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
        if len(self.kept) > KEPT_WORDS:
            self.kept = {}
        new = list(set().union(*cut).difference(self.kept)) if cut else []
        if new:
            self.kept.update(zip(new, self.encode_words(new)))
        get = self.kept.__getitem__
        return [list(chain.from_iterable(map(get, words))) for words in cut]

    def encode_words(self, words: list[str]) -> list[list[int]]:
        """The ids of each word (not empty), by merge rounds over all of them at once.

        A word beyond LONG_WORD characters would take as many rounds as it has
        different pairs, so such words are merged one pair after the other.
        """
        long = [w for w in words if len(w) > LONG_WORD]
        if long:
            short = dict(zip((s := [w for w in words if len(w) <= LONG_WORD]), self.encode_words(s) if s else []))
            return [short[w] if len(w) <= LONG_WORD else self._ids(self._one_by_one(w)) for w in words]
        length = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        symbols = self.of_char[np.frombuffer("".join(words).encode("utf-32-le"), dtype=np.uint32)]
        word = np.repeat(np.arange(len(words)), length)
        rank, pair = self._ranked(symbols, word, np.arange(len(symbols)))
        out_word, out_symbols, strict = [], [], []
        last = np.full(len(words), -1, dtype=np.int64)  # the rank of a word's last round if that merged several places
        while len(symbols):
            starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            lowest = np.minimum.reduceat(rank, starts)
            names = word[starts]
            # a pair of no higher rank than those merged at once before may have had to go first
            early = lowest <= last[names]
            strict += names[early].tolist()
            active = (lowest < NO_RANK) & ~early
            sizes = np.diff(np.r_[starts, len(symbols)])
            if not active.all():
                done = np.repeat(~active & ~early, sizes)
                out_word.append(word[done])
                out_symbols.append(symbols[done])
                stay = np.repeat(active, sizes)
                symbols, word, rank, pair = symbols[stay], word[stay], rank[stay], pair[stay]
                lowest, names, sizes = lowest[active], names[active], sizes[active]
                if not len(symbols):
                    break
            best = np.flatnonzero(rank == np.repeat(lowest, sizes))
            # of places in a row every other, from the left
            fresh = np.r_[True, best[1:] != best[:-1] + 1]
            place = np.arange(len(best))
            best = best[(place - np.maximum.accumulate(np.where(fresh, place, 0))) % 2 == 0]
            merges = np.bincount(word[best], minlength=len(words))
            last[names] = np.where(merges[names] > 1, lowest, -1)
            symbols[best] = self.merged[pair[best]]
            left, changed = np.ones(len(symbols), dtype=bool), np.zeros(len(symbols), dtype=bool)
            left[best + 1] = False
            changed[best] = changed[best[best > 0] - 1] = True  # the pairs that a merge is part of
            symbols, word, rank, pair = symbols[left], word[left], rank[left], pair[left]
            at = np.flatnonzero(changed[left])
            rank[at], pair[at] = self._ranked(symbols, word, at)
        results: list[list[int]] = [[]] * len(words)
        if out_word:
            word, symbols = np.concatenate(out_word), np.concatenate(out_symbols)
            order = np.argsort(word, kind="stable")
            word, symbols = word[order], symbols[order]
            starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            plain = (np.maximum.reduceat(symbols, starts) < self.n).tolist()
            flat = list(map(self.own.__getitem__, np.minimum(symbols, self.n - 1).tolist()))
            for w, lo, hi, all_pieces in zip(word[starts].tolist(), starts.tolist(), [*starts[1:].tolist(), len(word)], plain):
                results[w] = flat[lo:hi] if all_pieces else self._ids(symbols[lo:hi].tolist())
        for w in strict:
            results[w] = self._ids(self._one_by_one(words[w]))
        return results

    def _ranked(self, symbols: np.ndarray, word: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rank, and the place among all pairs, of the pairs that begin at the places at."""
        after = np.minimum(at + 1, len(symbols) - 1)
        key = symbols[at] << SHIFT | symbols[after]
        pair = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        there = (self.keys[pair] == key) & (word[after] == word[at]) & (after > at)
        return np.where(there, self.ranks[pair], NO_RANK), pair

    def _one_by_one(self, word: str) -> list[int]:
        """The symbols of a word, merged in strict order: lowest rank, then leftmost."""
        symbols: list = self.of_char[np.frombuffer(word.encode("utf-32-le"), dtype=np.uint32)].tolist()
        before, after = list(range(-1, len(symbols) - 1)), [*range(1, len(symbols)), -1]
        heap: list[tuple[int, int, int, int]] = []

        def offer(i: int, j: int) -> None:
            if i >= 0 and j >= 0 and (found := self.pairs.get(symbols[i] << SHIFT | symbols[j])):
                heapq.heappush(heap, (found[0], i, symbols[i], symbols[j]))

        for i in range(len(symbols) - 1):
            offer(i, i + 1)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if symbols[i] != a or j < 0 or symbols[j] != b:
                continue
            symbols[i], symbols[j] = self.pairs[a << SHIFT | b][1], None
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            offer(before[i], i)
            offer(i, after[i])
        return [s for s in symbols if s is not None]

    def _ids(self, symbols: list[int]) -> list[int]:
        if max(symbols) < self.n:
            return [self.own[s] for s in symbols]
        return list(chain.from_iterable([self.own[s]] if s < self.n else [self.byte_ids[b] for b in chr(s - self.n).encode()] for s in symbols))

    # ---- decoding

    def decode_bytes(self, ids: list[int]) -> bytes:
        """The UTF-8 bytes of the text of ids; the first space that the encoding put in front goes."""
        found = b"".join(map(self.bytes_of.__getitem__, ids))
        first = next((i for i in ids if self.kinds[i] != 3), None)
        if first is not None and self.kinds[first] == 1 and found[:1] == b" ":
            found = found[1:]
        return found

    def decode(self, ids: list[int]) -> str:
        found = self.decode_bytes(ids)
        try:
            return found.decode()
        except UnicodeDecodeError:  # bytes that are no character: each is a replacement character
            out, at = [], 0
            while at < len(found):
                for n in (1, 2, 3, 4):
                    try:
                        out.append(found[at : at + n].decode())
                        break
                    except UnicodeDecodeError:
                        continue
                else:
                    out.append("�")
                    n = 1
                at += n
            return "".join(out)


@lru_cache(maxsize=2)
def codec(path: str) -> PieceCodec:
    """The codec of a model file, read once a worker."""
    return PieceCodec(path)


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """doc_id and ids (array of int) of every text of docs. A null text is empty and has no ids; rows that repeat stay; other columns are left out."""
    import pyarrow as pa

    def run(batches):
        c = codec(path)
        for b in text_slices(batches, "text"):
            ids = c.encode([t or "" for t in b.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def decode_documents(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id and text of (doc_id, ids); null ids decode to the empty text."""
    import pyarrow as pa

    def run(batches):
        c = codec(path)
        for b in batches:
            texts = [c.decode(ids or []) for ids in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {encoded.schema['doc_id'].dataType.simpleString()}, text string")


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: every text encoded, its ids decoded again, both as digests.

    Nulls count as empty texts (no ids, the digests of nothing). The texts are
    handled in slices of a few MB, a longer one alone; rows that repeat stay.
    """
    import pyarrow as pa

    def run(batches):
        c = codec(path)
        digit = c.digits.__getitem__
        for b in text_slices(batches, "text"):
            n, a, d = [], [], []
            for ids in c.encode([t or "" for t in b.column("text").to_pylist()]):
                n.append(len(ids))
                a.append(hashlib.sha256(",".join(map(digit, ids)).encode()).hexdigest())
                d.append(hashlib.sha256(c.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(d, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")
