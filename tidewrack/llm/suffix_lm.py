"""Language-model scores from a probabilistic suffix tree over words.

Contexts of one to DEPTH words that are frequent enough are counted with their
next words, and kept where their next-word distribution diverges from that of
their suffix. A text's words are each scored in the longest kept suffix of what
comes before; distributions are smoothed down the suffixes to the unigram base.

    P(w | s) = n(s, w) / (n(s) + K) + rest(s) * P(w | suffix of s)
    rest(s)  = (n(s) - sum of the kept n(s, w) + K) / (n(s) + K)

Contexts and next words have absolute least counts, so the model grows with the
corpus and is never in one place. Every word is sent, with the three before it,
to the bucket of the word before it: all contexts that end in that word, their
counts and their suffixes are there, so a bucket learns and scores by itself.
Words too frequent for a bucket are dealt out by the word before them, and
their own next-word counts, summed up beforehand, go to each of their buckets.

The most frequent words are numbered by a dictionary of bounded size: only it is
broadcast. The others are known by a hash of 56 bits, as contexts and as next
words alike; two bitmaps of fixed size, broadcast too, say which words may be
frequent enough for either: they err towards more only, and the buckets count
exactly. Counts of all words stay in a table that grows with the corpus and is
joined; where a word outside the dictionary follows a bucket's words twice or
more, its count goes there too, for its base probability.
"""

from __future__ import annotations

import math
import pickle
from collections import Counter

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import released, staged, text_slices

#: the token that ends every text; no word holds a space
END = b" "
DEPTH = 3
#: most words in the dictionary; the others are hashed, which changes no score
DICTIONARY = 500_000
#: least share of all tokens of a word that is told apart as a next word; 0: all are
WORD_SHARE = 0.0
#: least count of a context, and of a next word that is kept with it
CONTEXT_COUNT = 20
NEXT_COUNT = 2
#: about how many places a bucket holds
BUCKET = 300_000
#: buckets that are sent together, and most places in a row of them
TOGETHER, SENT = 4, 8192
#: numbers of words outside the dictionary begin here; a hash is added
HASHED = 1 << 32
#: bits of each map of words outside the dictionary, 4 MB
MAPPED = 1 << 25
#: least divergence, in bits, of a kept context from its suffix
DIVERGENCE = 0.02
SMOOTHING = 10.0
ALPHA = 0.1


def held_out(doc_id: Column) -> Column:
    """Whether a row isn't learned from: crc32 of doc_id as text, mod 10, is 0. A null doc_id is."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 10 == 0, F.lit(True))


def words_of(text: str | None) -> list[bytes]:
    """The words of a text, A-Z lowered."""
    return (text or "").encode().lower().split()


def word_counts(docs: DataFrame, kept: int = 300_000) -> DataFrame:
    """(word, n) over the texts of docs, ends included. Tasks add up kept distinct words before they hand them on."""
    import pyarrow as pa

    def rows(counts: Counter):
        return pa.RecordBatch.from_arrays([pa.array(list(counts.keys()), pa.binary()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])

    def run(batches):
        counts: Counter = Counter()
        for b in text_slices(batches, "text"):
            for t in b.column("text").to_pylist():
                counts.update(words_of(t))
            counts[END] += len(b)
            if len(counts) > kept:
                yield rows(counts)
                counts = Counter()
        if counts:
            yield rows(counts)

    return docs.select("text").mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


class _Ids(dict):
    def __missing__(self, word: bytes) -> int:
        return -1


def _hash(word: bytes) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(word, 42) >> 8


def context_map(words: DataFrame) -> bytes:
    """A bitmap with the bit of every word of words (word)."""
    place = F.pmod(F.shiftrightunsigned(F.xxhash64("word"), 8), F.lit(MAPPED)) + 1
    parts = words.select(place.alias("p")).groupBy(F.bitmap_bucket_number("p").alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("bits"))
    bits = bytearray(MAPPED // 8)
    for r in parts.collect():
        bits[(r.k - 1) * 4096 : r.k * 4096] = r.bits
    return bytes(bits)


def encoded(docs: DataFrame, dictionary: list[bytes], mapped: bytes = b"", followed: bytes = b"", logs: np.ndarray | None = None) -> DataFrame:
    """docs (doc_id, text) as (row, doc_id, held_out, ids, rare, hashes, n_tokens, n_rare, base).

    ids has the number in the dictionary of every word. Others, which rare holds,
    are -2 if mapped has them, else -3 if followed has them, with their hashes in
    hashes, else -1. base is the sum of logs over the words in the dictionary.
    """
    import pyarrow as pa

    sent = docs.sparkSession.sparkContext.broadcast((dictionary, mapped, followed, np.zeros(len(dictionary)) if logs is None else logs))
    held: dict = {}
    names = ["row", "doc_id", "held_out", "ids", "rare", "hashes", "n_tokens", "n_rare", "base"]

    def has(bits: bytes, place: np.ndarray) -> np.ndarray:
        return (np.frombuffer(bits, np.uint8)[place >> 3] >> (place & 7) & 1 == 1) if bits else np.zeros(len(place), dtype=bool)

    def run(batches):
        if "ids" not in held:
            held["ids"] = _Ids({w: i for i, w in enumerate(sent.value[0])})
        get, (_, mapped, followed, logs) = held["ids"].__getitem__, sent.value
        for b in text_slices(batches, "text"):
            ids, rare, hashes, base = [], [], [], []
            for t in b.column("text").to_pylist():
                words = words_of(t)
                found = np.array([*map(get, words), 0], dtype=np.int32)
                outside = np.flatnonzero(found < 0)
                base.append(logs[found].sum() if not len(outside) else logs[found[found >= 0]].sum())
                rare.append([words[i] for i in outside.tolist()])
                number = np.array([_hash(w) for w in rare[-1]] if mapped or followed else [], dtype=np.int64)
                if len(number):
                    place = number % MAPPED
                    kind = np.where(has(mapped, place), -2, np.where(has(followed, place), -3, -1))
                    found[outside] = kind
                    number = number[kind < -1]
                ids.append(found)
                hashes.append(number)
            offsets = np.cumsum([0, *map(len, ids)]).astype(np.int32)
            flat = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int32)))
            yield pa.RecordBatch.from_arrays(
                [b.column("row"), b.column("doc_id"), b.column("held_out"), flat, pa.array(rare, pa.list_(pa.binary())), pa.array(hashes, pa.list_(pa.int64())), pa.array(np.diff(offsets), pa.int64()), pa.array([len(x) for x in rare], pa.int64()), pa.array(base, pa.float64())], names
            )

    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"row long, doc_id {kind}, held_out boolean, ids array<int>, rare array<binary>, hashes array<long>, n_tokens long, n_rare long, base double")


def _slices(batches, limit: int = 1_000_000):
    """(batch, flat ids, offsets) of at most about limit ids; a longer row comes alone.

    Where hashes are there, ids hold them: HASHED and more for words that may be in
    a context, below -1 for those that may only follow one.
    """
    for batch in batches:
        ends = batch.column("ids").offsets.to_numpy().astype(np.int64)
        ends = ends - ends[0]
        at = 0
        while at < len(batch):
            stop = max(at + 1, int(np.searchsorted(ends, ends[at] + limit, "right")) - 1)
            part = batch.slice(at, stop - at)
            ids = part.column("ids")
            offsets = ids.offsets.to_numpy().astype(np.int64)
            flat = ids.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            if "hashes" in part.schema.names:
                there, number = flat < -1, part.column("hashes").flatten().to_numpy(zero_copy_only=False)
                flat[there] = np.where(flat[there] == -2, HASHED + number, -2 - number)
            else:
                flat = np.maximum(flat, -1)
            yield part, flat, offsets - offsets[0]
            at = stop
    released()


class SuffixTree:
    """The contexts by level and, once it is built, the kept ones with their distributions.

    A context of a level is a number; steps[k] holds, sorted, the codes
    (number at level k of the words before) * size + (last word) of level k + 1;
    level 0 has the empty context alone, number 0.
    """

    def __init__(self, dictionary_counts: np.ndarray, total: int, distinct: int):
        self.size = len(dictionary_counts)
        self.total = total
        self.base = np.log10((dictionary_counts + ALPHA) / (total + ALPHA * (distinct + 1)))
        self.unknown = float(np.log10(ALPHA / (total + ALPHA * (distinct + 1))))
        self.steps: list[np.ndarray] = []
        self.counts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # by level: codes context * size + next, n, n(context)
        self.state: list[np.ndarray] = []  # by level: the number of the kept state a context stands for

    def levels(self, ids: np.ndarray, first: np.ndarray) -> list[np.ndarray]:
        """For each level the context that ends at each place, -1 where none does. first: where a text begins."""
        out, before = [], np.zeros(len(ids), dtype=np.int64)
        for step in self.steps:
            last = np.r_[-1, before[:-1]] if out else np.zeros(len(ids), dtype=np.int64)
            if out:
                last[first] = -1
            code = np.where((last >= 0) & (ids > 0), last * self.size + ids, -1)
            before = _find(step, code)
            out.append(before)
        return out

    def add_level(self, codes: np.ndarray, n: np.ndarray, all_n: np.ndarray) -> None:
        """The next words of the deepest level's contexts: sorted codes with their counts, and the contexts' own."""
        self.counts.append((codes, n, all_n))

    def build(self) -> None:
        """Decides which contexts are kept and smooths their distributions, shortest first."""
        total_levels = len(self.counts)
        self.parent, self.rest = np.zeros(1, np.int64), np.zeros(1)
        codes_all, logs_all = [], []
        # suffix of each context: its words without the first, as a number one level up
        suffix = [np.zeros(len(self.steps[0]) if self.steps else 0, np.int64)]
        for k in range(1, len(self.steps)):
            before, word = self.steps[k] // self.size, self.steps[k] % self.size
            suffix.append(_find(self.steps[k - 1], suffix[k - 1][before] * self.size + word))
        self.state = []
        for k in range(total_levels):
            codes, n, all_n = self.counts[k]
            up = self.state[k - 1][suffix[k]] if k else np.zeros(len(all_n), np.int64)
            # a context whose suffix was never frequent can't be: counts only fall; -1 would be an error
            context, word = codes // self.size, codes % self.size
            kept_sum = np.bincount(context, weights=n, minlength=len(all_n))
            rest = (all_n - kept_sum + SMOOTHING) / (all_n + SMOOTHING)
            table = (np.concatenate(codes_all) if codes_all else np.zeros(0, np.int64), np.concatenate(logs_all) if logs_all else np.zeros(0))
            under = 10 ** self._log(up[context], word, *_sorted(table))
            own = n / (all_n[context] + SMOOTHING) + rest[context] * under
            share = n / np.maximum(all_n[context], 1)
            away = np.bincount(context, weights=share * np.log2(np.maximum(share, 1e-300) / under), minlength=len(all_n))
            # what isn't kept is taken as one symbol
            left = np.maximum(1 - np.bincount(context, weights=share, minlength=len(all_n)), 0)
            under_left = np.maximum(1 - np.bincount(context, weights=under, minlength=len(all_n)), 1e-12)
            away += np.where(left > 0, left * np.log2(np.maximum(left, 1e-300) / under_left), 0)
            kept = away >= DIVERGENCE
            state = up.copy()
            state[kept] = len(self.parent) + np.arange(kept.sum())
            self.parent = np.r_[self.parent, up[kept]]
            self.rest = np.r_[self.rest, np.log10(rest[kept])]
            mine = kept[context]
            codes_all.append(state[context[mine]] * self.size + word[mine])
            logs_all.append(np.log10(own[mine]))
            self.state.append(state)
        self.codes, self.logs = _sorted((np.concatenate(codes_all), np.concatenate(logs_all)) if codes_all else (np.zeros(0, np.int64), np.zeros(0)))
        self.counts = []

    def _log(self, state: np.ndarray, word: np.ndarray, codes: np.ndarray, logs: np.ndarray) -> np.ndarray:
        """log10 P(word | state); for words outside the dictionary (-1) without the base."""
        out = np.zeros(len(state))
        todo = np.arange(len(state))
        while len(todo):
            s, w = state[todo], word[todo]
            at = _find(codes, np.where((s > 0) & (w >= 0), s * self.size + w, -1))
            found, root = at >= 0, s == 0
            out[todo[found]] += logs[at[found]]
            known = root & (w >= 0)
            out[todo[known]] += self.base[w[known]]
            on = ~found & ~root
            out[todo[on]] += self.rest[s[on]]
            state = state.copy()
            state[todo[on]] = self.parent[s[on]]
            todo = todo[on]
        return out

    def score(self, ids: np.ndarray, first: np.ndarray) -> np.ndarray:
        """log10 of each word's probability after the words before it; without the base for words outside the dictionary."""
        state = np.zeros(len(ids), dtype=np.int64)
        for level, of in zip(self.levels(ids, first), self.state):
            state = np.where(level >= 0, of[np.maximum(level, 0)] if len(of) else 0, state)
        state = np.r_[0, state[:-1]]
        state[first] = 0
        return self._log(state, ids, self.codes, self.logs)


def _sorted(table):
    order = np.argsort(table[0], kind="stable")
    return table[0][order], table[1][order]


def _find(codes: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """The place of each wanted code, or -1."""
    if not len(codes):
        return np.full(len(wanted), -1, dtype=np.int64)
    at = np.minimum(np.searchsorted(codes, wanted), len(codes) - 1)
    return np.where(codes[at] == wanted, at, -1)


def next_counts(rows: DataFrame, tree: SuffixTree) -> DataFrame:
    """(context, next, n) of the deepest level's contexts over rows (ids); next is -1 for words outside the dictionary."""
    import pyarrow as pa

    sent = rows.sparkSession.sparkContext.broadcast(pickle.dumps(tree))

    def run(batches):
        t = pickle.loads(sent.value)
        width = t.size + 1
        parts: list = []

        def merged():
            codes, n = np.concatenate([c for c, _ in parts]), np.concatenate([k for _, k in parts])
            order = np.argsort(codes, kind="stable")
            codes, n = codes[order], n[order]
            starts = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]])
            return codes[starts], np.add.reduceat(n, starts)

        for _, ids, offsets in _slices(batches):
            context = t.levels(ids, offsets[:-1])[-1][:-1]
            there = context >= 0
            codes, n = np.unique(context[there] * width + ids[1:][there] + 1, return_counts=True)
            if len(codes):
                parts.append((codes, n))
            if sum(len(c) for c, _ in parts) > 4_000_000:
                parts = [merged()]
        if parts:
            codes, n = merged()
            for at in range(0, len(codes), 100_000):
                c = codes[at : at + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array(c // width, pa.int64()), pa.array(c % width - 1, pa.int64()), pa.array(n[at : at + 100_000], pa.int64())], ["context", "next", "n"])

    return rows.select("ids").mapInArrow(run, "context long, next long, n long").groupBy("context", "next").agg(F.sum("n").alias("n"))


def learned(rows: DataFrame, counts: np.ndarray, total: int, distinct: int, depth: int = DEPTH) -> SuffixTree:
    """The tree of rows (ids) as a whole, at the driver: for corpora that fit there, and to hold context_gains against."""
    tree = SuffixTree(counts, total, distinct)
    least = CONTEXT_COUNT
    level = np.flatnonzero(counts >= least)
    codes = level[level > 0].astype(np.int64)  # after the end nothing comes
    for _ in range(depth):
        if not len(codes):
            break
        tree.steps.append(codes)
        found = next_counts(rows, tree)
        sums = found.groupBy("context").agg(F.sum("n").alias("all_n"))
        kept = found.where("next >= 0").join(F.broadcast(sums), "context").where(F.col("n") >= NEXT_COUNT)
        both = staged(kept.select("context", "next", "n", "all_n"), "contexts").toPandas().sort_values(["context", "next"])
        all_n = np.zeros(len(codes), dtype=np.float64)
        all_n[both["context"].to_numpy()] = both["all_n"].to_numpy()
        pairs = (both["context"] * tree.size + both["next"]).to_numpy(dtype=np.int64)
        n = both["n"].to_numpy(dtype=np.float64)
        tree.add_level(pairs, n, all_n)
        codes = pairs[(n >= least) & (pairs % tree.size > 0)]
    tree.build()
    return tree


def gains(a: np.ndarray, b: np.ndarray, c: np.ndarray, w: np.ndarray, seen: np.ndarray, seen_first: np.ndarray, base: np.ndarray, depth: int = DEPTH) -> np.ndarray:
    """log10 of P(w | the longest kept suffix of a, b, c) over w's base, for words w after a, b, c.

    All places of a last word c must be here. seen is how often a place is
    learned from, seen_first the same for contexts of one word. w are numbers in
    base, which has logarithms, -1 for words that are never kept; a, b and c are
    any numbers, and those of 0 and less end a context.
    """
    start = np.where(w >= 0, 10 ** base[np.maximum(w, 0)], 1.0)
    p, at, number = start.copy(), np.arange(len(w)), np.zeros(len(w), dtype=np.int64)
    width = len(base) + 1
    for k, before in enumerate((c, b, a)[:depth]):
        there = before[at] > 0
        at, number = at[there], number[there]
        if not len(at):
            break
        n = (seen if k else seen_first)[at]
        last = before[at].copy()
        far = last >= HASHED  # few: numbers of the dictionary are dense already
        last[far] = len(base) + np.unique(last[far], return_inverse=True)[1]
        _, number = np.unique(number * (last.max() + 1) + last, return_inverse=True)
        all_n = np.bincount(number, weights=n)
        there = all_n[number] >= CONTEXT_COUNT
        at, number, n = at[there], number[there], n[there]
        if not len(at):
            break
        codes, one, pair = np.unique(number * width + w[at] + 1, return_index=True, return_inverse=True)
        context, word = codes // width, codes % width - 1
        found = np.bincount(pair, weights=n, minlength=len(codes))
        found[(word < 0) | (found < NEXT_COUNT)] = 0
        under = p[at[one]]
        sums = lambda x: np.bincount(context, weights=x, minlength=len(all_n))
        rest = (all_n - sums(found) + SMOOTHING) / (all_n + SMOOTHING)
        own = found / (all_n[context] + SMOOTHING) + rest[context] * under
        share = found / np.maximum(all_n[context], 1)
        away = sums(share * np.log2(np.where(share > 0, share, 1) / np.where(share > 0, under, 1)))
        # what isn't kept is taken as one symbol
        left = np.maximum(1 - sums(share), 0)
        away += np.where(left > 0, left * np.log2(np.maximum(left, 1e-300) / np.maximum(1 - sums(np.where(share > 0, under, 0)), 1e-12)), 0)
        p[at] = np.where((away >= DIVERGENCE)[context], own, under)[pair]
    return np.log10(p / start)


def _dealt(counts: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """(first bucket, buckets) of every word: about limit places a bucket, a word alone in several if it has more."""
    many = np.where(counts > limit, np.ceil(counts / limit), 1).astype(np.int64)
    small = np.where(many > 1, 0, counts)
    first = (np.cumsum(small) // limit).astype(np.int64)
    heavy = np.flatnonzero(many > 1)
    first[heavy] = first.max(initial=0) + 1 + np.cumsum(many[heavy]) - many[heavy]
    return first, many


class _Deal:
    """To which bucket a place goes."""

    def __init__(self, counts: np.ndarray, hashed: float, limit: int):
        self.first, self.many = _dealt(counts, limit)
        self.usable = counts >= CONTEXT_COUNT
        self.rest = int((self.first + self.many).max(initial=0))  # the first bucket of words outside the dictionary
        self.over = max(1, math.ceil(hashed / limit))

    def context(self, c: np.ndarray) -> np.ndarray:
        """Whether words c may end a context."""
        return (c >= HASHED) | (c > 0) & self.usable[np.where(c < HASHED, np.maximum(c, 0), 0)]

    def split(self, c: np.ndarray) -> np.ndarray:
        """How many buckets words c have."""
        return np.where(c < HASHED, self.many[np.where(c < HASHED, c, 0)], 1)

    def buckets(self, b: np.ndarray, c: np.ndarray) -> np.ndarray:
        """The bucket of places after b, c."""
        mixed = (b + 1) * 0x9E3779B1 % 2**32 >> 8
        return np.where(c < HASHED, self.first[np.where(c < HASHED, c, 0)], self.rest + c % self.over) + mixed % self.split(c)


def _before(deal: _Deal, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The three words before each place, from the farthest; -1 where a context can't reach. The end, 0, is between texts."""
    c, b, a = (np.r_[np.full(k, -1), ids][: len(ids)] for k in (1, 2, 3))
    b = np.where((c > 0) & deal.context(b), b, -1)
    return np.where((b > 0) & deal.context(a), a, -1), b, c


def rare_places(rows: DataFrame, deal: _Deal) -> DataFrame:
    """(row, word, together) of every word outside the dictionary.

    together says where it is learned from: in the buckets sent together under this
    number; if -2 or less, in all those of the word -2 - together before it; if -1, nowhere.
    """
    import pyarrow as pa

    sent = rows.sparkSession.sparkContext.broadcast(deal)

    def run(batches):
        deal = sent.value
        for part, ids, offsets in _slices(batches):
            at = np.flatnonzero((ids < 0) | (ids >= HASHED))
            which = np.searchsorted(offsets, at, "right") - 1
            _, b, c = (x[at] for x in _before(deal, ids))
            learned = (ids[at] != -1) & deal.context(c) & ~part.column("held_out").to_numpy(zero_copy_only=False).astype(bool)[which]
            c = np.maximum(c, 0)
            together = np.where(learned, np.where(deal.split(c) > 1, -2 - c, deal.buckets(b, c) // TOGETHER), -1)
            yield pa.RecordBatch.from_arrays([pa.array(part.column("row").to_numpy()[which]), part.column("rare").flatten(), pa.array(together, pa.int64())], ["row", "word", "together"])

    return rows.select("row", "held_out", "ids", "rare", "hashes").mapInArrow(run, "row long, word binary, together long")


def context_gains(rows: DataFrame, counts: np.ndarray, base: np.ndarray, hashed: float = 0, depth: int = DEPTH, limit: int = BUCKET) -> DataFrame:
    """(row, gain) of rows (row, held_out, ids, hashes): the sum of gains over a row's words, learned from the rows that aren't held out.

    hashed is about how many places have a word in hashes before them.
    """
    return gain_parts(rows, _Deal(counts, hashed, limit), base, depth=depth).groupBy("row").agg(F.sum("gain").alias("gain"))


def gain_parts(rows: DataFrame, deal: _Deal, base: np.ndarray, divisor: float = 1.0, bases: DataFrame | None = None, depth: int = DEPTH) -> DataFrame:
    """The parts that context_gains sums. bases (together, hash, n) has the words outside the dictionary that may be kept as next words there, whose base probability is (n + ALPHA) / divisor."""
    import pyarrow as pa

    sent = rows.sparkSession.sparkContext.broadcast((deal, base))

    def places(batches):
        deal = sent.value[0]
        for part, ids, offsets in _slices(batches):
            a, b, c = _before(deal, ids)
            tag = part.column("row").to_numpy() * 2 + ~part.column("held_out").to_numpy(zero_copy_only=False).astype(bool)
            use = np.flatnonzero(deal.context(c))
            yield np.repeat(tag, np.diff(offsets))[use], a[use], b[use], c[use], ids[use]

    def packed(together, tags, grams):
        """At most SENT places a row, about in order of their words from the last one back; their bytes by significance, which compress well so."""
        import zstandard

        order = np.argsort((together << 38) + ((grams[:, 2] & 0xFFFFF) << 18) + (grams[:, 1] & 0x3FFFF), kind="stable")
        together, tags, grams = together[order], tags[order], grams[order]
        edges = np.flatnonzero(np.r_[True, together[1:] != together[:-1]]) if len(together) else np.zeros(0, np.int64)
        begins = np.concatenate([np.arange(lo, hi, SENT) for lo, hi in zip(edges, np.r_[edges[1:], len(together)])]) if len(edges) else edges
        ends = np.r_[begins[1:], len(together)]
        press = zstandard.ZstdCompressor(level=3).compress
        data = []
        for i, j in zip(begins.tolist(), ends.tolist()):
            least = tags[i:j].min()
            columns = np.concatenate([(tags[i:j] - least)[:, None], grams[i:j]], axis=1).astype("<i8")
            columns[1:, 2:4] -= columns[:-1, 2:4].copy()
            data.append(press(least.astype("<i8").tobytes() + columns.view(np.uint8).T.tobytes()))
        return pa.RecordBatch.from_arrays([pa.array(together[begins], pa.int64()), pa.array(data, pa.binary())], ["together", "data"])

    def unpacked(data: bytes):
        import zstandard

        raw = zstandard.ZstdDecompressor().decompress(data)
        columns = np.frombuffer(raw, dtype=np.uint8, offset=8).reshape(40, -1).T.copy().view("<i8")
        columns[:, 2:4] = np.cumsum(columns[:, 2:4], axis=0)
        return columns[:, 0] + np.frombuffer(raw, dtype="<i8", count=1), columns[:, 1:]

    def send(batches):
        for tags, a, b, c, w in places(batches):
            yield packed(sent.value[0].buckets(b, c) // TOGETHER, tags, np.stack([a, b, c, w], 1))

    def pairs(batches):
        for tags, _, _, c, w in places(batches):
            there = (tags & 1 == 1) & (sent.value[0].split(c) > 1)
            order = np.lexsort((w[there], c[there]))
            c, w = c[there][order], w[there][order]
            starts = np.flatnonzero(np.r_[True, (c[1:] != c[:-1]) | (w[1:] != w[:-1])]) if len(c) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(c[starts]), pa.array(w[starts]), pa.array(np.diff(np.r_[starts, len(c)]), pa.int64())], ["c", "w", "n"])

    def spread(batches):
        deal = sent.value[0]
        for part in batches:
            c, w, n = (part.column(k).to_numpy() for k in ("c", "w", "n"))
            few = n < NEXT_COUNT  # only their sum counts
            once, at = np.unique(c[few], return_inverse=True)
            n = np.r_[n[~few], np.bincount(at, weights=n[few], minlength=len(once)).astype(np.int64)]
            c, w = np.r_[c[~few], once], np.r_[w[~few], np.full(len(once), -1)]
            many = deal.many[c]
            again = np.repeat(np.arange(len(c)), many)
            turn = np.arange(len(again)) - np.repeat(np.cumsum(many) - many, many)
            c, none = c[again], np.full(len(again), -1)
            yield packed((deal.first[c] + turn) // TOGETHER, -1 - n[again], np.stack([none, -2 - turn, c, w[again]], 1))

    def spread_bases(batches):
        deal = sent.value[0]
        for part in batches:
            together, number, n = (part.column(k).to_numpy() for k in ("together", "hash", "n"))
            c = np.where(together < 0, -2 - together, 0)
            low = np.where(together < 0, deal.first[c] // TOGETHER, together)
            many = np.where(together < 0, (deal.first[c] + deal.many[c] - 1) // TOGETHER, together) - low + 1
            again = np.repeat(np.arange(len(n)), many)
            together = low[again] + np.arange(len(again)) - np.repeat(np.cumsum(many) - many, many)
            number, n = number[again], n[again]
            none = np.full(len(n), -1)
            yield packed(together, -1 - n, np.stack([none, none, none, number], 1))

    kind = "together long, data binary"
    used = rows.select("row", "held_out", "ids", *(["hashes"] if "hashes" in rows.columns else []))
    dealt = used.mapInArrow(send, kind)
    if (deal.many > 1).any():  # a negative tag is a count: of a word and its next one for the bucket that b says, or of a word where c is -1
        summed = used.mapInArrow(pairs, "c long, w long, n long").groupBy("c", "w").agg(F.sum("n").alias("n"))
        dealt = dealt.unionByName(summed.mapInArrow(spread, kind))
    if bases is not None:
        dealt = dealt.unionByName(bases.select("together", "hash", "n").mapInArrow(spread_bases, kind))
    dealt = dealt.repartition("together").sortWithinPartitions("together")

    def by_row(parts):
        row, gain = np.concatenate([r for r, _ in parts]), np.concatenate([g for _, g in parts])
        row, at = np.unique(row, return_inverse=True)
        return row, np.bincount(at, weights=gain, minlength=len(row))

    def learn(blocks: list):
        deal, base = sent.value
        tag = np.concatenate([t for t, _ in blocks])
        grams = np.concatenate([g for _, g in blocks])
        blocks.clear()
        count = (tag < 0) & (grams[:, 2] == -1)
        numbers, one = np.unique(grams[count, 3], return_index=True)
        logs = np.r_[base, np.log10((-1 - tag[count][one] + ALPHA) / divisor)]
        if count.any():
            tag, grams = tag[~count], grams[~count]
        w = grams[:, 3]
        outside = np.flatnonzero((w < -1) | (w >= HASHED))
        at = _find(numbers, np.where(w[outside] < 0, -2 - w[outside], w[outside] - HASHED))
        w[outside] = np.where(at >= 0, len(base) + at, -1)
        b, c = grams[:, 1], grams[:, 2]
        bucket = np.where(tag < 0, deal.first[np.where(tag < 0, c, 0)] - 2 - b, deal.buckets(b, c))
        order = np.argsort(bucket, kind="stable")
        if not len(order):
            return
        edges = np.r_[np.flatnonzero(np.r_[True, np.diff(bucket[order]) != 0]), len(order)]
        for lo, hi in zip(edges[:-1], edges[1:]):
            t, (a, b, c, w) = tag[order[lo:hi]], grams[order[lo:hi]].T
            seen = np.where(t >= 0, t & 1, 0).astype(np.float64)
            seen_first = np.where(t < 0, -1 - t, np.where(deal.split(c) > 1, 0, seen))
            gain = gains(a, b, c, w, seen, seen_first, logs, depth)
            there = (t >= 0) & (gain != 0)
            yield by_row([(t[there] >> 1, gain[there])])
        del tag, grams, b, c, w, t, a, bucket, order, seen, seen_first, gain, there
        released()

    def run(batches):
        now, blocks, made = None, [], []

        def rows_of(parts):
            row, gain = by_row(parts)
            for at in range(0, len(row), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(row[at : at + 100_000], pa.int64()), pa.array(gain[at : at + 100_000], pa.float64())], ["row", "gain"])

        for batch in batches:
            for together, data in zip(batch.column("together").to_pylist(), batch.column("data")):
                if together != now:
                    if blocks:
                        made.extend(learn(blocks))
                    now, blocks = together, []
                    if sum(len(r) for r, _ in made) > 1_000_000:
                        yield from rows_of(made)
                        made = []
                blocks.append(unpacked(data.as_py()))
        if blocks:
            made.extend(learn(blocks))
        if made:
            yield from rows_of(made)

    return dealt.mapInArrow(run, "row long, gain double")


def scored(docs: DataFrame, depth: int = DEPTH) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row of docs (doc_id, text).

    A null text is empty and has the end as its only token. Rows with a null
    doc_id are held out. With nothing to learn from, N and V are 0 and all words
    unknown. Rows that repeat stay; other columns are left out.
    """
    counts = staged(word_counts(docs.where(~held_out(F.col("doc_id")))), "word-counts")
    total, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    words = counts.where(F.col("word") != F.lit(bytearray(END)))
    share = WORD_SHARE * total
    least, listed = max(CONTEXT_COUNT, share), 0
    for r in words.where(F.col("n") >= least).groupBy("n").agg(F.count("*").alias("words")).orderBy(F.desc("n")).collect():
        listed += r.words
        if listed > DICTIONARY:
            least = r.n + 1
            break
    frequent = words.where(F.col("n") >= least).orderBy(F.desc("n"), "word").toPandas()
    ends = counts.where(F.col("word") == F.lit(bytearray(END))).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    dictionary = [END, *map(bytes, frequent["word"])]
    numbers = np.r_[ends, frequent["n"].to_numpy(dtype=np.float64)] if len(frequent) else np.array([float(ends)])

    outside = words.where(F.col("n") < least)
    between = outside.where(F.col("n") >= CONTEXT_COUNT)
    following = max(NEXT_COUNT, share)
    hashed, follow = outside.agg(*(F.coalesce(F.sum(F.when(F.col("n") >= x, F.col("n"))), F.lit(0)) for x in (CONTEXT_COUNT, following))).first()
    logs = np.log10((numbers + ALPHA) / (total + ALPHA * (distinct + 1)))
    followed = context_map(outside.where(F.col("n") >= following)) if follow else b""
    rows = staged(encoded(docs, dictionary, context_map(between) if hashed else b"", followed, logs), "encoded", "zstd")
    deal = _Deal(numbers, hashed, BUCKET)

    ends_known = 1 if ends else 0  # the end has number 0 even where nothing was learned
    asked = rare_places(rows.where(F.col("n_rare") > 0), deal)
    there = asked.join(outside.withColumnRenamed("word", "_word"), F.col("word") == F.col("_word"), "left")
    times = F.count("*").over(Window.partitionBy("word", "together"))
    kept = (F.col("together") != -1) & (F.col("n") >= following) & (times >= NEXT_COUNT)
    number = F.shiftrightunsigned(F.xxhash64("word"), 8)
    rare = staged(there.select("row", "n", F.when(kept, F.col("together")).alias("together"), F.when(kept, number).alias("hash")), "rare", "zstd")
    bases = rare.where(F.col("hash").isNotNull()).groupBy("together", "hash").agg(F.max("n").alias("n"))
    divisor = total + ALPHA * (distinct + 1)
    tail = rare.select(
        "row",
        F.lit(0.0).alias("gain"),
        F.log10((F.coalesce("n", F.lit(0)) + ALPHA) / divisor).alias("rare_base"),
        F.col("n").isNotNull().cast("long").alias("rare_known"),
    )
    gained = gain_parts(rows, deal, logs, divisor, bases, depth).select("row", "gain", F.lit(0.0).alias("rare_base"), F.lit(0).cast("long").alias("rare_known"))
    sums = tail.unionByName(gained).groupBy(F.col("row").alias("_row")).agg(*(F.sum(k).alias(k) for k in ("gain", "rare_base", "rare_known")))
    rare_base = F.coalesce("rare_base", F.lit(0.0))
    main = rows.select("row", "doc_id", "held_out", "n_tokens", "n_rare", "base")
    return main.join(sums, F.col("row") == F.col("_row"), "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_tokens") - F.col("n_rare") - (1 - ends_known) + F.coalesce("rare_known", F.lit(0))).cast("long").alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + rare_base).alias("base_score"),
        (F.col("base") + rare_base + F.coalesce("gain", F.lit(0.0))).alias("score"),
    )
