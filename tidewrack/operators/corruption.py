"""Detectors of corruption in bytes: runs, unknown words, odd word lengths, a language that breaks off."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.native import byte_slices
from . import words

LEAST_RUN = 128
#: bytes of bodies whose unknown words are counted together
CHUNK = 8_000_000
WORD_WINDOW, WORD_SLIDE, LEAST_WORDS, UNKNOWN_SHARE = 512, 64, 8, 0.4
LENGTH_WINDOW, LENGTH_SLIDE, LEAST_SIMILARITY, LEAST_SEEN, DECAY = 512, 128, 0.8, 96, 0.75
LANGUAGE_DROP = 0.2


def byte_runs(bodies: DataFrame, least: int = LEAST_RUN) -> DataFrame:
    """(id, start, length, byte) of the runs of one byte value, least or longer, of (id, body).

    One regex finds the runs; where they begin follows from the lengths of the
    gaps between them, so bytes are never exploded.
    """
    text = F.decode("body", "ISO-8859-1")
    pattern = F.lit(rf"(?s)(.)\1{{{least - 1},}}")
    cut = bodies.select("id", F.regexp_extract_all(text, pattern, F.lit(0)).alias("runs"), F.split(text, rf"(?s)(.)\1{{{least - 1},}}", -1).alias("gaps")).where(F.size("runs") > 0)
    each = cut.select("id", "gaps", "runs", F.posexplode("runs").alias("k", "run"))
    lengths = lambda c, n: F.aggregate(F.transform(F.slice(c, 1, n), F.length), F.lit(0), lambda a, x: a + x)
    start = lengths("gaps", F.col("k") + 1) + F.when(F.col("k") > 0, lengths("runs", F.greatest(F.col("k"), F.lit(1)))).otherwise(0)
    return each.select("id", start.cast("long").alias("start"), F.length("run").cast("long").alias("length"), F.ascii(F.substring("run", 1, 1)).alias("byte"))


def unknown_words(places: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(id, window, words, unknown, corrupt): windows of 512 bytes, every 64, over (id, pos, word).

    A window with 8 words or more, of which 40 % aren't in vocabulary (word), is
    corrupt. Every word is in the eight windows that cover its start: one
    grouping, no self-join.
    """
    known = vocabulary.select("word").distinct().withColumn("_known", F.lit(True))
    seen = places.join(known, "word", "left")
    last = F.floor(F.col("pos") / WORD_SLIDE)
    windows = F.sequence(F.greatest(F.lit(0), last - (WORD_WINDOW // WORD_SLIDE - 1)), last)
    each = seen.withColumn("window", F.explode(windows))
    sums = each.groupBy("id", "window").agg(F.count("*").alias("words"), F.count_if(F.col("_known").isNull()).alias("unknown"))
    return sums.withColumn("window", F.col("window") * WORD_SLIDE).withColumn("corrupt", (F.col("words") >= LEAST_WORDS) & (F.col("unknown") >= UNKNOWN_SHARE * F.col("words")))


def unknown_words_in(bodies: DataFrame, vocabulary: DataFrame, utf8: bool = True) -> DataFrame:
    """unknown_words of the words of bodies (id, body; ids are unique), whose places aren't shuffled.

    Bodies are dealt into chunks of about CHUNK bytes; of a chunk only its
    distinct words meet the vocabulary, and those found come back to it as one
    list, to count its windows where its bodies are.
    """
    import pyarrow as pa

    kind = bodies.schema["id"].dataType.simpleString()
    size = bodies.agg(F.sum(F.length("body"))).first()[0] or 0
    dealt = bodies.select("id", "body", F.pmod(F.xxhash64("id"), F.lit(max(1, -(-size // CHUNK)))).alias("_chunk"))

    def distinct(batches):
        held: dict = {}
        for b in byte_slices(batches, "body"):
            found, of = words.all_words_placed([x or b"" for x in b.column("body").to_pylist()], utf8)[:2]
            chunks = b.column("_chunk").to_numpy()[of].tolist()
            for c, w in zip(chunks, found):
                held.setdefault(c, set()).add(w)
            if sum(map(len, held.values())) > 1_000_000:
                yield from rows(held)
        yield from rows(held)

    def rows(held: dict):
        for c, own in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([c] * len(own), pa.int64()), pa.array(list(own), pa.binary())], ["_chunk", "word"])
        held.clear()

    asked = dealt.select("_chunk", "body").mapInArrow(distinct, "_chunk long, word binary")
    known = asked.join(vocabulary.select("word"), "word", "left_semi").groupBy("_chunk").agg(F.collect_set("word").alias("known"))

    def windows(left, right):
        there = set(right.column("known")[0].as_py()) if right.num_rows else set()
        ids, out = left.column("id").combine_chunks(), []
        for at in range(0, left.num_rows, 200):
            part = left.slice(at, 200)
            found, of, pos = words.all_words_placed([x or b"" for x in part.column("body").to_pylist()], utf8)
            missing = np.fromiter((w not in there for w in found), dtype=bool, count=len(found))
            body, window, key = _windows(of, pos, WORD_WINDOW, WORD_SLIDE)
            n = np.bincount(key.ravel()[key.ravel() >= 0], minlength=len(body))
            bad = np.bincount(key[missing].ravel()[key[missing].ravel() >= 0], minlength=len(body))
            out.append(pa.Table.from_arrays([ids.take(pa.array(at + body)), pa.array(window * WORD_SLIDE), pa.array(n), pa.array(bad)], ["id", "window", "words", "unknown"]))
        return pa.concat_tables(out) if out else pa.table({"id": ids, "window": pa.array([], pa.int64()), "words": pa.array([], pa.int64()), "unknown": pa.array([], pa.int64())})

    sums = dealt.groupBy("_chunk").cogroup(known.groupBy("_chunk")).applyInArrow(windows, f"id {kind}, window long, words long, unknown long")
    return sums.withColumn("corrupt", (F.col("words") >= LEAST_WORDS) & (F.col("unknown") >= UNKNOWN_SHARE * F.col("words")))


def _windows(of: np.ndarray, pos: np.ndarray, width: int, slide: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The windows, every slide bytes, that hold a start of a word: body and number of each, in order, and by word the windows (-1: none) that it is in."""
    back = np.arange(width // slide)
    window = (pos // slide)[:, None] - back
    key = of[:, None] << 32 | np.maximum(window, 0)
    found = np.unique(key[window >= 0])
    at = np.where(window >= 0, np.searchsorted(found, key), -1)
    return found >> 32, found & 0xFFFFFFFF, at


def odd_lengths(places: DataFrame) -> DataFrame:
    """(id, window, words, similarity, corrupt): word lengths of every 512 bytes, each 128, against a running model of what came before, of (id, pos, word).

    The model is decayed by 0.75 a window and needs more than 96 words; a cosine
    below 0.8 is corruption. The fold runs over one body's histograms, ordered.
    """
    import pyarrow as pa

    kind = places.schema["id"].dataType.simpleString()
    lists = places.groupBy("id").agg(F.collect_list(F.struct("pos", F.least(F.length("word"), F.lit(24)).cast("int").alias("len"))).alias("w"))

    def run(batches):
        for b in batches:
            w = b.column("w")
            of = np.repeat(np.arange(len(b)), np.diff(w.offsets.to_numpy()))
            yield _folded(b.column("id"), of, w.values.field(0).to_numpy(), w.values.field(1).to_numpy())

    return _flagged(lists.mapInArrow(run, f"id {kind}, window long, words long, similarity double"))


def odd_lengths_in(bodies: DataFrame, utf8: bool = True) -> DataFrame:
    """odd_lengths of the words of bodies (id, body; ids are unique), each body in its task."""
    kind = bodies.schema["id"].dataType.simpleString()

    def run(batches):
        for b in byte_slices(batches, "body"):
            _, starts, stops, of, pos = words.placed([x or b"" for x in b.column("body").to_pylist()], utf8)
            yield _folded(b.column("id"), of, pos, np.minimum(stops - starts, 24))

    return _flagged(bodies.select("id", "body").mapInArrow(run, f"id {kind}, window long, words long, similarity double"))


def _flagged(found: DataFrame) -> DataFrame:
    return found.withColumn("corrupt", F.coalesce(F.col("similarity") < LEAST_SIMILARITY, F.lit(False)))


def _folded(ids, of: np.ndarray, pos: np.ndarray, length: np.ndarray):
    """A batch (id, window, words, similarity) of words by body (a number into ids), place and length: all bodies in step, a window of each at a time."""
    import pyarrow as pa

    body, window, key = _windows(of, pos, LENGTH_WINDOW, LENGTH_SLIDE)
    at = (key * 25 + length[:, None])[key >= 0]
    h = np.bincount(at, minlength=len(body) * 25).reshape(-1, 25).astype(np.float64)
    words_ = h.sum(1)
    similarity = np.full(len(body), np.nan)
    if len(body):
        firsts = np.flatnonzero(np.r_[True, body[1:] != body[:-1]])
        many = np.diff(np.r_[firsts, len(body)])
        order = np.argsort(-many, kind="stable")  # those with a window left come first
        firsts, many = firsts[order], many[order]
        model, seen = np.zeros((len(firsts), 25)), np.zeros(len(firsts))
        for step in range(int(many[0])):
            live = int(np.searchsorted(-many, -step, "left"))
            x, m = h[firsts[:live] + step], model[:live]
            dot, square, own = np.zeros(live), np.zeros(live), np.zeros(live)
            for k in range(25):  # in the order of the lengths, so that a sum is the same in any company
                dot += m[:, k] * x[:, k]
                square += m[:, k] * m[:, k]
                own += x[:, k] * x[:, k]
            norm = np.sqrt(square * own)
            fit = (seen[:live] > LEAST_SEEN) & (norm > 0)
            similarity[(firsts[:live] + step)[fit]] = dot[fit] / norm[fit]
            model[:live] = m * DECAY + x
            seen[:live] = seen[:live] * DECAY + words_[firsts[:live] + step]
    return pa.RecordBatch.from_arrays([ids.take(pa.array(body)), pa.array(window * LENGTH_SLIDE), pa.array(words_.astype(np.int64)), pa.array(similarity, mask=np.isnan(similarity))], ["id", "window", "words", "similarity"])


def language_breaks(scores: DataFrame) -> DataFrame:
    """(id, window, score, corrupt): by (id, window, score) the windows whose best score is below 0.2 of the one before."""
    before = F.lag("score").over(Window.partitionBy("id").orderBy("window"))
    return scores.withColumn("corrupt", F.coalesce(F.col("score") < LANGUAGE_DROP * before, F.lit(False)))


def corrupt_ranges(flags: DataFrame, width: int) -> DataFrame:
    """(id, start, end): windows flagged corrupt, joined where they touch or overlap."""
    bad = flags.where("corrupt").select("id", F.col("window").alias("start"), (F.col("window") + width).alias("end"))
    w = Window.partitionBy("id").orderBy("start")
    fresh: Column = F.coalesce(F.col("start") > F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(True))
    return bad.withColumn("_island", F.sum(fresh.cast("int")).over(w)).groupBy("id", "_island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("_island")
