"""Inference of unknown bytes: contexts joined with n-gram models, scores, top two, replacements.

Cells stay packed, a row a span; only unknown positions are taken out, with the
known bytes on either side. Scoring is joins and groupings on those; a round
fixes the replacements that are surest in each span and writes the cells anew.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import cells as C
from ..functions.cells import CONFIDENCE_LEVELS
from ..functions.native import byte_slices, stretches
from ..sources.staging import mapped_dir, staged
from . import inference

LEAST_CONTEXT = 2
LONGEST = 5
CENTER_FACTOR = 0.25
TOP_SHARE = 0.96
AGGRESSIVE_RATIO = 25.0
FINAL_RATIO = 1.2
PRUNE = 0.2
LEAST_ALIGNED = 12


def occurrences(cells: DataFrame, longest: int = LONGEST) -> DataFrame:
    """(id, coindex, pos, left, right, weight) of the unknown positions of (id, cells): the known bytes next to them, longest at most.

    A marker ends a context. weight is lowered for context bytes that were
    themselves reconstructed, by their confidence.
    """
    import pyarrow as pa

    marker = np.array([C.DISCONTINUITY], dtype=np.uint32)

    def run(batches):
        for b in byte_slices(batches, "cells"):
            spans = [C.unpack(p) for p in b.column("cells").to_pylist()]
            # all spans of a slice at once; a marker behind each ends its contexts
            c = np.concatenate([x for span in spans for x in (span, marker)])
            sizes = np.array([len(x) + 1 for x in spans], dtype=np.int64)
            places = np.flatnonzero(C.is_unknown(c))
            if not len(places):
                continue
            known = C.is_known(c)
            at = np.arange(len(c))
            data = np.where(known, c & 0xFF, 0).astype(np.uint8)
            # how many known cells end before, and begin at, each place
            run_left = at - np.maximum.accumulate(np.where(known, -1, at))
            run_right = np.minimum.accumulate(np.where(known, len(c), at)[::-1])[::-1] - at
            lefts = np.where(places > 0, np.minimum(run_left[places - 1], longest), 0)
            rights = np.minimum(run_right[places + 1], longest)
            confidence = c >> C.CONFIDENCE_SHIFT & 0xFF
            doubt = np.where(known & (confidence < 63), confidence / ((CONFIDENCE_LEVELS + 2) * 1.5), 1.0)
            weights = np.ones(len(places))
            for far in range(longest, 0, -1):
                weights *= np.where(far <= lefts, doubt[places - far], 1.0)
            for far in range(1, longest + 1):
                weights *= np.where(far <= rights, doubt[np.minimum(places + far, len(c) - 1)], 1.0)
            span = np.repeat(np.arange(len(spans)), sizes)[places]
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("id").take(pa.array(span)),
                    pa.array(c[places].astype(np.int64)),
                    pa.array(places - (np.cumsum(sizes) - sizes)[span]),
                    stretches(data, places - lefts, lefts),
                    stretches(data, places + 1, rights),
                    pa.array(weights),
                ],
                ["id", "coindex", "pos", "left", "right", "weight"],
            )

    kind = cells.schema["id"].dataType.simpleString()
    return cells.select("id", "cells").mapInArrow(run, f"id {kind}, coindex long, pos long, left binary, right binary, weight double")


def wildcard_counts(found: DataFrame) -> DataFrame:
    """(id, coindex, occurrences) and, by max, the highest in use."""
    return found.groupBy("id", "coindex").agg(F.count("*").alias("occurrences"))


def side_scores(found: DataFrame, ngrams: DataFrame, side: str, model_weight: float = 1.0, longest: int = LONGEST) -> DataFrame:
    """(id, coindex, pos, byte, score) from the contexts on one side, with back-off: of each place only its longest context that the model has."""
    left = side == "left"
    context = "substring(gram, 1, n - 1)" if left else "substring(gram, 2, n - 1)"
    byte = "substring(gram, n, 1)" if left else "substring(gram, 1, 1)"
    table = ngrams.where(F.col("n").between(LEAST_CONTEXT + 1, longest + 1)).select((F.col("n") - 1).alias("k"), F.expr(context).alias("context"), F.expr(byte).alias("byte"), "freq")
    sums = F.sum("freq").over(Window.partitionBy("k", "context"))
    table = table.withColumn("context_freq", sums)
    cut = F.expr("substring(left, length(left) - k + 1, k)" if left else "substring(right, 1, k)")
    asked = found.where(F.length(side) >= LEAST_CONTEXT).withColumn("k", F.explode(F.sequence(F.lit(LEAST_CONTEXT), F.least(F.length(side), F.lit(longest))))).withColumn("context", cut)
    hits = asked.join(table, ["k", "context"])
    top = F.max("k").over(Window.partitionBy("id", "pos"))
    history = 0.4 * (1 + F.log(F.col("context_freq"))) / F.col("context_freq")
    score = F.col("weight") * (F.col("k") + 1) * model_weight * F.exp(0.4 * F.col("k")) * history * F.col("freq")
    return hits.withColumn("_top", top).where("k = _top").select("id", "coindex", "pos", F.conv(F.hex("byte"), 16, 10).cast("int").alias("byte"), score.alias("score"))


def center_scores(found: DataFrame, ngrams: DataFrame, averages: DataFrame, longest: int = LONGEST + 1) -> DataFrame:
    """(id, coindex, pos, byte, score) from grams with the unknown byte inside; of each place only the longest n that the model has.

    averages: (n, avgfreq). The model is spread by the place of the masked byte, at most n - 2 times.
    """
    masked = (
        ngrams.where(F.col("n").between(3, longest))
        .withColumn("j", F.explode(F.sequence(F.lit(1), F.col("n") - 2)))
        .select("n", "j", F.expr("concat(substring(gram, 1, j), substring(gram, j + 2, n - j - 1))").alias("masked"), F.expr("substring(gram, j + 1, 1)").alias("byte"), "freq")
    )
    asked = (
        found.where((F.length("left") > 0) & (F.length("right") > 0))
        .withColumn("n", F.explode(F.sequence(F.lit(3), F.lit(longest))))
        .withColumn("j", F.explode(F.sequence(F.lit(1), F.col("n") - 2)))
        .where("j <= length(left) AND n - 1 - j <= length(right)")
        .withColumn("masked", F.expr("concat(substring(left, length(left) - j + 1, j), substring(right, 1, n - 1 - j))"))
    )
    hits = asked.join(masked, ["n", "j", "masked"]).join(F.broadcast(averages), "n")
    top = F.max("n").over(Window.partitionBy("id", "pos"))
    score = F.col("freq") * F.col("weight") * CENTER_FACTOR * F.col("n") * F.col("n") / F.col("avgfreq")
    return hits.withColumn("_top", top).where("n = _top").select("id", "coindex", "pos", F.conv(F.hex("byte"), 16, 10).cast("int").alias("byte"), score.alias("score"))


# ---- constraints


def forbidden(byte: Column, before: Column, after: Column, encoding: str = "utf8", zero: Column | None = None) -> Column:
    """Whether a byte can't stand between its neighbours (null: unknown) in an encoding.

    zero, for ascii16: whether the place is one of those that hold zeros (null: not known).
    """
    if encoding == "utf8":
        continuation = byte.between(0x80, 0xBF)
        return (
            F.coalesce((before < 0x80) & continuation, F.lit(False))
            | F.coalesce(after.between(0x80, 0xBF) & (byte < 0x80), F.lit(False))
            | F.coalesce((before >= 0xC0) & ~continuation, F.lit(False))
            | byte.isin(0xC0, 0xC1)
            | (byte >= 0xF5)
        )
    if encoding == "euc":
        return F.coalesce((before < 0x80) & (after < 0x80) & (byte >= 0x80), F.lit(False))
    if encoding == "ascii16" and zero is not None:
        return F.coalesce(F.when(zero, byte != 0).otherwise(F.when(~zero, byte == 0)), F.lit(False))
    return F.lit(False)


def zero_places(cells: DataFrame) -> DataFrame:
    """(id, parity): whether the even (0) or the odd (1) places of a span of 16-bit text hold zeros, by its pairs of literals.

    Spans without such a pair, or whose pairs disagree, are left out.
    """
    import pyarrow as pa

    def run(batches):
        for b in byte_slices(batches, "cells"):
            ids, found = [], []
            for i, packed in zip(b.column("id").to_pylist(), b.column("cells").to_pylist()):
                c = C.unpack(packed)
                c = c[: len(c) // 2 * 2].reshape(-1, 2)
                both = c[C.is_known(c).all(axis=1)] & 0xFF
                one = {int(x) for x in np.unique(np.where((both == 0)[:, 0], 0, 1)[(both == 0).sum(1) == 1])}
                if len(one) == 1:
                    ids.append(i)
                    found.append(one.pop())
            yield pa.RecordBatch.from_arrays([pa.array(ids, b.column("id").type), pa.array(found, pa.int32())], ["id", "parity"])

    return cells.select("id", "cells").mapInArrow(run, f"id {cells.schema['id'].dataType.simpleString()}, parity int")


def forbidden_line_end(byte: Column, before: Column, after: Column, ending: Column) -> Column:
    """Whether a byte breaks the line ends of its model: with CRLF both stand together, else the other one doesn't occur."""
    lone = F.coalesce((byte == 13) & (after != 10), F.lit(False)) | F.coalesce((byte == 10) & (before != 13), F.lit(False))
    return F.when(ending == "CRLF", lone).when(ending == "LF", byte == 13).when(ending == "CR", byte == 10).otherwise(False)


def constraints(found: DataFrame, parity: DataFrame | None = None) -> DataFrame:
    """(id, coindex, before, after, zero, times): what the occurrences of an unknown have around them, and how often."""
    zero = F.lit(None).cast("boolean")
    if parity is not None:
        found = found.join(parity.select(F.col("id").alias("_id"), "parity"), F.col("id") == F.col("_id"), "left")
        zero = F.col("pos") % 2 == F.col("parity")
    return found.groupBy("id", "coindex", _last("left").alias("before"), _first("right").alias("after"), zero.alias("zero")).agg(F.count("*").alias("times"))


def _no(encoding: str, ending: str | None) -> Column:
    bad = forbidden(F.col("byte"), F.col("before"), F.col("after"), encoding, F.col("zero"))
    return bad if ending is None or "16" in encoding else bad | forbidden_line_end(F.col("byte"), F.col("before"), F.col("after"), F.lit(ending))


def candidates(found: DataFrame, encoding: str = "utf8", ending: str | None = None, parity: DataFrame | None = None) -> DataFrame:
    """(id, coindex, byte): the bytes that every occurrence of an unknown allows; all 256 where that leaves none."""
    each = constraints(found, parity).withColumn("byte", F.explode(F.sequence(F.lit(0), F.lit(255))))
    left = each.groupBy("id", "coindex", "byte").agg(F.max(_no(encoding, ending)).alias("_no"))
    none = F.min("_no").over(Window.partitionBy("id", "coindex"))
    return left.withColumn("_none", none).where("NOT _no OR _none").select("id", "coindex", "byte")


def unambiguous(allowed: DataFrame) -> DataFrame:
    """(id, coindex, byte, confidence): unknowns with one candidate."""
    return allowed.groupBy("id", "coindex").agg(F.count("*").alias("_n"), F.min("byte").alias("byte")).where("_n = 1").select("id", "coindex", "byte", F.lit(CONFIDENCE_LEVELS).alias("confidence"))


def _last(c: str) -> Column:
    return F.when(F.length(c) > 0, F.conv(F.hex(F.expr(f"substring({c}, length({c}), 1)")), 16, 10).cast("int"))


def _first(c: str) -> Column:
    return F.when(F.length(c) > 0, F.conv(F.hex(F.expr(f"substring({c}, 1, 1)")), 16, 10).cast("int"))


def in_use(allowed: DataFrame, found: DataFrame) -> DataFrame:
    """allowed (id, coindex, ...) without the unknowns that no position has any more."""
    return allowed.join(found.select("id", "coindex").distinct(), ["id", "coindex"], "left_semi")


# ---- edits of the replacements


def edited(replacements: DataFrame, edits: DataFrame) -> DataFrame:
    """replacements (id, coindex, byte, confidence) with edits (the same) in their place: a null byte takes one out, others are set or added."""
    names = ["id", "coindex", "byte", "confidence"]
    both = replacements.select(*names, F.lit(0).alias("_turn")).unionByName(edits.select(*names, F.lit(1).alias("_turn")))
    last = both.groupBy("id", "coindex").agg(F.max_by(F.struct("byte", "confidence"), "_turn").alias("_r"))
    return last.where("_r.byte IS NOT NULL").select("id", "coindex", "_r.byte", "_r.confidence")


def cleared_window(replacements: DataFrame, segment: int) -> DataFrame:
    """replacements without those of one segment's lost window."""
    return replacements.where(~F.col("coindex").between(segment * C.WINDOW + 1, (segment + 1) * C.WINDOW))


def moved_behind(replacements: DataFrame, segment: int) -> DataFrame:
    """replacements once another gap is found before a segment: those of its window and later ones are a window further on."""
    return replacements.withColumn("coindex", F.when(F.col("coindex") > segment * C.WINDOW, F.col("coindex") + C.WINDOW).otherwise(F.col("coindex")))


# ---- selection


def summed(found: DataFrame, scores: DataFrame, encoding: str = "utf8", ending: str | None = None, parity: DataFrame | None = None) -> DataFrame:
    """(id, coindex, byte, score, seen, occurrences): scores (id, coindex, pos, byte, score) added by unknown and byte, without bytes that an occurrence forbids."""
    totals = scores.groupBy("id", "coindex", "byte").agg(F.sum("score").alias("score"))
    seen = scores.select("id", "coindex", "pos").distinct().groupBy("id", "coindex").agg(F.count("*").alias("seen"))
    bad = totals.join(constraints(found, parity), ["id", "coindex"]).where(_no(encoding, ending)).select("id", "coindex", "byte").distinct()
    return totals.join(bad, ["id", "coindex", "byte"], "left_anti").join(seen, ["id", "coindex"]).join(wildcard_counts(found), ["id", "coindex"])


def top_two(totals: DataFrame) -> DataFrame:
    """(id, coindex, byte, top, second, seen, occurrences): the best byte of each unknown; ties, to nine digits, go to the lower byte."""
    w = Window.partitionBy("id", "coindex").orderBy(F.desc(F.round("score", 9)), "byte")
    ranked = totals.where("score > 0").withColumn("_rank", F.row_number().over(w)).withColumn("second", F.coalesce(F.lead("score").over(w), F.lit(0.0)))
    return ranked.where("_rank = 1").select("id", "coindex", "byte", F.col("score").alias("top"), "second", "seen", "occurrences")


def unsupported(totals: DataFrame) -> DataFrame:
    """(id, coindex, byte) whose score is below 0.2 of the best: what pruning removes."""
    best = F.max("score").over(Window.partitionBy("id", "coindex"))
    return totals.withColumn("_best", best).where((F.col("score") <= 0) | (F.col("score") < PRUNE * F.col("_best"))).select("id", "coindex", "byte")


def ranked(best: DataFrame) -> DataFrame:
    """Adds enough, ratio, ranking and confidence."""
    seen, occ = F.col("seen"), F.col("occurrences")
    ratio = F.least(F.col("top") / F.greatest(F.col("second"), F.lit(1e-12)), F.lit(10000.0))
    context = F.greatest(F.least(seen / 5, F.lit(1.0)), seen / occ)
    stored = 8 * (F.least(ratio, F.lit(4.0)) - 1.2) + F.col("top") / occ
    return (
        best.withColumn("enough", (seen >= occ) | (seen >= 3 + occ / 2))
        .withColumn("ratio", ratio)
        .withColumn("ranking", F.sqrt(context) * (10 * F.log("ratio") + 0.25 * F.log(1 + F.col("top") - F.col("second"))))
        .withColumn("confidence", F.least(F.floor(stored), F.lit(CONFIDENCE_LEVELS)).cast("int"))
    )


def with_span_best(rank: DataFrame) -> DataFrame:
    """rank with span_best, the highest ranking of those of a span that have enough, unless it has that already."""
    if "span_best" in rank.columns:
        return rank
    return rank.withColumn("span_best", F.max(F.when(F.col("enough"), F.col("ranking"))).over(Window.partitionBy("id")))


def is_chosen(ratio: float | None = None, share: float = TOP_SHARE) -> Column:
    """Whether a row of with_span_best is within share of its span's best; with ratio, whether its ratio is at least that."""
    near = F.col("enough") & (F.col("ranking") >= share * F.col("span_best"))
    return F.coalesce(near if ratio is None else F.col("ratio") >= ratio, F.lit(False)) & (F.col("confidence") >= 1)


def chosen(rank: DataFrame, iteration: int = 0, ratio: float | None = None, share: float = TOP_SHARE) -> DataFrame:
    """(id, coindex, byte, confidence): those ranked within share of their span's best; with ratio, all whose ratio is at least that."""
    kept = with_span_best(rank).where(is_chosen(ratio, share))
    return kept.select("id", "coindex", "byte", F.greatest(F.col("confidence") - 8 * iteration, F.lit(1)).alias("confidence"))


def apply_replacements(cells: DataFrame, replacements: DataFrame) -> DataFrame:
    """cells with every unknown that replacements (id, coindex, byte, confidence) knows. A span has at most a window of unknowns a gap, so its list is bounded."""
    import pyarrow as pa

    lists = replacements.groupBy(F.col("id").alias("_id")).agg(F.collect_list(F.struct("coindex", "byte", "confidence")).alias("_r"))
    joined = cells.join(lists, F.col("id") == F.col("_id"), "left").select(*cells.columns, "_r")

    def run(batches):
        for b in byte_slices(batches, "cells"):
            out = []
            lists = b.column("_r")
            # the parts of a slice's lists; null lists are empty
            start, all_ = lists.offsets.to_numpy(), lists.values
            keys_, bytes_, levels = (all_.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(3))
            there = lists.is_valid().to_numpy(zero_copy_only=False)
            for k, packed in enumerate(b.column("cells").to_pylist()):
                c = C.unpack(packed)
                if there[k] and start[k + 1] > start[k]:
                    own = slice(int(start[k]), int(start[k + 1]))
                    order = np.argsort(keys_[own])
                    keys = keys_[own][order]
                    values = (C.RECONSTRUCTED | np.minimum(levels[own], CONFIDENCE_LEVELS) << C.CONFIDENCE_SHIFT | bytes_[own])[order].astype(np.uint32)
                    at = np.minimum(np.searchsorted(keys, c), len(keys) - 1)
                    c = np.where(C.is_unknown(c) & (keys[at] == c), values[at], c).astype("<u4")
                out.append(c.tobytes())
            names = [n for n in b.schema.names if n != "_r"]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary()) if n == "cells" else b.column(n) for n in names], names)

    return joined.mapInArrow(run, cells.schema)


def ranked_unknowns(cells: DataFrame, ngrams: DataFrame, encoding: str = "utf8", ending: str | None = None, longest: int = LONGEST) -> DataFrame:
    """ranked(top_two(...)) of the unknowns of cells (id, cells), scored by their side contexts in ngrams (n, gram, freq), with pruned, the number of unsupported bytes.

    A model of no more than inference.MOST_GRAMS n-grams is sent to the spans,
    which are scored where they stand; for others contexts are joined with it.
    """
    grams = staged(ngrams.where(F.col("n").between(LEAST_CONTEXT + 1, longest + 1)).select("n", "gram", "freq"), "grams")
    if grams.count() <= inference.MOST_GRAMS:
        return inference.ranked_unknowns(cells, grams, inference.Rules(encoding, ending), longest)
    found = staged(occurrences(cells, longest), "occurrences")
    both = side_scores(found, grams, "left", longest=longest).unionByName(side_scores(found, grams, "right", longest=longest))
    totals = staged(summed(found, both, encoding, ending), "totals")
    pruned = unsupported(totals).groupBy("id", "coindex").agg(F.count("*").alias("pruned"))
    return ranked(top_two(totals)).join(pruned, ["id", "coindex"], "left").withColumn("pruned", F.coalesce("pruned", F.lit(0)))


def position_scores(found: DataFrame, grams: DataFrame, averages: DataFrame | None = None) -> DataFrame:
    """(id, coindex, pos, byte, score) of the unknown positions found: left, right and, with averages (n, avgfreq), center contexts."""
    scores = side_scores(found, grams, "left").unionByName(side_scores(found, grams, "right"))
    return scores if averages is None else scores.unionByName(center_scores(found, grams, averages))


def rescored(found: DataFrame, grams: DataFrame, averages: DataFrame | None, before: DataFrame, scores: DataFrame) -> DataFrame:
    """position_scores of found, of which those stay that (found) before had with the same bytes around them and so the same scores."""
    around = ["id", "coindex", "pos", "left", "right", "weight"]
    same = found.join(before.select(around), around, "left_semi").select("id", "pos")
    changed = found.join(before.select(around), around, "left_anti")
    return scores.join(same, ["id", "pos"], "left_semi").select(scores.columns).unionByName(position_scores(changed, grams, averages))


def reconstruct(
    cells: DataFrame,
    ngrams: DataFrame,
    averages: DataFrame | None = None,
    rounds: int | None = None,
    encoding: str = "utf8",
    aggressive: bool = True,
    align: bool = True,
    local_weight: float = 0.0,
    prune: bool = False,
    ending: str | None = None,
    iterations: int = 1,
) -> DataFrame:
    """cells (id, cells, ...) with unknown bytes inferred from ngrams (n, gram, freq), in rounds.

    A round takes the surest of each span; only positions next to what it fixed
    are scored again. When a round finds nothing sure any more, it takes all whose
    best byte is 1.2 times the second (if aggressive), until that gives nothing
    either. Then align takes from before a gap what agrees with the bytes found
    behind it, and rounds begin anew: iterations times, or as often as a span has
    segments, but only while that still fixes something. rounds bounds their
    number, where less time is worth more than the last bytes.

    local_weight adds the counts of the cells' own literal runs, so weighted, to
    the model's; prune leaves out candidates below 0.2 of their unknown's best;
    ending (CRLF, CR, LF) and encoding (utf8, euc, ascii16) forbid bytes; in
    ascii16 those that are left alone are fixed first.

    A model of no more than inference.MOST_GRAMS n-grams is sent to the spans,
    where the rounds run on arrays; a larger one is written to the shared folder
    as sorted files, which the tasks map. With averages, for ascii16, and where
    that folder can't be mapped, rounds are joins, written there. The order is confidence, then co-index.
    """
    grams = ngrams.groupBy("n", "gram").agg(F.sum("freq").alias("freq"))
    if local_weight:
        own = local_ngrams(cells).groupBy("n", "gram").agg(F.sum("freq").alias("freq"))
        both = grams.select("n", "gram", F.col("freq").cast("double").alias("freq")).unionByName(own.select("n", "gram", (F.col("freq") * local_weight).alias("freq")))
        grams = both.groupBy("n", "gram").agg(F.sum("freq").alias("freq"))
    grams = staged(grams, "grams")
    if averages is None and encoding != "ascii16":
        few = grams.count() <= inference.MOST_GRAMS
        folder = None if few or inference.MOST_GRAMS < 0 else mapped_dir(cells.sparkSession, "model")
        if few or folder is not None:
            rules = inference.Rules(encoding, ending, aggressive, align, prune, rounds, iterations)
            return inference.inferred(cells, grams, rules, lambda c, known: _align(c, None, known), folder)
    parity = None
    made: list[DataFrame] = []

    def fix(fixed: DataFrame) -> bool:
        nonlocal cells
        fixed = staged(fixed, "replacements")
        if fixed.isEmpty():
            return False
        made.append(fixed)
        cells = staged(apply_replacements(cells, fixed), "cells")
        return True

    if encoding == "ascii16":
        parity = staged(zero_places(cells), "parity")
        fix(unambiguous(candidates(occurrences(cells), encoding, ending, parity)))
    turns = iterations
    if "discontinuities" in cells.columns:
        turns = max(turns, 1 + (cells.agg(F.max("discontinuities")).first()[0] or 0))
    before = scores = None
    done = 0
    for _ in range(turns):
        last = False
        while rounds is None or done < rounds:
            last = last or done + 1 == rounds
            done += 1
            found = staged(occurrences(cells), "occurrences")
            if found.isEmpty():
                break
            scores = staged(position_scores(found, grams, averages) if before is None else rescored(found, grams, averages, before, scores), "scores")
            before = found
            totals = summed(found, scores, encoding, ending, parity)
            if prune:
                totals = staged(totals, "totals")
                totals = totals.join(unsupported(totals), ["id", "coindex", "byte"], "left_anti")
            rank = staged(ranked(top_two(totals)), "ranked")
            fixed = chosen(rank, ratio=FINAL_RATIO if last and aggressive else None, share=TOP_SHARE if not aggressive else 0.5)
            if aggressive and not last:
                fixed = fixed.unionByName(chosen(rank, ratio=AGGRESSIVE_RATIO)).dropDuplicates(["id", "coindex"])
            if not fix(fixed):
                if last or not aggressive:
                    break
                last = True
        if not align or not made:
            break
        known = made[0]
        for m in made[1:]:
            known = known.unionByName(m)
        left = occurrences(cells).count()
        cells = staged(aligned(cells, known), "cells")
        if occurrences(cells).count() == left:
            break
    return cells


def local_ngrams(cells: DataFrame, max_n: int = 6) -> DataFrame:
    """(model_id, n, gram, freq) of each span's own literal runs: a file-local model, its id the span's."""
    import pyarrow as pa

    from .ngrams import ngram_counts

    def run(batches):
        for b in byte_slices(batches, "cells"):
            ids, bodies = [], []
            for i, packed in zip(b.column("id").to_pylist(), b.column("cells").to_pylist()):
                c = C.unpack(packed)
                known = C.is_known(c)
                edges = np.flatnonzero(np.r_[True, known[1:] != known[:-1], True]) if len(c) else np.zeros(1, int)
                data = (c & 0xFF).astype(np.uint8)
                for a, z in zip(edges[:-1].tolist(), edges[1:].tolist()):
                    if known[a] and z - a >= 3:
                        ids.append(str(i))
                        bodies.append(data[a:z].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(bodies, pa.binary())], ["model_id", "body"])

    return ngram_counts(cells.select("id", "cells").mapInArrow(run, "model_id string, body binary"), max_n)


# ---- against the truth


def accuracy(cells: DataFrame, truth: DataFrame) -> DataFrame:
    """(id, total, identical, reconstructed, correct, correct_folded, unknown) of (id, cells) against (id, original, known_start).

    known_start (true where the column isn't there) says that the cells begin
    where the truth does. If so, the first segment is held against the beginning of the truth, the last one
    against its end; segments without a known place aren't counted.
    """
    import pyarrow as pa

    names = ["total", "identical", "reconstructed", "correct", "correct_folded", "unknown"]

    def fold(x):
        return np.where((x >= 65) & (x <= 90), x + 32, x)

    def run(batches):
        for b in byte_slices(batches, "cells"):
            rows = []
            for packed, original, known_start in zip(b.column("cells").to_pylist(), b.column("original").to_pylist(), b.column("known_start").to_pylist()):
                c, t = C.unpack(packed), np.frombuffer(original or b"", dtype=np.uint8)
                marks = np.flatnonzero(C.is_marker(c))
                if not len(marks):
                    parts = [(c[: len(t)], t[: len(c)] if known_start else None)]
                else:
                    parts = [(c[marks[-1] + 1 :], None)]
                    if known_start:
                        parts.append((c[: min(marks[0], len(t))], t[: marks[0]]))
                sums = np.zeros(6, dtype=np.int64)
                for cell, there in parts:
                    if there is None:
                        there = t[len(t) - len(cell) :] if 0 < len(cell) <= len(t) else t[:0]
                    cell = cell[len(cell) - len(there) :] if len(there) else cell[:0]
                    known = C.is_known(cell)
                    byte = (cell & 0xFF).astype(np.uint8)
                    made = known & ((cell >> 16 & 0xFF) < 63)
                    sums += [len(cell), (known & (byte == there)).sum(), made.sum(), (made & (byte == there)).sum(), (made & (fold(byte) == fold(there))).sum(), (~known).sum()]
                rows.append(sums.tolist())
            yield pa.RecordBatch.from_arrays([b.column("id"), *(pa.array([r[k] for r in rows], pa.int64()) for k in range(6))], ["id", *names])

    kind = cells.schema["id"].dataType.simpleString()
    start = F.col("known_start") if "known_start" in truth.columns else F.lit(True)
    joined = cells.select("id", "cells").join(truth.select("id", "original", start.alias("known_start")), "id")
    return joined.mapInArrow(run, f"id {kind}, " + ", ".join(f"{n} long" for n in names))


def aligned(cells: DataFrame, replacements: DataFrame, weights: dict[int, float] | None = None) -> DataFrame:
    """cells with unknowns behind a gap taken from the literals before it, where the two agree at one offset.

    The bytes that replacements (id, coindex, byte) give a segment's lost window
    are slid along the end of the segment before; the offset with the best
    weighted agreement, of twelve matches or more and most of them, fixes the rest.
    """
    import pyarrow as pa

    lists = replacements.groupBy(F.col("id").alias("_id")).agg(F.collect_list(F.struct("coindex", "byte")).alias("_r"))
    joined = cells.join(lists, F.col("id") == F.col("_id"), "left").select(*cells.columns, "_r")

    def run(batches):
        for b in byte_slices(batches, "cells"):
            out = []
            for p, r in zip(b.column("cells").to_pylist(), b.column("_r").to_pylist()):
                out.append(_align(C.unpack(p), weights, {x["coindex"]: x["byte"] for x in r or []}).astype("<u4").tobytes())
            names = [n for n in b.schema.names if n != "_r"]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary()) if n == "cells" else b.column(n) for n in names], names)

    return joined.mapInArrow(run, cells.schema)


def _align(c: np.ndarray, weights: dict[int, float] | None, known: dict[int, int] | None = None) -> np.ndarray:
    """One span. known: bytes by co-index that are replaced already."""
    if not known:
        return c
    marks = np.flatnonzero(C.is_marker(c))
    c = c.copy()
    for k, m in enumerate(marks.tolist(), 1):
        before = c[(marks[k - 2] + 1 if k > 1 else 0) : m]
        tail = np.where(C.is_known(before), (before & 0xFF).astype(np.int64), -1)
        window = {i - k * C.WINDOW: v for i, v in known.items() if k * C.WINDOW < i <= (k + 1) * C.WINDOW}
        best, place = 0.0, None
        far, value = np.array(list(window), dtype=np.int64), np.array(list(window.values()), dtype=np.int64)
        for gap in range(0, C.WINDOW - len(tail) if len(tail) < C.WINDOW else 1):
            at = len(tail) + gap - far
            there = (at >= 0) & (at < len(tail))
            if there.sum() < LEAST_ALIGNED:
                break
            same = tail[at[there]] == value[there]
            if same.sum() < LEAST_ALIGNED or same.sum() * 2 <= len(same):
                continue
            w = np.array([(weights or {}).get(int(v), 1.0) for v in value[there]])
            score = float((np.where(same, 1, -1) * w).sum()) * np.sqrt(there.mean())
            if score > best:
                best, place = score, gap
        if place is not None:
            unknown = C.is_unknown(c) & (c > k * C.WINDOW) & (c <= (k + 1) * C.WINDOW)
            at = len(tail) + place - (c.astype(np.int64) - k * C.WINDOW)
            good = unknown & (at >= 0) & (at < len(tail))
            good[good] = tail[at[good]] >= 0
            c[good] = C.INFERRED | tail[at[good]].astype(np.uint32)
    return c
