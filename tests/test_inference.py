"""Inference in a span's task against the rounds of joins; detectors and what they find; whole queries against brute force."""

import random
import zlib
from collections import Counter

import numpy as np
import pytest

from tidewrack.functions import cells as C
from tidewrack.operators import corruption, deflate, inference, ngrams, reconstruct, words
from tidewrack.plans import catalog, recover
from tidewrack.sources import blobs as B

rng = random.Random(6)
VOCABULARY = ["".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(2, 8))) for _ in range(300)]


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(VOCABULARY) for _ in range(n)).encode()


def deflated(data):
    c = zlib.compressobj(6, zlib.DEFLATED, -15)
    return c.compress(data) + c.flush()


@pytest.fixture(scope="module")
def model(spark):
    return ngrams.ngram_counts(spark.createDataFrame([("m", prose(6000, 1))], "model_id string, body binary"), 6, 3).cache()


@pytest.fixture(scope="module")
def holed(spark):
    """Spans whose unknown bytes come again under one number, beside each other too."""
    rows = []
    for i in range(6):
        text = prose(300, 50 + i)
        c = np.frombuffer(text, np.uint8).astype("<u4") | np.uint32(C.LITERAL)
        c = c.copy()
        names = {}
        for p in random.Random(i).sample(range(len(c)), len(c) // 12):
            c[p] = names.setdefault((text[p], p % 3), len(names) + 1)
        rows.append((i, c.tobytes(), text))
    return spark.createDataFrame(rows, "id long, cells binary, original binary").cache()


@pytest.mark.parametrize("ending,prune", [(None, False), ("LF", True)])
def test_the_rounds_of_a_task_are_those_of_joins(spark, model, holed, monkeypatch, ending, prune):
    cells = holed.select("id", "cells")
    quick = {r.id: C.unpack(r.cells) for r in reconstruct.reconstruct(cells, model, rounds=2, align=False, ending=ending, prune=prune).collect()}
    monkeypatch.setattr(inference, "MOST_GRAMS", -1)
    joined = {r.id: C.unpack(r.cells) for r in reconstruct.reconstruct(cells, model, rounds=2, align=False, ending=ending, prune=prune).collect()}
    assert all((quick[i] == joined[i]).mean() > 0.999 for i in quick)
    assert sum(int(C.is_unknown(c).sum()) for c in quick.values()) < 0.7 * sum(int(C.is_unknown(C.unpack(r.cells)).sum()) for r in holed.collect())


def test_rounds_go_on_until_nothing_is_left_to_fix(model, holed):
    table = model.where("n BETWEEN 3 AND 6").toPandas()
    grams = inference.GramModel(table.n.to_numpy(), np.array([int.from_bytes(g, "big") for g in table.gram]), table.freq.to_numpy())
    keep = lambda c, found: c
    for r in holed.collect():
        c = C.unpack(r.cells)
        few, all_ = (inference.infer(c, grams, inference.Rules(rounds=n), keep) for n in (2, None))
        again = inference.infer(all_, grams, inference.Rules(), keep)
        left = [int(C.is_unknown(x).sum()) for x in (c, few, all_, again)]
        assert left[0] > left[1] >= left[2] and left[2] == left[3]
        made = C.is_known(all_) & C.is_unknown(c)
        truth = np.frombuffer(r.original, np.uint8)
        assert ((all_ & 0xFF)[made] == truth[made]).mean() > 0.6


def test_sixteen_bit_text(spark):
    text = "some plain text, twice".encode("utf-16-le")
    c = np.frombuffer(text, np.uint8).astype("<u4") | np.uint32(C.LITERAL)
    c = c.copy()
    c[[5, 9]] = [1, 1]
    c[12] = 2
    df = spark.createDataFrame([(1, c.tobytes()), (2, (np.array([0, 0, 65, 65], "<u4") | np.uint32(C.LITERAL)).tobytes())], "id long, cells binary")
    assert [tuple(r) for r in reconstruct.zero_places(df).collect()] == [(1, 1)]
    fixed = reconstruct.unambiguous(reconstruct.candidates(reconstruct.occurrences(df), "ascii16", parity=reconstruct.zero_places(df))).collect()
    assert [(r.coindex, r.byte, r.confidence) for r in fixed] == [(1, 0, 62)]
    made = reconstruct.reconstruct(df, ngrams.ngram_counts(spark.createDataFrame([("m", text)], "model_id string, body binary"), 3), encoding="ascii16", rounds=1)
    assert C.plain_text(C.unpack(made.where("id = 1").first().cells))[:12] == text[:12]


# ---- detectors in the recovery


def test_checkpoints():
    data = prose(3000, 9)
    stream = deflated(data)
    places = deflate.checkpoints(stream, 64)
    assert places[-1][0] == len(data) and [p for p, _ in places[:-1]] == list(range(0, len(data), 64))
    bits = deflate.Bits(stream)
    # the symbol read at a checkpoint makes the first byte at or behind its place, or a copy that runs over it
    head = deflate.read_header(bits, 0)
    for pos, bit in places[3:200:17]:
        symbol, _ = head.literals.next(bits, bit)
        assert symbol != 256 and (symbol > 256 or symbol in data[pos : pos + 258])
    stored = zlib.compressobj(0, zlib.DEFLATED, -15)
    stored = stored.compress(data[:1000]) + stored.flush()
    assert [b - places2 * 8 for places2, b in deflate.checkpoints(stored, 100)[:-1]] == [40] * 10


def test_members_that_stop_reading_as_words_are_decoded_again(spark):
    data = prose(20_000, 3)
    stream = bytearray(deflated(data))
    at = len(stream) // 2
    stream[at : at + 40] = bytes(random.Random(2).randrange(256) for _ in range(40))
    raw = spark.createDataFrame([(1, 0, "a.txt", bytes(stream), data), (1, 1, "b.txt", deflated(data), data)], "archive_id long, ord int, name string, body binary, original binary")
    blob = B.stored_zip(raw, original="original")
    vocabulary = spark.createDataFrame([(bytearray(w.encode()),) for w in VOCABULARY], "word binary")
    plain, marked = ({r.name: r for r in recover.recover_members(blob, vocabulary=v).collect()} for v in (None, vocabulary))
    assert marked["b.txt"].complete and plain["b.txt"].cells == marked["b.txt"].cells

    def wrong(r):
        """Known bytes in front of the damage's end that aren't the truth's."""
        c = C.unpack(r.cells)
        c = c[~C.is_marker(c)][: len(data)]
        known = C.is_known(c)
        return int(((c & 0xFF)[known] != np.frombuffer(data, np.uint8)[: len(c)][known]).sum()), int(known.sum())

    streams = spark.createDataFrame([("a", bytes(stream)), ("b", deflated(data))], "id string, body binary")
    found = {r.id: r for r in recover.marked_corrupt(streams, deflate.decoded(streams), vocabulary).collect()}
    assert found["b"].corrupt_from is None
    if found["a"].corrupt_from is not None:
        assert found["a"].corrupt_from <= at + 512 and found["a"].corrupt_to > at
    assert wrong(marked["a.txt"])[0] <= wrong(plain["a.txt"])[0]


def test_stages_of_the_block_search(spark):
    texts = [prose(2000, k) for k in range(3)]
    streams = spark.createDataFrame([(i, deflated(t)) for i, t in enumerate(texts)], "id long, body binary")
    found = {r.metric: r.value for r in deflate.stage_counts(streams).collect()}
    assert found["valid_dynhuff_packet"] >= 3 and found["candidate_dynhuff_packet"] >= found["valid_huffman_tree"] >= found["valid_EOD_marker"] >= 3


# ---- queries without SQL


def test_blocks_of_a_stream(spark, sf_dir):
    """Blocks by the bits where zlib can go on: each block is decoded with nothing but what came before."""
    found = {r.packets: r.members for r in catalog.QUERIES["packet_histogram"](spark, sf_dir).collect()}
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    right = Counter(min(10, len(deflate.recover_blocks(deflated(r.text.encode())))) for r in docs)
    assert found == dict(right)
    random_ = random.Random(4)
    data = bytes(random_.choice(b"abcdefgh \n") for _ in range(120_000)) + random_.randbytes(50_000)
    blocks = deflate.recover_blocks(deflated(data))
    assert len(blocks) > 3 and sum(p.size for p in blocks) == len(data) and [p.final for p in blocks] == [False] * (len(blocks) - 1) + [True]
    assert len(deflate.recover_blocks(b"".join([(c := zlib.compressobj(6, zlib.DEFLATED, -15)).compress(b"a b c" * 99), c.flush(zlib.Z_FULL_FLUSH), c.compress(b"d e f" * 99), c.flush()]))) == 3


def test_every_damaged_stream_is_reconstructed(spark, sf_dir):
    found = catalog.QUERIES["reconstruct_accuracy"](spark, sf_dir).collect()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    assert {r.id for r in found} == {int(r.source[3:]) * 1_000_000 + r.doc_id // catalog.STREAM_DOCS for r in docs}
    assert {r.damage for r in found} == {"head", "tail", "middle"}
    for r in found:  # what wasn't inferred is right, and little is left
        assert r.identical == r.total - r.reconstructed - r.unknown + r.correct and r.unknown <= 0.05 * r.total
    made = sum(r.reconstructed for r in found)
    assert made > 0 and sum(r.correct for r in found) > 0.1 * made


def test_word_queries(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    counts = Counter((r.lang, w) for r in docs for w in words.words(r.text.encode()))
    assert {(r.model_id, bytes.fromhex(r.word)): r.freq for r in catalog.QUERIES["word_freq"](spark, sf_dir).collect()} == dict(counts)
    all_counts = Counter()
    for (_, w), n in counts.items():
        all_counts[w] += n
    known = {w for w, n in all_counts.items() if n >= 3}
    windows, lengths = {}, {}
    for r in docs:
        x = r.text.encode()
        starts = np.flatnonzero(words.boundaries(x)).tolist()
        edges = sorted({0, *starts, len(x)})
        for s, e in zip(edges, edges[1:]):
            if x[s:e].strip():
                for k in range(max(0, s // 64 - 7), s // 64 + 1):
                    n, u = windows.get((r.doc_id, k * 64), (0, 0))
                    windows[r.doc_id, k * 64] = (n + 1, u + (x[s:e] not in known))
                for k in range(max(0, s // 128 - 3), s // 128 + 1):
                    lengths.setdefault(r.doc_id, {}).setdefault(k * 128, np.zeros(25))[min(24, e - s)] += 1
    found = {(r.id, r.window): (r.words, r.unknown, r.corrupt) for r in catalog.QUERIES["known_word_ratio_windows"](spark, sf_dir).collect()}
    assert found == {k: (n, u, n >= 8 and u >= 0.4 * n) for k, (n, u) in windows.items()}
    right = {}
    for i, by in lengths.items():
        model, seen = np.zeros(25), 0.0
        for w in sorted(by):
            h = by[w]
            likeness = None
            if seen > 96 and model.any():
                likeness = float(model @ h / np.sqrt((model @ model) * (h @ h)))
            right[i, w] = (int(h.sum()), likeness)
            model, seen = model * 0.75 + h, seen * 0.75 + h.sum()
    found = {(r.id, r.window): (r.words, r.similarity, r.corrupt) for r in catalog.QUERIES["word_length_windows"](spark, sf_dir).collect()}
    assert found.keys() == right.keys()
    for k, (n, likeness) in right.items():
        assert found[k][0] == n and (likeness is None) == (found[k][1] is None)
        assert likeness is None or abs(found[k][1] - likeness) < 1e-9 and found[k][2] == (found[k][1] < corruption.LEAST_SIMILARITY)


def _shuffles(df) -> bool:
    return "Exchange" in df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["side_scores", "replacement_ranking"])
def test_unknowns_are_ranked_where_their_span_stands(spark, sf_dir, name):
    """Scores, a row a byte and place, are many times the input; they must not be shuffled."""
    assert not _shuffles(catalog.QUERIES[name](spark, sf_dir))


def test_ranked_in_the_task_or_by_joins(spark, monkeypatch):
    text = b"the cat sat on the mat and the rat sat on the hat, then that cat ate the rat on the mat. " * 20
    c = np.frombuffer(text, dtype=np.uint8).astype("<u4") | np.uint32(C.LITERAL)
    spans = []
    for i in range(3):
        x = c.copy()
        x[20 + i :: 37] = np.arange(1, len(x[20 + i :: 37]) + 1) % 7 + 1  # unknowns that occur more than once
        x[11] = C.reconstructed(text[11], 20)
        spans.append((i, bytearray(x.tobytes())))
    cells = spark.createDataFrame(spans, "id long, cells binary")
    model = ngrams.ngram_counts(spark.createDataFrame([("m", bytearray(text))], "model_id string, body binary"), 6)
    names = ["id", "coindex", "byte", "seen", "occurrences", "pruned", "enough", "confidence"]
    take = lambda df: sorted(tuple(r[n] for n in names) + (round(r.top, 9), round(r.ranking, 6), round(r.span_best, 6)) for r in reconstruct.with_span_best(df).collect())
    own = take(reconstruct.ranked_unknowns(cells, model))
    monkeypatch.setattr(reconstruct.inference, "MOST_GRAMS", 0)
    assert own == take(reconstruct.ranked_unknowns(cells, model)) and len(own) == 21


def test_a_large_model_is_mapped_and_gives_the_same(spark, model, holed, monkeypatch):
    cells = holed.select("id", "cells")
    sent = sorted((r.id, bytes(r.cells)) for r in reconstruct.reconstruct(cells, model).collect())
    monkeypatch.setattr(inference, "MOST_GRAMS", 0)
    monkeypatch.setattr(reconstruct, "position_scores", lambda *a: pytest.fail("rounds are joins"))
    assert sorted((r.id, bytes(r.cells)) for r in reconstruct.reconstruct(cells, model).collect()) == sent
