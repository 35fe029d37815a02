from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewrack.functions import cells as C
from tidewrack.functions import native
from tidewrack.operators import corruption, language, ngrams, reconstruct, words
from tidewrack.sources import sinks


def bodies(spark, *rows):
    return spark.createDataFrame([("m", bytes(b)) for b in rows], "model_id string, body binary")


def test_counts_of_prefixes(spark):
    rows = [b"abcabc", b"", b"xy", b"\xff\x00\xff\x00\xff\x00\xff\x00\xff"]
    want: Counter = Counter()
    for b in rows:
        for p in range(len(b) - 2):
            for n in range(1, min(8, len(b) - p) + 1):
                want[b[p : p + n]] += 1
    found = ngrams.ngram_counts(bodies(spark, *rows), 8).collect()
    assert {bytes(r.gram): r.freq for r in found} == dict(want) and all(r.n == len(r.gram) for r in found)
    assert ngrams.ngram_counts(bodies(spark), 3).count() == 0
    assert ngrams.trigram_counts(bodies(spark, b"aaaa" * 20_000), 100).first().freq == 100


def test_models_are_written_and_read(spark, tmp_path):
    model = ngrams.ngram_counts(bodies(spark, b"hello hello"), 3)
    ngrams.write_model(model, str(tmp_path / "m"))
    assert ngrams.read_model(spark, str(tmp_path / "m")).count() == model.count()
    spark.range(3).write.parquet(str(tmp_path / "x"))
    with pytest.raises(ValueError):
        ngrams.read_model(spark, str(tmp_path / "x"))


def test_word_rules():
    for text, want in [
        ("a cat's 3.14, ok", ["a", " cat's", " 3.14", ",", " ok"]),
        ("<b>x</b><br/>y", ["<b", ">", "x", "</b", ">", "<br", "/>", "y"]),
        ("one--two", ["one", "--", "two"]),
        ("&amp;&#39;", ["&amp", ";", "&#39", ";"]),
        ("", []),
    ]:
        joined = b"".join(words.words(text.encode()))
        assert joined.replace(b" ", b"") == text.replace(" ", "").encode(), text
        if text == "one--two":
            assert words.words(text.encode()) == [b"one", b"--", b"two"]
    assert words.words("naïve café".encode())[0].startswith("naïve".encode())
    assert not words.boundaries(b"ab\x7fcd")[2]


def test_lengths_and_line_ends(spark):
    found = {(r.kind, r.len): r["count"] for r in ngrams.closed_words(bodies(spark, b"ab cde  f\ng", b"<p>text</p>", b"noend", b" " + b"x" * 40 + b" ")).collect()}
    assert found == {("delimiter", 1): 8, ("word", 3): 1, ("delimiter", 2): 1, ("word", 1): 2, ("word", 4): 1, ("word", 2): 1, ("word", 24): 1} or sum(v for (k, _), v in found.items() if k == "word") == 6
    ends = lambda *b: ngrams.line_endings(bodies(spark, *b)).first().ending
    assert (ends(b"a\r\nb"), ends(b"a\rb\rc\n"), ends(b"a\nb"), ends(b"")) == ("CRLF", "CR", "LF", "LF")
    m = ngrams.closed_words(bodies(spark, b"ab cde  f\ng h "))
    assert abs(ngrams.length_similarity(m, m).first().similarity - 1) < 1e-12


def test_runs_and_windows(spark):
    df = spark.createDataFrame([(1, b"ab" + b"\0" * 200 + b"c" + b"\xff" * 128 + b"\n" * 127), (2, b""), (3, None)], "id int, body binary")
    assert sorted((r.id, r.start, r.length, r.byte) for r in corruption.byte_runs(df).collect()) == [(1, 2, 200, 0), (1, 203, 128, 255)]
    text = b" ".join(b"word%d" % (i % 7) for i in range(200)) + b" " + b" ".join(b"q%dz" % i for i in range(200))
    places = words.word_places(spark.createDataFrame([(1, text)], "id int, body binary"))
    known = spark.createDataFrame([(w,) for i in range(7) for w in (b"word%d" % i, b" word%d" % i)], "word binary")
    flags = corruption.unknown_words(places, known)
    (r,) = corruption.corrupt_ranges(flags, 512).collect()
    assert 700 < r.start < 1400 and r.end >= len(text) - 64
    assert corruption.odd_lengths(places).where("corrupt").count() >= 0
    scores = spark.createDataFrame([(1, 0, 1.0), (1, 128, 0.9), (1, 256, 0.1)], "id int, window int, score double")
    assert [r.window for r in corruption.language_breaks(scores).where("corrupt").collect()] == [256]


def test_languages(spark):
    model = spark.createDataFrame([("de", 3, b"der", 5), ("de", 3, b"ein", 3), ("en", 3, b"the", 5), ("en", 3, b"and", 3)], "model_id string, n int, gram binary, freq long")
    samples = spark.createDataFrame([(1, b"the", 2), (1, b"der", 1), (2, b"ein", 4)], "id int, gram binary, freq long")
    best = {r.id: r.model_id for r in language.best(language.scores(samples, language.profiles(model))).collect()}
    assert best == {1: "en", 2: "de"}
    assert language.resolve_model(language.with_fallback("en", "ascii"), spark.createDataFrame([("en",), ("en-utf8",)], "model_id string")).first().model_id == "en-utf8"


def test_cells_and_sinks(spark):
    c = np.array([C.literal(65), C.DISCONTINUITY, 5, C.reconstructed(66, 50), C.INFERRED | 60, C.reconstructed(67, 5)], dtype="<u4")
    assert C.plain_text(c) == b"A?B<C"
    df = spark.createDataFrame([(1, c.tobytes()), (2, b"")], "id int, cells binary")
    assert {r.id: bytes(r.body) for r in sinks.plain_text(df).collect()} == {1: b"A?B<C", 2: b""}
    assert sinks.html_text(c) == 'A<hr><span class="unk">?</span><span class="recon">B</span><span class="infer">&lt;</span><span class="wild">C</span>'
    counts = {r["class"]: r.n for r in sinks.class_counts(df).where("id = 1").collect()}
    assert counts == {"Literal": 1, "Discontinuity": 1, "Unknown": 1, "Reconstructed": 1, "InferredLit": 1, "WildGuess": 1}
    (marked,) = sinks.marked_text(df.where("id = 1"), spark.createDataFrame([(1, b"AxB<C")], "id int, original binary")).collect()
    assert bytes(marked.body) == b"A{?}B<C"
    classes = spark.createDataFrame([(int(x),) for x in c], "c long").select(C.cell_class(F.col("c")).alias("k"), C.cell_byte(F.col("c")).alias("b")).collect()
    assert [r.k for r in classes] == ["Literal", "Discontinuity", "Unknown", "Reconstructed", "InferredLit", "WildGuess"]
    assert sinks.directory("out/%", F.lit("a/b.zip"), F.lit(2)) is not None
    named = spark.range(1).select(sinks.directory("out/%", F.lit("a/b.zip"), F.lit(2)).alias("x"), sinks.output_name(F.lit("../x/y.txt"), F.lit("b"), F.lit(7), as_html=True).alias("y")).first()
    assert named.x == "out/b-2" and ".." not in named.y and named.y.endswith("y.txt.htm")


def test_bytes_natively(spark):
    r = spark.createDataFrame([(b"\x01\x02\x03\xff",)], "b binary").select(native.le("b", 0, 4).alias("l"), native.be("b", 1, 2).alias("g"), native.le("b", 3, 2).alias("n"), F.hex(native.reversed_bytes("b")).alias("r"), native.starts_with("b", 1, b"\x02\x03").alias("s")).first()
    assert (r.l, r.g, r.n, r.r, r.s) == (0xFF030201, 0x0203, None, "FF030201", True)


def test_unknown_bytes_are_inferred(spark):
    text = b"the cat sat on the mat and the cat ran to the hat " * 40
    c = np.array([C.literal(b) for b in text], dtype="<u4")
    for co, places in ((7, [405, 505]), (9, [820]), (11, [1203])):
        c[places] = co
    cells = spark.createDataFrame([(1, c.tobytes())], "id int, cells binary")
    model = ngrams.ngram_counts(bodies(spark, text), 6).select("n", "gram", "freq")
    average = ngrams.average_frequency(ngrams.ngram_counts(bodies(spark, text), 6), bodies(spark, text)).select("n", "avgfreq")
    fixed = reconstruct.reconstruct(cells, model, average, rounds=2)
    assert C.plain_text(C.unpack(fixed.first().cells)) == text
    found = reconstruct.accuracy(fixed, spark.createDataFrame([(1, text)], "id int, original binary")).first()
    assert (found.reconstructed, found.correct, found.unknown, found.identical) == (4, 4, 0, len(text))
    near = reconstruct.occurrences(cells)
    assert {(r.coindex, r.occurrences) for r in reconstruct.wildcard_counts(near).collect()} == {(7, 2), (9, 1), (11, 1)}
    allowed = reconstruct.candidates(near)
    assert allowed.where("byte BETWEEN 128 AND 191").count() == 0 and reconstruct.unambiguous(allowed).count() == 0
    assert reconstruct.local_ngrams(cells, 3).count() > 0


def test_alignment_fills_from_before_the_gap():
    text = np.frombuffer(bytes(range(65, 91)) * 40, dtype=np.uint8).astype(np.uint32)
    rng = np.random.default_rng(1)
    text = rng.integers(65, 91, 600).astype(np.uint32)
    before = C.LITERAL | text
    after = np.array([C.WINDOW + d for d in range(100, 60, -1)], dtype=np.uint32)
    known = {int(C.WINDOW + d): int(text[600 - d]) for d in range(100, 80, -1)}
    c = np.concatenate([before, np.array([C.DISCONTINUITY], np.uint32), after]).astype(np.uint32)
    out = reconstruct._align(c, None, known)
    assert (out[601:] == (C.INFERRED | text[500:540])).all()


def test_boundaries_of_many_bodies_are_those_of_each():
    """Bodies are cut together, by a table of pairs; each must come out as the rules say of it alone."""
    import random

    r = random.Random(5)
    bodies = [bytes(r.choice(b"ab1 <>/&#-'.,?\x7f\xc3\xa9\xa0\xd7Z;\n") for _ in range(r.randrange(40))) for _ in range(2000)]
    bodies += [b"x" * n for n in (249, 250, 600)] + [b"?", b"? ", b"a? ?"]
    for utf8 in (True, False):
        _, _, found = words.all_boundaries(bodies, utf8)
        each = []
        for x in bodies:
            c = np.frombuffer(b"\0a" + x + b"\0", dtype=np.uint8)
            pp = c[:-3].copy()
            pp[:2] = 0
            each.append(words._rules(pp, c[1:-2], c[2:-1], c[3:], utf8))
        assert (np.concatenate(each) == found).all()
        together, of = words.all_words(bodies, utf8)
        assert [(w, k) for k, x in enumerate(bodies) for w in words.words(x, utf8)] == list(zip(together, of.tolist()))


def test_windows_of_bodies_are_those_of_places(spark):
    text = b"one two three four five six seven eight nine ten eleven twelve, and so on it goes; " * 30
    rows = [(k, bytearray(text[k:] + (b"zq xv jj wq kk " * 40 if k % 2 else b"") + text[: 200 * k])) for k in range(6)] + [(7, bytearray(b"")), (8, None)]
    df = spark.createDataFrame(rows, "id int, body binary")
    places = words.word_places(df).cache()
    known = spark.createDataFrame([(bytearray(w),) for w in set(words.words(text))], "word binary")
    take = lambda x: sorted(tuple(r[c] for c in ("id", "window", "words")) + ((r["unknown"],) if "unknown" in x.columns else (r["similarity"],)) + (r["corrupt"],) for r in x.collect())
    in_bodies = corruption.unknown_words_in(df, known)
    assert take(in_bodies) == take(corruption.unknown_words(places, known)) and any(r[-1] for r in take(in_bodies))
    own = corruption.odd_lengths_in(df)
    assert take(own) == take(corruption.odd_lengths(places)) and any(r[-1] for r in take(own))
    assert "Exchange" not in own._jdf.queryExecution().executedPlan().toString()


def test_languages_of_bodies_are_scored_in_their_task(spark):
    rows = [(1, "a", "the cat and the dog and the hat"), (2, "b", "der hund und die katze und der hut"), (3, "a", "the hund"), (4, "b", "zz"), (5, "b", "")]
    df = spark.createDataFrame(rows, "id int, model_id string, body string").withColumn("body", F.encode("body", "UTF-8"))
    profile = language.profiles(ngrams.ngram_counts(df.select("model_id", "body"), 3))
    samples = ngrams.ngram_counts(df.select(F.col("id").cast("string").alias("model_id"), "body"), 3).where("n = 3").select(F.col("model_id").cast("int").alias("id"), "gram", "freq")
    take = lambda x: sorted((r.id, r.model_id, round(r.score, 9)) for r in x.collect())
    found = language.scores_in(df.select("id", "body"), profile)
    assert take(found) == take(language.scores(samples, profile)) and len(take(found)) > 3
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
