"""The queries of the recovery engine and their oracle SQL, by name.

Each query takes (spark, sf_dir). Texts come from the documents table; archives,
streams and damage are derived from it without chance, so that DuckDB can state
what has to come out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import native
from ..operators import corruption, deflate, language, ngrams, reconstruct, signatures, spans, words
from ..operators.signatures import ScanOptions
from ..sources import blobs, sinks
from ..sources.staging import staged
from . import cases, recover

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str, by_lang: bool = False) -> DataFrame:
    """(model_id, body) of documents."""
    return ngrams.encoded(table(spark, sf_dir, "documents"), key=F.col("lang") if by_lang else None)


def bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, body) of documents."""
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.encode("text", "UTF-8").alias("body"))


def gram_hex(df: DataFrame) -> DataFrame:
    return df.withColumn("gram", F.hex("gram"))


# the pairs of hex digits of each text; every prefix of up to 4 bytes of what begins with 3 bytes left
_PAIRS = "WITH h AS (SELECT doc_id AS id, lang, regexp_extract_all(hex(encode(text)), '..') AS b FROM documents)"
_GRAMS = (
    _PAIRS
    + """, g AS (SELECT n, gram, count(*) AS freq FROM (
  SELECT 1 AS n, unnest([b[i] for i in range(1, len(b) - 1)]) AS gram FROM h
  UNION ALL SELECT 2, unnest([b[i] || b[i + 1] for i in range(1, len(b) - 1)]) FROM h
  UNION ALL SELECT 3, unnest([b[i] || b[i + 1] || b[i + 2] for i in range(1, len(b) - 1)]) FROM h
  UNION ALL SELECT 4, unnest([b[i] || b[i + 1] || b[i + 2] || b[i + 3] for i in range(1, len(b) - 2)]) FROM h) GROUP BY ALL)
"""
)


# ---- n-gram models


@query("byte_unigrams", _PAIRS + " SELECT gram, count(*) AS freq FROM (SELECT unnest(b) AS gram FROM h) GROUP BY 1")
def byte_unigrams(spark, d):
    return gram_hex(ngrams.ngram_counts(texts(spark, d), 1, least_left=1)).select("gram", "freq")


@query("byte_trigrams", _GRAMS + "SELECT gram, least(freq, 65535) AS freq FROM g WHERE n = 3")
def byte_trigrams(spark, d):
    return gram_hex(ngrams.trigram_counts(texts(spark, d))).select("gram", "freq")


@query("byte_ngrams_n", _GRAMS + "SELECT n::INT AS n, gram, freq FROM g")
def byte_ngrams_n(spark, d):
    return gram_hex(ngrams.ngram_counts(texts(spark, d), 4)).select("n", "gram", "freq")


@query("ngram_min_freq", _GRAMS + "SELECT n::INT AS n, gram, freq FROM g WHERE freq >= 5")
def ngram_min_freq(spark, d):
    return gram_hex(ngrams.ngram_counts(texts(spark, d), 4, 5)).select("n", "gram", "freq")


@query("ngram_distinct_per_n", _GRAMS + "SELECT n::INT AS n, count(*) AS distinct_grams FROM g GROUP BY n")
def ngram_distinct_per_n(spark, d):
    return ngrams.distinct_per_n(ngrams.ngram_counts(texts(spark, d), 4)).select("n", "distinct_grams")


@query("ngram_avgfreq", _GRAMS + "SELECT n::INT AS n, count(*) AS distinct_grams, (SELECT sum(len(b)) FROM h)::BIGINT AS total_bytes, round((SELECT sum(len(b)) FROM h) / count(*), 6) AS avgfreq FROM g GROUP BY n")
def ngram_avgfreq(spark, d):
    t = texts(spark, d)
    return ngrams.average_frequency(ngrams.ngram_counts(t, 4), t).select("n", "distinct_grams", "total_bytes", F.round("avgfreq", 6).alias("avgfreq"))


@query("reverse_ngrams", _GRAMS + "SELECT n::INT AS n, substr(gram, 7, 2) || substr(gram, 5, 2) || substr(gram, 3, 2) || substr(gram, 1, 2) AS gram, freq FROM g")
def reverse_ngrams(spark, d):
    return gram_hex(ngrams.reverse_ngrams(ngrams.ngram_counts(texts(spark, d), 4))).select("n", "gram", "freq")


@query("next_byte_distribution", _GRAMS + "SELECT (n - 1)::INT AS k, substr(gram, 1, 2 * n - 2) AS context, right(gram, 2) AS next, freq, sum(freq) OVER (PARTITION BY n, substr(gram, 1, 2 * n - 2))::BIGINT AS context_freq FROM g WHERE n IN (2, 3)")
def next_byte_distribution(spark, d):
    return ngrams.next_bytes(ngrams.ngram_counts(texts(spark, d), 3)).select("k", F.hex("context").alias("context"), F.hex("next").alias("next"), "freq", "context_freq")


@query("next_byte_topk", _GRAMS + "SELECT * FROM (SELECT (n - 1)::INT AS k, substr(gram, 1, 2 * n - 2) AS context, right(gram, 2) AS next, freq, row_number() OVER (PARTITION BY n, substr(gram, 1, 2 * n - 2) ORDER BY freq DESC, right(gram, 2))::INT AS rank FROM g WHERE n IN (2, 3)) WHERE rank <= 2")
def next_byte_topk(spark, d):
    return ngrams.top_next(ngrams.ngram_counts(texts(spark, d), 3)).select("k", F.hex("context").alias("context"), F.hex("next").alias("next"), "freq", "rank")


@query("byte_weights", _GRAMS + "SELECT ('0x' || gram)::INT AS byte, round(floor(sum(freq) OVER () / 256) / freq, 9) AS weight FROM g WHERE n = 1")
def byte_weights(spark, d):
    return ngrams.byte_weights(ngrams.ngram_counts(texts(spark, d), 1)).select("byte", F.round("weight", 9).alias("weight"))


# ---- words and their lengths

_LENGTHS = r"""WITH t AS (SELECT lang AS model_id, regexp_extract(translate(text, '<>', chr(1) || chr(1)), '(?s)[\x00-\x20].*') AS tail FROM documents),
runs AS (
  SELECT model_id, 'word' AS kind, unnest(regexp_extract_all(tail, '([^\x00-\x20]+)[\x00-\x20]', 1)) AS run FROM t
  UNION ALL SELECT model_id, 'delimiter', unnest(regexp_extract_all(tail, '[\x00-\x20]+')) FROM t),
c AS (SELECT model_id, kind, least(octet_length(encode(run)), 24)::INT AS len, count(*) AS count FROM runs GROUP BY ALL)
"""


@query("word_length_hist", _LENGTHS + "SELECT * FROM c")
def word_length_hist(spark, d):
    return ngrams.closed_words(texts(spark, d, True))


@query("word_length_combined", _LENGTHS + "SELECT kind, len, sum(count)::BIGINT AS count FROM c GROUP BY ALL")
def word_length_combined(spark, d):
    return ngrams.combine(ngrams.closed_words(texts(spark, d, True)).withColumn("model_id", F.lit("all"))).drop("model_id")


@query("word_length_scaled", _LENGTHS + "SELECT model_id, kind, len, ceil(count * 0.3)::BIGINT AS count FROM c")
def word_length_scaled(spark, d):
    return ngrams.scale(ngrams.closed_words(texts(spark, d, True)), 0.3)


@query(
    "word_length_similarity",
    _LENGTHS
    + """, p AS (SELECT model_id, kind, len, count / sum(count) OVER (PARTITION BY model_id, kind) * CASE WHEN len <= 1 THEN 0.1 ELSE 1 END * CASE WHEN kind = 'delimiter' THEN 0.1 ELSE 1 END AS p FROM c),
n AS (SELECT model_id, sqrt(sum(p * p)) AS norm FROM p GROUP BY 1)
SELECT a.model_id AS left_id, b.model_id AS right_id, round(sum(a.p * b.p) / (any_value(x.norm) * any_value(y.norm)), 9) AS similarity
FROM p a JOIN p b USING (kind, len) JOIN n x ON x.model_id = a.model_id JOIN n y ON y.model_id = b.model_id GROUP BY 1, 2""",
)
def word_length_similarity(spark, d):
    m = staged(ngrams.closed_words(texts(spark, d, True)), "lengths")
    return ngrams.length_similarity(m, m).withColumn("similarity", F.round("similarity", 9))


@query("word_freq")
def word_freq(spark, d):
    return words.word_frequencies(texts(spark, d, True)).withColumn("word", F.hex("word"))


@query("known_word_ratio_windows")
def known_word_ratio_windows(spark, d):
    known = words.word_frequencies(texts(spark, d)).where("freq >= 3").select("word")
    return corruption.unknown_words_in(bodies(spark, d), known)


@query("word_length_windows")
def word_length_windows(spark, d):
    return corruption.odd_lengths_in(bodies(spark, d))


@query("line_endings", r"SELECT lang AS model_id, sum(length(text) - length(replace(text, chr(13) || chr(10), chr(10))))::BIGINT AS crlf, sum(length(text) - length(replace(text, chr(13), '')))::BIGINT AS cr, sum(length(text) - length(replace(text, chr(10), '')))::BIGINT AS lf, 'LF' AS ending FROM documents GROUP BY lang")
def line_endings(spark, d):
    return ngrams.line_endings(texts(spark, d, True))


@query(
    "byte_runs",
    """WITH b AS (SELECT doc_id AS id, regexp_extract_all(hex(encode(CASE WHEN doc_id % 5 = 0 THEN substr(text, 1, 20) || '<' || repeat('~', 128 + (doc_id % 100)::INT) || '>' || substr(text, 21) ELSE text END)), '..') AS x FROM documents),
c AS (SELECT id, unnest(range(0, len(x))) AS pos, unnest(x) AS v FROM b),
i AS (SELECT *, pos - row_number() OVER (PARTITION BY id, v ORDER BY pos) AS g FROM c)
SELECT id, min(pos)::BIGINT AS start, count(*) AS length, ('0x' || v)::INT AS byte FROM i GROUP BY id, v, g HAVING count(*) >= 128""",
)
def byte_runs(spark, d):
    docs = table(spark, d, "documents")
    run = F.concat(F.substring("text", 1, 20), F.lit("<"), F.repeat(F.lit("~"), (128 + F.col("doc_id") % 100).cast("int")), F.lit(">"), F.expr("substring(text, 21)"))
    return corruption.byte_runs(docs.select(F.col("doc_id").alias("id"), F.encode(F.when(F.col("doc_id") % 5 == 0, run).otherwise(F.col("text")), "UTF-8").alias("body")))


@query(
    "utf8_constraints",
    _PAIRS
    + """, c AS (SELECT DISTINCT unnest([b[i - 1] for i in range(1, len(b) + 1)]) AS p, unnest([b[i + 1] for i in range(1, len(b) + 1)]) AS q FROM h),
k AS (SELECT ('0x' || p)::INT AS before_, ('0x' || q)::INT AS after_ FROM c),
a AS (SELECT before_, after_, byte FROM k, (SELECT unnest(range(0, 256)) AS byte))
SELECT before_ AS before, after_ AS after, count(*) AS allowed FROM a
WHERE NOT (coalesce(before_ < 128 AND byte BETWEEN 128 AND 191, false) OR coalesce(after_ BETWEEN 128 AND 191 AND byte < 128, false)
  OR coalesce(before_ >= 192 AND NOT byte BETWEEN 128 AND 191, false) OR byte IN (192, 193) OR byte >= 245)
GROUP BY 1, 2""",
)
def utf8_constraints(spark, d):
    b = bodies(spark, d)
    # neighbours two apart, from the distinct trigrams and the two ends of every body
    inner = ngrams.ngram_counts(texts(spark, d), 3).where("n = 3").select(native.be("gram", 0, 1).cast("int").alias("before"), native.be("gram", 2, 1).cast("int").alias("after"))
    first = b.where("length(body) > 0").select(F.lit(None).cast("int").alias("before"), native.be("body", 1, 1).cast("int").alias("after"))
    last = b.where("length(body) > 1").select(native.be("body", F.length("body") - 2, 1).cast("int").alias("before"), F.lit(None).cast("int").alias("after"))
    pairs = inner.union(first).union(last).distinct()
    each = pairs.withColumn("byte", F.explode(F.sequence(F.lit(0), F.lit(255))))
    return each.where(~reconstruct.forbidden(F.col("byte"), F.col("before"), F.col("after"))).groupBy("before", "after").agg(F.count("*").alias("allowed"))


# ---- languages

_TRIGRAMS = _PAIRS + """,
s AS (SELECT id, any_value(lang) AS lang, gram, count(*) AS freq FROM (SELECT id, lang, unnest([b[i] || b[i + 1] || b[i + 2] for i in range(1, len(b) - 1)]) AS gram FROM h) GROUP BY id, gram),
m AS (SELECT lang AS model_id, gram, sum(freq) AS freq FROM s GROUP BY 1, 2),
p AS (SELECT * FROM (SELECT model_id, gram, freq / sum(freq) OVER (PARTITION BY model_id) AS p, row_number() OVER (PARTITION BY model_id ORDER BY freq DESC, gram) AS r FROM m) WHERE r <= 400),
n AS (SELECT model_id, sqrt(sum(p * p)) AS norm FROM p GROUP BY 1),
o AS (SELECT * FROM s WHERE gram IN (SELECT gram FROM p)),
z AS (SELECT id, sqrt(sum(freq::DOUBLE * freq)) AS size FROM o GROUP BY 1),
scored AS (SELECT o.id, p.model_id, round(sum(o.freq * p.p) / (any_value(size) * any_value(norm)), 9) AS score FROM o JOIN p USING (gram) JOIN z USING (id) JOIN n USING (model_id) GROUP BY 1, 2)
"""


def _scored(spark, d):
    profile = language.profiles(ngrams.ngram_counts(texts(spark, d, True), 3))
    return language.scores_in(bodies(spark, d), profile).withColumn("score", F.round("score", 9))


@query("language_scores", _TRIGRAMS + "SELECT id, model_id, score FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, model_id) AS r FROM scored) WHERE r = 1")
def language_scores(spark, d):
    return language.best(_scored(spark, d)).select("id", "model_id", "score")


@query("language_choice", _TRIGRAMS + "SELECT model_id, round(sum(score), 6) AS total FROM (SELECT *, max(score) OVER (PARTITION BY id) AS top FROM scored) WHERE score >= 0.8 * top GROUP BY 1")
def language_choice(spark, d):
    return language.most_frequent(_scored(spark, d)).withColumn("total", F.round("total", 6))


# ---- decoding


def _streams(spark, d):
    return deflate.deflated(bodies(spark, d))


@query("intact_roundtrip", "SELECT doc_id AS id, octet_length(encode(text)) AS bytes, octet_length(encode(text)) AS known, 0::BIGINT AS unknown, 0::INT AS discontinuities, true AS complete, sha256(encode(text)) AS sha256 FROM documents")
def intact_roundtrip(spark, d):
    found = staged(deflate.decoded(_streams(spark, d)), "decoded")
    text = sinks.plain_text(found).select(F.col("id").alias("_id"), F.sha2("body", 256).alias("sha256"))
    return found.join(text, F.col("id") == F.col("_id")).select("id", "bytes", "known", "unknown", "discontinuities", "complete", "sha256")


@query("listing", "SELECT doc_id AS id, octet_length(encode(text))::BIGINT AS bytes, octet_length(encode(text))::BIGINT AS known, '+' AS mark FROM documents UNION ALL SELECT NULL, sum(octet_length(encode(text)))::BIGINT, sum(octet_length(encode(text)))::BIGINT, '+' FROM documents")
def listing(spark, d):
    return deflate.listing(deflate.decoded(_streams(spark, d)).select("id", "bytes", "known"))


@query("packet_chain", "SELECT doc_id AS id, octet_length(encode(text))::BIGINT AS bytes, true AS ends_final FROM documents")
def packet_chain(spark, d):
    found = deflate.packets(_streams(spark, d))
    return found.groupBy("id").agg(F.sum("size").alias("bytes"), F.max_by("final", "packet_no").alias("ends_final"))


#: documents of one source that make up a damaged stream at most
STREAM_DOCS = 200


def _damage(bodies: list[bytes], turn: int) -> tuple:
    """(body, known_start, corrupt_from, corrupt_to, damage, original) of a stream of bodies with full flushes; turn says which damage.

    Where that would leave less than a fifth of the text to be decoded, part of
    the tail is cut off, of a fifth of the stream as much as leaves that.
    """
    import zlib

    c = zlib.compressobj(6, zlib.DEFLATED, -15)
    parts = [c.compress(x) + c.flush(zlib.Z_FULL_FLUSH) for x in bodies]
    packed, whole = b"".join(parts) + c.flush(), b"".join(bodies)
    n = len(packed)
    decodes = lambda end: len(zlib.decompressobj(-15).decompress(packed[:end]))

    def behind(at: int) -> int:
        begins, size = 0, 0
        for x, p in zip(bodies, parts):
            size += len(x) if begins >= at else 0
            begins += len(p)
        return size

    if turn == 0 and behind(n // 5) * 5 >= len(whole):
        return packed[n // 5 :], False, None, None, "head", whole
    if turn == 2 and (decodes(n // 2) + behind(n // 2 + 64)) * 5 >= len(whole):
        return packed[: n // 2] + b"\xaa" * 64 + packed[n // 2 + 64 :], True, n // 2, n // 2 + 64, "middle", whole
    cut = n // 5
    while cut and decodes(n - cut) * 5 < len(whole):
        cut //= 2
    return packed[: n - cut], True, None, None, "tail", whole


def _damaged(spark, d):
    """Texts of a source, by doc_id in groups of bounded size, in one stream with full flushes; the head cut off, the tail cut off, or bytes overwritten, by turns."""
    import pyarrow as pa

    docs = table(spark, d, "documents").select("source", "doc_id", F.encode("text", "UTF-8").alias("body"))
    number = F.expr(f"cast(substring(source, 4) AS long) * 1000000 + doc_id div {STREAM_DOCS}")
    lists = docs.groupBy(number.alias("id")).agg(F.array_sort(F.collect_list(F.struct("doc_id", "body"))).alias("m"))

    def run(batches):
        for batch in batches:
            for at in range(len(batch)):
                b = batch.slice(at, 1)
                (i,), (m,) = b.column("id").to_pylist(), b.column("m").to_pylist()
                row = _damage([x["body"] or b"" for x in m], (i or 0) % 3)
                kinds = [pa.binary(), pa.bool_(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
                names = ["body", "known_start", "corrupt_from", "corrupt_to", "damage", "original"]
                yield pa.RecordBatch.from_arrays([b.column("id"), *(pa.array([v], t) for v, t in zip(row, kinds))], ["id", *names])
        native.released()

    return lists.mapInArrow(run, "id long, body binary, known_start boolean, corrupt_from long, corrupt_to long, damage string, original binary")


@query("damaged_recovery", f"SELECT DISTINCT substr(source, 4)::BIGINT * 1000000 + doc_id // {STREAM_DOCS} AS id, true AS known_are_right, true AS fifth_recovered FROM documents")
def damaged_recovery(spark, d):
    """Of every damaged stream: whether all that counts as known is the truth's, and is at least a fifth of it."""
    streams = staged(_damaged(spark, d), "damaged")
    found = staged(deflate.decoded(streams), "decoded")
    right = reconstruct.accuracy(found, streams).select("id", (F.col("identical") == F.col("total") - F.col("unknown")).alias("known_are_right"))
    sizes = streams.select("id", F.length("original").alias("_n"))
    share = found.join(sizes, "id").select("id", (F.col("known") * 5 >= F.col("_n")).alias("fifth_recovered"))
    return streams.select("id").join(right, "id", "left").join(share, "id", "left")


@query("reconstruct_accuracy")
def reconstruct_accuracy(spark, d):
    """Of every damaged stream, with its kind of damage."""
    streams = staged(_damaged(spark, d), "damaged")
    found = staged(deflate.decoded(streams), "decoded")
    model = ngrams.ngram_counts(texts(spark, d), 6, 3)
    fixed = reconstruct.reconstruct(found, model)
    kinds = streams.select(F.col("id").alias("_id"), "damage")
    return reconstruct.accuracy(fixed, streams).join(kinds, F.col("id") == F.col("_id")).drop("_id")


@query("cell_classes", "SELECT doc_id AS id, 'Literal' AS class, octet_length(encode(text))::BIGINT AS n FROM documents WHERE text <> ''")
def cell_classes(spark, d):
    return sinks.class_counts(deflate.decoded(_streams(spark, d)))


@query("html_sink", "SELECT doc_id AS id, replace(replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;'), chr(10), '<br>' || chr(10)) AS body FROM documents")
def html_sink(spark, d):
    page = sinks.html(deflate.decoded(_streams(spark, d)))
    return page.select("id", F.regexp_extract("html", r"(?s)<body><p>(.*)</p><p>.*$", 1).alias("body"))


# ---- archives


def _members(spark, d):
    conv = table(spark, d, "conversations")
    return conv.select(F.col("conv_id").alias("archive_id"), F.col("turn").alias("ord"), F.format_string("turn%d.txt", "turn").alias("name"), F.encode("text", "UTF-8").alias("body"))


def _zips(spark, d):
    return blobs.stored_zip(_members(spark, d))


_ZIP = """WITH m AS (SELECT conv_id AS blob_id, turn, 'turn' || turn || '.txt' AS name, octet_length(encode(text)) AS size FROM conversations),
l AS (SELECT *, 30 + length(name) + size AS local_size, 46 + length(name) AS dir_size FROM m),
o AS (SELECT *, coalesce(sum(local_size) OVER (PARTITION BY blob_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS local_offset,
  sum(local_size) OVER (PARTITION BY blob_id)::BIGINT + coalesce(sum(dir_size) OVER (PARTITION BY blob_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS dir_offset,
  sum(local_size + dir_size) OVER (PARTITION BY blob_id)::BIGINT AS ends FROM l)
"""


@query(
    "stored_zip_scan",
    _ZIP
    + """SELECT blob_id, local_offset AS "offset", 'LocalFileHeader' AS sig_type, local_offset + 30 + length(name) AS header_end FROM o
UNION ALL SELECT blob_id, dir_offset, 'CentralDirEntry', dir_offset + 46 + length(name) FROM o
UNION ALL SELECT blob_id, any_value(ends), 'EndOfCentralDir', any_value(ends) FROM o GROUP BY blob_id
UNION ALL SELECT blob_id, any_value(ends) + 22, 'zipEOF', any_value(ends) + 22 FROM o GROUP BY blob_id""",
)
def stored_zip_scan(spark, d):
    return signatures.signatures(_zips(spark, d)).select("blob_id", "offset", "sig_type", "header_end")


@query("zip_headers", _ZIP + """SELECT blob_id, local_offset AS "offset", name, size::BIGINT AS size, 0 AS method FROM o""")
def zip_headers(spark, d):
    s = signatures.signatures(_zips(spark, d)).where("sig_type = 'LocalFileHeader'")
    return s.select("blob_id", "offset", F.col("attrs")["name"].alias("name"), F.col("attrs")["size"].cast("long").alias("size"), F.col("attrs")["method"].cast("int").alias("method"))


def _numbered(spark, d):
    return staged(spans.archives(spans.filtered(signatures.signatures(_zips(spark, d)))), "signatures")


@query("zip_spans", _ZIP + """SELECT blob_id, name AS name_hint, local_offset + 30 + length(name) AS start, local_offset + 30 + length(name) + size AS "end", true AS known_start, true AS known_end, size::BIGINT AS orig_size, 'zip' AS kind FROM o""")
def zip_spans(spark, d):
    return spans.spans(_numbered(spark, d)).where("kind = 'zip'").select("blob_id", "name_hint", "start", "end", "known_start", "known_end", "orig_size", "kind")


@query("stored_extract", "SELECT conv_id AS blob_id, 'turn' || turn || '.txt' AS name_hint, sha256(encode(text)) AS sha256 FROM conversations")
def stored_extract(spark, d):
    archives = staged(_zips(spark, d), "zips")
    found = spans.spans(spans.archives(spans.filtered(signatures.signatures(archives))))
    return spans.stored_members(archives, found).select("blob_id", "name_hint", F.sha2("body", 256).alias("sha256"))


@query("central_dir_skew", _ZIP + 'SELECT blob_id, name, local_offset + 7 AS "offset", local_offset, 7::BIGINT AS skew FROM o')
def central_dir_skew(spark, d):
    shifted = _zips(spark, d).withColumn("content", F.concat(F.lit(bytearray(b"prefix!")), F.col("content")))
    numbered = staged(spans.archives(spans.filtered(signatures.signatures(shifted))), "signatures")
    return spans.header_skew(numbered).select("blob_id", "name", "offset", "local_offset", "skew")


@query("archive_skew", "SELECT conv_id AS blob_id, 0 AS archive_no, count(*) AS matched, 1::BIGINT AS skews, 0::BIGINT AS skew, 0::BIGINT AS base_skew FROM conversations GROUP BY conv_id")
def archive_skew(spark, d):
    return spans.archive_skew(_numbered(spark, d)).select("blob_id", "archive_no", "matched", "skews", "skew", "base_skew")


@query("lost_first_name", "SELECT conv_id AS blob_id, 0 AS archive_no, 'turn' || min(turn) || '.txt' AS name FROM conversations GROUP BY conv_id HAVING count(*) > 1")
def lost_first_name(spark, d):
    zips = _zips(spark, d).withColumn("content", F.expr("concat(unhex('00000000'), substring(content, 5))"))
    return spans.first_names(spans.archives(spans.filtered(signatures.signatures(zips))))


@query("signature_counts", _ZIP + "SELECT sig_type, count(*) AS n FROM (SELECT 'LocalFileHeader' AS sig_type FROM o UNION ALL SELECT 'CentralDirEntry' FROM o UNION ALL SELECT unnest(['EndOfCentralDir', 'zipEOF']) FROM (SELECT DISTINCT blob_id FROM o)) GROUP BY 1")
def signature_counts(spark, d):
    return spans.signature_counts(signatures.signatures(_zips(spark, d)))


def _gzip(name_hex: str, flags: str) -> F.Column:
    return F.unhex(F.concat(F.lit("1F8B08" + flags), F.lit("00E1F5050003"), F.lit(name_hex)))


@query("gzip_header_fields", """SELECT doc_id AS blob_id, CASE WHEN doc_id % 2 = 0 THEN 'doc' || doc_id || '.txt' END AS name, 100000000::BIGINT AS mtime, (10 + CASE WHEN doc_id % 2 = 0 THEN length('doc' || doc_id || '.txt') + 1 ELSE 0 END)::BIGINT AS header_end FROM documents""")
def gzip_header_fields(spark, d):
    named = F.concat(F.lit("1F8B080800E1F5050003"), F.hex(F.encode(F.format_string("doc%d.txt", "doc_id"), "UTF-8")), F.lit("00"))
    head = F.when(F.col("doc_id") % 2 == 0, named).otherwise("1F8B080000E1F5050003")
    made = table(spark, d, "documents").select(F.col("doc_id").alias("blob_id"), F.concat(F.unhex(head), F.encode("text", "UTF-8")).alias("content"))
    s = signatures.signatures(made, ScanOptions(input_format="gzip")).where("sig_type = 'gzipHeader' AND offset = 0")
    return s.select("blob_id", F.col("attrs")["name"].alias("name"), F.col("attrs")["mtime"].cast("long").alias("mtime"), "header_end")


@query("zlib_header_check", "SELECT doc_id AS blob_id, 0::BIGINT AS \"offset\", 2::BIGINT AS header_end FROM documents")
def zlib_header_check(spark, d):
    made = _streams(spark, d).select(F.col("id").alias("blob_id"), F.concat(F.unhex(F.lit("789C")), "body", F.unhex(F.lit("00000000"))).alias("content"))
    return signatures.signatures(made, ScanOptions(input_format="zlib_all_fixed")).where("sig_type = 'ZlibHeader' AND offset = 0").select("blob_id", "offset", "header_end")


@query("scan_range", _ZIP + """SELECT blob_id, local_offset AS "offset", name FROM o WHERE local_offset >= 100 AND local_offset + 30 + length(name) <= 4000""")
def scan_range(spark, d):
    s = signatures.signatures(_zips(spark, d), ScanOptions(scan_range=(100, 4000))).where("sig_type = 'LocalFileHeader'")
    return s.select("blob_id", "offset", F.col("attrs")["name"].alias("name")).where("offset + 30 + length(name) <= 4000")


@query("output_names", "SELECT conv_id AS blob_id, turn, 'dir/turn' || turn || '.txt' AS own, 'turn' || turn || '.txt' AS junked, 'archive-' || lpad(hex(turn), 8, '0') || '.dat' AS plain FROM conversations")
def output_names(spark, d):
    c = table(spark, d, "conversations")
    name = F.format_string("dir/turn%d.txt", "turn")
    base, offset = F.lit("archive"), F.col("turn").cast("long")
    return c.select(
        F.col("conv_id").alias("blob_id"),
        "turn",
        sinks.output_name(name, base, offset).alias("own"),
        sinks.output_name(name, base, offset, junk_paths=True).alias("junked"),
        sinks.output_name(F.lit(None).cast("string"), base, offset).alias("plain"),
    )


@query("chunked_ingest", _ZIP + """SELECT blob_id, local_offset AS "offset", name FROM o""")
def chunked_ingest(spark, d):
    """The members that a stream of blobs gives, run to its end: the batch scan's."""
    import uuid

    from ..sources.staging import shared_dir
    from ..streaming import chunked

    root = f"{shared_dir(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"
    _zips(spark, d).write.parquet(f"{root}/in")
    stream = chunked.scanned(chunked.read_stream(spark, f"{root}/in"))
    chunked.written(stream, f"{root}/out", f"{root}/checkpoint").start().awaitTermination()
    found = spark.read.schema(signatures.SCHEMA).parquet(f"{root}/out").where("sig_type = 'LocalFileHeader'")
    return found.select("blob_id", "offset", F.col("attrs")["name"].alias("name"))


def _mixed_zips(spark, d):
    """Archives of deflated members for conversations of even numbers, of stored ones for the others."""
    members = _members(spark, d)
    packed = deflate.deflated(members.select(F.struct("archive_id", "ord", "name").alias("id"), "body")).select("id.*", "body", "original")
    return blobs.stored_zip(packed.where("archive_id % 2 = 0"), original="original").unionByName(blobs.stored_zip(members.where("archive_id % 2 = 1")))


@query("recover_members", "SELECT conv_id AS blob_id, 'turn' || turn || '.txt' AS name, octet_length(encode(text))::BIGINT AS bytes, octet_length(encode(text))::BIGINT AS known, true AS complete, sha256(encode(text)) AS sha256 FROM conversations")
def recover_members(spark, d):
    found = staged(recover.recover_members(staged(_mixed_zips(spark, d), "zips")), "members")
    text = sinks.plain_text(found.select(F.col("member_id").alias("id"), "cells")).select("id", F.sha2("body", 256).alias("sha256"))
    return found.join(text, F.col("member_id") == F.col("id")).select("blob_id", "name", "bytes", "known", "complete", "sha256")


@query("recover_text", "SELECT 'turn' || turn || '.txt' AS name, text AS body FROM conversations")
def recover_text(spark, d):
    return recover.recover(staged(_mixed_zips(spark, d), "zips")).select("name", F.decode("body", "UTF-8").alias("body"))


@query(
    "recovery_statistics",
    """WITH s AS (SELECT count(*) AS n, sum(octet_length(encode(text)))::BIGINT AS b FROM conversations)
SELECT metric, value FROM (SELECT unnest(['members', 'complete', 'bytes', 'known_bytes', 'unknown_bytes', 'discontinuities', 'zip_members']) AS metric, unnest([n, n, b, b, 0, 0, n]) AS value FROM s)""",
)
def recovery_statistics(spark, d):
    return recover.statistics(recover.recover_members(staged(_mixed_zips(spark, d), "zips")))


@query("packet_histogram")
def packet_histogram(spark, d):
    """Of whole documents. SQL doesn't know how many blocks a compressor makes of one; a test holds it against zlib."""
    return recover.packet_histogram(deflate.packets(_streams(spark, d)))


@query("gzip_recovery", "SELECT doc_id AS blob_id, octet_length(encode(text))::BIGINT AS bytes, true AS complete FROM documents")
def gzip_recovery(spark, d):
    """gzip members made of documents, each a blob."""
    made = _streams(spark, d).select(
        F.col("id").alias("blob_id"),
        F.concat(F.unhex(F.lit("1F8B0800000000000003")), "body", F.unhex(F.concat(blobs.le_hex(F.crc32("original"), 4), blobs.le_hex(F.length("original"), 4)))).alias("content"),
    )
    options = recover.RecoverOptions(scan=ScanOptions(input_format="gzip"))
    return recover.recover_members(staged(made, "gzips"), options).where("span_no = 1").select("blob_id", "bytes", "complete")


# ---- constructed cases


@query("joined_archives", _ZIP + cases.JOINED_SQL)
def joined_archives(spark, d):
    return cases.joined_archives(spark, d, _zips(spark, d))


for _name, (_query, _sql) in cases.QUERIES.items():
    query(_name, _sql)(_query)
