"""Byte n-gram, word and word-length models, by DataFrame aggregation.

Counting has a map side in Arrow kernels: a task turns its bytes into codes with
numpy and adds them up before anything is shuffled, so what is shuffled is
distinct grams of a task, not positions. Models are tables; nothing about them
has to fit on the driver.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MAX_N = 6
#: at fewer bytes to the end no gram starts
LEAST_LEFT = 3


def encoded(docs: DataFrame, text: str = "text", key: Column | None = None) -> DataFrame:
    """(model_id, body) of a table of texts."""
    return docs.select((F.lit("all") if key is None else key).alias("model_id"), F.coalesce(F.encode(F.col(text), "UTF-8"), F.lit(bytearray())).alias("body"))


def _codes(bodies: list[bytes], max_n: int, least_left: int):
    """(n, codes) of all grams of 1 to max_n bytes that start where least_left bytes are left."""
    lengths = np.array([len(b) for b in bodies], dtype=np.int64)
    data = np.frombuffer(b"".join(bodies), dtype=np.uint8).astype(np.uint64)
    ends = np.repeat(np.cumsum(lengths), lengths)
    left = ends - np.arange(len(data))  # bytes from each place to its body's end
    code = data.copy()
    for n in range(1, max_n + 1):
        if n > 1:
            code = code[: len(data) - n + 1] << np.uint64(8) | data[n - 1 :]
            code = code[: max(0, len(data) - n + 1)]
        if len(code) == 0:
            return
        yield n, code[left[: len(code)] >= max(n, least_left)]


def ngram_counts(bodies: DataFrame, max_n: int = MAX_N, min_freq: int = 1, least_left: int = LEAST_LEFT) -> DataFrame:
    """(model_id, n, gram, freq) of (model_id, body): grams of 1 to max_n (at most 8) bytes.

    Counted are all prefixes of what starts at each place with least_left bytes
    left; grams below min_freq are left out.
    """
    import pyarrow as pa

    def run(batches):
        held: dict[tuple[str, int], list] = {}
        size = 0

        def flush():
            for (model, n), parts in held.items():
                codes, counts = _merged(parts)
                for at in range(0, len(codes), 200_000):
                    c = codes[at : at + 200_000]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([model] * len(c), pa.string()), pa.array(np.full(len(c), n, np.int32)), pa.array(c.view(np.int64)), pa.array(counts[at : at + 200_000])], ["model_id", "n", "code", "freq"]
                    )

        for batch in batches:
            models, texts = batch.column("model_id").to_pylist(), batch.column("body").to_pylist()
            groups: dict[str, list[list[bytes]]] = {}
            for m, t in zip(models, texts):
                lists = groups.setdefault(m, [[]])
                if sum(map(len, lists[-1])) > 1_000_000 if len(lists[-1]) % 64 == 0 else False:
                    lists.append([])
                lists[-1].append(t)
            for m, lists in groups.items():
                for own in lists:
                    for n, codes in _codes(own, max_n, least_left):
                        u, c = np.unique(codes, return_counts=True)
                        parts = held.setdefault((m, n), [])
                        parts.append((u, c.astype(np.int64)))
                        size += len(u)
                        if len(parts) > 16:
                            before = sum(len(x) for x, _ in parts)
                            parts[:] = [_merged(parts)]
                            size -= before - len(parts[0][0])
            if size > 4_000_000:
                yield from flush()
                held, size = {}, 0
        yield from flush()

    partial = bodies.mapInArrow(run, "model_id string, n int, code long, freq long")
    counts = partial.groupBy("model_id", "n", "code").agg(F.sum("freq").alias("freq")).where(F.col("freq") >= min_freq)
    gram = F.unhex(F.lpad(F.hex("code"), F.col("n") * 2, F.lit("0")))
    return counts.select("model_id", "n", gram.alias("gram"), "freq")


def _merged(parts: list) -> tuple[np.ndarray, np.ndarray]:
    codes, counts = np.concatenate([c for c, _ in parts]), np.concatenate([k for _, k in parts])
    order = np.argsort(codes, kind="stable")
    codes, counts = codes[order], counts[order]
    if not len(codes):
        return codes, counts
    starts = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]])
    return codes[starts], np.add.reduceat(counts, starts)


def trigram_counts(bodies: DataFrame, cap: int = 65535) -> DataFrame:
    """(model_id, gram, freq) of consecutive bytes in threes, counts ending at cap."""
    return ngram_counts(bodies, 3).where("n = 3").select("model_id", "gram", F.least("freq", F.lit(cap)).alias("freq"))


def reverse_ngrams(ngrams: DataFrame) -> DataFrame:
    """The model of the reversed direction: every gram backwards, with its count."""
    from ..functions.native import reversed_bytes

    return ngrams.withColumn("gram", reversed_bytes("gram"))


def distinct_per_n(ngrams: DataFrame) -> DataFrame:
    """(model_id, n, distinct_grams): a gram is there once, so this is a count."""
    return ngrams.groupBy("model_id", "n").agg(F.count("*").alias("distinct_grams"))


def average_frequency(ngrams: DataFrame, bodies: DataFrame) -> DataFrame:
    """(model_id, n, distinct_grams, total_bytes, avgfreq): bytes of the corpus by distinct grams."""
    total = bodies.groupBy("model_id").agg(F.sum(F.length("body")).alias("total_bytes"))
    return distinct_per_n(ngrams).join(total, "model_id").withColumn("avgfreq", F.when(F.col("distinct_grams") > 0, F.col("total_bytes") / F.col("distinct_grams")).otherwise(F.col("total_bytes")))


def next_bytes(ngrams: DataFrame) -> DataFrame:
    """(model_id, k, context, next, freq, context_freq, share): what follows each context of k bytes."""
    long = ngrams.where("n > 1").select("model_id", (F.col("n") - 1).alias("k"), F.expr("substring(gram, 1, n - 1)").alias("context"), F.expr("substring(gram, n, 1)").alias("next"), "freq")
    by = Window.partitionBy("model_id", "k", "context")
    return long.withColumn("context_freq", F.sum("freq").over(by)).withColumn("share", F.col("freq") / F.col("context_freq"))


def top_next(ngrams: DataFrame, top: int = 2) -> DataFrame:
    """The top next bytes of each context; equal counts by the lower byte."""
    order = Window.partitionBy("model_id", "k", "context").orderBy(F.desc("freq"), "next")
    return next_bytes(ngrams).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


# ---- words and their lengths


def closed_words(bodies: DataFrame) -> DataFrame:
    """(model_id, kind, len, count): lengths of the runs of words and of delimiters, at most 24.

    Delimiters are bytes up to 0x20 and < and >. What stands before the first
    delimiter, and a word that isn't ended by one, isn't counted.
    """
    text = F.decode("body", "ISO-8859-1")
    tail = F.regexp_extract(text, r"(?s)[\x00-\x20<>].*", 0)
    runs = bodies.select("model_id", F.regexp_extract_all(tail, F.lit(r"[^\x00-\x20<>]+(?=[\x00-\x20<>])|[\x00-\x20<>]+"), F.lit(0)).alias("runs"))
    each = runs.select("model_id", F.explode("runs").alias("run"))
    kind = F.when(each["run"].rlike(r"^[\x00-\x20<>]"), "delimiter").otherwise("word")
    return each.groupBy("model_id", kind.alias("kind"), F.least(F.length("run"), F.lit(24)).cast("int").alias("len")).agg(F.count("*").alias("count"))


def combine(*models: DataFrame) -> DataFrame:
    """The sum of word-length models."""
    out = models[0]
    for m in models[1:]:
        out = out.unionByName(m)
    return out.groupBy("model_id", "kind", "len").agg(F.sum("count").alias("count"))


def scale(model: DataFrame, factor: float) -> DataFrame:
    """The counts times factor (0 to 1), rounded up."""
    return model.withColumn("count", F.ceil(F.col("count") * factor))


def length_similarity(left: DataFrame, right: DataFrame) -> DataFrame:
    """(left_id, right_id, similarity): cosine of the length probabilities; lengths of 1 and all delimiters weigh 0.1."""

    def shares(m: DataFrame, name: str) -> DataFrame:
        total = Window.partitionBy("model_id", "kind")
        weight = F.when(F.col("len") <= 1, 0.1).otherwise(1.0) * F.when(F.col("kind") == "delimiter", 0.1).otherwise(1.0)
        return m.select(F.col("model_id").alias(name), "kind", "len", (F.col("count") / F.sum("count").over(total) * weight).alias(f"p_{name}"))

    a, b = shares(left, "left_id"), shares(right, "right_id")
    norm_a = a.groupBy("left_id").agg(F.sqrt(F.sum(F.col("p_left_id") ** 2)).alias("norm_l"))
    norm_b = b.groupBy("right_id").agg(F.sqrt(F.sum(F.col("p_right_id") ** 2)).alias("norm_r"))
    dots = a.join(b, ["kind", "len"]).groupBy("left_id", "right_id").agg(F.sum(F.col("p_left_id") * F.col("p_right_id")).alias("dot"))
    return dots.join(norm_a, "left_id").join(norm_b, "right_id").select("left_id", "right_id", (F.col("dot") / (F.col("norm_l") * F.col("norm_r"))).alias("similarity"))


def byte_weights(ngrams: DataFrame) -> DataFrame:
    """(model_id, byte, weight): inverse byte frequency, the average of 256 bytes (whole) by the count."""
    ones = ngrams.where("n = 1")
    total = F.sum("freq").over(Window.partitionBy("model_id"))
    return ones.select("model_id", F.conv(F.hex("gram"), 16, 10).cast("int").alias("byte"), (F.floor(total / 256) / F.col("freq")).alias("weight"))


def line_endings(bodies: DataFrame) -> DataFrame:
    """(model_id, crlf, cr, lf, ending): line ends of each model's bodies; CRLF where there is one, else CR where they are more than LF, else LF."""
    text = F.decode("body", "ISO-8859-1")
    crlf = F.length(text) - F.length(F.replace(text, F.lit("\r\n"), F.lit("\n")))
    cr = F.length(text) - F.length(F.replace(text, F.lit("\r"), F.lit("")))
    lf = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))
    sums = bodies.select("model_id", crlf.alias("crlf"), (cr - crlf).alias("cr"), (lf - crlf).alias("lf")).groupBy("model_id").agg(*(F.sum(c).cast("long").alias(c) for c in ("crlf", "cr", "lf")))
    return sums.withColumn("ending", F.when(F.col("crlf") > 0, "CRLF").when(F.col("cr") > F.col("lf"), "CR").otherwise("LF"))


def write_model(ngrams: DataFrame, path: str) -> None:
    """A model directory, a folder for each model."""
    ngrams.write.mode("overwrite").partitionBy("model_id").parquet(path)


def read_model(spark, path: str) -> DataFrame:
    """A model directory; its columns are checked."""
    found = spark.read.parquet(path)
    if not {"model_id", "n", "gram", "freq"} <= set(found.columns):
        raise ValueError(f"{path} is no n-gram model")
    return found
