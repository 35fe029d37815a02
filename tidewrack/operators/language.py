"""Which language some bytes are in: n-gram profiles as tables."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.native import byte_slices

SECOND_SHARE = 0.8


def profiles(ngrams: DataFrame, n: int = 3, top: int = 400) -> DataFrame:
    """(model_id, gram, p): each model's most frequent grams of n bytes with their share. top bounds a profile, whatever the corpus."""
    order = Window.partitionBy("model_id").orderBy(F.desc("freq"), "gram")
    total = F.sum("freq").over(Window.partitionBy("model_id"))
    return ngrams.where(F.col("n") == n).select("model_id", "gram", (F.col("freq") / total).alias("p"), F.row_number().over(order).alias("_rank")).where(F.col("_rank") <= top).drop("_rank")


def scores(samples: DataFrame, profile: DataFrame) -> DataFrame:
    """(id, model_id, score): cosine of a sample's gram counts (id, gram, freq) with each profile. The profile is small by its bound and broadcast."""
    norms = profile.groupBy("model_id").agg(F.sqrt(F.sum(F.col("p") ** 2)).alias("norm"))
    known = profile.select("gram").distinct()
    own = samples.join(F.broadcast(known), "gram", "left_semi")
    size = own.groupBy("id").agg(F.sqrt(F.sum(F.col("freq").cast("double") ** 2)).alias("size"))
    dots = own.join(F.broadcast(profile), "gram").groupBy("id", "model_id").agg(F.sum(F.col("freq") * F.col("p")).alias("dot"))
    return dots.join(size, "id").join(F.broadcast(norms), "model_id").select("id", "model_id", (F.col("dot") / (F.col("size") * F.col("norm"))).alias("score"))


def scores_in(bodies: DataFrame, profile: DataFrame) -> DataFrame:
    """scores of bodies (id, body; ids are unique) against profiles of grams of three bytes, each body in its task."""
    import pyarrow as pa

    table = profile.where("model_id IS NOT NULL").select("model_id", F.conv(F.hex("gram"), 16, 10).cast("long").alias("code"), "p").toPandas()
    models = sorted(table["model_id"].unique())
    codes = np.unique(table["code"].to_numpy(dtype=np.int64))
    shares = np.zeros((len(codes), len(models)))
    shares[np.searchsorted(codes, table["code"]), np.searchsorted(models, table["model_id"])] = table["p"]
    # which of codes a gram is, or their number
    place = np.full(1 << 24, len(codes), dtype=np.uint16 if len(codes) < 65535 else np.uint32)
    place[codes] = np.arange(len(codes))
    sent = bodies.sparkSession.sparkContext.broadcast((models, shares, place))
    kind = bodies.schema["id"].dataType.simpleString()

    def run(batches):
        models, shares, place = sent.value
        n, norms, used = len(shares), np.sqrt((shares**2).sum(0)), (shares > 0).astype(np.float64)
        for b in byte_slices(batches, "body"):
            texts = [x or b"" for x in b.column("body").to_pylist()]
            lengths = np.array([len(x) for x in texts], dtype=np.int64)
            data = np.frombuffer(b"".join(texts), dtype=np.uint8).astype(np.int32)
            of = np.repeat(np.arange(len(texts)), lengths)
            found = place[data[:-2] << 16 | data[1:-1] << 8 | data[2:]]
            kept = (found < n) & (of[:-2] == of[2:])
            key = of[:-2][kept] * n + found[kept]
            for lo in range(0, len(texts), 256):
                hi = min(len(texts), lo + 256)
                counts = np.bincount(key[slice(*np.searchsorted(key // n if n else key, (lo, hi)))] - lo * n, minlength=(hi - lo) * n).reshape(hi - lo, n).astype(np.float64)
                size = np.sqrt((counts**2).sum(1))
                row, model = np.nonzero(counts @ used)
                score = (counts @ shares)[row, model] / (size[row] * norms[model])
                yield pa.RecordBatch.from_arrays([b.column("id").take(pa.array(lo + row)), pa.array([models[m] for m in model.tolist()], pa.string()), pa.array(score)], ["id", "model_id", "score"])

    return bodies.select("id", "body").mapInArrow(run, f"id {kind}, model_id string, score double")


def best(scored: DataFrame) -> DataFrame:
    """(id, model_id, score): the best model of each id; ties go to the lower model_id."""
    order = Window.partitionBy("id").orderBy(F.desc("score"), "model_id")
    return scored.withColumn("_rank", F.row_number().over(order)).where("_rank = 1").drop("_rank")


def most_frequent(scored: DataFrame) -> DataFrame:
    """(model_id, total): over all samples the sum of scores that are 0.8 of their sample's best or more, best first."""
    top = F.max("score").over(Window.partitionBy("id"))
    return scored.withColumn("_top", top).where(F.col("score") >= SECOND_SHARE * F.col("_top")).groupBy("model_id").agg(F.sum("score").alias("total")).orderBy(F.desc("total"), "model_id")


def resolve_model(wanted: list[str], existing: DataFrame) -> DataFrame:
    """(model_id) of existing that comes first in wanted, a list in order of preference."""
    ranked = existing.select("model_id").distinct().withColumn("_rank", F.array_position(F.array(*map(F.lit, wanted)), F.col("model_id"))).where("_rank > 0")
    return ranked.agg(F.min_by("model_id", "_rank").alias("model_id"))


def with_fallback(language: str, encoding: str) -> list[str]:
    """The models to try for a language: its encoding's, then the UTF-8 one for ASCII, then any of the language."""
    names = [f"{language}-{encoding}"]
    if encoding.lower() == "ascii":
        names.append(f"{language}-utf8")
    return [*names, language]
