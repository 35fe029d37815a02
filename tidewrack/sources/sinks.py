"""What decoded cells are written as: text, text with error marks, HTML, listings, tables."""

from __future__ import annotations

import html as _html

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import cells as C
from ..functions.native import byte_slices

UNKNOWN = 0x3F


def _mapped(cells: DataFrame, name: str, spark_kind: str, make) -> DataFrame:
    import pyarrow as pa

    kind = pa.binary() if spark_kind == "binary" else pa.string()

    def run(batches):
        for b in byte_slices(batches, "cells"):
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array([make(C.unpack(p)) for p in b.column("cells").to_pylist()], kind)], ["id", name])

    return cells.select("id", "cells").mapInArrow(run, f"id {cells.schema['id'].dataType.simpleString()}, {name} {spark_kind}")


def plain_text(cells: DataFrame, unknown: int = UNKNOWN) -> DataFrame:
    """(id, body): the bytes, unknown ones as a mark."""
    return _mapped(cells, "body", "binary", lambda c: C.plain_text(c, unknown))


CLASS_NAMES = {0: "unk", 1: "wild", 20: "guess", 48: "recon", 63: "user", 64: "infer", 224: "lit"}


def _class_of(c: np.ndarray) -> np.ndarray:
    level = (c >> 16 & 0xFF).astype(np.int64)
    bounds = np.array([0, 1, 20, 48, 63, 64, 224])
    out = bounds[np.searchsorted(bounds, level, "right") - 1]
    out = np.where(C.is_known(c), out, 0)
    return np.where(C.is_marker(c), -1, out)


def html_text(c: np.ndarray) -> str:
    """Spans by class run, escaped; line ends become breaks, gaps a rule."""
    if not len(c):
        return ""
    kind = _class_of(c)
    edges = np.flatnonzero(np.r_[True, kind[1:] != kind[:-1], True])
    out = []
    for a, z in zip(edges[:-1].tolist(), edges[1:].tolist()):
        k = int(kind[a])
        if k == -1:
            out.append("<hr>" * (z - a))
            continue
        text = "?" * (z - a) if k == 0 else _html.escape((c[a:z] & 0xFF).astype(np.uint8).tobytes().decode("utf-8", "replace")).replace("\n", "<br>\n")
        out.append(text if k == 224 else f'<span class="{CLASS_NAMES[k]}">{text}</span>')
    return "".join(out)


STYLE = ".unk{background:#fcc}.wild{color:#c00}.guess{color:#c60}.recon{color:#060}.user{color:#06c}.infer{color:#609}"


def html(cells: DataFrame) -> DataFrame:
    """(id, html): a page for each span, its classes explained at the foot."""
    key = " ".join(f'<span class="{n}">{n}</span>' for n in CLASS_NAMES.values())
    page = lambda c: f'<!DOCTYPE html><html><head><meta charset="utf-8"><style>{STYLE}</style></head><body><p>{html_text(c)}</p><p>{key}</p></body></html>'
    return _mapped(cells, "html", "string", page)


def marked_text(cells: DataFrame, truth: DataFrame) -> DataFrame:
    """(id, body): the bytes with braces around stretches that differ from the truth (id, original), of the same length."""
    import pyarrow as pa

    def mark(c: np.ndarray, original: bytes) -> bytes:
        made = np.frombuffer(C.plain_text(c), dtype=np.uint8)
        there = np.frombuffer(original, dtype=np.uint8)
        n = min(len(made), len(there))
        wrong = np.r_[made[:n] != there[:n], np.ones(len(made) - n, bool)]
        edges = np.flatnonzero(np.r_[True, wrong[1:] != wrong[:-1], True]) if len(wrong) else np.zeros(1, int)
        return b"".join(b"{" + made[a:z].tobytes() + b"}" if wrong[a] else made[a:z].tobytes() for a, z in zip(edges[:-1].tolist(), edges[1:].tolist()))

    def run(batches):
        for b in byte_slices(batches, "cells"):
            out = [mark(C.unpack(p), t or b"") for p, t in zip(b.column("cells").to_pylist(), b.column("original").to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(out, pa.binary())], ["id", "body"])

    joined = cells.select("id", "cells").join(truth.select("id", "original"), "id")
    return joined.mapInArrow(run, f"id {cells.schema['id'].dataType.simpleString()}, body binary")


def class_counts(cells: DataFrame) -> DataFrame:
    """(id, class, n): positions by class."""
    import pyarrow as pa

    names = {-1: "Discontinuity", 0: "Unknown", 1: "WildGuess", 20: "Guessed", 48: "Reconstructed", 63: "UserSupplied", 64: "InferredLit", 224: "Literal"}

    def run(batches):
        for b in byte_slices(batches, "cells"):
            ids, kinds, counts = [], [], []
            for i, p in zip(b.column("id").to_pylist(), b.column("cells").to_pylist()):
                u, n = np.unique(_class_of(C.unpack(p)), return_counts=True)
                ids += [i] * len(u)
                kinds += [names[k] for k in u.tolist()]
                counts += n.tolist()
            yield pa.RecordBatch.from_arrays([pa.array(ids, b.column("id").type), pa.array(kinds, pa.string()), pa.array(counts, pa.int64())], ["id", "class", "n"])

    return cells.select("id", "cells").mapInArrow(run, f"id {cells.schema['id'].dataType.simpleString()}, class string, n long")


def write_cells(cells: DataFrame, path: str, mode: str = "error") -> None:
    cells.write.mode(mode).parquet(path)


def read_cells(spark, path: str) -> DataFrame:
    found = spark.read.parquet(path)
    if not {"id", "cells"} <= set(found.columns):
        raise ValueError(f"{path} holds no cells")
    return found


def discarded(df: DataFrame) -> None:
    """Runs everything that df needs and keeps nothing: to time or to check a recovery."""
    df.write.format("noop").mode("overwrite").save()


def with_messages(texts: DataFrame, messages: DataFrame) -> DataFrame:
    """(id, body) of texts with messages (id, pos, message) put in front of the bytes at pos, those of one place in their own order. A text has few messages."""
    lists = messages.groupBy(F.col("id").alias("_id")).agg(F.sort_array(F.collect_list(F.struct("pos", "message")), asc=False).alias("_m"))
    joined = texts.join(lists, F.col("id") == F.col("_id"), "left")
    put = F.expr("aggregate(coalesce(_m, array()), hex(body), (b, x) -> overlay(b PLACING hex(encode(x.message, 'UTF-8')) FROM cast(2 * x.pos + 1 AS int) FOR 0))")
    return joined.select("id", F.unhex(put).alias("body"))


def last_bytes(cells: DataFrame, n: int = 512) -> DataFrame:
    """(id, body): the last n cells of each span as text, what a detector's window begins with when decoding goes on."""
    tail = cells.select("id", F.expr(f"substring(cells, greatest(length(cells) - {4 * n}, 0) + 1, {4 * n})").alias("cells"))
    return plain_text(tail)


# ---- names of what is written


def settled_names(wanted: DataFrame, existing: DataFrame, policy: str = "error") -> DataFrame:
    """wanted (name, fallback, ...) with written_as, by what exists (name): policy error raises, force writes over it, fallback takes the other name."""
    if policy not in ("error", "force", "fallback"):
        raise ValueError(f"no policy {policy}")
    there = existing.select(F.col("name").alias("_name")).distinct()
    joined = wanted.join(there, F.col("name") == F.col("_name"), "left")
    if policy == "error" and not joined.where("_name IS NOT NULL").isEmpty():
        raise FileExistsError("members would overwrite what is there")
    other = F.col("fallback") if policy == "fallback" else F.col("name")
    return joined.withColumn("written_as", F.when(F.col("_name").isNull(), F.col("name")).otherwise(other)).drop("_name")


def output_name(name_hint: Column, base: Column, offset: Column, extension: str = "dat", junk_paths: bool = False, as_html: bool = False) -> Column:
    """A member's file: its own name (without folders if junk_paths), else base, offset and extension."""
    own = F.regexp_extract(name_hint, r"([^/\\]*)$", 1) if junk_paths else F.regexp_replace(name_hint, r"^/+|(?:^|/)\.\.(?=/|$)", "")
    plain = F.concat(base, F.lit("-"), F.lpad(F.hex(offset), 8, "0"), F.lit(f".{extension}"))
    named = F.when(F.length(F.coalesce(own, F.lit(""))) > 0, own).otherwise(plain)
    return F.concat(named, F.lit(".htm")) if as_html else named


def directory(pattern: str, path: Column, archive_no: Column) -> Column:
    """pattern with % replaced by a path's base name without extension, and the number of any archive but the first."""
    base = F.regexp_replace(F.regexp_extract(path, r"([^/\\]*)$", 1), r"\.[^.]*$", "")
    numbered = F.when(archive_no > 0, F.concat(base, F.lit("-"), archive_no.cast("string"))).otherwise(base)
    return F.replace(F.lit(pattern), F.lit("%"), numbered)
