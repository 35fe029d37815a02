"""What operators on pairs share: sorted rows read as runs of a key, hot groups cut into blocks, links handed on as stars."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import released


def in_blocks(rows: DataFrame, blocks: Column, node: str) -> DataFrame:
    """rows, dealt by node into blocks and repeated for each pair of blocks (lo, hi) with their own, which is block."""
    return (
        rows.withColumn("_blocks", blocks)
        .withColumn("block", F.pmod(F.xxhash64(node), F.col("_blocks")).cast("int"))
        .withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
        .withColumn("lo", F.least("block", "_other"))
        .withColumn("hi", F.greatest("block", "_other"))
    )


def streamed(batches, keys: list[str]):
    """The rows of sorted batches as tables of whole runs of equal keys, so that no run is cut."""
    import pyarrow as pa

    held = []
    for b in batches:
        if not len(b):
            continue
        if held and any(held[-1].column(k)[-1].as_py() != b.column(k)[0].as_py() for k in keys):
            yield pa.Table.from_batches(held)
            held = []
        starts = np.flatnonzero(np.diff(runs([b.column(k).to_numpy() for k in keys]))) + 1
        if len(starts):
            cut = int(starts[-1])
            yield pa.Table.from_batches([*held, b.slice(0, cut)])
            held = [b.slice(cut)]
        else:
            held.append(b)
    if held:
        yield pa.Table.from_batches(held)
    released()


def runs(columns: list[np.ndarray]) -> np.ndarray:
    """A number for each run of rows that are equal in all columns."""
    new = np.zeros(max(len(columns[0]) - 1, 0), dtype=bool)
    for c in columns:
        new |= c[1:] != c[:-1]
    return np.r_[0, np.cumsum(new)] if len(columns[0]) else np.zeros(0, np.int64)


def parts(table, keys: list[str]):
    """The runs of a table of equal keys, each a table."""
    of = runs([table.column(k).to_numpy() for k in keys])
    bounds = np.flatnonzero(np.r_[True, of[1:] != of[:-1], True]) if len(of) else np.zeros(1, np.int64)
    for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        yield table.slice(lo, hi - lo)


def united(n: int, pairs) -> np.ndarray:
    """For each of n places the smallest one that the pairs (arrays a, b) connect it to."""
    label = np.arange(n)
    for a, b in pairs:
        while True:
            x, y = label[a], label[b]
            apart = x != y
            if not apart.any():
                break
            low, high = np.minimum(x, y)[apart], np.maximum(x, y)[apart]
            np.minimum.at(label, high, low)
            while True:
                further = label[label]
                if (further == label).all():
                    break
                label = further
    return label


def stars(ids: np.ndarray, pairs) -> tuple[np.ndarray, np.ndarray]:
    """Edges from the places that the pairs connect to one of their group."""
    label = united(len(ids), pairs)
    there = np.flatnonzero(label != np.arange(len(ids)))
    return ids[there], ids[label[there]]


def edges(found: list[tuple[np.ndarray, np.ndarray]]):
    """A batch (a, b) of lists of edges."""
    import pyarrow as pa

    a, b = (np.concatenate([np.zeros(0, np.int64), *(x[k] for x in found)]).astype(np.int64) for k in (0, 1))
    return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])
