"""Embedding near-duplicates by sorted projection passes.

Vectors that are equal are one, with a weight. In every pass the distinct ones
are ordered by the concatenated signs of random projections and each is compared
with a bounded window of its neighbours; pairs at the threshold, verified in
double precision, are united, and a block of the window hands on a spanning star
of each group, never the pairs.

A pass compares all pairs that agree in its first signs, as many as leave a
window's worth of vectors a group on average: where vectors lie so densely that
more than a window agree, they are taken out and compared in pairs of blocks.
So passes are as many as it takes for a pair at the very threshold to agree in
one of them with the stated probability, whatever the number and the density of
the vectors. The order is cut only where those first signs change, so results
don't depend on partitions either.

Links are then counted exactly among the members of each component, in blocks,
so that no window bounds the number of a vector's partners.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from .blocks import edges, in_blocks, parts, stars, streamed
from .common import few, staged
from .graph import components

COSINE = 0.9
WINDOW = 256
BITS = 62
#: least probability that a pair at the threshold is found by the passes
RECALL = 0.999
BLOCK = 2048
#: bytes of vectors (as doubles) in a block of a dense group, 8192 vectors at most
DENSE_BYTES = 16_000_000
#: how many groups of a window's size are sorted together
RANGE = 64
SEED = 23


def signs_for(count: int, window: int = WINDOW) -> int:
    """How many leading signs leave a window of vectors or less, on average, that agree in them."""
    return max(0, math.ceil(math.log2(max(count, 1) / window)))


def passes_for(count: int, cosine: float = COSINE, window: int = WINDOW, recall: float = RECALL) -> int:
    """How many passes make a pair of that cosine agree in the leading signs of one with that probability.

    Each sign agrees with probability 1 - angle / pi.
    """
    together = (1 - math.acos(cosine) / math.pi) ** signs_for(count, window)
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - together))) if together < 1 else 1


def usable(vector: Column) -> Column:
    """Whether a vector can link at all: there, all components finite, one of them not zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def _matrix(column, dim: int) -> np.ndarray:
    """Packed vectors of so many components, of 4 or 8 bytes, as doubles."""
    data = column.to_pylist()
    kind = "<f4" if data and len(data[0]) == 4 * dim else "<f8"
    return np.frombuffer(b"".join(data), dtype=kind).reshape(-1, dim).astype(np.float64)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _near(a: np.ndarray, b: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """The places of the pairs of unit vectors with that cosine or more, in double precision."""
    return np.nonzero(a @ b.T >= cosine)


def _codes(x: np.ndarray, turn: int, dim: int) -> np.ndarray:
    """The signs of a pass's projections, the first one most significant."""
    r = np.random.default_rng((SEED, turn, dim)).standard_normal((dim, BITS))
    signs = np.zeros((len(x), 64), dtype=bool)
    signs[:, 64 - BITS :] = x @ r > 0
    return np.packbits(signs, axis=1).view(">u8")[:, 0].astype(np.int64)


def _by_dim(batches, most: int = 1000):
    """(dim, unit vectors, rows) of parts of batches."""
    import pyarrow as pa

    for batch in batches:
        for at in range(0, len(batch), most):
            part = batch.slice(at, most)
            dims = part.column("dim").to_numpy()
            for dim in np.unique(dims).tolist():
                own = part.filter(pa.array(dims == dim))
                yield dim, _unit(_matrix(own.column("vector"), dim)), own


def window_links(distinct: DataFrame, passes: int, cosine: float = COSINE, window: int = WINDOW, signs: int | None = None) -> DataFrame:
    """Edges (a, b) that connect the pairs of (node, dim, vector) found in all passes.

    signs is how many leading signs are a group; pairs that agree in them are
    always compared.
    """
    import pyarrow as pa

    signs = signs_for(distinct.count(), window) if signs is None else signs
    rows = distinct.select("node", "dim", "vector")

    def sized(batches):
        for dim, x, _ in _by_dim(batches, 10_000):
            for k in range(passes):
                group, n = np.unique(_codes(x, k, dim) >> (BITS - signs), return_counts=True)
                dims, turns = np.full(len(n), dim, np.int32), np.full(len(n), k, np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in (dims, turns, group, n)], ["_dim", "_pass", "_group", "n"])

    def coded(batches):
        for dim, x, own in _by_dim(batches):
            for k in range(passes):
                code = _codes(x, k, dim)
                yield pa.RecordBatch.from_arrays([own.column("dim"), pa.array(np.full(len(own), k, np.int32)), pa.array(code >> (BITS - signs)), pa.array(code), own.column("node"), own.column("vector")], ["dim", "pass", "group", "code", "node", "vector"])

    def windows(batches):
        now, last_x, last_n = None, None, None
        for batch in batches:
            found = []
            for t in parts(batch, ["dim", "pass", "range"]):
                key = tuple(t.column(k)[0].as_py() for k in ("dim", "pass", "range"))
                x, n = _unit(_matrix(t.column("vector"), key[0])), t.column("node").to_numpy()
                if key == now:
                    x, n = np.concatenate([last_x, x]), np.concatenate([last_n, n])
                pairs = [(at + i, at + j) for at in range(0, len(x), window) for i, j in [_near(x[at : at + window], x[at : at + 2 * window], cosine)]]
                found.append(stars(n, pairs))
                now, last_x, last_n = key, x[-window:], n[-window:]
            yield edges(found)

    def blocks(batches):
        keys = ["dim", "pass", "group", "lo", "hi"]
        for table in streamed(batches, keys):
            found = []
            for t in parts(table, keys):
                x, block = _unit(_matrix(t.column("vector"), t.column("dim")[0].as_py())), t.column("block").to_numpy()
                left, right = np.flatnonzero(block == t.column("lo")[0].as_py()), np.flatnonzero(block == t.column("hi")[0].as_py())
                of_right = x[right]
                pairs = ((left[at + i], right[j]) for at in range(0, len(left), window) for i, j in [_near(x[left[at : at + window]], of_right, cosine)])
                found.append(stars(t.column("node").to_numpy(), pairs))
            yield edges(found)

    dense = rows.mapInArrow(sized, "_dim int, _pass int, _group long, n long").groupBy("_dim", "_pass", "_group").agg(F.sum("n").alias("_size")).where(F.col("_size") > window)
    dense = staged(dense, "dense-groups")
    made = rows.mapInArrow(coded, "dim int, pass int, group long, code long, node long, vector binary")
    thin, same = made, (F.col("dim") == F.col("_dim")) & (F.col("pass") == F.col("_pass")) & (F.col("group") == F.col("_group"))
    if dense.count():
        thin = made.join(few(dense), same, "left_anti")
    leading = max(0, signs - RANGE.bit_length() + 1)
    thin = thin.withColumn("range", F.shiftright("code", BITS - leading)).repartition("dim", "pass", "range").sortWithinPartitions("dim", "pass", "range", "code", "node")
    kind = "a long, b long"
    found = thin.select("dim", "pass", "range", "node", "vector").mapInArrow(windows, kind)
    if dense.count():
        most = F.greatest(F.lit(window), F.least(F.lit(8192), F.floor(F.lit(DENSE_BYTES) / 8 / F.col("dim"))))
        cut = in_blocks(made.join(few(dense), same), F.ceil(F.col("_size") / most).cast("int"), "node").select("dim", "pass", "group", "lo", "hi", "block", "node", "vector")
        cut = cut.repartition("dim", "pass", "group", "lo", "hi").sortWithinPartitions("dim", "pass", "group", "lo", "hi")
        found = found.union(cut.mapInArrow(blocks, kind))
    return found


def link_counts(members: DataFrame, cosine: float = COSINE, block: int = BLOCK) -> DataFrame:
    """(node, linked): by members (root, node, dim, vector, weight) the weight of all with that cosine within the root, the node's own included.

    A root's members are dealt into blocks; each pair of blocks is a task's
    group, and only counts leave it.
    """
    import pyarrow as pa

    sizes = members.groupBy(F.col("root").alias("_root")).agg(F.count("*").alias("_size"))
    dealt = (
        members.join(sizes, F.col("root") == F.col("_root"))
        .withColumn("_blocks", F.ceil(F.col("_size") / block).cast("int"))
        .withColumn("_block", F.pmod(F.xxhash64("node"), F.col("_blocks")).cast("int"))
        .withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
        .select("root", F.least("_block", "_other").alias("lo"), F.greatest("_block", "_other").alias("hi"), "_block", "node", "dim", "vector", "weight")
    )
    dealt = dealt.repartition("root", "lo", "hi").sortWithinPartitions("root", "lo", "hi")

    def counted(rows):
        dims = np.array([r[2] for r in rows])
        nodes, found = [], []
        for dim in np.unique(dims).tolist():
            own = [r for r in rows if r[2] == dim]
            x = _unit(_matrix(pa.array([r[3] for r in own], pa.binary()), dim))
            w = np.array([r[4] for r in own], dtype=np.int64)
            part = np.array([r[0] for r in own])
            one, two = rows[0][5]
            if one == two:
                near = x @ x.T >= cosine
                np.fill_diagonal(near, True)
                sums = near @ w
            else:
                left, right = part == one, part == two
                near = x[left] @ x[right].T >= cosine
                sums = np.zeros(len(own), dtype=np.int64)
                sums[left], sums[right] = near @ w[right], near.T @ w[left]
            nodes += [r[1] for r in own]
            found += sums.tolist()
        return nodes, found

    def run(batches):
        rows: list = []
        now = None
        nodes, found = [], []
        for b in batches:
            columns = [b.column(c).to_pylist() for c in ("root", "lo", "hi", "_block", "node", "dim", "vector", "weight")]
            for root, lo, hi, part, node, dim, vector, weight in zip(*columns):
                if (root, lo, hi) != now:
                    if rows:
                        n, f = counted(rows)
                        nodes += n
                        found += f
                    rows, now = [], (root, lo, hi)
                rows.append((part, node, dim, vector, weight, (lo, hi)))
            if len(nodes) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(found, pa.int64())], ["node", "linked"])
                nodes, found = [], []
        if rows:
            n, f = counted(rows)
            nodes += n
            found += f
        if nodes:
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(found, pa.int64())], ["node", "linked"])

    return dealt.mapInArrow(run, "node long, linked long").groupBy("node").agg(F.sum("linked").alias("linked"))


def _packed(rows: DataFrame) -> DataFrame:
    """vector (array) as bytes, beside vec_id and dim: of floats where it is of floats, else of doubles; equal values are equal bytes."""
    import pyarrow as pa

    form = "<f4" if isinstance(rows.schema["vector"].dataType.elementType, FloatType) else "<f8"

    def run(batches):
        for b in batches:
            flat = b.column("vector").flatten().to_numpy(zero_copy_only=False).astype(form) + np.dtype(form).type(0)
            ends = b.column("vector").offsets.to_numpy()
            ends = ends - ends[0]
            data = [flat[i:j].tobytes() for i, j in zip(ends[:-1].tolist(), ends[1:].tolist())]
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), pa.array(np.diff(ends).astype(np.int32)), pa.array(data, pa.binary())], ["vec_id", "dim", "vector"])

    kind = rows.schema["vec_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"vec_id {kind}, dim int, vector binary")


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, window: int = WINDOW, recall: float = RECALL) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row of vectors (vec_id, embedding).

    Vectors that are null, zero, or hold null or non-finite components link with
    nothing, and vectors of different lengths never link. Rows that repeat, or
    share an embedding, are linked to each other. A row with a null vec_id counts
    as a partner; a component is named by its smallest vec_id that isn't null,
    and kept is false where vec_id is null. Other columns are left out.
    """
    rows = vectors.select("vec_id", F.col("embedding").alias("vector"))
    good = staged(_packed(rows.where(usable(F.col("vector")))), "vectors")
    distinct = good.groupBy("dim", "vector").agg(F.min("vec_id").alias("least"), F.count("*").alias("weight"))
    distinct = staged(distinct.select(F.monotonically_increasing_id().alias("node"), "dim", "vector", "least", "weight"), "distinct-vectors")
    found = components(window_links(distinct, passes_for(distinct.count(), cosine, window, recall), cosine, window))
    roots = staged(found.select("id", "root").union(found.select(F.col("root"), F.col("root"))).distinct(), "roots")
    linked = distinct.join(roots, F.col("node") == F.col("id"), "left").select("node", "dim", "vector", "weight", "least", F.coalesce("root", "node").alias("root"), F.col("root").isNotNull().alias("in_group"))
    counts = link_counts(linked.where("in_group"), cosine).withColumnRenamed("node", "_node")
    least = linked.groupBy(F.col("root").alias("_root")).agg(F.min("least").alias("component_id"))
    named = (
        linked.join(least, F.col("root") == F.col("_root"))
        .join(counts, F.col("node") == F.col("_node"), "left")
        .select(F.col("vector").alias("_vector"), (F.coalesce("linked", "weight") - 1).alias("n_links"), "component_id")
    )
    of_good = good.join(named, F.col("vector") == F.col("_vector")).select("vec_id", "n_links", "component_id")
    of_rest = rows.where(~usable(F.col("vector"))).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return of_good.unionByName(of_rest).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
