"""SimHash fingerprints, and near-duplicate groups through BK-trees.

A fingerprint has a bit where most of a text's shingle hashes have it. Equal
fingerprints are grouped first. The distinct ones are dealt into shards by the
values of groups of their bits; a shard's fingerprints form a BK-tree, whose
children are keyed by their Hamming distance to the parent, and a search follows
only the edges within the radius. Two ways of dealing:

* grouped(): fingerprints of 64 bits at 3 bits or fewer. They are cut into
  pieces, of which 3 bits can spoil but three, so that no link is lost.
* similar(): shingle sets of a given Jaccard similarity. The fingerprints have as
  many bands as it takes for two such texts to share one with the stated
  probability, and the bands get longer with the number of texts, so that a
  shard stays small. What the trees find are candidates; links are decided by the
  shingle sets themselves.

The trees are not broadcast, as all of them together hold every fingerprint:
each is built and searched in the task that its shard is shuffled to. A shard
with more members than a task should hold is cut into blocks, and each pair of
blocks is a task's work. A shard hands on a spanning star for each of its
groups, never the pairs.
"""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .blocks import edges as edge_batch
from .blocks import in_blocks, parts, runs, stars, streamed
from .common import few, fresh, staged, text_slices
from .graph import components

SEED = 42
#: most members of a shard, and of a group of candidates, that are handled as one; more are cut into blocks of half as many
SHARD = 4096
MEMBERS = 512
#: bytes of shingle sets about which a block of candidates holds at most
MEMBER_BYTES = 8_000_000
#: bits beside the band by which the trees of similar() compare
CHECKED = 128
_MIX = 0x9E3779B97F4A7C15


def shingle_hashes(text: str | None, shingle: int) -> np.ndarray:
    """XXH64 (seed 42) of a text's shingles, repeats included; none without words.

    A-Z are lowered; words are split at space, tab to carriage return; a text of
    fewer words than a shingle is one.
    """
    import xxhash

    words = (text or "").encode().lower().split()
    if len(words) <= shingle:
        parts = [b" ".join(words)] if words else []
    else:
        parts = map(b" ".join, zip(*(words[i:] for i in range(shingle))))
    digest = xxhash.xxh64_intdigest
    return np.array([digest(s, SEED) for s in parts], dtype=np.uint64)


def fingerprint(text: str | None, shingle: int = 3, words64: int = 1) -> bytes:
    """The fingerprint of a text, most significant byte first; all zero without words."""
    return majority(shingle_hashes(text, shingle), words64)


def majority(hashes: np.ndarray, words64: int) -> bytes:
    """The bits that over half of the hashes have; beyond the first 64, of further hashes mixed from each."""
    with np.errstate(over="ignore"):
        turn = np.arange(1, words64, dtype=np.uint64) * np.uint64(_MIX)
    count = np.zeros(64 * words64, dtype=np.int64)
    for at in range(0, len(hashes), 255):  # so many add up in a byte
        h = hashes[at : at + 255, None]
        if words64 > 1:
            with np.errstate(over="ignore"):
                more = (h ^ turn) * np.uint64(0xBF58476D1CE4E5B9)
                more = (more ^ (more >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            h = np.concatenate([h, more ^ (more >> np.uint64(31))], axis=1)
        bits = np.unpackbits(h.astype(">u8").view(np.uint8), axis=1)
        count += np.add.reduce(bits, axis=0, dtype=np.uint8)
    return np.packbits(2 * count > len(hashes)).tobytes()


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """doc_id and fp (binary, 64 bits) of every row of docs; a null text counts as empty."""
    import pyarrow as pa

    def run(batches):
        for b in text_slices(batches, "text"):
            found = [fingerprint(t, shingle) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(found, pa.binary())], ["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, fp binary")


def shingle_sets(docs: DataFrame, shingle: int, words64: int) -> DataFrame:
    """doc_id, fp (binary) and shingles of every row of docs; fp is of the set, without repeats.

    shingles has the leading 32 bits of their hashes, distinct and sorted: two
    sets of n have n * n / 2^32 in common by chance, so that a similarity is off
    by n / 2^32, which is one in a million for texts of 4,000 words.
    """
    import pyarrow as pa

    def run(batches):
        for b in text_slices(batches, "text"):
            sets = [np.unique(shingle_hashes(t, shingle)) for t in b.column("text").to_pylist()]
            found = [majority(s, words64) for s in sets]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(found, pa.binary()), pa.array([np.unique(s >> np.uint64(32)).astype("<u4").tobytes() for s in sets], pa.binary())], ["doc_id", "fp", "shingles"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, fp binary, shingles binary")


def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(1, dtype=np.int64)


class BKForest:
    """BK-trees over rows of 64-bit words, one for each run of equal numbers in tree.

    All trees are built together, a level at a time: what is still on its way
    down takes the edge of its distance to the node where it is; the first of
    those that take a new edge becomes the child at its end.
    """

    WIDTH = 1024  # more than any distance

    def __init__(self, values: np.ndarray, tree: np.ndarray):
        self.values = values
        n = len(values)
        first = np.flatnonzero(np.r_[True, tree[1:] != tree[:-1]]) if n else np.zeros(0, np.int64)
        self.root = np.repeat(first, np.diff(np.r_[first, n]))
        at, todo = self.root.copy(), np.flatnonzero(self.root != np.arange(n))
        edges, ends = [], []
        while len(todo):
            edge = at[todo] * self.WIDTH + _distance(values[todo], values[at[todo]])
            new, where, which = np.unique(edge, return_index=True, return_inverse=True)
            child = todo[where]
            edges.append(new)
            ends.append(child)
            at[todo] = child[which]
            stays = np.ones(len(todo), dtype=bool)
            stays[where] = False
            todo = todo[stays]
        edges, ends = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (edges, ends))
        order = np.argsort(edges, kind="stable")
        self.edges, self.ends = edges[order], ends[order]

    def within(self, asked: np.ndarray, radius: int, most: int = 250_000):
        """Yields (asked, found): the places in the tree of each asked place, at radius or less, that come before it."""
        todo = [(asked, self.root[asked])]
        while todo:
            q, node = todo.pop()
            if len(q) > most:
                todo += [(q[i : i + most], node[i : i + most]) for i in range(0, len(q), most)]
                continue
            d = _distance(self.values[q], self.values[node])
            hit = (d <= radius) & (node < q)
            if hit.any():
                yield q[hit], node[hit]
            lo = np.searchsorted(self.edges, node * self.WIDTH + np.maximum(d - radius, 0))
            hi = np.searchsorted(self.edges, node * self.WIDTH + np.minimum(d + radius, self.WIDTH - 1), "right")
            many = hi - lo
            if many.any():
                starts = np.cumsum(many) - many
                place = np.arange(many.sum()) - np.repeat(starts - lo, many)
                todo.append((np.repeat(q, many), self.ends[place]))


def links(distinct: DataFrame, groups: list[list[int]], checked: list[int], radius: int, limit: int = SHARD) -> DataFrame:
    """Edges (a, b) that connect what is linked among (rep, fp), each fp once: within every shard a star a group.

    groups are the places of bits, 48 at most, whose value deals into shards;
    checked is the places, a multiple of 64, in which linked ones differ in
    radius bits or fewer. Shards are sorted and read as a stream. Those of more
    than limit members are dealt into blocks, and every pair of blocks is apart.
    """
    import pyarrow as pa

    words = len(checked) // 64
    names = [f"w{k}" for k in range(words)]

    def dealt(batches):
        for batch in batches:
            for at in range(0, len(batch), 2000):
                b = batch.slice(at, 2000)
                raw = b"".join(b.column("fp").to_pylist())
                bits = np.unpackbits(np.frombuffer(raw, np.uint8).reshape(len(b), -1), axis=1)
                # the places of all groups side by side, each in 64 bits
                wide = np.zeros((len(b), len(groups), 64), dtype=np.uint8)
                for k, g in enumerate(groups):
                    wide[:, k, 64 - len(g) :] = bits[:, g]
                key = np.ascontiguousarray(np.packbits(wide, axis=2)).view(">u8").astype(np.int64)[:, :, 0] + (np.arange(len(groups)) << 48)
                w = np.ascontiguousarray(np.packbits(bits[:, checked], axis=1)).view(">u8").astype(np.uint64).view(np.int64)
                rep = b.column("rep").to_numpy()
                columns = [key.ravel(), np.repeat(rep, len(groups)), *(np.repeat(w[:, k], len(groups)) for k in range(words))]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["shard", "rep", *names])

    kind = ", ".join(f"{c} long" for c in ["shard", "rep", *names])
    rows = distinct.select("rep", "fp").mapInArrow(dealt, kind)

    def search(table, keys):
        of = runs([table.column(k).to_numpy() for k in keys])
        many = np.bincount(of)[of] > 1
        of, rep = of[many], table.column("rep").to_numpy()[many]
        values = np.stack([table.column(c).to_numpy()[many] for c in names], 1).view(np.uint64)
        return stars(rep, BKForest(values, of).within(np.arange(len(of)), radius))

    def run(keys):
        def each(batches):
            for table in streamed(batches, keys):
                found = search(table, keys)
                if len(found[0]):
                    yield edge_batch([found])

        return each

    hot = staged(rows.groupBy(F.col("shard").alias("_shard")).agg(F.count("*").alias("_size")).where(F.col("_size") > limit), "hot-shards")
    whole = rows
    if hot.count():
        whole = rows.join(few(hot), F.col("shard") == F.col("_shard"), "left_anti")
    found = whole.repartition("shard").sortWithinPartitions("shard").mapInArrow(run(["shard"]), "a long, b long")
    if hot.count():
        cut = rows.join(few(hot), F.col("shard") == F.col("_shard"))
        cut = in_blocks(cut, F.ceil(F.col("_size") / (limit // 2)).cast("int"), "rep").select("shard", "lo", "hi", "rep", *names)
        cut = cut.repartition("shard", "lo", "hi").sortWithinPartitions("shard", "lo", "hi")
        found = found.union(cut.mapInArrow(run(["shard", "lo", "hi"]), "a long, b long"))
    return found


def _pieces(count: int, radius: int) -> list[list[int]]:
    """Groups of places of 64 bits: what differs in radius bits or fewer agrees in one of them. Longer ones for more fingerprints."""
    taken = 1 if count <= 1 << 26 else 2
    edges = np.linspace(0, 64, radius + taken + 1).astype(int)
    pieces = [list(range(lo, hi)) for lo, hi in zip(edges[:-1], edges[1:])]
    return [sum(c, []) for c in combinations(pieces, taken)]


def grouped(docs: DataFrame, *, shingle: int = 3, radius: int = 3) -> DataFrame:
    """doc_id, fp and component_id of every row of docs (doc_id, text).

    component_id is the smallest doc_id that links reach, the row's own included.
    Null and empty texts share the zero fingerprint, linked like any other. Rows
    with a null doc_id are given the component of their fingerprint's other rows,
    or null. Rows that repeat stay; other columns are left out.
    """
    prints = staged(fingerprints(docs, shingle), "fingerprints")
    distinct = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    distinct = staged(distinct.select(F.monotonically_increasing_id().alias("rep"), "fp", "least"), "distinct-fingerprints")
    found = components(links(distinct, _pieces(distinct.count(), radius), list(range(64)), radius))
    return _named(prints, distinct, found)


def _named(prints: DataFrame, distinct: DataFrame, found: DataFrame) -> DataFrame:
    """doc_id, fp and component_id of prints, by distinct (rep, fp, least) and found (id, root)."""
    rooted = distinct.join(found, F.col("rep") == F.col("id"), "left").select("fp", "least", F.coalesce("root", "rep").alias("root"))
    least = rooted.groupBy(F.col("root").alias("_root")).agg(F.min("least").alias("component_id"))
    named = rooted.join(least, F.col("root") == F.col("_root")).select(F.col("fp").alias("_fp"), "component_id")
    return prints.join(named, F.col("fp") == F.col("_fp")).select("doc_id", "fp", "component_id")


def hexadecimal(fp: Column) -> Column:
    return F.lower(F.hex(fp))


# ---- shingle sets of a similarity


def bands_for(count: int, similarity: float, recall: float) -> tuple[int, int]:
    """(bits of a band, bands) for so many texts.

    With shingle sets of Jaccard similarity J, a bit differs with probability
    arccos(2J/(1+J))/pi, 0.15 at 0.8; the bands are as many as it takes for one
    to agree with probability recall. A shard has 256 texts or so at most.
    """
    bits = max(16, math.ceil(math.log2(max(count, 1))) - 8)
    agree = (1 - math.acos(min(1.0, 2 * similarity / (1 + similarity))) / math.pi) ** bits
    return bits, max(1, math.ceil(math.log(1 - recall) / math.log(1 - agree))) if agree < 1 else 1


def radius_for(similarity: float, bits: int, deviations: float = 2.5) -> int:
    """The Hamming distance that so many bits exceed, at that similarity, as seldom as the deviations say."""
    p = math.acos(min(1.0, 2 * similarity / (1 + similarity))) / math.pi
    return math.ceil(bits * p + deviations * math.sqrt(bits * p * (1 - p)))


def alike(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, similarity: float):
    """Pairs (i, j) of the places left and right whose sets have that Jaccard similarity. Two empty sets have it."""
    sizes = np.array([len(s) for s in sets])
    flat = np.concatenate(sets) if len(sets) else np.zeros(0, np.uint32)
    owner = np.repeat(np.arange(len(sets)), sizes)
    _, column, count = np.unique(flat, return_inverse=True, return_counts=True)
    shared = count > 1
    number = np.cumsum(shared) - 1
    there = shared[column]
    owner, column = owner[there], number[column[there]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    common = np.zeros((len(left), len(right)), dtype=np.float32)
    row_left, row_right = np.full(len(sets), -1), np.full(len(sets), -1)
    row_left[left], row_right[right] = np.arange(len(left)), np.arange(len(right))
    columns = int(shared.sum())
    step = min(columns, max(64, 1_000_000 // max(len(sets), 1)))
    for at in range(0, columns, max(step, 1)):
        lo, hi = np.searchsorted(column, [at, at + step])
        own, col = owner[lo:hi], column[lo:hi] - at
        x, y = np.zeros((len(left), step), np.float32), np.zeros((len(right), step), np.float32)
        a, b = row_left[own], row_right[own]
        x[a[a >= 0], col[a >= 0]] = 1
        y[b[b >= 0], col[b >= 0]] = 1
        common += x @ y.T
    both = sizes[left][:, None] + sizes[right][None, :]
    i, j = np.nonzero(common >= similarity * (both - common))
    return left[i], right[j]


def alike_links(members: DataFrame, similarity: float, limit: int = MEMBERS, most_bytes: int = MEMBER_BYTES) -> DataFrame:
    """Edges (a, b) that connect those members (root, rep, shingles) of a root whose sets are that similar.

    First every member is held against its root's first one (the node that is
    the root), which takes one reading; those that are alike are connected by
    it. Of a root with more members than limit, or more bytes, these needn't be
    held against each other any more, only against the rest: members are dealt
    into blocks, and each pair of blocks in which some of the rest are is apart.
    """
    import pyarrow as pa

    sizes = members.groupBy(F.col("root").alias("_root")).agg(F.count("*").alias("_size"), F.sum(F.length("shingles")).alias("_bytes"))
    sizes = sizes.withColumn("_blocks", F.greatest(F.ceil(F.col("_size") / limit), F.ceil(F.col("_bytes") / most_bytes), F.lit(1)).cast("int"))
    sizes = staged(sizes, "candidate-groups")
    large = sizes.where("_blocks > 1")

    def sets_of(table):
        return [np.frombuffer(s, dtype="<u4") for s in table.column("shingles").to_pylist()]

    def small(batches):
        for table in streamed(batches, ["root"]):
            found = []
            for t in parts(table, ["root"]):
                here = np.arange(len(t))
                found.append(stars(t.column("rep").to_numpy(), [alike(sets_of(t), here, here, similarity)]))
            yield edge_batch(found)

    kind = "a long, b long"
    small_ones = members.join(few(large), F.col("root") == F.col("_root"), "left_anti") if large.count() else members
    edges = small_ones.select("root", "rep", "shingles").repartition("root").sortWithinPartitions("root").mapInArrow(small, kind)
    if not large.count():
        return edges

    def against_first(batches):
        first = now = None
        for b in batches:
            roots, places, reps = (b.column(c).to_pylist() for c in ("root", "part", "rep"))
            found = []
            for root, part, rep, s in zip(roots, places, reps, sets_of(b)):
                if (root, part) != now:
                    now, first = (root, part), s  # sorted, the first comes first
                common = len(np.intersect1d(first, s, assume_unique=True))
                found.append(bool(common >= similarity * (len(first) + len(s) - common)))
            yield pa.RecordBatch.from_arrays([b.column("root"), b.column("rep"), pa.array(found), b.column("turn")], ["root", "rep", "near", "turn"])

    inside = members.join(few(large), F.col("root") == F.col("_root"))
    others = inside.select("root", "rep", "shingles", F.pmod(F.xxhash64("rep"), F.col("_blocks")).cast("int").alias("part"), F.lit(1).alias("turn"))
    firsts = inside.where("rep = root").select("root", "rep", "shingles", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)).alias("part"), F.lit(0).alias("turn"))
    in_parts = others.unionByName(firsts).repartition("root", "part").sortWithinPartitions("root", "part", "turn")
    near = staged(in_parts.mapInArrow(against_first, "root long, rep long, near boolean, turn int").where("turn = 1").drop("turn"), "alike-first")
    edges = edges.union(near.where("near AND rep != root").select("rep", "root"))
    rest = staged(near.where("NOT near").groupBy(F.col("root").alias("_left")).agg(F.count("*").alias("_rest")), "unlike-first")
    if not rest.count():
        return edges

    # blocks 0.. are of the rest, the others of what is alike to the first; a pair needs one of the rest
    marked = inside.join(rest, F.col("root") == F.col("_left")).join(near.select(F.col("rep").alias("_rep"), "near"), F.col("rep") == F.col("_rep"))
    share = F.col("_rest") / F.col("_size")
    of_rest = F.greatest(F.ceil(F.col("_blocks") * share), F.lit(1)).cast("int")
    of_near = F.greatest(F.ceil(F.col("_blocks") * (1 - share)), F.lit(1)).cast("int")
    dealt = marked.withColumn("_of_rest", of_rest).withColumn(
        "block", F.when(F.col("near"), F.col("_of_rest") + F.pmod(F.xxhash64("rep"), of_near).cast("int")).otherwise(F.pmod(F.xxhash64("rep"), F.col("_of_rest")).cast("int"))
    )
    against = F.when(F.col("near"), F.sequence(F.lit(0), F.col("_of_rest") - 1)).otherwise(F.sequence(F.lit(0), F.col("_of_rest") + of_near - 1))
    dealt = dealt.withColumn("_other", F.explode(against)).select("root", F.least("block", "_other").alias("lo"), F.greatest("block", "_other").alias("hi"), "block", "rep", "shingles")

    def pairs(batches):
        for table in streamed(batches, ["root", "lo", "hi"]):
            found = []
            for t in parts(table, ["root", "lo", "hi"]):
                block, rep, sets = t.column("block").to_numpy(), t.column("rep").to_numpy(), sets_of(t)
                left, right = np.flatnonzero(block == t.column("lo")[0].as_py()), np.flatnonzero(block == t.column("hi")[0].as_py())
                found.append(stars(rep, [alike(sets, left, right, similarity)]))
            yield edge_batch(found)

    dealt = dealt.repartition("root", "lo", "hi").sortWithinPartitions("root", "lo", "hi")
    return edges.union(dealt.mapInArrow(pairs, kind))


def similar(docs: DataFrame, *, shingle: int = 5, similarity: float = 0.8, recall: float = 0.99) -> DataFrame:
    """doc_id and component_id of every row of docs (doc_id, text): the smallest doc_id that links reach.

    Two rows are linked if their sets of shingles have the similarity or more:
    none below is ever linked. Of pairs right at the similarity, the trees find
    each with probability recall times 0.99 or so, more of those above (README
    has figures). Texts without words are one group. Null doc_ids are as in grouped().
    """
    bits, bands = bands_for(docs.count(), similarity, recall)
    words64 = math.ceil(max(bits * bands, CHECKED) / 64)
    prints = shingle_sets(docs, shingle, words64).select(F.monotonically_increasing_id().alias("row"), "doc_id", "fp", "shingles")
    prints = staged(prints, "shingle-sets")
    # a fingerprint is known by the first row that has it
    distinct = staged(prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.min("row").alias("rep")), "distinct-fingerprints")
    groups = [list(range(k * bits, (k + 1) * bits)) for k in range(bands)]
    found = components(links(distinct, groups, list(range(CHECKED)), radius_for(similarity, CHECKED)))
    roots = staged(found.union(found.select(F.col("root"), F.col("root"))).distinct(), "candidates")
    members = prints.join(few(roots), F.col("row") == F.col("id")).select("root", F.col("row").alias("rep"), "shingles")
    sure = components(alike_links(members, similarity))
    return _named(prints.select("doc_id", "fp"), distinct, sure).drop("fp")


def deduplicated(docs: DataFrame, **options) -> DataFrame:
    """docs without near-duplicates: of each group the document with the smallest doc_id stays.

    Takes five words and a similarity of 0.8 (see similar()) unless options say
    otherwise. Empty and null texts are one group. Rows that share a doc_id stay
    or go together, equal texts among them once; rows with a null doc_id stay.
    """
    name, goes, repeats = (fresh(docs.columns, n) for n in ("doc_id_here", "doc_id_goes", "doc_id_repeats"))
    found = similar(docs, **options).where("doc_id IS NOT NULL")
    flags = found.groupBy("doc_id").agg((~F.bool_or(F.col("component_id") == F.col("doc_id"))).alias(goes), (F.count("*") > 1).alias(repeats))
    flags = staged(flags.where(F.col(goes) | F.col(repeats)).withColumnRenamed("doc_id", name), "doc-flags")
    kept = docs.join(few(flags), docs["doc_id"] == F.col(name), "left").where(~F.coalesce(F.col(goes), F.lit(False)))
    once = kept.where(~F.coalesce(F.col(repeats), F.lit(False))).select(docs.columns)
    more = kept.where(F.col(repeats)).select(docs.columns)
    return once.unionByName(more.dropDuplicates(["doc_id", "text"]))
